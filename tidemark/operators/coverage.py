"""Erasure coverage: which (asset, version) carries evidence that a subject is absent.

State is keyed by (request, asset, version) and computed as a least fixpoint: nothing is attested
until a direct check says so, and a rebuild is promoted only when each of its inputs has been. All
requests advance together. Evidence is held as rows (identifiers, partitions and inputs each in
their own relation), so a record with a million inputs is a million rows and never one value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import DEFAULT_HOPS, lineage_edges
from tidemark.operators.iterate import EdgeIndex, grow
from tidemark.session import Scratch, materialize

NODE = ["request", "asset", "version"]
UNKNOWN_VERSION = "unknown"

#: The order residue is listed in, most fundamental first.
RESIDUE_RANK = {
    "predicate-gap": 1,
    "predicate-split": 2,
    "partitions-uncovered": 3,
    "not-sole-producer": 4,
    "not-total": 5,
    "no-recorded-lineage": 6,
    "closure-mismatch": 7,
    "unattested-input": 8,
    "attested-other-version": 9,
    "no-attestation": 10,
    "unverified-signature": 11,
}


@dataclass
class Evidence:
    """What a coverage job reads, as rows."""

    identifiers: DataFrame  # request, identifier
    reached: DataFrame  # request, asset, hop
    lineage: DataFrame  # downstream, upstream
    attestations: DataFrame  # att_id, request, asset, version, kind, result, ...
    att_identifiers: DataFrame  # att_id, identifier
    att_partitions: DataFrame  # att_id, part_name
    att_inputs: DataFrame  # att_id, input_asset, input_version
    keys: DataFrame  # key_id, attestor, not_before, state, state_at
    edges: DataFrame | None = None  # downstream, upstream: each table-level edge of lineage once, where it is written

    def table_edges(self) -> DataFrame:
        return lineage_edges(self.lineage).distinct() if self.edges is None else self.edges


# -- which records count -----------------------------------------------------------------------


def key_drops(attestations: DataFrame, keys: DataFrame) -> DataFrame:
    """Accepted records a change to the key registry invalidates; retiring a key drops nothing."""
    known = keys.select("key_id", "state", F.lit(1).alias("known"))
    reason = F.when(F.col("known").isNull(), "unknown-key").when(
        F.col("state") == "compromised", "key-compromised"
    )
    return (
        attestations.join(known, "key_id", "left")
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select("att_id", "request", "asset", "attestor", "reason")
    )


def standing(attestations: DataFrame, keys: DataFrame) -> DataFrame:
    sound = keys.filter(F.col("state") != "compromised").select("key_id")
    return attestations.join(sound, "key_id", "left_semi")


def usable(attestations: DataFrame, keys: DataFrame) -> DataFrame:
    """Verified, unretracted records under a sound key; only these can explain anything."""
    ok = (F.col("signature_valid") == 1) & (F.col("retracted") == 0)
    return standing(attestations, keys).filter(ok)


def current_versions(reached: DataFrame, attestations: DataFrame, keys: DataFrame) -> DataFrame:
    """The version a row is reported at: the one the latest record names, else unknown."""
    latest = standing(attestations, keys).groupBy("request", "asset").agg(
        F.max_by("version", F.struct("at", "seq")).alias("version")
    )
    return reached.select("request", "asset").distinct().join(latest, ["request", "asset"], "left").select(
        "request", "asset", F.coalesce("version", F.lit(UNKNOWN_VERSION)).alias("version")
    )


def node_set(ev: Evidence) -> DataFrame:
    """Every (asset, version) named by a record, by a declared input, or as a current version."""
    named = ev.attestations.select(*NODE)
    inputs = ev.att_inputs.join(ev.attestations.select("att_id", "request"), "att_id").select(
        "request", F.col("input_asset").alias("asset"), F.col("input_version").alias("version")
    )
    now = current_versions(ev.reached, ev.attestations, ev.keys)
    return named.union(inputs).union(now).distinct()


# -- direct checks -----------------------------------------------------------------------------


def searched_all(records: DataFrame, ev: Evidence) -> DataFrame:
    """Records that each looked for every identifier of their request."""
    size = ev.identifiers.groupBy("request").agg(F.countDistinct("identifier").alias("k"))
    hits = (
        records.select("att_id", "request")
        .join(ev.att_identifiers, "att_id")
        .join(ev.identifiers, ["request", "identifier"])
        .groupBy("att_id", "request")
        .agg(F.countDistinct("identifier").alias("found"))
    )
    whole = hits.join(size, "request").filter(F.col("found") == F.col("k")).select("att_id")
    return records.join(whole, "att_id", "left_semi")


def absent_checks(records: DataFrame) -> DataFrame:
    return records.filter((F.col("kind") == "direct") & (F.col("result") == "absent"))


def present_reports(records: DataFrame) -> DataFrame:
    return records.filter((F.col("kind") == "direct") & (F.col("result") == "present"))


def partition_cover(full_checks: DataFrame, ev: Evidence) -> DataFrame:
    """Per version, how many named partitions the full checks cover between them, of how many."""
    named = full_checks.filter(F.col("scope_kind") == "partitions").select("att_id", *NODE, "scope_total")
    total = named.groupBy(*NODE).agg(F.max("scope_total").cast("long").alias("total"))
    covered = (
        named.join(ev.att_partitions, "att_id")
        .groupBy(*NODE)
        .agg(F.countDistinct("part_name").alias("covered"))
    )
    return total.join(covered, NODE, "left").select(*NODE, F.coalesce("covered", F.lit(0)).alias("covered"), "total")


def direct_checks(records: DataFrame, ev: Evidence) -> DataFrame:
    """Versions a direct check explains: one whole-scope record, or partitions that add up."""
    full = searched_all(absent_checks(records), ev)
    whole = full.filter(F.col("scope_kind") == "whole").select(*NODE)
    parts = partition_cover(full, ev).filter(F.col("covered") >= F.col("total")).select(*NODE)
    return whole.union(parts).distinct()


# -- rebuilds ----------------------------------------------------------------------------------


def rebuild_checks(records: DataFrame, ev: Evidence) -> DataFrame:
    """Every rebuild record with the conditions that need no fixpoint, each as 1 or 0.

    A self-rebuild (one input: the same asset at another version) is not held to recorded lineage.
    """
    rebuilds = records.filter(F.col("kind") == "rebuild").select(
        "att_id", *NODE, "materialization", "sole_producer"
    )
    # One input, however often it is said, where the least is the greatest: nothing is shuffled to tell repeats.
    said = F.struct("input_asset", "input_version")
    declared = ev.att_inputs.groupBy("att_id").agg(F.min(said).alias("least"), F.max(said).alias("most")).select(
        "att_id",
        F.col("least").eqNullSafe(F.col("most")).alias("one_input"),
        F.col("least.input_asset").alias("one_asset"),
        F.col("least.input_version").alias("one_version"),
    )
    recorded = ev.table_edges().withColumnRenamed("downstream", "asset")
    has_lineage = recorded.select("asset").distinct().withColumn("recorded", F.lit(1))
    gaps = undeclared_upstreams(rebuilds, ev).groupBy("att_id").agg(F.count(F.lit(1)).alias("n_undeclared"))
    self_rebuild = (
        F.col("one_input")
        & (F.col("one_asset") == F.col("asset"))
        & (F.col("one_version") != F.col("version"))
    )
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return (
        rebuilds.join(declared, "att_id", "left")
        .join(has_lineage, "asset", "left")
        .join(gaps, "att_id", "left")
        .select(
            "att_id",
            *NODE,
            "materialization",
            flag(F.col("materialization") == "full").alias("total"),
            flag(F.col("sole_producer") == 1).alias("sole"),
            flag(self_rebuild).alias("self_rebuild"),
            flag(F.col("recorded") == 1).alias("recorded"),
            flag((F.col("recorded") == 1) & F.col("n_undeclared").isNull()).alias("closed"),
        )
    )


def undeclared_upstreams(rebuilds: DataFrame, ev: Evidence) -> DataFrame:
    """Upstreams the catalog records for a rebuilt asset that the record did not declare."""
    recorded = ev.table_edges().withColumnRenamed("downstream", "asset")
    said = ev.att_inputs.select("att_id", F.col("input_asset").alias("upstream"))
    return (
        rebuilds.select("att_id", *NODE)
        .join(recorded, "asset")
        .join(said, ["att_id", "upstream"], "left_anti")
    )


def sound_rebuilds(checked: DataFrame) -> DataFrame:
    ok = (
        (F.col("total") == 1)
        & (F.col("sole") == 1)
        & ((F.col("self_rebuild") == 1) | (F.col("closed") == 1))
    )
    return checked.filter(ok)


def chain_roots(steps: DataFrame) -> DataFrame:
    """The far end of every chain of self-rebuilds, by pointer doubling.

    `steps` is (request, asset, version, prior), one prior each. A chain of n versions takes about
    log2(n) rounds. A version whose pointer never leaves the chain is on a loop and is left out: no
    evidence outside it can reach it through its one prior.
    """
    scratch = Scratch(steps.sparkSession, "chains")
    pointers, rows = scratch.write(steps, "p0")
    limit = max(rows, 1).bit_length() + 1
    for n in range(1, limit + 1):
        far = pointers.select(
            "request", "asset", F.col("version").alias("prior"), F.col("prior").alias("farther")
        )
        on = ["request", "asset", "prior"]
        moving = pointers.join(far, on, "left_semi").limit(1).count() > 0
        if not moving:
            return pointers
        jumped = pointers.join(far, on, "left").select(*NODE, F.coalesce("farther", "prior").alias("prior"))
        pointers, _ = scratch.write(jumped, f"p{n}")
    looped = pointers.select("request", "asset", F.col("version").alias("prior"))
    return pointers.join(looped, ["request", "asset", "prior"], "left_anti")


def promote(grounded: DataFrame, sound: DataFrame, inputs: DataFrame, barred: DataFrame) -> DataFrame:
    """The least fixpoint: versions a direct check grounds, then rebuilds whose inputs all are.

    `barred` are versions a present report contradicts; they are never promoted. A version whose
    only explanation is one self-rebuild waits on the root of its chain instead of on its prior
    version, so ten thousand compactions cost a handful of rounds.
    """
    scratch = Scratch(sound.sparkSession, "promote")
    grounded, _ = scratch.write(grounded.join(barred, NODE, "left_anti").distinct(), "grounded")
    open_rebuilds = sound.join(barred, NODE, "left_anti").select(
        "att_id",
        "request",
        F.col("asset").alias("built"),
        F.col("version").alias("built_version"),
        "self_rebuild",
    )
    needs, _ = scratch.write(
        open_rebuilds.join(inputs, "att_id").select(
            *open_rebuilds.columns, F.col("input_asset").alias("asset"), F.col("input_version").alias("version")
        ),
        "needs",
    )
    built = [F.col("built").alias("asset"), F.col("built_version").alias("version")]
    chained = (
        needs.groupBy("request", "built", "built_version")
        .agg(
            F.countDistinct("att_id").alias("ways"),
            F.min("self_rebuild").alias("by_self"),
            F.min("att_id").alias("att_id"),
            F.min("version").alias("prior"),
        )
        .filter((F.col("ways") == 1) & (F.col("by_self") == 1))
        .select("att_id", "request", *built, "prior")
        .join(grounded, NODE, "left_anti")
    )
    chained, chains = scratch.write(chained, "chained")
    if chains:
        roots = chained.join(chain_roots(chained.select(*NODE, "prior")).withColumnRenamed("prior", "root"), NODE)
        needs = needs.join(roots.select("att_id", "root"), "att_id", "left").withColumn(
            "version", F.coalesce("root", "version")
        )
    needs, rows = scratch.write(
        needs.select("att_id", "request", "built", "built_version", "asset", "version").distinct(), "waits"
    )
    waiting = EdgeIndex(needs, NODE, ["att_id"], rows=rows)
    wanted = EdgeIndex(needs.select("att_id", *NODE), ["att_id"], NODE, rows=rows)

    def step(frontier: DataFrame, promoted: DataFrame, _n: int) -> DataFrame:
        touched = waiting.probe(frontier.select(*NODE)).select("att_id", "request", "built", "built_version").distinct()
        still_open = wanted.probe(touched.select("att_id")).join(promoted.select(*NODE), NODE, "left_anti")
        ready = touched.join(still_open.select("att_id"), "att_id", "left_anti")
        return ready.select("request", F.col("built").alias("asset"), F.col("built_version").alias("version")).distinct()

    promoted = grow(grounded, step, NODE, None, "promote")
    waiting.release()
    wanted.release()
    return promoted


# -- the report --------------------------------------------------------------------------------


@dataclass
class Derived:
    """One coverage derivation, its shared steps computed once."""

    ev: Evidence
    records: DataFrame
    checked: DataFrame
    attested: DataFrame
    current: DataFrame
    present: DataFrame
    stated: DataFrame | None = None  # what `states` found, once it was asked


def derive(ev: Evidence) -> Derived:
    records = materialize(usable(ev.attestations, ev.keys), "usable")
    present = present_reports(records).select(*NODE, "at")
    checked = materialize(rebuild_checks(records, ev), "checked")
    attested = promote(
        direct_checks(records, ev), sound_rebuilds(checked), ev.att_inputs, present.select(*NODE).distinct()
    )
    current = materialize(current_versions(ev.reached, ev.attestations, ev.keys), "current")
    return Derived(ev, records, checked, attested, current, present)


def first_mentions(d: Derived, nodes: DataFrame | None = None) -> DataFrame:
    """When each version was first heard of, as a record's own version or as a declared input.

    With `nodes`, only of these versions.
    """
    own = d.records.select(*NODE, "at")
    said = d.ev.att_inputs.select("att_id", F.col("input_asset").alias("asset"), F.col("input_version").alias("version"))
    if nodes is not None:
        said = said.join(nodes, ["asset", "version"], "left_semi")
    inputs = d.records.select("att_id", "request", "at").join(said, "att_id").select(*NODE, "at")
    if nodes is not None:
        own, inputs = own.join(nodes, NODE, "left_semi"), inputs.join(nodes, NODE, "left_semi")
    return own.union(inputs).groupBy(*NODE).agg(F.min("at").alias("first_at"))


def states(d: Derived) -> DataFrame:
    """Every reached asset's state at its reported version.

    A present report at another version still stands unless the reported version is attested and
    was first heard of after it. Computed once for a derivation.
    """
    if d.stated is None:
        d.stated = materialize(_states(d), "states")
    return d.stated


def _states(d: Derived) -> DataFrame:
    here = d.present.select(*NODE).distinct().withColumn("present_here", F.lit(1))
    attested = d.attested.select(*NODE).withColumn("attested", F.lit(1))
    elsewhere = materialize(
        d.current.join(
            d.present.select("request", "asset", F.col("version").alias("found_in"), F.col("at").alias("found_at")),
            ["request", "asset"],
        )
        .filter(F.col("found_in") != F.col("version"))
        .groupBy(*NODE)
        .agg(F.max(F.struct("found_at", "found_in")).alias("last"))
        .select(*NODE, F.col("last.found_at").alias("found_at"), F.col("last.found_in").alias("found_in")),
        "elsewhere",
    )
    answered = (F.col("attested") == 1) & (F.col("first_at") > F.col("found_at"))
    standing_elsewhere = F.col("found_in").isNotNull() & ~F.coalesce(answered, F.lit(False))
    return (
        d.current.join(here, NODE, "left")
        .join(attested, NODE, "left")
        .join(elsewhere.join(first_mentions(d, elsewhere.select(*NODE)), NODE, "left"), NODE, "left")
        .select(
            *NODE,
            F.when((F.col("present_here") == 1) | standing_elsewhere, "CONTRADICTED")
            .when(F.col("attested") == 1, "ATTESTED")
            .otherwise("UNPROVEN")
            .alias("state"),
            F.when(F.col("present_here") == 1, F.col("version"))
            .when(standing_elsewhere, F.col("found_in"))
            .alias("found_in"),
        )
    )


def _rows(df: DataFrame, kind: str, detail: Column) -> DataFrame:
    return df.select(*NODE, F.lit(RESIDUE_RANK[kind]).alias("rank"), F.lit(kind).alias("kind"), detail.alias("detail"))


def identifier_reach(d: Derived, nodes: DataFrame) -> DataFrame:
    """Per version and identifier, how far the checks that looked for it reached.

    `whole` is 1 where some check searched the whole version for it; `covered` of `total` is how
    many partitions the others named; `searched` is 0 where no check looked at all.
    """
    checks = absent_checks(d.records).join(nodes, NODE, "left_semi")
    per = checks.select("att_id", *NODE, "scope_kind", "scope_total").join(d.ev.att_identifiers, "att_id")
    reach = per.groupBy(*NODE, "identifier").agg(
        F.max((F.col("scope_kind") == "whole").cast("int")).alias("whole"),
        F.max("scope_total").alias("total"),
    )
    parts = (
        per.filter(F.col("scope_kind") == "partitions")
        .join(d.ev.att_partitions, "att_id")
        .groupBy(*NODE, "identifier")
        .agg(F.countDistinct("part_name").alias("covered"))
    )
    asked = checks.select(*NODE).distinct().join(d.ev.identifiers.distinct(), "request")
    key = [*NODE, "identifier"]
    return asked.join(reach, key, "left").join(parts, key, "left").select(
        *key,
        F.col("whole").isNotNull().cast("int").alias("searched"),
        F.coalesce("whole", F.lit(0)).alias("whole"),
        F.coalesce("covered", F.lit(0)).alias("covered"),
        "total",
    )


def residue(d: Derived, *kinds: str) -> DataFrame:
    """Why each unproven row is unproven: (request, asset, version, rank, kind, detail), a row a reason.

    With `kinds`, only reasons of these kinds, and only what they rest on is computed. A reason that
    several records give is one row; the other kinds have each row once by how they are found.
    """
    wanted = kinds or tuple(RESIDUE_RANK)
    asks = lambda *names: any(n in wanted for n in names)
    open_nodes = states(d).filter(F.col("state") == "UNPROVEN").select(*NODE)
    none = F.lit(None).cast("string")
    found = {}
    if asks("predicate-gap", "predicate-split"):
        reach = materialize(identifier_reach(d, open_nodes), "searched")
        gap = reach.filter(F.col("searched") == 0)
        found["predicate-gap"] = gap, F.col("identifier")
    if asks("predicate-split", "partitions-uncovered"):
        full = materialize(searched_all(absent_checks(d.records).join(open_nodes, NODE, "left_semi"), d.ev).select("att_id", *NODE, "scope_kind", "scope_total"), "full")
    if asks("predicate-split"):
        split = reach.join(gap.select(*NODE), NODE, "left_anti").join(full.select(*NODE), NODE, "left_anti")
        partly = F.concat("identifier", F.lit(" "), F.col("covered").cast("string"), F.lit("/"), F.col("total").cast("string"))
        found["predicate-split"] = split, F.when(F.col("whole") == 1, F.col("identifier")).otherwise(partly)
    if asks("partitions-uncovered"):
        parts = partition_cover(full, d.ev).join(full.filter("scope_kind = 'whole'").select(*NODE), NODE, "left_anti")
        found["partitions-uncovered"] = parts.filter("covered < total"), F.concat(F.col("covered").cast("string"), F.lit("/"), F.col("total").cast("string"))
    faults = d.checked.join(open_nodes, NODE, "left_semi")
    if asks("not-sole-producer", "not-total", "no-recorded-lineage", "closure-mismatch", "unattested-input"):
        faults = materialize(faults, "faults")
    held = faults.filter(F.col("self_rebuild") == 0)
    if asks("not-sole-producer"):
        found["not-sole-producer"] = faults.filter("sole = 0").select(*NODE).distinct(), none
    if asks("not-total"):
        found["not-total"] = faults.filter("total = 0").select(*NODE, "materialization").distinct(), F.col("materialization")
    if asks("no-recorded-lineage"):
        found["no-recorded-lineage"] = held.filter("recorded = 0").select(*NODE).distinct(), none
    if asks("closure-mismatch"):
        # A closed record has declared every upstream.
        gaps = undeclared_upstreams(held.filter("recorded = 1 AND closed = 0"), d.ev)
        found["closure-mismatch"] = gaps.select(*NODE, "upstream").distinct(), F.col("upstream")
    if asks("unattested-input"):
        inputs = faults.select("att_id", *NODE).join(d.ev.att_inputs, "att_id").select(*NODE, "input_asset", "input_version").distinct()
        unmet = inputs.join(
            d.attested.select("request", F.col("asset").alias("input_asset"), F.col("version").alias("input_version")),
            ["request", "input_asset", "input_version"],
            "left_anti",
        )
        found["unattested-input"] = unmet, F.concat("input_asset", F.lit("@"), "input_version")
    other = d.attested.select("request", "asset", F.col("version").alias("other")).join(open_nodes, ["request", "asset"]).filter(
        F.col("other") != F.col("version")
    )
    found["attested-other-version"] = other, F.col("other")
    if asks("no-attestation", "unverified-signature"):
        unsigned = standing(d.ev.attestations, d.ev.keys).filter("signature_valid = 0 AND retracted = 0").join(
            open_nodes, NODE, "left_semi"
        ).select(*NODE, "attestor").distinct()
        found["unverified-signature"] = unsigned, F.col("attestor")
        spoken = d.records.select(*NODE).union(unsigned.select(*NODE)).union(other.select(*NODE))
        found["no-attestation"] = open_nodes.join(spoken, NODE, "left_anti"), none
    rows = [_rows(found[kind][0], kind, found[kind][1]) for kind in wanted]
    everything = rows[0]
    for part in rows[1:]:
        everything = everything.unionByName(part)
    return everything


def summary(rows: DataFrame) -> DataFrame:
    """Counts against a total, never a percentage."""
    return rows.groupBy("request").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("state") == "ATTESTED").alias("attested"),
        F.count_if(F.col("state") == "UNPROVEN").alias("unproven"),
        F.count_if(F.col("state") == "CONTRADICTED").alias("contradicted"),
    )


def assurance(ev: Evidence, requests: DataFrame) -> DataFrame:
    """What the answer was built from: hops, assets, ledger records and records dropped for their key."""
    assets = ev.reached.groupBy("request").agg(F.countDistinct("asset").alias("assets_reached"))
    filed = ev.attestations.join(ev.reached.select("request", "asset"), ["request", "asset"], "left_semi")
    records = filed.groupBy("request").agg(F.count(F.lit(1)).alias("filed"))
    drops = key_drops(filed, ev.keys).groupBy("request").agg(F.count(F.lit(1)).alias("dropped"))
    return (
        requests.select("request", F.coalesce("hops", F.lit(DEFAULT_HOPS)).alias("hops_walked"))
        .join(assets, "request", "left")
        .join(records, "request", "left")
        .join(drops, "request", "left")
        .select(
            "request",
            "hops_walked",
            F.coalesce("assets_reached", F.lit(0)).alias("assets_reached"),
            (F.coalesce("filed", F.lit(0)) + 1).alias("evidence_records"),
            F.coalesce("dropped", F.lit(0)).alias("dropped_for_keys"),
        )
    )


#: The next step each kind of residue calls for.
NEXT_STEP = {
    "no-attestation": "direct-check",
    "attested-other-version": "direct-check",
    "unattested-input": "upstream-first",
    "not-total": "physical-deletion",
    "partitions-uncovered": "direct-check",
    "not-sole-producer": "direct-check",
    "no-recorded-lineage": "catalog-gap",
    "closure-mismatch": "redeclare-inputs",
    "predicate-gap": "direct-check",
    "predicate-split": "direct-check",
    "unverified-signature": "attestor-setup",
}

#: The order work is offered in.
STEP_PRIORITY = {
    "upstream-first": 0,
    "direct-check": 1,
    "redeclare-inputs": 2,
    "attestor-setup": 3,
    "physical-deletion": 4,
    "catalog-gap": 5,
    "unknown": 6,
}


def in_scope(assets: DataFrame, scopes: DataFrame, by: list[str]) -> DataFrame:
    """`assets` rows some scope of the same `by` admits: an exact name, or a prefix ending in `*`.

    Exact scopes are an equi-join. Prefix scopes are joined on the prefix itself, once per prefix
    length in use: the lengths are few and read from the scopes, so no pair is ever compared that
    does not already share its prefix.
    """
    exact = scopes.filter(~F.col("scope").endswith("*")).select(*by, F.col("scope").alias("asset"))
    prefixes = scopes.filter(F.col("scope").endswith("*")).select(
        *by, F.expr("left(scope, length(scope) - 1)").alias("prefix")
    )
    lengths = prefixes.select(*by, F.length("prefix").alias("len")).distinct()
    tried = assets.join(lengths, by).withColumn("prefix", F.expr("left(asset, len)"))
    columns = assets.columns
    by_prefix = tried.join(prefixes, [*by, "prefix"], "left_semi").select(*columns)
    return assets.join(exact, [*by, "asset"], "left_semi").select(*columns).union(by_prefix).distinct()


def obligations(rows: DataFrame, reasons: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """Every row not attested, with the next step its first reason calls for.

    `scopes` is (request, scope): what the caller can act on. Rows outside it stay and are marked.
    """
    first = reasons.groupBy(*NODE).agg(F.min_by("kind", "rank").alias("kind"))
    step = F.create_map(*[F.lit(x) for pair in NEXT_STEP.items() for x in pair])
    priority = F.create_map(*[F.lit(x) for pair in STEP_PRIORITY.items() for x in pair])
    work = (
        rows.filter(F.col("state") != "ATTESTED")
        .join(first, NODE, "left")
        .withColumn("action", F.coalesce(step[F.col("kind")], F.lit("unknown")))
        .withColumn("priority", priority[F.col("action")])
        .select(*NODE, "state", "action", "priority")
    )
    if scopes is None:
        return work.withColumn("in_scope", F.lit(1))
    inside = in_scope(work.select("request", "asset"), scopes, ["request"]).withColumn("inside", F.lit(1))
    return work.join(inside, ["request", "asset"], "left").withColumn(
        "in_scope", F.coalesce("inside", F.lit(0))
    ).drop("inside")


def census(reached: DataFrame, lineage: DataFrame) -> DataFrame:
    """Per request, how many reached assets can be cross-checked, are sources, or neither.

    Cross-checkable: upstream lineage is recorded. Source: only downstream is. Otherwise no edge
    names the asset and no rebuild claim about it can be held to anything.
    """
    edges = lineage_edges(lineage)
    fed = edges.select(F.col("downstream").alias("asset")).distinct().withColumn("fed", F.lit(1))
    feeds = edges.select(F.col("upstream").alias("asset")).distinct().withColumn("feeds", F.lit(1))
    word = F.when(F.col("fed") == 1, "cross-checkable").when(F.col("feeds") == 1, "source").otherwise("unattestable")
    return (
        reached.select("request", "asset")
        .join(fed, "asset", "left")
        .join(feeds, "asset", "left")
        .groupBy("request", word.alias("class"))
        .agg(F.count(F.lit(1)).alias("assets"))
    )


def redacted(identifiers: DataFrame) -> DataFrame:
    """Identifiers as their SHA-256 digests."""
    return identifiers.select("request", F.sha2("identifier", 256).alias("digest")).distinct()


def absence_check(
    df: DataFrame, columns: list[str], identifiers: DataFrame, partition: str | None = None
) -> DataFrame:
    """Rows of `df` naming any of the identifiers in any of `columns`, per partition when one is given.

    The check an attestor runs itself, in one pass: each column is looked up in the identifiers (a
    broadcast when their measured size allows, a shuffle when not) and a row counts once however
    many of its columns match.
    """
    by = [partition] if partition else []
    wanted = identifiers.select(F.col(identifiers.columns[0]).cast("string").alias("value")).distinct()
    looked = df.select(*by, *[F.col(c).cast("string").alias(f"_v{i}") for i, c in enumerate(columns)])
    hit = F.lit(False)
    for i in range(len(columns)):
        side = wanted.select(F.col("value").alias(f"_v{i}"), F.lit(True).alias(f"_h{i}"))
        looked = looked.join(side, f"_v{i}", "left")
        hit = hit | F.coalesce(f"_h{i}", F.lit(False))
    return looked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(hit).alias("matches")
    )
