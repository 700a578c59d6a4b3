"""Names and sentences a person reads, as column expressions.

Sentences are data: patterns with slots, listed below. `say` fills one, `pick` the one that a state names.
"""

from __future__ import annotations

from collections.abc import Mapping
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE = "warehouse"
HOUSE = "urn:li:dataPlatform:lake"
BLANK = "··"

#: The sentences that readers of the reports already know, by state. A slot {n:one|many} is
#: the word that agrees with the number n.
MOVED = {
    "schema": "its columns changed",
    "content": "its rows changed",
    "both": "its columns and rows changed",
}
REASONS = {
    "direct": "read {table}, and {moved} after this finished{aside}",
    "noticed": "read {table}, and {moved} after this finished{aside}. Nothing reported that change; it was noticed when {reader} read the table",
    "observed": "read {table}, and {moved} after this finished{aside}. Nothing reported that change; an outside observer reported the table's contents",
    "inherited": "built on work from {via}, which is itself out of date because {table} changed",
}
RESTORED = "{label} redid {tables} and {n:it came|they came} out identical, so everything this was built on still stands"
EXPLANATIONS = {
    "ATTESTED": "{table} at version {version} is attested",
    "UNPROVEN": "{table} at version {version} is unattested: {why}",
    "CONTRADICTED": "{table} is contradicted: the subject was found in version {found}",
}
COVERED = "{attested} of {total} {total:asset|assets} covered, {unproven} unattested"
STILL_PRESENT = ", {contradicted} reported still present"
ASSURANCE = "Walked {hops} {hops:hop|hops} downstream, reached {assets} {assets:asset|assets}, built from {records} ledger {records:record|records}"
BOARDS = {
    "empty": "No agents set up yet.",
    "unstarted": "{total} {total:agent is|agents are} set up. None has finished, so nothing can be out of date yet.",
    "current": "{finished} of {total} {total:agent has|agents have} finished, and none of the tables {total:it|they} read has changed since.",
    "behind": "{stale} of {finished} finished {finished:agent|agents} {stale:is|are} out of date, because a table {stale:it|they} read changed afterwards.",
}
COMPLETIONS = {
    "same": "no outputs changed; nothing was marked stale ({took})",
    "alone": "nothing downstream had finished, so nothing was marked ({took})",
    "marked": "marked {n} finished task(s) stale in {took}",
}

#: What keeps an asset from being attested, by kind.
RESIDUE = {
    "no-attestation": "nobody has attested anything about {table}",
    "not-total": "the run that wrote it was a {detail}, which leaves earlier rows in place",
    "partitions-uncovered": "{covered} of {total} partitions are covered",
    "not-sole-producer": "more than one run contributed to this version of {table}",
    "no-recorded-lineage": "no upstream lineage is recorded for {table}, so a rebuild has nothing to be checked against",
    "closure-mismatch": "the rebuild did not declare {named}, which is recorded as feeding it",
    "unattested-input": "it was built from {input} at version {version}, which is unattested",
    "predicate-gap": "nobody searched for {detail}",
    "predicate-split": "no single attestation searched for every identifier; {detail} was searched on its own",
    "unverified-signature": "a record from {detail} could not be verified",
    "attested-other-version": "it was attested at version {detail} and has been written since",
}

#: Our own words, where no reader holds us to any.
LEFT_OUT = ", leaving {columns} aside, which {n:is|are} registered as different in every run"
NO_ASSETS = "No asset is recorded downstream of this request's seed tables."


def say(pattern: str, **slots: Column) -> Column:
    """`pattern` with its slots filled; null if a slot is."""
    parts = []
    for literal, slot, choice, _ in Formatter().parse(pattern):
        if literal:
            parts.append(F.lit(literal))
        if slot:
            one, _, many = choice.partition("|")
            parts.append(F.when(slots[slot] == 1, one).otherwise(many) if choice else slots[slot].cast("string"))
    return F.concat(*parts)


def pick(patterns: Mapping[str, str], state: Column, **slots: Column) -> Column:
    """The pattern that `state` names, filled; null for a state that has none."""
    return F.coalesce(*[F.when(state == name, say(pattern, **slots)) for name, pattern in patterns.items()])


def state_of(**conditions: Column) -> Column:
    """The name of the first condition that holds."""
    return F.coalesce(*[F.when(holds, name) for name, holds in conditions.items()])


# -- names -------------------------------------------------------------------------------------


def short_name(urn: Column) -> Column:
    """The last dotted part of a dataset URN's middle segment."""
    path = F.coalesce(F.get(F.split(urn, ","), F.lit(1)), urn)
    return F.element_at(F.split(path, r"\."), -1)


def task_name(urn: Column) -> Column:
    """The last comma segment of a nested URN without its closing brackets."""
    return F.regexp_replace(F.element_at(F.split(urn, ","), -1), r"\)+$", "")


def dataset_urn(name: Column, platform: str = HOUSE, space: str = NAMESPACE) -> Column:
    """A dataset URN; a name that brings its own namespace keeps it."""
    full = F.when(name.contains("."), name).otherwise(F.concat(F.lit(f"{space}."), name))
    return F.concat(F.lit(f"urn:li:dataset:({platform},"), full, F.lit(",PROD)"))


def task_urn(flow: Column, name: Column, platform: str = "spark") -> Column:
    """A job URN nested in its flow's."""
    return F.concat(F.lit(f"urn:li:dataJob:(urn:li:dataFlow:({platform},"), flow, F.lit(",PROD),"), name, F.lit(")"))


def words(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))


def table_label(urn: Column) -> Column:
    return words(short_name(urn))


def task_label(title: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), words(name))


def hop_label(hops: Column) -> Column:
    return say("{n} {n:hop|hops}", n=hops)


# -- staleness sentences -----------------------------------------------------------------------


def reason(
    hops: Column, caused_by: Column, kind: Column, unreported: Column, noticed_by: Column, via: Column, excluded: Column
) -> Column:
    """Why a task is out of date. `excluded` is the array of columns the comparison left out."""
    state = state_of(inherited=hops > 1, direct=~F.coalesce(unreported == 1, F.lit(False)), noticed=noticed_by.isNotNull(), observed=F.lit(True))
    count = F.coalesce(F.size(excluded), F.lit(0))
    aside = F.when(count > 0, say(LEFT_OUT, columns=F.array_join(F.array_sort(excluded), " and "), n=count)).otherwise("")
    moved = F.coalesce(pick(MOVED, kind), F.lit(MOVED["both"]))
    return pick(REASONS, state, table=table_label(caused_by), moved=moved, aside=aside, reader=noticed_by, via=F.coalesce(via, F.lit("an upstream task")))


def restored_reason(label: Column, tables: Column) -> Column:
    """Why a mark came off; `tables` is the array of dataset names that came back identical."""
    return say(RESTORED, label=label, tables=F.array_join(F.array_sort(F.transform(tables, table_label)), ", "), n=F.size(tables))


def duration(ms: Column) -> Column:
    """Milliseconds under a second, tenths of a second under a minute, minutes and seconds beyond."""
    seconds = F.round(ms / 1000).cast("long")
    tenths = F.round(ms.cast("decimal(20,3)") / 1000, 1).cast("decimal(20,1)")
    rest = F.lpad((seconds % 60).cast("string"), 2, "0")
    return (
        F.when(ms.isNull() | (ms < 0), BLANK)
        .when(ms < 1000, say("{n} ms", n=F.round(ms).cast("long")))
        .when(ms < 60_000, say("{n} s", n=tenths))
        .otherwise(say("{m} m {s} s", m=F.floor(seconds / 60), s=rest))
    )


# -- erasure sentences -------------------------------------------------------------------------


def residue_sentence(kind: Column, detail: Column, table: Column) -> Column:
    """One reason in words. `detail` is the residue row's own; kind codes never appear."""

    def part(mark: str, n: int) -> Column:
        return F.split_part(detail, F.lit(mark), F.lit(n))

    return pick(
        RESIDUE, kind, table=table, detail=detail, named=table_label(detail),
        covered=part("/", 1), total=part("/", 2), input=table_label(part("@", 1)), version=part("@", 2),
    )


def split_sentence(identifiers: Column, partial: Column) -> Column:
    """The split in one sentence: `partial` holds identifier, covered and total for each partial search."""
    names = F.array_join(identifiers, " and ")
    reached = F.transform(
        partial, lambda p: say("{name} was searched over {n} of {total} partitions", name=p["identifier"], n=p["covered"], total=p["total"])
    )
    tail = F.when(F.size(partial) > 0, say(", and {each}", each=F.array_join(reached, " and "))).otherwise("")
    every = F.when(F.size(identifiers) == 2, "both").otherwise("all of")
    return say("no single attestation searched for {every} {names}{tail}", every=every, names=names, tail=tail)


def gap_sentence(missing: Column) -> Column:
    return say(RESIDUE["predicate-gap"], detail=F.array_join(missing, " and "))


def explanation(table: Column, version: Column, state: Column, why: Column, found_in: Column) -> Column:
    return pick(EXPLANATIONS, state, table=table, version=version, why=why, found=found_in)


# -- lead lines --------------------------------------------------------------------------------


def coverage_line(total: Column, attested: Column, unproven: Column, contradicted: Column) -> Column:
    present = F.when(contradicted > 0, say(STILL_PRESENT, contradicted=contradicted)).otherwise("")
    counted = F.concat(say(COVERED, total=total, attested=attested, unproven=unproven), present)
    return F.when(total == 0, NO_ASSETS).otherwise(counted)


def assurance_line(hops: Column, assets: Column, records: Column) -> Column:
    return say(ASSURANCE, hops=hops, assets=assets, records=records)


def board_line(total: Column, finished: Column, stale: Column) -> Column:
    state = state_of(empty=total == 0, unstarted=finished == 0, current=stale == 0, behind=F.lit(True))
    return pick(BOARDS, state, total=total, finished=finished, stale=stale)


def completion_line(changed: Column, affected: Column, elapsed: Column) -> Column:
    took = F.coalesce(say("{ms} ms", ms=elapsed), F.lit("unreported"))
    return pick(COMPLETIONS, state_of(same=changed == 0, alone=affected == 0, marked=F.lit(True)), n=affected, took=took)
