"""The coverage rule, case by case. Every case is its own request, so one derivation answers all."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import wording as X
from tidemark.operators import coverage as V
from tidemark.sources.estate import Estate

DAY0 = datetime(2026, 1, 1)
ATT = (
    "att_id STRING, request STRING, asset STRING, version STRING, kind STRING, result STRING, materialization STRING, "
    "sole_producer INT, scope_kind STRING, scope_total INT, key_id STRING, attestor STRING, at TIMESTAMP, seq INT, "
    "signature_valid INT, retracted INT"
)


class World:
    def __init__(self):
        self.atts, self.ids, self.parts, self.inputs, self.lineage, self.reach, self.asked = [], [], [], [], [], [], []
        self.cases: dict[str, list] = {}

    def case(self, name, build, expect):
        self.cases[name] = expect
        build(Case(self, name))


class Case:
    """One request over customers, orders -> details -> summary, its assets named apart from others'."""

    def __init__(self, world, name, ids=("cust",)):
        self.w, self.name, self.n = world, name, 0
        self.set_ids(ids)
        for a in ("customers", "orders", "details", "summary"):
            world.reach.append((name, self.a(a), 0))
        self.edges(("details", "customers"), ("details", "orders"), ("summary", "details"))

    def a(self, asset):
        return f"urn:li:dataset:{self.name}.{asset}"

    def set_ids(self, ids):
        self.w.asked = [r for r in self.w.asked if r[0] != self.name] + [(self.name, i) for i in ids]
        self.all = list(ids)

    def edges(self, *pairs):
        mine = f"urn:li:dataset:{self.name}."
        self.w.lineage = [e for e in self.w.lineage if not e[0].startswith(mine)]
        self.w.lineage += [(self.a(d), self.a(u)) for d, u in pairs]

    def _add(self, asset, version, kind, day=None, sig=1, retracted=0, key="good", **kw):
        self.n += 1
        att = f"{self.name}/{self.n}"
        row = dict(result=None, materialization=None, sole_producer=None, scope_kind=None, scope_total=None) | kw
        at = DAY0 + timedelta(days=self.n if day is None else day)
        self.w.atts.append(
            (att, self.name, self.a(asset), version, kind, row["result"], row["materialization"], row["sole_producer"],
             row["scope_kind"], row["scope_total"], key, "team", at, self.n, sig, retracted)
        )
        return att

    def direct(self, asset, version="v1", result="absent", ids=None, parts=None, total=None, **kw):
        scope = {"scope_kind": "partitions", "scope_total": total} if parts is not None else {"scope_kind": "whole"}
        att = self._add(asset, version, "direct", result=result, **scope, **kw)
        self.w.ids += [(att, i) for i in (self.all if ids is None else ids)]
        self.w.parts += [(att, p) for p in parts or ()]

    def rebuild(self, asset, version="v1", inputs=(("customers", "v1"), ("orders", "v1")), how="full", sole=1, **kw):
        att = self._add(asset, version, "rebuild", materialization=how, sole_producer=sole, **kw)
        self.w.inputs += [(att, self.a(i), v) for i, v in inputs]


def grounded(c):
    c.direct("customers")
    c.direct("orders")


def build():
    w = World()

    def merge(c):
        grounded(c)
        c.rebuild("details", how="merge")

    w.case("merge", merge, [("details", "UNPROVEN", "not-total")])
    w.case("partitions", lambda c: c.direct("customers", parts=["a", "b", "c"], total=730), [("customers", "UNPROVEN", "partitions-uncovered:3/730")])
    w.case("silent", lambda c: None, [("customers", "UNPROVEN", "no-attestation")])

    def no_lineage(c):
        c.edges(("summary", "details"))
        grounded(c)
        c.rebuild("details")

    w.case("no_lineage", no_lineage, [("details", "UNPROVEN", "no-recorded-lineage")])

    def cycle(c):
        c.edges(("customers", "orders"), ("orders", "customers"))
        c.rebuild("customers", inputs=[("orders", "v1")])
        c.rebuild("orders", inputs=[("customers", "v1")])

    w.case("cycle", cycle, [("customers", "UNPROVEN", "unattested-input"), ("orders", "UNPROVEN", "unattested-input")])

    def two_writers(c):
        grounded(c)
        c.rebuild("details", sole=0)

    w.case("two_writers", two_writers, [("details", "UNPROVEN", "not-sole-producer")])

    def reopened(c):
        c.direct("customers", "v1")
        c.rebuild("customers", "v2", inputs=[], how="append")

    w.case("reopened", reopened, [("customers", "UNPROVEN", "attested-other-version:v1")])

    def full(c):
        grounded(c)
        c.rebuild("details")
        c.rebuild("summary", inputs=[("details", "v1")])

    w.case("full", full, [("details", "ATTESTED", None), ("customers", "ATTESTED", None), ("summary", "ATTESTED", None)])

    def present(c):
        c.direct("customers")
        c.direct("customers", result="present")

    w.case("present", present, [("customers", "CONTRADICTED", None)])

    def rolled_back(c):
        c.direct("customers", "v1")
        c.direct("customers", "v2", result="present")
        c.direct("customers", "v1")

    w.case("rolled_back", rolled_back, [("customers", "CONTRADICTED", None)])

    def answered(c):
        c.direct("customers", "v1", result="present")
        c.direct("customers", "v2")

    w.case("answered", answered, [("customers", "ATTESTED", None)])

    def unanswered(c):
        c.direct("customers", "v1", result="present")
        c.rebuild("customers", "v2", inputs=[], how="append")

    w.case("unanswered", unanswered, [("customers", "CONTRADICTED", None)])

    def superseded(c):
        grounded(c)
        c.rebuild("details")
        c.rebuild("customers", "v2", inputs=[], how="append")

    w.case("superseded", superseded, [("details", "ATTESTED", None), ("customers", "UNPROVEN", "not-total:append")])

    def backfilled(c):
        grounded(c)
        c.rebuild("details", inputs=[("customers", "v2"), ("orders", "v1")])

    w.case("backfilled", backfilled, [("details", "UNPROVEN", "unattested-input")])

    def retracted(c):
        c.direct("customers", retracted=1)
        c.direct("orders")
        c.rebuild("details")

    w.case("retracted", retracted, [("details", "UNPROVEN", "unattested-input")])

    def narrow(c):
        grounded(c)
        c.rebuild("details", inputs=[("customers", "v1")])

    w.case("narrow", narrow, [("details", "UNPROVEN", "closure-mismatch")])

    def wide(c):
        grounded(c)
        c.rebuild("details", inputs=[("customers", "v1"), ("orders", "v1"), ("extra", "v1")])

    w.case("wide", wide, [("details", "UNPROVEN", "unattested-input")])
    w.case("unsigned", lambda c: c.direct("customers", sig=0), [("customers", "UNPROVEN", "unverified-signature:team")])

    def unsigned_rebuild(c):
        grounded(c)
        c.rebuild("details", sig=0)

    w.case("unsigned_rebuild", unsigned_rebuild, [("details", "UNPROVEN", "unverified-signature:team")])

    def gap(c):
        c.set_ids(["cust", "hash"])
        c.direct("customers", ids=["cust"])

    w.case("gap", gap, [("customers", "UNPROVEN", "predicate-gap:hash")])

    def split(c):
        c.set_ids(["cust", "hash"])
        c.direct("customers", ids=["cust"])
        c.direct("customers", ids=["hash"], parts=["a"], total=730)

    w.case("split", split, [("customers", "UNPROVEN", "predicate-split:hash 1/730")])

    def composed(c):
        c.set_ids(["cust", "hash"])
        c.direct("customers", parts=["p1"], total=2)
        c.direct("customers", parts=["p2"], total=2)
        c.direct("orders", parts=["p1"], total=2)

    w.case("composed", composed, [("customers", "ATTESTED", None), ("orders", "UNPROVEN", "partitions-uncovered:1/2")])

    def compaction(c):
        grounded(c)
        c.rebuild("details", "v1")
        c.rebuild("details", "v2", inputs=[("details", "v1")])

    w.case("compaction", compaction, [("details", "ATTESTED", None)])

    def merged_compaction(c):
        grounded(c)
        c.rebuild("details", "v1")
        c.rebuild("details", "v2", inputs=[("details", "v1")], how="merge")

    w.case("merged_compaction", merged_compaction, [("details", "UNPROVEN", "not-total")])

    def mixed(c):
        grounded(c)
        c.rebuild("details", "v1")
        c.rebuild("details", "v2", inputs=[("details", "v1"), ("orders", "v1")])

    w.case("mixed", mixed, [("details", "UNPROVEN", "closure-mismatch")])
    w.case("floating", lambda c: c.rebuild("details", "v2", inputs=[("details", "v1")]), [("details", "UNPROVEN", "unattested-input")])
    w.case("own_version", lambda c: c.rebuild("details", "v1", inputs=[("details", "v1")]), [("details", "UNPROVEN", "closure-mismatch")])

    def chain(c):
        c.direct("details", "v1")
        for v in range(2, 40):
            c.rebuild("details", f"v{v}", inputs=[("details", f"v{v - 1}")])

    w.case("chain", chain, [("details", "ATTESTED", None)])

    def cut_chain(c):
        c.direct("details", "v1", retracted=1)
        for v in range(2, 20):
            c.rebuild("details", f"v{v}", inputs=[("details", f"v{v - 1}")])

    w.case("cut_chain", cut_chain, [("details", "UNPROVEN", "unattested-input")])

    def blocked_chain(c):
        c.direct("details", "v1")
        for v in range(2, 12):
            c.rebuild("details", f"v{v}", inputs=[("details", f"v{v - 1}")])
        c.direct("details", "v6", result="present", day=0)

    w.case("blocked_chain", blocked_chain, [("details", "CONTRADICTED", None)])

    def looped(c):
        c.rebuild("details", "v1", inputs=[("details", "v2")])
        c.rebuild("details", "v2", inputs=[("details", "v1")])

    w.case("looped", looped, [("details", "UNPROVEN", "unattested-input")])

    def bad_key(c):
        c.direct("customers", key="stolen")
        c.direct("orders")
        c.rebuild("details")

    w.case("bad_key", bad_key, [("details", "UNPROVEN", "unattested-input"), ("customers", "UNPROVEN", "no-attestation")])
    w.case("old_key", lambda c: c.direct("customers", key="old"), [("customers", "ATTESTED", None)])
    return w


WORLD = build()


@pytest.fixture(scope="module")
def derived(spark):
    w = WORLD
    make = spark.createDataFrame
    keys = [("good", "team", DAY0, "active", None), ("stolen", "team", DAY0, "compromised", DAY0), ("old", "team", DAY0, "retired", DAY0)]
    ev = V.Evidence(
        identifiers=make(w.asked, "request STRING, identifier STRING"),
        reached=make(w.reach, "request STRING, asset STRING, hop INT"),
        lineage=make(w.lineage, "downstream STRING, upstream STRING"),
        attestations=make(w.atts, ATT),
        att_identifiers=make(w.ids, "att_id STRING, identifier STRING"),
        att_partitions=make(w.parts, "att_id STRING, part_name STRING"),
        att_inputs=make(w.inputs, "att_id STRING, input_asset STRING, input_version STRING"),
        keys=make(keys, "key_id STRING, attestor STRING, not_before TIMESTAMP, state STRING, state_at TIMESTAMP"),
    )
    d = V.derive(ev)
    rows = {(r.request, r.asset.split(".")[-1]): r for r in V.states(d).collect()}
    residue: dict = {}
    for r in V.residue(d).orderBy("rank").collect():
        said = r.kind if r.detail is None else f"{r.kind}:{r.detail}"
        residue.setdefault((r.request, r.asset.split(".")[-1]), []).append(said)
    return d, rows, residue


@pytest.mark.parametrize("case", sorted(WORLD.cases))
def test_case(derived, case):
    _, rows, residue = derived
    for asset, state, why in WORLD.cases[case]:
        assert rows[case, asset].state == state, residue.get((case, asset))
        said = residue.get((case, asset), [])
        if why is None:
            assert said == [] or state == "CONTRADICTED"
        else:
            assert any(s == why or s.split(":")[0] == why for s in said), said


def test_every_unproven_asset_has_a_reason_and_only_given_assets_answer(derived):
    _, rows, residue = derived
    assert set(rows) == {(r, a.split(".")[-1]) for r, a, _ in WORLD.reach}
    for key, row in rows.items():
        assert (row.state == "UNPROVEN") == bool(residue.get(key)), key


def test_contradiction_names_the_version_it_was_found_in(derived):
    _, rows, _ = derived
    assert rows["rolled_back", "customers"].version == "v1"
    assert rows["rolled_back", "customers"].found_in == "v2"


def test_no_attestation_stands_alone(derived):
    _, _, residue = derived
    assert residue["silent", "customers"] == ["no-attestation"]


def test_summary_counts_and_obligations(derived):
    d, _, _ = derived
    got = {r.request: (r.total, r.attested, r.unproven, r.contradicted) for r in V.summary(V.states(d)).collect()}
    assert got["full"] == (4, 4, 0, 0)
    assert got["silent"] == (4, 0, 4, 0)
    work = V.obligations(V.states(d), V.residue(d)).filter("request = 'merge'").collect()
    assert {(r.asset.split(".")[-1], r.action) for r in work} == {("details", "physical-deletion"), ("summary", "direct-check")}


def test_pinned_sentences(spark):
    one = spark.range(1)
    partial = F.array(F.struct(F.lit("hash_9f2a").alias("identifier"), F.lit(1).alias("covered"), F.lit(730).alias("total")))
    names = F.array(F.lit("cust_88213"), F.lit("hash_9f2a"))
    said = one.select(
        X.explanation(F.lit("customers"), F.lit("v1"), F.lit("UNPROVEN"), X.split_sentence(names, partial), F.lit(None)).alias("a"),
        X.explanation(F.lit("customers"), F.lit("v1"), F.lit("UNPROVEN"), X.gap_sentence(F.array(F.lit("hash_9f2a"))), F.lit(None)).alias("b"),
    ).first()
    assert said.a == (
        "customers at version v1 is unattested: no single attestation searched for both cust_88213 and hash_9f2a, "
        "and hash_9f2a was searched over 1 of 730 partitions"
    )
    assert said.b == "customers at version v1 is unattested: nobody searched for hash_9f2a"


def test_every_residue_kind_has_words_that_do_not_name_it(spark):
    kinds = spark.createDataFrame([(k, "3/730") for k in V.RESIDUE_RANK], "kind STRING, detail STRING")
    for r in kinds.select("kind", X.residue_sentence(F.col("kind"), F.col("detail"), F.lit("customers")).alias("s")).collect():
        assert len(r.s) > 10 and r.kind not in r.s
        assert "clean" not in r.s and "%" not in r.s and "proof" not in r.s


def test_reach_honours_each_requests_own_bound(spark):
    from tidemark.operators.graph import reach

    name = lambda i: f"urn:li:dataset:n{i}"
    chain = spark.createDataFrame([(name(i), name(i + 1)) for i in range(8)], "upstream string, downstream string")
    seeds = spark.createDataFrame([(r, name(0)) for r in ("six", "one", "none", "absent")], "request string, asset string")
    hops = spark.createDataFrame([("six", 6), ("one", 1), ("none", None)], "request string, hops int")
    got = {r.request: r.far for r in reach(chain, seeds, hops).groupBy("request").agg({"hop": "max"}).toDF("request", "far").collect()}
    assert got == {"six": 6, "one": 1, "none": 3, "absent": 3}


def test_residue_of_one_kind_is_that_part_of_the_whole(derived):
    d = derived[0]
    whole = sorted(map(tuple, V.residue(d).collect()), key=str)
    assert len(whole) == len(set(whole))
    for kind in V.RESIDUE_RANK:
        assert sorted(map(tuple, V.residue(d, kind).collect()), key=str) == [r for r in whole if r[4] == kind]


def test_states_are_computed_once_for_a_derivation(derived):
    d = derived[0]
    assert V.states(d) is V.states(d)


def test_an_input_said_twice_is_one_input(spark):
    ev = V.Evidence(
        None, None, spark.createDataFrame([("urn:li:dataset:a", "urn:li:dataset:u")], "downstream STRING, upstream STRING"), None, None, None,
        spark.createDataFrame(
            [("twice", "urn:li:dataset:a", "v1")] * 2 + [("two", "urn:li:dataset:a", "v1"), ("two", "urn:li:dataset:a", None)],
            "att_id STRING, input_asset STRING, input_version STRING",
        ),
        None,
    )
    records = spark.createDataFrame(
        [(i, "r", "urn:li:dataset:a", "v2", "rebuild", "full", 1) for i in ("twice", "two", "none")],
        "att_id STRING, request STRING, asset STRING, version STRING, kind STRING, materialization STRING, sole_producer INT",
    )
    got = {r.att_id: (r.self_rebuild, r.closed) for r in V.rebuild_checks(records, ev).collect()}
    assert got == {"twice": (1, 0), "two": (0, 0), "none": (0, 0)}


def test_shared_views_are_read_from_what_was_written(spark, tmp_path):
    """Views made after `share` scan what it wrote, not the tables under it."""
    spark.createDataFrame([(1, "x", 0, -1.0, "m")], "c_custkey LONG, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING").write.parquet(f"{tmp_path}/customer.parquet")
    e = Estate(spark, str(tmp_path))
    e.share("requests")
    assert e.request_identifiers.count() == 2
    assert all("customer.parquet" not in f for f in e.request_identifiers.inputFiles())
