"""Walks, marks, restorations and waves against small plain-Python readings of the same rules."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import board as B
from tidemark.operators import change as C
from tidemark.operators import graph as G
from tidemark.operators import iterate
from tidemark.operators import ledger as L
from tidemark.operators import staleness as S
from tidemark.functions.ranking import running_total

DAY = datetime(2026, 1, 1)


def random_board(seed: int, tables: int = 12, tasks: int = 14):
    """A board that may hold cycles, tables with several writers and tasks reading what they write."""
    rng = random.Random(seed)
    board = {}
    for i in range(tasks):
        name = f"t{i:02d}"
        board[name] = dict(
            reads=sorted({f"d{rng.randrange(tables):02d}" for _ in range(rng.randrange(0, 4))}),
            writes=list(dict.fromkeys(f"d{rng.randrange(tables):02d}" for _ in range(rng.randrange(1, 3)))),
            status=rng.choice(["complete", "stale", "stale", "complete", "running", "registered"]),
            finished=None if rng.random() < 0.1 else DAY + timedelta(days=rng.randrange(6)),
            causes=sorted({f"d{rng.randrange(tables):02d}" for _ in range(rng.randrange(0, 2))}),
            observed={f"d{rng.randrange(tables):02d}"} if rng.random() < 0.15 else set(),
        )
        if board[name]["status"] == "stale" and not board[name]["causes"]:
            board[name]["causes"] = [f"d{rng.randrange(tables):02d}"]
        if board[name]["status"] != "stale":
            board[name]["causes"] = []
    return board


SEEDS = range(12)
BOARDS = {f"f{seed}": random_board(seed) for seed in SEEDS}


@pytest.fixture(scope="module")
def world(spark):
    tasks, reads, writes, causes, fps = [], [], [], [], []
    for flow, board in BOARDS.items():
        for name, t in board.items():
            tasks.append((flow, name, t["status"], t["finished"]))
            reads += [(flow, name, d) for d in t["reads"]]
            writes += [(flow, name, d, i) for i, d in enumerate(t["writes"])]
            causes += [(flow, name, d, None, 1, "content", DAY) for d in t["causes"]]
            fps += [(flow, name, d, "observed", "s", "c") for d in t["observed"]]
    make = spark.createDataFrame
    return dict(
        tasks=make(tasks, "flow STRING, task STRING, status STRING, finished_at TIMESTAMP").cache(),
        reads=make(reads, "flow STRING, task STRING, dataset STRING").cache(),
        writes=make(writes, "flow STRING, task STRING, dataset STRING, ord INT").cache(),
        causes=make(causes, "flow STRING, task STRING, caused_by STRING, caused_by_task STRING, hops INT, kind STRING, since TIMESTAMP").cache(),
        fps=make(fps, "flow STRING, task STRING, dataset STRING, slot STRING, schema_fp STRING, content_fp STRING").cache(),
    )


def walk(board, origin, exclude=()):
    """One origin's reach: task -> (hops, dataset it was reached through)."""
    seen_data, seen, found, frontier, hops = {origin}, set(exclude), {}, [origin], 0
    while frontier:
        hops += 1
        following = []
        for dataset in frontier:
            for name in sorted(n for n, t in board.items() if dataset in t["reads"]):
                if name in seen or board[name]["status"] not in ("complete", "stale"):
                    continue
                seen.add(name)
                found[name] = (hops, dataset)
                for out in board[name]["writes"]:
                    if out not in seen_data:
                        seen_data.add(out)
                        following.append(out)
        frontier = following
    return found


@pytest.fixture(params=["few edges", "split edges"])
def layout(request, monkeypatch):
    """Every loop gives the same answer when its edges are held and their keys split."""
    if request.param == "split edges":
        monkeypatch.setattr(iterate, "HOT_KEY_EDGES", 1)


def test_cascade_matches_one_walk_per_change(spark, world, layout):
    changes = [(flow, f"d{i:02d}", "content", 0) for flow in BOARDS for i in (0, 3, 7)]
    excluded = [(flow, "t01") for flow in BOARDS]
    df = spark.createDataFrame(changes, "flow STRING, dataset STRING, kind STRING, unreported INT")
    out = spark.createDataFrame(excluded, "flow STRING, task STRING")
    got = S.affected_by(world["tasks"], world["reads"], world["writes"], df, out, first_via=True)
    have = {(r.flow, r.origin, r.task): (r.hops, r.via) for r in got.collect()}
    want = {
        (flow, origin, task): hit
        for flow, origin, _, _ in changes
        for task, hit in walk(BOARDS[flow], origin, ["t01"]).items()
    }
    assert have == want


def test_rerun_waves_and_cycles(world, layout):
    got = {(r.flow, r.task): r.wave for r in G.rerun_waves(world["tasks"], world["reads"], world["writes"]).collect()}
    want = {}
    for flow, board in BOARDS.items():
        flagged = [n for n, t in board.items() if t["status"] == "stale"]
        before = {
            n: {m for m in flagged if m != n and set(board[m]["writes"]) & set(board[n]["reads"])} for n in flagged
        }
        placed, wave, left = set(), 0, set(flagged)
        while left:
            ready = {n for n in left if before[n] <= placed}
            if not ready:
                break
            want.update({(flow, n): wave for n in ready})
            placed |= ready
            left -= ready
            wave += 1
        want.update({(flow, n): None for n in left})
    assert got == want
    assert None in want.values() and 1 in want.values()


def test_startable_ready_and_blocked(world):
    waves = G.rerun_waves(world["tasks"], world["reads"], world["writes"])
    start = {(r.flow, r.task) for r in G.startable_now(waves, world["tasks"], world["reads"], world["writes"]).collect()}
    ready = {(r.flow, r.task) for r in B.ready_to_start(world["tasks"], world["reads"], world["writes"]).collect()}
    first = {(r.flow, r.task) for r in waves.filter("wave = 0").collect()}
    done = ("complete", "stale")
    for flow, board in BOARDS.items():
        for name, t in board.items():
            writers = [n for n, o in board.items() if set(o["writes"]) & set(t["reads"])]
            settled = all(board[n]["status"] in done or n == name for n in writers)
            assert ((flow, name) in start) == ((flow, name) in first and settled)
            free = t["status"] == "registered" and all(board[n]["status"] in done for n in writers)
            assert ((flow, name) in ready) == free


def restored(board, finishing, unchanged, changed, exclude):
    if not board[finishing]["causes"] or not unchanged:
        return set()
    moved = {d for d in board[finishing]["writes"] if d not in unchanged} | set(changed)
    cleared: set = set()
    progressed = True
    while progressed:
        progressed = False
        for name, t in board.items():
            if t["status"] != "stale" or not t["causes"] or name == finishing or name in cleared or name in exclude:
                continue
            if t["finished"] is None:
                continue
            sound = True
            for d in t["reads"]:
                for w, o in board.items():
                    if d not in o["writes"]:
                        continue
                    ok = d not in moved and (w == finishing or w in cleared or o["status"] == "complete")
                    ok = ok and d not in o["observed"] and d not in t["causes"]
                    ok = ok and o["finished"] is not None and o["finished"] <= t["finished"]
                    sound = sound and ok
            if sound:
                cleared.add(name)
                progressed = True
    return cleared


def test_restorations_match_the_sequential_rule(spark, world):
    decisions, unchanged, changed, exclude, want = [], [], [], [], set()
    for flow, board in BOARDS.items():
        marked = [n for n, t in board.items() if t["causes"]]
        finishing = marked[0]
        same = board[finishing]["writes"][:1]
        decisions.append((flow, finishing))
        unchanged += [(flow, d) for d in same]
        changed.append((flow, "d11"))
        exclude.append((flow, marked[-1] if marked[-1] != finishing else "none"))
        want |= {(flow, n) for n in restored(board, finishing, same, ["d11"], [exclude[-1][1]])}
    make = spark.createDataFrame
    got = B.restored_by(
        world["tasks"],
        world["reads"],
        world["writes"],
        world["causes"],
        world["fps"],
        make(decisions, "flow STRING, finishing STRING"),
        make(unchanged, "flow STRING, dataset STRING"),
        make(changed, "flow STRING, dataset STRING"),
        make(exclude, "flow STRING, task STRING"),
    )
    assert {(r.flow, r.task) for r in got.collect()} == want
    assert want


def test_cascade_edges_light_only_marked_tasks(world):
    got = defaultdict(dict)
    for r in G.cascade_edges(world["reads"], world["writes"], world["causes"]).collect():
        got[r.flow, r.origin][r.src, r.dst] = r.hops
    for flow, board in BOARDS.items():
        for origin in {d for t in board.values() for d in t["causes"]}:
            marked = {n for n, t in board.items() if origin in t["causes"]}
            only = {n: {**t, "status": "stale" if n in marked else "running"} for n, t in board.items()}
            lit = {}
            for name, (_, via) in walk(only, origin).items():
                lit[via, name] = 1
                lit.update({(name, out): 1 for out in board[name]["writes"]})
            assert got[flow, origin] == lit


# -- hot keys ----------------------------------------------------------------------------------


def test_a_hot_table_is_split_and_nothing_is_lost(spark, monkeypatch):
    edges = spark.createDataFrame(
        [("hub", f"t{i}") for i in range(900)] + [(f"d{i}", f"u{i}") for i in range(300)], "dataset STRING, task STRING"
    )
    index = iterate.EdgeIndex(edges, ["dataset"], ["task"], hot=100)
    assert index.salted and index.held
    probe = spark.createDataFrame([("hub", "o1"), ("d5", "o1"), ("gone", "o2")], "dataset STRING, origin STRING")
    got = index.probe(probe).select("origin", "dataset", "task")
    assert got.count() == 901 and got.distinct().count() == 901
    per_part = index.edges.filter("dataset = 'hub'").groupBy(F.spark_partition_id()).count().collect()
    assert len(per_part) > 1
    index.release()


def test_running_total_over_one_key_holding_most_rows(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"),
        F.col("id").alias("seq"),
        (F.col("id") % 3).alias("v"),
    )
    got = {(r.k, r.seq): r.total for r in running_total(df, ["k"], ["seq"], F.col("v"), "total").collect()}
    running = defaultdict(int)
    for i in range(5000):
        k = "hot" if i % 10 < 8 else f"k{i % 7}"
        running[k] += i % 3
        assert got[k, i] == running[k]


# -- single rules ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("before", "after", "kind"),
    [
        (("s", "c"), ("s", "c"), None),
        ((None, None), ("s", "c"), None),
        (("s", "c"), ("x", "c"), "schema"),
        (("s", "c"), ("s", "x"), "content"),
        (("s", "c"), ("x", "x"), "both"),
    ],
)
def test_change_kind(spark, before, after, kind):
    parts = [F.lit(x).cast("string") for x in (*before, *after)]
    assert spark.range(1).select(C.change_kind(*parts)).first()[0] == kind


def test_column_change_is_null_when_unknown_or_equal(spark):
    sets = spark.createDataFrame(
        [(["a", "b"], ["b", "c"]), (["a", "b"], ["b", "a"]), (None, ["a"])], "b ARRAY<STRING>, a ARRAY<STRING>"
    )
    got = [r[0] for r in sets.select(C.column_change(F.col("b"), F.col("a"))).collect()]
    assert (got[0].added, got[0].removed) == (["c"], ["a"]) and got[1:] == [None, None]


def test_observation_verdict_order(spark):
    slots = [("current", "c1"), ("previous", "c0"), ("observed", "c2")]
    fps = spark.createDataFrame([("f", "w", "d", s, "s", c) for s, c in slots], "flow STRING, task STRING, dataset STRING, slot STRING, schema_fp STRING, content_fp STRING")
    seen = spark.createDataFrame([("f", f"r{c}", "d", "s", c) for c in ("c0", "c1", "c2", "c9")], "flow STRING, task STRING, dataset STRING, schema_fp STRING, content_fp STRING")
    want = {"rc2": "current", "rc1": "superseded-notice", "rc0": "superseded-report", "rc9": "unknown"}
    assert {r.task: r.verdict for r in C.resolve(seen, fps).collect()} == want
    assert {r.task: r.verdict for r in C.classify(seen, fps).collect()} == want
    assert {r.task for r in C.unreported_changes(seen, fps).collect()} == {"rc9"}


def test_merge_keeps_recorded_causes_and_lets_the_new_copy_win(spark):
    cols = "flow STRING, task STRING, caused_by STRING, caused_by_task STRING, hops INT, kind STRING"
    old = spark.createDataFrame([("f", "t", "a", None, 3, "schema"), ("f", "t", "b", "w", 1, "content")], cols)
    new = spark.createDataFrame([("f", "t", "a", None, 2, "both")], cols)
    merged = {r.caused_by: (r.hops, r.kind) for r in S.merge_causes(old, new).collect()}
    assert merged == {"a": (2, "both"), "b": (1, "content")}
    lead = S.merged_primary(S.merge_causes(old, new), S.primary_mark(new)).first()
    assert (lead.caused_by, lead.hops, lead.n_causes) == ("a", 2, 2)


def test_ledger_prefix_stops_at_the_first_gap(spark):
    rows = [("k", "a", 1), ("k", "a", 2), ("k", "a", 4), ("k", "b", 2), ("k", "c", 1)]
    got = L.read_prefix(spark.createDataFrame(rows, "kind STRING, ledger_key STRING, seq INT")).collect()
    assert {(r.ledger_key, r.seq) for r in got} == {("a", 1), ("a", 2), ("c", 1)}


def test_volatile_conflict_names_the_first(spark):
    cols = "flow STRING, task STRING, dataset STRING, column_name STRING"
    recorded = [("f", f"t{i}", "d2", "x") for i in range(5)] + [("f", "t7", "d2", "y"), ("f", "t9", "d3", "z")]
    declared = [("f", "t0", "d2", "x"), ("f", "t7", "d2", "y"), ("f", "t9", "d3", "z"), ("f", "t3", "d3", "w")]
    got = C.volatile_conflict(spark.createDataFrame(declared, cols), spark.createDataFrame(recorded, cols)).collect()
    assert {(r.task, r.dataset, r.other) for r in got} == {("t0", "d2", "t7"), ("t7", "d2", "t0"), ("t3", "d3", "t9")}


def test_the_nearest_origin_is_the_least_of_the_closest(spark):
    """A diamond: the task between two changes keeps the closer one, ties go to the smaller name."""
    edges = {"t1": ("b", "c"), "t2": ("a", "d"), "t3": ("c", "e"), "t4": ("d", "e"), "t5": ("e", "f"), "t6": ("z", "y")}
    make = spark.createDataFrame
    tasks = make([("f", t, "complete") for t in edges], "flow STRING, task STRING, status STRING")
    reads = make([("f", t, r) for t, (r, _) in edges.items()] + [("f", "t5", "c")], "flow STRING, task STRING, dataset STRING")
    writes = make([("f", t, w) for t, (_, w) in edges.items()], "flow STRING, task STRING, dataset STRING")
    changes = make([("f", "a"), ("f", "b")], "flow STRING, dataset STRING")
    got = {(r.task, r.hops, r.origin) for r in S.nearest_origin(tasks, reads, writes, changes).collect()}
    assert got == {("t1", 1, "b"), ("t2", 1, "a"), ("t3", 2, "b"), ("t4", 2, "a"), ("t5", 2, "b")}


def test_a_pipeline_without_an_order_is_an_error(spark):
    waves = spark.createDataFrame([("f", "a", 0), ("f", "b", None)], "flow STRING, task STRING, wave INT")
    assert G.complete_order(waves.filter("wave IS NOT NULL")).count() == 1
    with pytest.raises(ValueError, match="f/b"):
        G.complete_order(waves)
