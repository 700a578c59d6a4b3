"""Walks and orders over task and table lineage.

Edges are shuffled once by their probe key (`EdgeIndex`) and every hop shuffles only the newly
reached rows. All origins, boards and requests advance together: they are columns of the state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.iterate import EdgeIndex, grow
from tidemark.session import Scratch

FINISHED = ("complete", "stale")
DATASET_PREFIX = "urn:li:dataset:"
DEFAULT_HOPS = 3


# -- joins every derivation shares -------------------------------------------------------------


def producers_of(writes: DataFrame) -> DataFrame:
    """How many tasks write each dataset, and the one to name when there is exactly one."""
    return writes.groupBy("flow", "dataset").agg(
        F.count(F.lit(1)).alias("writers"), F.min("task").alias("first_writer")
    )


def sole_producer(writes: DataFrame) -> DataFrame:
    """The producer to name, or nobody when the dataset has several."""
    return producers_of(writes).select(
        "flow",
        "dataset",
        F.when(F.col("writers") == 1, F.col("first_writer")).alias("producer"),
    )


def readers_of(reads: DataFrame, datasets: DataFrame) -> DataFrame:
    return datasets.join(reads, ["flow", "dataset"])


def external_inputs(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Inputs that nothing on the board produces."""
    wanted = reads.select("flow", "dataset").distinct()
    return wanted.join(writes.select("flow", "dataset"), ["flow", "dataset"], "left_anti")


def every_writer(
    reads: DataFrame, writes: DataFrame, tasks: DataFrame, holds: Column, when_none: bool, but_self: bool = False
) -> DataFrame:
    """Per read, whether `holds` (over `status`) is true of every task writing the table.

    The writers are reduced to one row per table before the reads meet them, so a table with many
    writers and many readers costs their sum and not their product. A read nobody writes answers
    `when_none`, because "every" over nothing has to be decided, not left null. With `but_self` the
    reader's own failing does not count against it.
    """
    fails = ~F.coalesce(holds, F.lit(False))
    failing = (
        writes.join(tasks.select("flow", "task", "status"), ["flow", "task"])
        .groupBy("flow", "dataset")
        .agg(F.count_if(fails).alias("failing"), F.min(F.when(fails, F.col("task"))).alias("one_failing"))
    )
    clear = F.col("failing") == 0
    if but_self:
        clear = clear | ((F.col("failing") == 1) & (F.col("one_failing") == F.col("task")))
    return reads.join(failing, ["flow", "dataset"], "left").select(
        "flow", "task", "dataset", F.when(F.col("failing").isNull(), F.lit(when_none)).otherwise(clear).alias("met")
    )


# -- walks over tasks and datasets ------------------------------------------------------------


def task_walk(
    reads: DataFrame,
    writes: DataFrame,
    origins: DataFrame,
    part: Sequence[str] = (),
    max_hops: int | None = None,
    first_via: bool = False,
) -> DataFrame:
    """Tasks reached from each origin dataset, once, at the shortest hop.

    `origins` holds `part` columns and `origin`. With `first_via` the dataset through which the
    task was first reached is kept as `via`: first in walk order, where a dataset's place is the
    path (task and output position) that first led to it. Paths are compared as arrays inside a
    `min` aggregate, so no frontier is ever sorted as a whole.
    """
    part = list(part)
    read_index = EdgeIndex(reads.select(*part, "dataset", "task"), [*part, "dataset"], ["task"])
    write_columns = [*part, "task", "dataset"] + (["ord"] if first_via else [])
    write_index = EdgeIndex(writes.select(*write_columns), [*part, "task"], ["dataset"])
    keys = [*part, "origin", "task"]
    step_type = "array<struct<task:string,ord:int>>"

    def readers(datasets: DataFrame) -> DataFrame:
        found = read_index.probe(datasets)
        if not first_via:
            return found.select(*keys).distinct()
        return found.groupBy(*keys).agg(F.min(F.struct("path", "dataset")).alias("best")).select(
            *keys,
            F.col("best.dataset").alias("via"),
            F.col("best.path").alias("path"),
        )

    def outputs(tasks: DataFrame) -> DataFrame:
        found = write_index.probe(tasks)
        by = [*part, "origin", "dataset"]
        if not first_via:
            return found.select(*by).distinct()
        entry = F.array(F.struct(F.col("task"), F.col("ord").cast("int").alias("ord")))
        return found.groupBy(*by).agg(F.min(F.concat("path", entry)).alias("path"))

    start = origins.select(*part, "origin").distinct().withColumn("dataset", F.col("origin"))
    if first_via:
        start = start.withColumn("path", F.array().cast(step_type))
    seed = readers(start)
    reached = grow(
        seed, lambda frontier, _seen, _n: readers(outputs(frontier)), keys, max_hops, "walk", first=1
    )
    read_index.release()
    write_index.release()
    kept = [*keys, F.col("round").alias("hops")] + (["via"] if first_via else [])
    return reached.select(*kept)


def lineage_edges(lineage: DataFrame) -> DataFrame:
    """Table-level edges only; column edges live in the same relation and are left out at the scan."""
    return lineage.filter(
        F.col("downstream").startswith(DATASET_PREFIX) & F.col("upstream").startswith(DATASET_PREFIX)
    ).select("downstream", "upstream")


def table_edges(lineage: DataFrame) -> tuple[DataFrame, int]:
    """The different table-level edges written once, with their number."""
    return Scratch(lineage.sparkSession, "lineage").write(lineage_edges(lineage).distinct(), "edges")


def reach(
    lineage: DataFrame,
    seeds: DataFrame,
    hops: DataFrame | None = None,
    max_hops: int = DEFAULT_HOPS,
    edges: tuple[DataFrame, int] | None = None,
) -> DataFrame:
    """Assets downstream of each request's seeds within its hop bound, seeds at hop 0.

    `seeds` is (request, asset); `hops`, when given, is (request, hops) and bounds each request on
    its own. `max_hops` bounds the requests that state no bound. `edges` is what `table_edges` made
    of `lineage`, where others need it too.
    """
    found, rows = edges or table_edges(lineage)
    index = EdgeIndex(found.select(F.col("upstream").alias("asset"), F.col("downstream").alias("next")), ["asset"], ["next"], rows=rows)
    seed = seeds.select("request", "asset").distinct().withColumn("bound", F.lit(max_hops))
    if hops is not None:
        stated = hops.groupBy("request").agg(F.max("hops").alias("stated"))
        seed = seed.join(stated, "request", "left").withColumn("bound", F.coalesce("stated", "bound")).drop("stated")
    bound = ["request", "asset", "bound"]

    # A request stops at its own bound, so the loop ends when the widest one has.
    def step(frontier: DataFrame, _seen: DataFrame, n: int) -> DataFrame:
        found = index.probe(frontier.filter(F.col("bound") >= n).select(*bound)).drop("asset")
        return found.withColumnRenamed("next", "asset").select(*bound).distinct()

    found = grow(seed, step, ["request", "asset"], None, "reach")
    index.release()
    return found.select("request", "asset", F.col("round").alias("hop"))


def recorded_upstreams(reached: DataFrame, lineage: DataFrame) -> DataFrame:
    """Every upstream the catalog records for a reached asset, inside the walk or not; rows, not lists."""
    assets = reached.select("asset").distinct()
    edges = lineage_edges(lineage).distinct().withColumnRenamed("downstream", "asset")
    return assets.join(edges, "asset", "left")


def unknown_seeds(seeds: DataFrame, entities: DataFrame, lineage: DataFrame) -> DataFrame:
    """Seeds that are neither a known entity nor either end of any edge."""
    known = (
        entities.select("asset")
        .union(lineage.select("downstream"))
        .union(lineage.select("upstream"))
        .distinct()
    )
    return seeds.join(known, "asset", "left_anti")


def neighbours(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Immediate neighbours of every task and dataset: what it takes in and what it gives out."""
    read = reads.select("flow", F.col("dataset").alias("src"), F.col("task").alias("dst"))
    wrote = writes.select("flow", F.col("task").alias("src"), F.col("dataset").alias("dst"))
    edges = read.unionByName(wrote).distinct()
    outward = edges.select("flow", F.col("src").alias("node"), F.col("dst").alias("neighbour"), F.lit("out").alias("side"))
    inward = edges.select("flow", F.col("dst").alias("node"), F.col("src").alias("neighbour"), F.lit("in").alias("side"))
    return outward.unionByName(inward)


# -- orders ------------------------------------------------------------------------------------


def waits_for(
    nodes: DataFrame, reads: DataFrame, writes: DataFrame, last_writer: bool = False
) -> tuple[DataFrame, DataFrame]:
    """What each of `nodes` waits on, and who feeds it: (flow, task, gate) and (flow, gate, task).

    A gate is a table that some node writes. Going through it keeps a table with many writers and
    many readers at their sum. A task that reads a table it also writes does not wait for itself: it
    gets a gate of its own, fed by the other writers. When two such tasks share a table they wait
    for each other anyway, so the table's own gate says the same without a gate per task.
    With `last_writer` only the last writer of a table in name order counts as its producer, which
    is how a board is drawn and never how work is ordered.
    """
    inside = nodes.select("flow", "task")
    feeds = writes.join(inside, ["flow", "task"], "left_semi").select("flow", "dataset", "task").distinct()
    if last_writer:
        feeds = feeds.groupBy("flow", "dataset").agg(F.max("task").alias("task"))
    wanted = reads.join(inside, ["flow", "task"], "left_semi").join(
        feeds.select("flow", "dataset").distinct(), ["flow", "dataset"], "left_semi"
    ).select("flow", "task", "dataset")
    both = feeds.join(wanted, ["flow", "dataset", "task"], "left_semi")
    lone = (
        both.groupBy("flow", "dataset")
        .agg(F.count(F.lit(1)).alias("n"), F.min("task").alias("own"))
        .filter(F.col("n") == 1)
        .select("flow", "dataset", "own")
    )
    own_gate = F.concat("dataset", F.lit("\u0001"), "own")
    mine = F.col("own") == F.col("task")
    waits = wanted.join(lone, ["flow", "dataset"], "left").select(
        "flow", "task", F.when(mine, own_gate).otherwise(F.col("dataset")).alias("gate")
    )
    others = feeds.join(lone, ["flow", "dataset"]).filter(~mine).select("flow", own_gate.alias("gate"), "task")
    return waits, feeds.withColumnRenamed("dataset", "gate").unionByName(others)


def layers(nodes: DataFrame, waits: DataFrame, feeds: DataFrame) -> DataFrame:
    """Kahn layering: each node's wave, and null for what no order can place (a cycle or behind one).

    `waits` is (flow, task, gate) and `feeds` (flow, gate, task): a node is placed once every task
    feeding every gate it waits on is placed. A round looks only at nodes behind the gates that the
    last round's nodes feed, and keeps those with no gate still fed by an unplaced task.
    """
    key = ["flow", "task"]
    gate = ["flow", "gate"]
    scratch = Scratch(nodes.sparkSession, "gates")
    feeds, fed = scratch.write(feeds.distinct(), "feeds")
    waits, waiting = scratch.write(waits.join(feeds, gate, "left_semi").distinct(), "waits")
    out = EdgeIndex(feeds, key, ["gate"], rows=fed)
    behind = EdgeIndex(waits, gate, ["task"], rows=waiting)
    ahead = EdgeIndex(waits, key, ["gate"], rows=waiting)
    into = EdgeIndex(feeds, gate, ["task"], rows=fed)
    first = nodes.select(*key).distinct().join(waits.select(*key), key, "left_anti")

    def step(frontier: DataFrame, placed: DataFrame, _n: int) -> DataFrame:
        passed = out.probe(frontier.select(*key)).select(*gate).distinct()
        touched = behind.probe(passed).select(*key).distinct()
        needed = ahead.probe(touched)
        shut = into.probe(needed.select(*gate).distinct()).join(placed.select(*key), key, "left_anti").select(*gate)
        held = needed.join(shut.distinct(), gate, "left_semi").select(*key)
        return touched.join(held, key, "left_anti")

    placed = grow(first, step, key, None, "layers")
    for index in (out, behind, ahead, into):
        index.release()
    return nodes.select(*key).distinct().join(placed, key, "left").withColumnRenamed("round", "wave")


def cyclic(waves: DataFrame) -> DataFrame:
    """What the layering could not place; reported, never forced into an order."""
    return waves.filter(F.col("wave").isNull()).drop("wave")


def complete_order(waves: DataFrame, named: int = 20) -> DataFrame:
    """`waves` of a pipeline that must have an order; raises, naming the first tasks, where it has none."""
    stuck = cyclic(waves).orderBy("flow", "task").limit(named).collect()
    if stuck:
        raise ValueError("no order exists; in or behind a cycle: " + ", ".join(f"{r.flow}/{r.task}" for r in stuck))
    return waves


def display_layers(waves: DataFrame) -> DataFrame:
    """A drawable layer for every node: the unplaced share one layer after the last."""
    last = waves.groupBy("flow").agg(F.max("wave").alias("last"))
    return waves.join(last, "flow").select(
        "flow", "task", F.coalesce("wave", F.coalesce("last", F.lit(-1)) + 1).alias("layer")
    )


def rerun_waves(tasks: DataFrame, reads: DataFrame, writes: DataFrame) -> DataFrame:
    """The order flagged work is redone in: waves over flagged tasks only, null when cyclic."""
    flagged = tasks.filter(F.col("status") == "stale").select("flow", "task")
    return layers(flagged, *waits_for(flagged, reads, writes))


def startable_now(waves: DataFrame, tasks: DataFrame, reads: DataFrame, writes: DataFrame) -> DataFrame:
    """First-wave tasks every one of whose inputs is settled, the task itself counting as settled."""
    first = waves.filter(F.col("wave") == 0).select("flow", "task")
    mine = reads.join(first, ["flow", "task"], "left_semi")
    waiting = every_writer(mine, writes, tasks, F.col("status").isin(*FINISHED), True, but_self=True).filter(~F.col("met"))
    return first.join(waiting.select("flow", "task"), ["flow", "task"], "left_anti")


def cascade_edges(reads: DataFrame, writes: DataFrame, causes: DataFrame) -> DataFrame:
    """Edges one origin's marks light up, with the recorded hop, through tasks marked for it only.

    `causes` is (flow, task, caused_by, caused_by_task, hops). The task that made the change is left
    out of its own cascade. A read edge is the one its task was reached by: the first dataset, in
    walk order, among those that led to it.
    """
    own = F.col("task").eqNullSafe(F.col("caused_by_task"))
    marked = causes.filter(~own).select("flow", F.col("caused_by").alias("origin"), "task", "hops")
    marked_reads = reads.join(marked.select("flow", "task", "origin"), ["flow", "task"])
    marked_writes = writes.join(marked.select("flow", "task", "origin"), ["flow", "task"])
    walked = task_walk(
        marked_reads.withColumn("scope", F.col("origin")).drop("origin"),
        marked_writes.withColumn("scope", F.col("origin")).drop("origin"),
        marked.select("flow", F.col("origin").alias("scope"), "origin").distinct(),
        part=("flow", "scope"),
        first_via=True,
    )
    lit = walked.drop("hops", "scope").join(marked, ["flow", "origin", "task"])
    into = lit.select("flow", "origin", F.col("via").alias("src"), F.col("task").alias("dst"), "hops")
    out = lit.join(writes, ["flow", "task"]).select(
        "flow", "origin", F.col("task").alias("src"), F.col("dataset").alias("dst"), "hops"
    )
    return into.unionByName(out)
