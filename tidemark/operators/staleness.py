"""Which finished work a change invalidates, and the marks that record it.

A mark is kept as rows: one per recorded cause, with the nearest first by (hops, caused_by). A task
downstream of a million changes then has a million cause rows and no million-element list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import FINISHED, sole_producer, task_walk
from tidemark.operators.iterate import EdgeIndex, grow


def affected_by(
    tasks: DataFrame,
    reads: DataFrame,
    writes: DataFrame,
    changes: DataFrame,
    exclude: DataFrame | None = None,
    first_via: bool = False,
) -> DataFrame:
    """One row per (flow, origin, task) a change reaches, at the origin's shortest distance.

    Only finished tasks are eligible and walked through, so the status filter is applied to the read
    edges once, before the walk. `exclude` (flow, task) is out of every walk.
    """
    finished = tasks.filter(F.col("status").isin(*FINISHED)).select("flow", "task")
    if exclude is not None:
        finished = finished.join(exclude.select("flow", "task"), ["flow", "task"], "left_anti")
    open_reads = reads.join(finished, ["flow", "task"], "left_semi")
    open_writes = writes.join(finished, ["flow", "task"], "left_semi")
    origins = changes.select("flow", F.col("dataset").alias("origin"))
    return task_walk(open_reads, open_writes, origins, ("flow",), first_via=first_via)


def nearest_origin(tasks: DataFrame, reads: DataFrame, writes: DataFrame, changes: DataFrame) -> DataFrame:
    """(flow, task, hops, origin): the nearest change behind each reached task, ties to the smaller name.

    All origins are walked at once and a task is kept at its first round, so the work is linear in
    the edges, where the closure grows with (change, task) pairs. The smallest origin survives: one
    at a task's least distance is at the least distance of the task before it too.
    """
    finished = tasks.filter(F.col("status").isin(*FINISHED)).select("flow", "task")
    inward = EdgeIndex(reads.join(finished, ["flow", "task"], "left_semi").select("flow", "dataset", "task"), ["flow", "dataset"], ["task"])
    outward = EdgeIndex(writes.join(finished, ["flow", "task"], "left_semi").select("flow", "task", "dataset"), ["flow", "task"], ["dataset"])

    def least(found: DataFrame, end: str) -> DataFrame:
        return found.groupBy("flow", end).agg(F.min("origin").alias("origin"))

    def step(frontier: DataFrame, _seen: DataFrame, _n: int) -> DataFrame:
        made = least(outward.probe(frontier.select("flow", "task", "origin")), "dataset")
        return least(inward.probe(made), "task")

    start = changes.select("flow", "dataset", F.col("dataset").alias("origin")).distinct()
    reached = grow(least(inward.probe(start), "task"), step, ["flow", "task"], None, "nearest", first=1)
    inward.release()
    outward.release()
    return reached.select("flow", "task", F.col("round").alias("hops"), "origin")


def cause_rows(affected: DataFrame, changes: DataFrame, writes: DataFrame) -> DataFrame:
    """The cause each reached task records: who made the change, when anybody can be named."""
    made_by = sole_producer(writes).withColumnRenamed("dataset", "origin")
    about = changes.select("flow", F.col("dataset").alias("origin"), "kind", "unreported")
    author = F.when(F.col("unreported") == 0, F.col("producer"))
    return (
        affected.join(about, ["flow", "origin"])
        .join(made_by, ["flow", "origin"], "left")
        .withColumn("caused_by_task", author)
        .drop("producer")
        .withColumnRenamed("origin", "caused_by")
    )


def name_via(causes: DataFrame, writes: DataFrame) -> DataFrame:
    """The task a farther mark came through: the sole producer of the dataset it was reached by."""
    through = sole_producer(writes).select("flow", F.col("dataset").alias("via"), F.col("producer").alias("via_task"))
    return causes.join(through, ["flow", "via"], "left").withColumn(
        "via_task", F.when(F.col("hops") > 1, F.col("via_task"))
    )


def primary_mark(causes: DataFrame) -> DataFrame:
    """One mark per task: the nearest cause leads, ties to the smaller dataset name."""
    order = F.struct("hops", "caused_by")
    lead = F.struct("hops", "caused_by", "caused_by_task", "kind")
    return (
        causes.groupBy("flow", "task")
        .agg(F.min_by(lead, order).alias("m"), F.count(F.lit(1)).alias("n_causes"))
        .select("flow", "task", "m.*", "n_causes")
    )


def in_report_order(marks: DataFrame) -> DataFrame:
    return marks.orderBy("hops", "task", "flow")


def merge_causes(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union of causes keyed by (dataset, author); an incoming copy replaces the recorded one."""
    key = ["flow", "task", "caused_by", "caused_by_task"]
    fields = ["hops", "kind"]
    both = existing.select(*key, *fields, F.lit(0).alias("fresh")).unionByName(
        incoming.select(*key, *fields, F.lit(1).alias("fresh"))
    )
    # A grouping key treats two absent authors as the same one.
    return both.groupBy(*key).agg(
        F.max_by(F.struct(*fields), "fresh").alias("kept"), F.max("fresh").alias("fresh")
    ).select(*key, "kept.*", "fresh")


def merged_primary(merged: DataFrame, incoming_primary: DataFrame) -> DataFrame:
    """The mark after a merge: the incoming primary leads where there is one, else the nearest cause."""
    nearest = primary_mark(merged)
    lead = incoming_primary.select(
        "flow", "task", F.struct("hops", "caused_by", "caused_by_task", "kind").alias("lead")
    )
    was = F.struct("hops", "caused_by", "caused_by_task", "kind")
    return (
        nearest.join(lead, ["flow", "task"], "left")
        .withColumn("m", F.coalesce("lead", was))
        .select("flow", "task", "m.*", "n_causes")
    )


def bad_marks(marks: DataFrame) -> DataFrame:
    """Marks that cannot be read: the reject table with the first problem of each."""
    problem = (
        F.when(F.col("caused_by").isNull() | (F.col("caused_by") == ""), "no cause")
        .when(F.col("hops").isNull() | (F.col("hops") < 1), "no hop distance")
        .when(F.col("kind").isNull() | ~F.col("kind").isin("schema", "content", "both"), "unknown change kind")
    )
    return marks.withColumn("problem", problem).filter(F.col("problem").isNotNull())
