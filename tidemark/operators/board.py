"""What a board says: restorations, readiness, freshness and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import FINISHED, every_writer, layers
from tidemark.session import Scratch

STALE_TAG = "stale_work"


# -- restoring ---------------------------------------------------------------------------------


def firing(decisions: DataFrame, causes: DataFrame, unchanged: DataFrame) -> DataFrame:
    """Decisions that can restore anything: the task carried a mark and something came back identical.

    `decisions` is (flow, finishing), `unchanged` is (flow, dataset).
    """
    marked = causes.select("flow", F.col("task").alias("finishing"))
    return decisions.join(marked, ["flow", "finishing"], "left_semi").join(
        unchanged.select("flow"), "flow", "left_semi"
    )


def restored_by(
    tasks: DataFrame,
    reads: DataFrame,
    writes: DataFrame,
    causes: DataFrame,
    fps: DataFrame,
    decisions: DataFrame,
    unchanged: DataFrame,
    changed: DataFrame | None = None,
    exclude: DataFrame | None = None,
) -> DataFrame:
    """Flagged tasks an identical redo proves still sound; one decision per flow, all flows at once.

    Every rule that does not depend on what else gets cleared is settled first, once. What is left
    is "cleared after every unsettled writer it reads from is cleared", which is the layering of
    the candidates behind the tables those writers feed; a cycle is never cleared.
    """
    scratch = Scratch(tasks.sparkSession, "restore")
    live, fired = scratch.write(firing(decisions, causes, unchanged).select("flow", "finishing"), "live")
    if not fired:
        return tasks.select("flow", "task", F.lit(0).alias("wave")).limit(0)
    moved = (
        writes.join(live, (writes.flow == live.flow) & (writes.task == live.finishing), "left_semi")
        .select("flow", "dataset")
        .join(unchanged.select("flow", "dataset"), ["flow", "dataset"], "left_anti")
    )
    if changed is not None:
        moved = moved.union(changed.select("flow", "dataset"))
    moved = moved.distinct().withColumn("moved", F.lit(1))

    candidates = (
        tasks.filter((F.col("status") == "stale") & F.col("finished_at").isNotNull())
        .join(live, "flow")
        .filter(F.col("task") != F.col("finishing"))
        .join(causes.select("flow", "task"), ["flow", "task"], "left_semi")
    )
    if exclude is not None:
        candidates = candidates.join(exclude.select("flow", "task"), ["flow", "task"], "left_anti")
    candidates = candidates.select("flow", "task", "finishing", F.col("finished_at").alias("read_at"))

    noticed = fps.filter(F.col("slot") == "observed").select("flow", "task", "dataset", F.lit(1).alias("noticed"))
    cited = causes.select("flow", "task", F.col("caused_by").alias("dataset"), F.lit(1).alias("cited")).distinct()
    wrote = (
        writes.select("flow", "dataset", "task")
        .join(tasks.select("flow", "task", "status", F.col("finished_at").alias("wrote_at")), ["flow", "task"])
        .join(live, "flow")
        .join(noticed, ["flow", "task", "dataset"], "left")
        .withColumn("settled", (F.col("task") == F.col("finishing")) | (F.col("status") == "complete"))
    )
    wrote, _ = scratch.write(wrote, "wrote")
    candidates, _ = scratch.write(candidates, "candidates")
    # What every writer of a table has to satisfy, as one row per table.
    ground = wrote.groupBy("flow", "dataset").agg(
        F.max("wrote_at").alias("last_write"),
        F.bool_or(F.col("wrote_at").isNull() | (F.col("noticed") == 1)).alias("doubted"),
    ).join(moved, ["flow", "dataset"], "left")
    footing = (
        reads.join(candidates, ["flow", "task"])
        .join(ground, ["flow", "dataset"])
        .join(cited, ["flow", "task", "dataset"], "left")
    )
    in_time = F.coalesce(F.col("last_write") <= F.col("read_at"), F.lit(False))
    doubted = F.coalesce("doubted", F.lit(False))
    sound = F.col("moved").isNull() & F.col("cited").isNull() & in_time & ~doubted
    footing, _ = scratch.write(
        footing.select("flow", "task", F.col("dataset").alias("gate"), sound.alias("sound")), "footing"
    )
    hopeless = footing.filter(~F.col("sound")).select("flow", "task")
    nodes = candidates.select("flow", "task").join(hopeless, ["flow", "task"], "left_anti")
    waits = footing.drop("sound").join(nodes, ["flow", "task"], "left_semi")
    feeds = wrote.filter(~F.col("settled")).select("flow", F.col("dataset").alias("gate"), "task")
    placed = layers(nodes, waits, feeds)
    return placed.filter(F.col("wave").isNotNull()).select("flow", "task", "wave")


# -- readiness and freshness -------------------------------------------------------------------


def ready_to_start(tasks: DataFrame, reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Registered tasks whose every input has no writer or only finished ones."""
    waiting = tasks.filter(F.col("status") == "registered").select("flow", "task")
    mine = reads.join(waiting, ["flow", "task"], "left_semi")
    unmet = every_writer(mine, writes, tasks, F.col("status").isin(*FINISHED), True).filter(~F.col("met"))
    return waiting.join(unmet.select("flow", "task"), ["flow", "task"], "left_anti")


def blocked(tasks: DataFrame, reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Registered tasks and every unfinished writer each waits on, a row per pair and input."""
    waiting = tasks.filter(F.col("status") == "registered").select("flow", "task")
    unfinished = tasks.filter(~F.col("status").isin(*FINISHED)).select("flow", "task", "name")
    wrote = writes.join(unfinished, ["flow", "task"]).select("flow", "dataset", F.col("name").alias("waiting_on"))
    return reads.join(waiting, ["flow", "task"], "left_semi").join(wrote, ["flow", "dataset"]).select(
        "flow", "task", "dataset", "waiting_on"
    )


def freshness(wanted: DataFrame, tasks: DataFrame, writes: DataFrame) -> DataFrame:
    """The worst state among a table's writers; a table nobody registered has a verdict of its own."""
    rank = (
        F.when(F.col("status") == "stale", 0)
        .when(F.col("status") == "running", 1)
        .when(F.col("status") == "complete", 3)
        .otherwise(2)
    )
    worst = (
        writes.join(tasks.select("flow", "task", "status"), ["flow", "task"])
        .groupBy("flow", "dataset")
        .agg(F.min(rank).alias("worst"), F.count(F.lit(1)).alias("writers"))
    )
    word = (
        F.when(F.col("worst").isNull(), "no-registered-producer")
        .when(F.col("worst") == 0, "stale")
        .when(F.col("worst") == 1, "in-flight")
        .when(F.col("worst") == 2, "not-yet-produced")
        .otherwise("fresh")
    )
    return wanted.select("flow", "dataset").distinct().join(worst, ["flow", "dataset"], "left").select(
        "flow", "dataset", word.alias("verdict"), F.coalesce("writers", F.lit(0)).alias("writers")
    )


def prior_status(tasks: DataFrame, causes: DataFrame, fps: DataFrame) -> DataFrame:
    """Where a task returns to when its run is abandoned."""
    marked = causes.select("flow", "task").distinct().withColumn("marked", F.lit(1))
    printed = fps.filter(F.col("slot") == "current").select("flow", "task").distinct().withColumn("printed", F.lit(1))
    word = (
        F.when(F.col("marked") == 1, "stale")
        .when(F.col("finished_at").isNotNull() & (F.col("printed") == 1), "complete")
        .otherwise("registered")
    )
    return (
        tasks.join(marked, ["flow", "task"], "left")
        .join(printed, ["flow", "task"], "left")
        .select("flow", "task", word.alias("prior_status"))
    )


# -- rollups -----------------------------------------------------------------------------------


def stale_tagged(tags: DataFrame) -> DataFrame:
    """Per task, whether the stale tag is among its tags."""
    return tags.groupBy("flow", "task").agg(F.max((F.col("tag") == STALE_TAG).cast("int")).alias("tagged"))


def totals(tasks: DataFrame, causes: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Counts per board; the tag counts are null when no tags were read."""
    board = tasks.join(
        causes.select("flow", "task").distinct().withColumn("marked", F.lit(1)), ["flow", "task"], "left"
    )
    if tags is None:
        board = board.withColumn("tagged", F.lit(None).cast("int"))
    else:
        board = board.join(stale_tagged(tags), ["flow", "task"], "left").withColumn(
            "tagged", F.coalesce("tagged", F.lit(0))
        )
    known = F.lit(tags is not None)
    is_marked, is_tagged = F.col("marked") == 1, F.col("tagged") == 1
    return board.groupBy("flow").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.count_if(F.col("status").isin(*FINISHED)).alias("finished"),
        F.count_if(F.col("status") == "stale").alias("stale"),
        F.count_if(is_marked).alias("marked"),
        F.when(known, F.count_if(is_marked & is_tagged)).alias("tagged"),
        F.when(known, F.count_if(F.col("marked").isNull() & is_tagged)).alias("left_over"),
    )


def primary_marks(tasks: DataFrame, causes: DataFrame) -> DataFrame:
    """Each flagged task's leading cause with when it was recorded."""
    lead = F.min_by(
        F.struct("caused_by", "caused_by_task", "hops", "since"), F.struct("hops", "caused_by")
    )
    flagged = tasks.filter(F.col("status") == "stale").select("flow", "task")
    return (
        causes.join(flagged, ["flow", "task"], "left_semi")
        .groupBy("flow", "task")
        .agg(lead.alias("m"), F.count(F.lit(1)).alias("n_causes"))
        .select("flow", "task", "m.*", "n_causes")
    )


def current_change(marks: DataFrame) -> DataFrame:
    """The change a board is showing: the newest mark, ties to the smaller cause, then the task."""
    newest = marks.groupBy("flow").agg(F.max("since").alias("since"))
    fields = F.struct("caused_by", "caused_by_task", "since")
    return (
        marks.join(newest, ["flow", "since"])
        .groupBy("flow")
        .agg(F.min_by(fields, F.struct("caused_by", "task")).alias("c"))
        .select("flow", "c.*")
    )


def detection_timing(marks: DataFrame, tasks: DataFrame, measured: DataFrame) -> DataFrame:
    """How long the newest change took to detect: the largest measured figure among its marks.

    `measured` is (flow, task, detected_ms); boards with an unnamed author or no measurement are absent. An
    author that is not on the board has no name to give as source.
    """
    now = current_change(marks).filter(F.col("caused_by_task").isNotNull()).select("flow", "caused_by_task")
    known = tasks.select("flow", F.col("task").alias("caused_by_task"), F.col("name").alias("source"))
    return (
        marks.join(now, ["flow", "caused_by_task"])
        .join(measured.filter(F.col("detected_ms") >= 0), ["flow", "task"], "left")
        .groupBy("flow", "caused_by_task")
        .agg(F.max("detected_ms").alias("ms"), F.count(F.lit(1)).alias("flagged"))
        .filter(F.col("ms").isNotNull())
        .join(known, ["flow", "caused_by_task"], "left")
        .select("flow", "ms", "source", "flagged")
    )


def last_report_at(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("flow").agg(F.max(F.greatest("finished_at", "started_at")).alias("last_report"))


def status_counts(tasks: DataFrame) -> DataFrame:
    words = ("registered", "running", "complete", "stale")
    return tasks.groupBy("flow").agg(*[F.count_if(F.col("status") == w).alias(f"n_{w}") for w in words])


def trimmed_board(tasks: DataFrame, marks: DataFrame) -> DataFrame:
    return tasks.select("flow", "task", "name", "status").join(
        marks.select("flow", "task", "caused_by", "n_causes"), ["flow", "task"], "left"
    )


def rows_written(shapes: DataFrame) -> DataFrame:
    return shapes.groupBy("task").agg(F.sum("row_count").alias("rows_written"))


def output_columns(shape_columns: DataFrame) -> DataFrame:
    """A task's output columns in first-seen order; a list as long as its tables are wide."""
    first = shape_columns.groupBy("task", "column_name").agg(F.min(F.struct("dataset", "pos", "column_name")).alias("seen"))
    ordered = F.transform(F.array_sort(F.collect_list("seen")), lambda s: s["column_name"])
    return first.groupBy("task").agg(F.array_join(ordered, ",").alias("columns"))


def table_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """A table now against its recorded shape: both are (dataset, row_count, columns array)."""
    had = before.select("dataset", F.col("row_count").alias("rows_before"), F.col("columns").alias("was"))
    return had.join(after, "dataset").select(
        "dataset",
        F.filter("columns", lambda c: ~F.array_contains("was", c)).alias("added"),
        F.filter("was", lambda c: ~F.array_contains("columns", c)).alias("removed"),
        "rows_before",
        F.col("row_count").alias("rows_after"),
    )


def rerun_summary(waves: DataFrame, startable: DataFrame) -> DataFrame:
    ready = startable.groupBy("flow").agg(F.count(F.lit(1)).alias("startable"))
    return (
        waves.groupBy("flow")
        .agg(
            F.count(F.lit(1)).alias("flagged"),
            F.coalesce(F.max("wave") + 1, F.lit(0)).alias("waves"),
            F.count_if(F.col("wave").isNull()).alias("cyclic"),
        )
        .join(ready, "flow", "left")
        .select("flow", "flagged", "waves", "cyclic", F.coalesce("startable", F.lit(0)).alias("startable"))
    )


def repair_cost(tasks: DataFrame) -> DataFrame:
    """Summed last run times of the flagged tasks, null unless every one of them is known."""
    return tasks.filter(F.col("status") == "stale").groupBy("flow").agg(
        F.when(F.bool_and(F.col("run_ms").isNotNull()), F.sum("run_ms")).alias("estimate_ms"),
        F.count(F.lit(1)).alias("flagged"),
    )


def missing_tasks(expected: DataFrame, tasks: DataFrame) -> DataFrame:
    return expected.join(tasks.select("task"), "task", "left_anti")


def has_baseline(outputs: DataFrame, fps: DataFrame) -> DataFrame:
    known = fps.filter(F.col("slot") == "current").select("flow", "task", "dataset").withColumn("known", F.lit(1))
    return outputs.join(known, ["flow", "task", "dataset"], "left").select(
        *outputs.columns, F.coalesce("known", F.lit(0)).alias("has_baseline")
    )


def board_scan(tasks: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The board without removed tasks, and the members that have no record at all.

    The disagreement is looked for before removed tasks are dropped: a removed task still has a
    record, so it is not a disagreement.
    """
    disagree = members.join(tasks.select("flow", "task"), ["flow", "task"], "left_anti")
    return tasks.filter(F.col("removed") == 0).drop("removed"), disagree


def in_flight_ms(tasks: DataFrame, at: Column) -> DataFrame:
    """How long running work has been running; null when the clock contradicts itself."""
    elapsed = F.unix_millis(at.cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp"))
    running = (F.col("status") == "running") & (elapsed >= 0)
    return tasks.select("flow", "task", F.when(running, elapsed).alias("in_flight_ms"))
