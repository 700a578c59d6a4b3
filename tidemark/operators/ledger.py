"""The append-only ledger, the incidents it remembers, and its history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranking import row_numbers, running_total
from tidemark.functions.wording import hop_label, say, table_label

HISTORY_WINDOW = 200
LISTED_TASKS = 20


def append_numbers(heads: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """New rows with the next sequence numbers of their keys; `heads` is (kind, ledger_key, head)."""
    numbered = row_numbers(rows, ["kind", "ledger_key"], order, "nth")
    return (
        numbered.join(heads, ["kind", "ledger_key"], "left")
        .withColumn("seq", F.coalesce("head", F.lit(0)) + F.col("nth"))
        .drop("nth", "head")
    )


def heads(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("kind", "ledger_key").agg(F.max("seq").alias("head"))


def read_prefix(ledger: DataFrame) -> DataFrame:
    """Records 1..n of each key, up to its first missing number.

    The first gap is the smallest successor, of 0 or of a number present, that is itself missing:
    a join on (key, number), which spreads a large key as evenly as many small ones.
    """
    key = ["kind", "ledger_key"]
    present = ledger.select(*key, "seq")
    after = present.select(*key, (F.col("seq") + 1).alias("seq")).unionByName(
        present.select(*key, F.lit(1).cast(ledger.schema["seq"].dataType).alias("seq")).distinct()
    )
    gaps = after.join(present, [*key, "seq"], "left_anti").groupBy(*key).agg(F.min("seq").alias("gap"))
    return ledger.join(gaps, key).filter(F.col("seq") < F.col("gap")).drop("gap")


def history(records: DataFrame, newest: int = HISTORY_WINDOW) -> DataFrame:
    """The newest records of each board with their real numbers; an unreadable body stays as null."""
    last = Window.partitionBy("flow").orderBy(F.desc("seq"))
    body = F.from_json("body", "event string, elapsedMs long")
    kept = records.withColumn("nth", F.row_number().over(last)).filter(F.col("nth") <= newest)
    return kept.select("flow", "seq", "at", body["event"].alias("event"), body["elapsedMs"].alias("elapsed_ms"))


def change_records(affected: DataFrame, restored: DataFrame) -> DataFrame:
    """One record per decision that flagged or cleared anything; a flag leads.

    `affected` and `restored` are (flow, decision, task); the named tasks stay in those relations.
    """
    both = affected.select("flow", "decision", F.lit(1).alias("a"), F.lit(0).alias("r")).union(
        restored.select("flow", "decision", F.lit(0).alias("a"), F.lit(1).alias("r"))
    )
    return both.groupBy("flow", "decision").agg(
        F.sum("a").alias("affected"), F.sum("r").alias("restored")
    ).withColumn("event", F.when(F.col("affected") > 0, "marked").otherwise("cleared"))


def raise_incidents(affected: DataFrame) -> DataFrame:
    """One incident per decision, on the dataset its nearest mark blames, listing the first tasks.

    `affected` is (flow, decision, task, hops, caused_by). Only the listed twenty are gathered, and
    the rank is cut within each partition before the shuffle.
    """
    first = Window.partitionBy("flow", "decision").orderBy("hops", "task")
    lines = (
        affected.withColumn("nth", F.row_number().over(first))
        .filter(F.col("nth") <= LISTED_TASKS)
        .withColumn("line", say("{task} ({far})", task=F.col("task"), far=hop_label(F.col("hops"))))
        .groupBy("flow", "decision")
        .agg(F.array_sort(F.collect_list(F.struct("nth", "line"))).alias("listed"))
    )
    count = affected.groupBy("flow", "decision").agg(
        F.count(F.lit(1)).alias("flagged"), F.min_by("caused_by", F.struct("hops", "task")).alias("dataset")
    )
    n = F.col("flagged")
    title = say("{n} finished {n:task is|tasks are} out of date after {table} changed", n=n, table=table_label(F.col("dataset")))
    rest = F.when(n > LISTED_TASKS, say("\n… and {n} more", n=n - LISTED_TASKS)).otherwise("")
    body = F.concat(F.array_join(F.transform("listed", lambda x: x["line"]), "\n"), rest)
    return count.join(lines, ["flow", "decision"]).select(
        "flow", "decision", "dataset", "flagged", title.alias("title"), body.alias("body")
    )


def closable(incidents: DataFrame, causes: DataFrame) -> DataFrame:
    """Incidents none of whose tasks still carries a mark citing their dataset.

    `incidents` has one row per (incident, flow, dataset, task).
    """
    cited = causes.select("flow", "task", F.col("caused_by").alias("dataset"))
    open_still = incidents.join(cited, ["flow", "task", "dataset"], "left_semi").select("incident")
    return incidents.select("incident", "flow", "dataset").distinct().join(open_still, "incident", "left_anti")


def causes_after(
    causes: DataFrame, merged: DataFrame, finishing: DataFrame, superseded: DataFrame, restored: DataFrame
) -> DataFrame:
    """Every recorded cause once a decision has landed.

    The cascade is merged in, the reporter's mark is replaced by what it finished on, restored tasks
    lose theirs, in that order.
    """
    key = ["flow", "task"]
    columns = [*key, "caused_by", "caused_by_task", "hops", "kind"]
    untouched = causes.join(merged.select(*key), key, "left_anti").select(*columns)
    landed = untouched.unionByName(merged.select(*columns))
    landed = landed.join(finishing.select(*key), key, "left_anti").unionByName(superseded.select(*columns))
    return landed.join(restored.select(*key), key, "left_anti")


def repaired_tables(causes: DataFrame, cleared: DataFrame) -> DataFrame:
    """Tables a decision took marks off for: every cause of the tasks it cleared."""
    return causes.join(cleared, ["flow", "task"], "left_semi").select("flow", "caused_by").distinct()


def candidate_incidents(records: DataFrame, active: DataFrame, newest: int | None = None) -> DataFrame:
    """Incidents a board's records raised that are still active; of the `newest` records only, if given."""
    if newest is None:
        return records.select("flow", "incident").distinct().join(active, ["flow", "incident"], "left_semi")
    last = Window.partitionBy("flow").orderBy(F.desc("seq"))
    recent = records.withColumn("nth", F.row_number().over(last)).filter(F.col("nth") <= newest)
    return recent.select("flow", "incident").distinct().join(active, ["flow", "incident"], "left_semi")


def history_rows(records: DataFrame) -> DataFrame:
    """Headlines, newest first; a record that cannot be read keeps its row."""
    a, r = F.col("affected"), F.col("restored")
    parts = F.concat_ws(
        ", ",
        F.when(a > 0, say("{n} {n:task|tasks} went out of date", n=a)),
        F.when(r > 0, say("{n} {n:flag|flags} came off", n=r)),
    )
    headline = (
        F.when(a.isNull(), "a decision was recorded here that cannot be read")
        .when(parts == "", "a decision was recorded that changed nothing")
        .otherwise(parts)
    )
    return records.select("flow", "seq", headline.alias("headline")).orderBy(F.desc("seq"), "flow")


def passes(trace: DataFrame) -> DataFrame:
    """Trace steps with the pass each belongs to; a `read` opens one, 0 is a fragment before any."""
    opens = F.when(F.col("phase") == "read", 1).otherwise(0)
    return running_total(trace, ["flow"], ["seq"], opens, "pass_no")


def newest_events(trace: DataFrame, keep: int) -> DataFrame:
    """The newest events of each board under their own numbers."""
    last = Window.partitionBy("flow").orderBy(F.desc("seq"))
    return trace.withColumn("nth", F.row_number().over(last)).filter(F.col("nth") <= keep).drop("nth")
