"""Table fingerprints that ignore row order and count duplicates.

The content digest is an additive multiset hash: each row's SHA-256 is cut into 20-bit lanes, the
lanes are summed, and the row count and sums are hashed once more. Sums commute, so partial
aggregation on each executor reduces the table to one row before anything is shuffled: no sort,
no shuffle of rows, no group whose size grows with the table. A 20-bit lane in a 64-bit sum has
room for 8 * 10^12 rows. The exact mode, which needs every row's text in one string, exists for
small recorded tables only and refuses larger ones; the multiset digest serves those.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.canon import row_key, row_repr

#: U+001F joins column names; lanes are five hex digits, read three at a time.
COLUMN_SEPARATOR = "\u001f"
LANE_DIGITS = 5
WORD_DIGITS = 15
DIGEST_DIGITS = 64


def schema_fp(columns: Column) -> Column:
    """SHA-256 over the sorted column names of an array column."""
    return F.sha2(F.array_join(F.array_sort(columns), COLUMN_SEPARATOR), 256)


def kept_columns(columns: Sequence[str], exclude: Sequence[str] = ()) -> list[str]:
    kept = [name for name in columns if name not in set(exclude)]
    if not kept:
        raise ValueError("every column is excluded as volatile, so no content is left to compare")
    return kept


def row_digests(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    kept = kept_columns(df.columns, exclude)
    return df.select(F.sha2(row_key(df, kept), 256).alias("digest"))


def lanes(word: Column, digits: int) -> list[Column]:
    """The 20-bit lanes of a number read from `digits` hex digits, highest first."""
    shifts = range(4 * (digits - LANE_DIGITS), -1, -4 * LANE_DIGITS)
    if digits < LANE_DIGITS:
        return [word]
    return [F.shiftright(word, shift).bitwiseAND(F.lit(0xFFFFF)) for shift in shifts]


def content_fp(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """One row: `content`, `row_count`. Names never enter; `exclude` drops columns from the values."""
    rows = row_digests(df, exclude)
    starts = range(0, DIGEST_DIGITS, WORD_DIGITS)
    widths = [min(WORD_DIGITS, DIGEST_DIGITS - start) for start in starts]
    words = rows.select(
        *[
            F.conv(F.substring("digest", start + 1, width), 16, 10).cast("long").alias(f"w{i}")
            for i, (start, width) in enumerate(zip(starts, widths, strict=True))
        ]
    )
    cut = [lane for i, width in enumerate(widths) for lane in lanes(F.col(f"w{i}"), width)]
    names = [f"lane{i}" for i in range(len(cut))]
    sums = words.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.coalesce(F.sum(lane), F.lit(0)).alias(name) for lane, name in zip(cut, names, strict=True)],
    )
    return sums.select(
        F.sha2(F.concat_ws("|", "row_count", *names), 256).alias("content"), "row_count"
    )


def table_shape(df: DataFrame) -> DataFrame:
    """Row count and the ordered column list."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "columns", F.lit(",".join(df.columns))
    )


def fingerprint(df: DataFrame, dataset: str, exclude: Sequence[str] = ()) -> DataFrame:
    columns = F.array(*[F.lit(name) for name in df.columns])
    return content_fp(df, exclude).select(
        F.lit(dataset).alias("dataset"),
        schema_fp(columns).alias("schema_fp"),
        F.col("content").alias("content_fp"),
        "row_count",
    )


def fingerprint_all(
    tables: Mapping[str, DataFrame], volatile: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """One row per table, all computed in one job."""
    volatile = volatile or {}
    parts = [fingerprint(df, name, volatile.get(name, ())) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def reproduce(recorded: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Recorded digests against recomputed ones, per table."""
    now = recomputed.select(
        "dataset", F.col("schema_fp").alias("schema_now"), F.col("content_fp").alias("content_now")
    )
    same = F.col("schema_fp").eqNullSafe(F.col("schema_now")) & F.col("content_fp").eqNullSafe(
        F.col("content_now")
    )
    return recorded.join(now, "dataset", "left").select(
        "dataset",
        F.when(F.col("content_now").isNull(), "missing")
        .when(same, "reproduced")
        .otherwise("different")
        .alias("outcome"),
    )


def volatile_by_dataset(volatile: DataFrame) -> DataFrame:
    """The one volatile list each table is hashed under, or a conflict.

    `volatile` holds one row per (flow, task, dataset, column_name). A list is as long as a table
    is wide; the lists of a table are compared by their extremes, never gathered.
    """
    lists = volatile.groupBy("flow", "dataset", "task").agg(
        F.array_join(F.array_sort(F.collect_set("column_name")), ",").alias("columns")
    )
    return lists.groupBy("flow", "dataset").agg(
        F.min("columns").alias("columns"),
        (F.min("columns") != F.max("columns")).cast("int").alias("conflict"),
        F.count(F.lit(1)).alias("declared_by"),
    )
