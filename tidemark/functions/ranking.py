"""Running totals over keys of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """`df` with the running sum of `value` per key, in `order`, as `name`.

    The rows are range-partitioned by key and order, so a key holding a third of them spans many
    partitions. Each partition sums its own part; what comes before a part is a sum over one total
    per (key, partition). Ranges are sampled, so they are fixed by writing the rows out once.
    """
    ranged = df.withColumn("_value", value).repartitionByRange(*by, *order)
    ranged = materialize(ranged.withColumn("_part", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy(*by, "_part").agg(F.sum("_value").alias("_sum"))
    upto = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.withColumn("_before", F.coalesce(F.sum("_sum").over(upto), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("_within", F.sum("_value").over(within))
    return (
        summed.join(before, [*by, "_part"])
        .withColumn(name, F.col("_before") + F.col("_within"))
        .drop("_value", "_part", "_before", "_within")
    )


def row_numbers(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Row numbers per key without ever sorting a whole key in one task."""
    return running_total(df, by, order, F.lit(1), name)
