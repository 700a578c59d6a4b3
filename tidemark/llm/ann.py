"""Approximate nearest neighbours along shifted space-filling curves."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.hilbert import hilbert_keys
from tidemark.session import Scratch

#: Curves, dimensions and bits a dimension of each, and the share of all rows read on either side of a query.
CURVES, DIMS, BITS, REACH = 8, 7, 9, 0.1

#: Rows of a curve kept together.
BLOCK = 2048


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows with a key whose vector is not null, not zero and all finite, as doubles."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = F.exists("v", lambda x: x != 0) & ~F.exists("v", bad)
    return rows.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(array):
        return np.zeros((0, 1))
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1)


def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sum and sum of products of a partition's vectors, and its largest square norm."""
    count, total, products, largest = 0, None, None, 0.0
    for batch in batches:
        x = matrix(batch.column(1))
        if not len(x):
            continue
        largest = max(largest, float((x * x).sum(1).max()))
        count += len(x)
        total = x.sum(0) if total is None else total + x.sum(0)
        products = x.T @ x if products is None else products + x.T @ x
    if count:
        yield pa.RecordBatch.from_pylist([{"n": count, "largest": largest, "total": total.tolist(), "products": products.ravel().tolist()}])


class Curves:
    """Random projections of the vectors, lengthened by the component that gives all of them one norm,
    so that near on a curve means a large inner product; each curve has its own projection and shift."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, largest: float, curves: int, dims: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        size = len(mean) + 1
        self.bits, self.largest, self.mean = bits, largest, mean
        dims = min(dims, size)
        self.projections = [np.linalg.qr(rng.normal(size=(size, dims)))[0] for _ in range(curves)]
        self.shifts = [rng.random(dims) - 0.5 for _ in range(curves)]
        self.scales = [np.sqrt(np.maximum(1e-30, ((p[:-1].T @ spread) * p[:-1].T).sum(1))) for p in self.projections]

    def keys(self, x: np.ndarray, curve: int) -> np.ndarray:
        extra = np.sqrt(np.maximum(0, self.largest - (x * x).sum(1)))
        y = np.column_stack([x - self.mean, extra]) @ self.projections[curve] / self.scales[curve]
        cells = 1 << self.bits
        return hilbert_keys(np.clip((y + 4.5 + self.shifts[curve]) / 9 * cells, 0, cells - 1).astype(np.int64), self.bits)


def nearest(
    rows: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding",
    curves: int = CURVES, dims: int = DIMS, bits: int = BITS, reach: float = REACH, block: int = BLOCK, seed: int = 11,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each query, not itself.

    Every row is keyed on every curve and range-partitioned by (curve, key) into ordered blocks. A
    query reads the blocks within `reach` (a share of all rows) of its own on every curve, its own
    ones first; each block answers with its k best ids by exact inner product, the later ones only with
    what can still be among the k best, and the answers merge. `queries` are rows of the
    same table. Vectors that are null, zero or hold a null or non-finite component take no part, nor
    do those whose length is not the commonest one. Ties go to the smaller id. Rows repeating an id
    are candidates once for each different vector, of which the best counts. Extra columns are ignored.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "ann")
    schema = "query_id long, rank int, vec_id long, score double"
    sized = usable(rows, key, vector).withColumn("size", F.size("v"))
    commonest = sized.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if commonest is None:
        return spark.createDataFrame([], schema)
    ids = queries.select(F.col(key).cast("long").alias("vec_id")).distinct().withColumn("asks", F.lit(True))
    vectors, count = scratch.write(
        sized.filter(F.col("size") == commonest["size"]).dropDuplicates(["vec_id", "v"]).join(ids, "vec_id", "left")
        .select("vec_id", "v", F.coalesce("asks", F.lit(False)).alias("asks")), "vectors"
    )
    parts = vectors.mapInArrow(moments, "n long, largest double, total array<double>, products array<double>")
    # d * d sums from each partition, added up before they come here.
    sums = parts.agg(F.sum("n").alias("n"), F.max("largest").alias("largest")).first()
    add = lambda c: [r.x for r in parts.select(F.posexplode(c).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()]
    mean = np.array(add("total")) / sums.n
    spread = np.array(add("products")).reshape(len(mean), -1) / sums.n - np.outer(mean, mean)
    made = Curves(mean, spread, sums.largest, curves, dims, bits, seed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            for c in range(curves):
                keys = made.keys(x, c) if len(x) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, c, np.int32)), pa.array(keys), *batch.columns], ["curve", "key", "vec_id", "v", "asks"]
                )

    placed = vectors.mapInArrow(place, "curve int, key long, vec_id long, v array<double>, asks boolean")
    pieces = max(curves, -(-count * curves // (4 * block)))
    ordered, _ = scratch.write(
        placed.repartitionByRange(pieces, "curve", "key", "vec_id").withColumn("part", F.spark_partition_id())
        .sortWithinPartitions("curve", "key", "vec_id").withColumn("serial", F.monotonically_increasing_id()), "ordered"
    )
    # A partition's rows before it, by curve: one row for each partition, so the window is small.
    sizes = ordered.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("serial").alias("lowest"))
    earlier = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("curve", "part", "lowest", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    blocked = ordered.join(before, ["curve", "part"]).withColumn(
        "block", F.floor((F.col("before") + F.col("serial") - F.col("lowest")) / block).cast("int")
    )
    last = -(-count // block) - 1
    width = math.ceil(reach * count / block)
    held = blocked.select("curve", "block", "vec_id", "v", F.lit(False).alias("asks"), F.lit(None).cast("double").alias("least"))
    home = blocked.filter("asks").select("curve", "block", "vec_id", "v", "asks", F.lit(None).cast("double").alias("least"))

    def search(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids, x = table.column("vec_id").to_numpy(), matrix(table.column("v"))
        theirs, y = ids[~asks], x[~asks]
        # smaller ids first, so a stable sort settles ties
        order = np.argsort(theirs, kind="stable")
        theirs, y = theirs[order], y[order]
        heads = np.flatnonzero(np.diff(theirs, prepend=theirs[:1] - 1))
        out = ([], [], [])
        mine, q = ids[asks], x[asks]
        bound = table.column("least").to_numpy(zero_copy_only=False)[asks]
        bound = np.where(np.isnan(bound), -np.inf, bound - 1e-9 * (1 + np.abs(bound)))
        for lo in range(0, len(mine), 256):
            rough = q[lo : lo + 256] @ y.T
            rough[mine[lo : lo + 256, None] == theirs[None, :]] = -np.inf
            if len(heads) > k:
                # the best row of each id, so that k rows of one id do not stand for k neighbours
                by_id = rough if len(heads) == len(theirs) else np.maximum.reduceat(rough, heads, axis=1)
                least = np.partition(by_id, -k, axis=1)[:, -k]
            else:
                least = np.full(len(rough), -np.inf)
            floor = np.where(np.isfinite(least), least - 1e-9 * (1 + np.abs(least)), -np.inf)
            floor = np.maximum(floor, bound[lo : lo + 256])
            for i, row in enumerate(rough):
                # A product's rounding must not depend on its neighbours, or ties would not be ties.
                close = np.flatnonzero((row >= floor[i]) & (row > -np.inf))
                score = (y[close] * q[lo + i]).sum(1)
                best = np.argsort(-score, kind="stable")
                best = best[np.sort(np.unique(theirs[close[best]], return_index=True)[1])[:k]]
                out[0].append(np.full(len(best), mine[lo + i]))
                out[1].append(theirs[close[best]])
                out[2].append(score[best])
        types = (("query_id", pa.int64(), np.int64), ("vec_id", pa.int64(), np.int64), ("score", pa.float64(), np.float64))
        return pa.table({n: pa.array(np.concatenate([np.zeros(0, d), *o]), t) for (n, t, d), o in zip(types, out)})

    answer = "query_id long, vec_id long, score double"
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near, _ = scratch.write(held.union(home).groupBy("curve", "block").applyInArrow(search, answer), "near")
    best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order))
    floors = best.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    blocks = F.sequence(F.greatest(F.col("block") - width, F.lit(0)), F.least(F.col("block") + width, F.lit(last)))
    around = blocked.filter("asks").join(floors, "vec_id", "left").select(
        "curve", F.explode(F.array_remove(blocks, F.col("block"))).alias("block"), "vec_id", "v", "asks", "least"
    )
    far = held.union(around).groupBy("curve", "block").applyInArrow(search, answer)
    merged = near.union(far).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
