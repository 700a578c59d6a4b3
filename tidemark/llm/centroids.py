"""Lloyd's clustering in exact integers, with a heap of bounds for each cluster."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

#: Vectors in a block, as a power of two. A block's vectors and heaps are what one call holds: 1 MB for 64 components.
BLOCK_BITS = 12

#: Blocks in a bucket of the tables, about.
BUCKET_BLOCKS = 16

#: Integer components may reach this far from zero, so that a squared distance fits a long.
LIMIT = 1 << 27

#: Components up to this far from zero have dot products that doubles hold exactly.
EXACT = 1 << 22

#: Rounding that a bound may have gathered, in units of distance and as a share of it.
SLACK = (1e-6, 1e-9)

HEAPS = "block long, cluster int, gaps array<double>, places array<int>, total array<long>"


def integer_vectors(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """(vec_id, parts) of the rows that take part, parts = floor(scale * x) of each component."""
    held = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def fine(x):
        return x.isNotNull() & ~F.isnan(x) & (x * scale >= -LIMIT) & (x * scale < LIMIT)

    whole = F.col("vec_id").isNotNull() & (F.size("embedding") == size) & F.forall("embedding", fine)
    return held.filter(whole).select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale).cast("int")).alias("parts"))


class Blocks:
    """Vectors and heaps as tables bucketed by block, so that a round joins them without moving a vector."""

    def __init__(self, spark: SparkSession, vectors: DataFrame):
        self.spark, self.name, self.tables = spark, f"centroids_{uuid.uuid4().hex}", []
        rows = vectors.count()
        self.buckets = max(1, min(10_000, max(spark.sparkContext.defaultParallelism, rows // (BUCKET_BLOCKS << BLOCK_BITS))))
        numbered = vectors.withColumn("_n", F.monotonically_increasing_id())
        placed = numbered.select(
            F.shiftright("_n", BLOCK_BITS).alias("block"), F.col("_n").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int").alias("place"), "vec_id", "parts"
        )
        self.vectors = self.write(placed, "vectors")

    def write(self, rows: DataFrame, label: str) -> DataFrame:
        table = f"{self.name}_{label}"
        rows.repartition(self.buckets, "block").write.bucketBy(self.buckets, "block").saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    def release(self, keep: int = 0) -> None:
        """Drop the tables of earlier rounds but for the vectors and the `keep` last ones."""
        old = self.tables[1 : len(self.tables) - keep]
        for table in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables = [t for t in self.tables if t not in old]


def square_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, one row for each vector."""
    most = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0))
    if most <= EXACT // max(1, math.isqrt(vectors.shape[1])):
        x, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None]).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(1) for c in centroids], axis=1)


def rescan(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of a tie), squared distance to it, and how much further the next one is."""
    apart = square_distances(vectors, centroids)
    nearest = apart.argmin(1)
    rows = np.arange(len(vectors))
    least = apart[rows, nearest]
    if apart.shape[1] == 1:
        return nearest, least, np.full(len(vectors), np.inf)
    apart[rows, nearest] = np.iinfo(np.int64).max
    upper = np.sqrt(least.astype(np.float64))
    lower = np.sqrt(apart.min(1).astype(np.float64))
    return nearest, least, (lower - upper) - SLACK[0] - SLACK[1] * lower


def matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)


class Block:
    """The vectors of a block and, for each cluster, a heap of (gap + the cluster's drift so far, place)."""

    def __init__(self, vectors: pa.Table, heaps: pa.Table, size: int, clusters: int):
        self.place = vectors.column("place").to_numpy()
        order = np.argsort(self.place, kind="stable")
        self.vec_id = vectors.column("vec_id").to_numpy()[order]
        self.parts = matrix(vectors.column("parts"), size)[order]
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(clusters)]
        self.total = np.zeros((clusters, size), np.int64)
        for row in heaps.to_pylist():
            self.heaps[row["cluster"]] = list(zip(row["gaps"], row["places"]))
            self.total[row["cluster"]] = row["total"]

    def settle(self, centroids: np.ndarray, drift: np.ndarray, fresh: bool) -> None:
        """Pop what a cluster's drift has caught up with, find its nearest centroid, and push it there."""
        expired: list[int] = list(range(len(self.parts))) if fresh else []
        home = [-1] * len(expired)
        for c, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= drift[c]:
                expired.append(heappop(heap)[1])
                home.append(c)
        if not expired:
            return
        places, was = np.array(expired), np.array(home)
        nearest, _, gap = rescan(self.parts[places], centroids)
        moved = nearest != was
        np.add.at(self.total, nearest[moved], self.parts[places[moved]])
        left = moved & (was >= 0)
        np.subtract.at(self.total, was[left], self.parts[places[left]])
        due = gap + drift[nearest]
        if fresh:
            for c in range(len(self.heaps)):
                mine = nearest == c
                self.heaps[c] = list(zip(due[mine].tolist(), places[mine].tolist()))
                heapify(self.heaps[c])
        else:
            for c, key, place in zip(nearest.tolist(), due.tolist(), expired):
                heappush(self.heaps[c], (key, place))

    def rows(self, block: int) -> pa.Table:
        held = [c for c, heap in enumerate(self.heaps) if heap]
        return pa.table(
            {
                "block": pa.array([block] * len(held), pa.int64()),
                "cluster": pa.array(held, pa.int32()),
                "gaps": pa.array([[k for k, _ in self.heaps[c]] for c in held], pa.list_(pa.float64())),
                "places": pa.array([[p for _, p in self.heaps[c]] for c in held], pa.list_(pa.int32())),
                "total": pa.array([self.total[c].tolist() for c in held], pa.list_(pa.int64())),
            }
        )

    def assigned(self, centroids: np.ndarray) -> pa.Table:
        cluster = np.empty(len(self.parts), np.int32)
        for c, heap in enumerate(self.heaps):
            cluster[[p for _, p in heap]] = c
        distance = ((self.parts - centroids[cluster]) ** 2).sum(1)
        return pa.table({"vec_id": self.vec_id, "cluster": cluster, "distance": distance})


def first_centroids(vectors: DataFrame, count: int, seed: int) -> list[list[int]]:
    """The vectors whose ids hash lowest; `count` rows come to the driver."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r.parts for r in vectors.withColumn("_h", hashed).orderBy("_h", "vec_id", "parts").limit(count).select("parts").collect()]


def moved_centroids(heaps: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The floored means of the clusters; empty ones stay. Clusters x components sums come to the driver."""
    sums = heaps.select("cluster", F.posexplode("total").alias("k", "part")).groupBy("cluster", "k").agg(F.sum("part").alias("part"))
    counts = {r.cluster: r.n for r in heaps.groupBy("cluster").agg(F.sum(F.size("places")).alias("n")).collect()}
    out = [list(c) for c in centroids]
    for r in sums.collect():
        out[r.cluster][r.k] = r.part // counts[r.cluster]
    return out


def drifts(before: Iterable[list[int]], after: Iterable[list[int]]) -> np.ndarray:
    """How much closer each cluster's members may have come to another centroid than to their own."""
    step = np.array([math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y))) for x, y in zip(before, after)])
    furthest = [max(np.delete(step, c), default=0.0) for c in range(len(step))]
    return (step + furthest) * (1 + SLACK[1])


def round_of(centroids: np.ndarray, drift: np.ndarray, fresh: bool, final: bool) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """A block's part of a round: its heaps, or in the final one its vectors' clusters."""

    def settled(key: tuple, vectors: pa.Table, heaps: pa.Table) -> pa.Table:
        block = Block(vectors, heaps, centroids.shape[1], len(centroids))
        block.settle(centroids, drift, fresh)
        return block.assigned(centroids) if final else block.rows(key[0].as_py())

    return settled


def cluster_vectors(rows: DataFrame, clusters: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, seed: int = 2) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) of every vector that takes part, final centroids).

    `rows` has (vec_id, embedding). A vector takes part if its vec_id is not null and it has exactly `size`
    components, none null or non-finite, and none at or beyond 2**27 / `scale`, where squared distances would
    leave a long. Each row is a vector, whether its id or its components repeat or not. Centroids start as the vectors
    whose id hashes lowest (ties by components), fewer of them if there are fewer vectors; no vectors give no rows.

    The vectors are written once, in blocks, bucketed by block. A block keeps a heap for each cluster, of how
    much further than its own centroid any other is from a vector, plus the drift that the cluster had
    gathered when it was measured. A round pops what the drift has caught up with, measures only those exactly,
    and writes the heaps and the sums of their members, next to which the vectors are read in place.
    """
    spark = rows.sparkSession
    vectors = integer_vectors(rows, size, scale)
    centroids = first_centroids(vectors, clusters, seed)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    blocks = Blocks(spark, vectors)
    heaps = spark.createDataFrame([], HEAPS)
    drift = np.zeros(len(centroids))
    for n in range(rounds + 1):
        final = n == rounds
        settled = round_of(np.array(centroids, np.int64), drift, n == 0, final)
        both = blocks.vectors.groupBy("block").cogroup(heaps.groupBy("block"))
        if final:
            out = materialize(both.applyInArrow(settled, "vec_id long, cluster int, distance long"), "clusters")
            blocks.release()
            spark.sql(f"DROP TABLE IF EXISTS {blocks.tables[0]}")
            return out, centroids
        heaps = blocks.write(both.applyInArrow(settled, HEAPS), f"heaps{n}")
        blocks.release(keep=1)
        moved = moved_centroids(heaps, centroids)
        drift = drift + drifts(centroids, moved)
        centroids = moved
    raise AssertionError("unreachable")


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """The vectors with the summed distances of their cluster and of all, and a digest of their centroid.

    A sum that leaves a long is null. The sums and digests have a row for each cluster.
    """
    spark = assigned.sparkSession
    digests = spark.createDataFrame([(c, ",".join(map(str, parts))) for c, parts in enumerate(centroids)], "cluster int, parts string")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    told = sums.join(digests, "cluster").select(
        "cluster",
        F.col("s").try_cast("long").alias("cluster_inertia"),
        F.sum("s").over(Window.partitionBy()).try_cast("long").alias("inertia"),
        F.sha2(F.col("parts").cast("binary"), 256).alias("centroid_sha256"),
    )
    return assigned.join(told, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
