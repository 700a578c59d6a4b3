"""The one loop under every walk and fixpoint, and the edge layout it probes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import Scratch

#: Above this many edges on one key, the key's edges are spread over several partitions.
HOT_KEY_EDGES = 250_000

#: Held edges per partition, so the layout grows with the edges and not with a session setting.
EDGES_PER_PARTITION = 2_000_000


def grow(
    seed: DataFrame,
    step: Callable[[DataFrame, DataFrame, int], DataFrame],
    key: Sequence[str],
    max_rounds: int | None = None,
    label: str = "grow",
    first: int = 0,
) -> DataFrame:
    """Semi-naive closure: `step(frontier, reached, round)` proposes rows, new keys are kept.

    Each round writes only its own new rows, so the state is never rewritten and no plan is
    longer than one round. `seed` must hold each key once and `step` must return the seed's
    columns; a key is kept at the first round that reaches it. The result carries `round`.
    """
    scratch = Scratch(seed.sparkSession, label)
    columns = seed.columns
    frontier, rows = scratch.write(seed.withColumn("round", F.lit(first)), f"r{first}")
    schema = frontier.schema
    names = [f"r{first}"]
    n = first
    while rows > 0 and (max_rounds is None or n < max_rounds):
        n += 1
        reached = scratch.read_all(names, schema)
        found = step(frontier, reached, n).select(*columns).join(
            reached.select(*key), list(key), "left_anti"
        )
        frontier, rows = scratch.write(found.withColumn("round", F.lit(n)), f"r{n}")
        names.append(f"r{n}")
    return scratch.read_all(names, schema)


class EdgeIndex:
    """Edges laid out once by their probe key, so a loop shuffles only its frontier.

    The edges are computed once into the scratch space. Few edges stay there: the planner knows
    their exact size and broadcasts or shuffles them as that size says. Many are shuffled by key
    and held. A key with more than `hot` of them is split by a hash of its far end into pieces of
    about that size, and a probing row is copied to each piece, so one hub table read by a third of
    all tasks does not become one task's work.
    """

    def __init__(
        self,
        edges: DataFrame,
        key: Sequence[str],
        spread: Sequence[str],
        hot: int | None = None,
        rows: int | None = None,
    ):
        """`rows` is given when `edges` is a scratch table already, with its row count."""
        hot = HOT_KEY_EDGES if hot is None else hot
        self.on = self.key = list(key)
        spark = edges.sparkSession
        scratch = Scratch(spark, "edges")
        if rows is None:
            edges, rows = scratch.write(edges, "edges")
        self.salted = self.held = False
        if rows > hot:
            heavy = (
                edges.groupBy(*self.key)
                .agg(F.count(F.lit(1)).alias("_n"))
                .filter(F.col("_n") > hot)
                .select(*self.key, F.ceil(F.col("_n") / hot).cast("int").alias("_fan"))
            )
            self.heavy, found = scratch.write(heavy, "heavy")
            self.salted = found > 0
            if self.salted:
                salt = F.when(F.col("_fan").isNull(), F.lit(0)).otherwise(
                    F.pmod(F.xxhash64(*spread), F.col("_fan")).cast("int")
                )
                edges = (
                    edges.join(self.heavy, self.key, "left").withColumn("_salt", salt).drop("_fan")
                )
                self.on = [*self.key, "_salt"]
            configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
            parts = max(configured, -(-rows // EDGES_PER_PARTITION))
            edges = edges.repartition(parts, *self.on).persist(StorageLevel.MEMORY_AND_DISK)
            self.held = True
        self.edges = edges

    def probe(self, rows: DataFrame) -> DataFrame:
        """Inner join of `rows` with the edges on the key."""
        if self.salted:
            pieces = F.sequence(F.lit(0), F.coalesce("_fan", F.lit(1)) - 1)
            rows = (
                rows.join(self.heavy, self.key, "left").withColumn("_salt", F.explode(pieces)).drop("_fan")
            )
        return rows.join(self.edges, self.on).drop("_salt")

    def release(self) -> None:
        if self.held:
            self.edges.unpersist()
