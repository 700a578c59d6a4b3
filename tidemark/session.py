"""Session settings and the shared scratch space that iterative jobs write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int = 8, app: str = "tidemark", **extra: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.ui.retainedExecutions", "5")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names, or a temporary one on a local master only."""
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


class Scratch:
    """A run's own directory of Parquet tables under the checkpoint root.

    Writing a table cuts lineage as a checkpoint does, survives lost executors, and gives the
    next plan exact sizes to choose its joins from.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """Write `df` and return it read back, with the row count seen while writing."""
        seen = Observation()
        target = f"{self.path}/{name}"
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(target)
        return self.spark.read.schema(df.schema).parquet(target), int(seen.get["rows"])

    def read_all(self, names: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Compute `df` once into the scratch space, where several later plans read it."""
    return Scratch(df.sparkSession, label).write(df, "t")[0]
