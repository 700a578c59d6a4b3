"""Readers and writers for the exchanged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of a trip file, in its order.
TRIP_COLUMNS = (
    "pickup_datetime",
    "dropoff_datetime",
    "passenger_count",
    "trip_distance",
    "fare_amount",
    "tip_amount",
    "total_amount",
    "payment_type",
    "pickup_zone_id",
    "dropoff_zone_id",
)

ZONE_CSV = "LocationID STRING, Borough STRING, Zone STRING, service_zone STRING"


class NotATable(ValueError):
    """The file does not hold a {columns, rows} table."""


def read_table(spark: SparkSession, path: str, row: T.StructType) -> DataFrame:
    """A `{columns, rows}` JSON table with an explicit row schema; a key a row lacks reads as null.

    One JSON document is one task's work whatever reads it, so this is for the small hand-carried
    tables; everything else is Parquet.
    """
    whole = T.StructType(
        [T.StructField("columns", T.ArrayType(T.StringType())), T.StructField("rows", T.ArrayType(row))]
    )
    raw = spark.read.schema(whole).option("multiLine", True).json(path)
    if not raw.filter(F.col("columns").isNull() | F.col("rows").isNull()).isEmpty():
        raise NotATable(f"{path} lacks columns or rows")
    declared = raw.select("columns").first()
    names = [name for name in declared["columns"] if name in row.names]
    return raw.select(F.explode("rows").alias("row")).select(*[F.col(f"row.{name}") for name in names])


def write_table(df: DataFrame, path: str) -> None:
    """Fingerprints ignore row order, so the file order needs no sort."""
    df.write.mode("errorifexists").parquet(path)


def read_trips(spark: SparkSession, path: str) -> DataFrame:
    """The ten journey columns of a columnar file; the others are never read."""
    return spark.read.parquet(path).select(*TRIP_COLUMNS)


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """A headed CSV lookup: numeric ids only, missing names as empty strings."""
    raw = spark.read.schema(ZONE_CSV).option("header", True).option("enforceSchema", False).csv(path)
    kept = raw.filter(F.trim("LocationID").rlike(r"^\d+$"))
    blank = F.lit("")
    return kept.select(
        F.trim("LocationID").cast("long").alias("zone_id"),
        F.coalesce("Zone", blank).alias("zone_name"),
        F.coalesce("Borough", blank).alias("borough"),
        F.coalesce("service_zone", blank).alias("service_zone"),
    )
