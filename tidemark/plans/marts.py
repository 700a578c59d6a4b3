"""The tables the watched jobs build: cleaning, labelling, daily marts and one-row rollups.

Lookups are joined without hints: the planner broadcasts them by their measured size. Every rollup
is an aggregate with a map-side combine; "busiest" picks are `max_by` aggregates, not sorts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.money import half_up, mean_money, share

#: Payment codes and their words, distance buckets in order.
PAYMENT_LABELS = {1: "card", 2: "cash", 3: "no_charge", 4: "dispute"}
BUCKETS = ("short", "medium", "long")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONEY = "decimal(18,2)"


def money(c: Column) -> Column:
    return F.round(c, 2).cast(MONEY)


def total(name: str) -> Column:
    return F.sum(name).cast("double")


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row frames as one row: stacked, then each column's one value picked. No cross join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])


def one_of(values: Column, codes: Mapping[int, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return table[values]


def earliest_best(value: str, measure: str) -> Column:
    """The value with the largest measure, the smallest such value on a tie."""
    return F.min_by(value, F.struct(-F.col(measure), F.col(value)))


# -- orders ------------------------------------------------------------------------------------


def clean_orders(raw: DataFrame) -> DataFrame:
    name = F.initcap(F.regexp_replace(F.trim("customer"), " +", " "))
    return raw.select(
        "order_id",
        name.alias("customer"),
        F.col("order_total").cast(MONEY).alias("order_total"),
        F.to_date("order_date").alias("order_date"),
    ).filter(F.col("order_total") > 0)


def daily_revenue(clean: DataFrame) -> DataFrame:
    per_day = clean.groupBy("order_date").agg(F.sum("order_total").alias("taken"), F.count(F.lit(1)).alias("order_count"))
    return per_day.select(
        "order_date",
        F.col("taken").cast("double").alias("total_revenue"),
        "order_count",
        mean_money(F.col("taken"), F.col("order_count")).alias("average_order_value"),
    ).orderBy("order_date")


# -- trips -------------------------------------------------------------------------------------


def qualifying(trips: DataFrame) -> DataFrame:
    return trips.filter(
        "pickup_datetime IS NOT NULL AND dropoff_datetime IS NOT NULL AND passenger_count > 0 AND trip_distance > 0 "
        "AND fare_amount > 0 AND total_amount > 0 AND tip_amount IS NOT NULL AND pickup_zone_id IS NOT NULL "
        "AND dropoff_zone_id IS NOT NULL AND payment_type IN (1, 2, 3, 4)"
    )


def first_per_day(trips: DataFrame, position: Sequence[str], per_day: int = 300) -> DataFrame:
    """The first qualifying trips of each day, in the order `position` gives.

    A rank filter this small is applied within each partition before the shuffle, so a busy day
    sends at most `per_day` rows from each.
    """
    day = Window.partitionBy(F.to_date("pickup_datetime")).orderBy(*position)
    return qualifying(trips).withColumn("nth", F.row_number().over(day)).filter(F.col("nth") <= per_day).drop("nth")


def clean_trips(trips: DataFrame) -> DataFrame:
    kept = trips.filter(F.col("dropoff_datetime") > F.col("pickup_datetime"))
    return kept.select(
        "trip_id",
        F.to_date("pickup_datetime").alias("pickup_date"),
        F.hour("pickup_datetime").alias("pickup_hour"),
        "pickup_zone_id",
        "dropoff_zone_id",
        "passenger_count",
        money(F.col("trip_distance")).alias("trip_distance"),
        money(F.col("fare_amount")).alias("fare_amount"),
        money(F.col("tip_amount")).alias("tip_amount"),
        money(F.col("total_amount")).alias("total_amount"),
        one_of(F.col("payment_type"), PAYMENT_LABELS).alias("payment_label"),
    )


def clean_zones(zones: DataFrame) -> DataFrame:
    return zones.select("zone_id", F.trim("zone_name").alias("zone_name"), F.trim("borough").alias("borough"))


def label_trips(trips: DataFrame, zones: DataFrame) -> DataFrame:
    def side(name: str) -> DataFrame:
        return zones.select(
            F.col("zone_id").alias(f"{name}_zone_id"),
            F.col("borough").alias(f"{name}_borough"),
            F.col("zone_name").alias(f"{name}_zone"),
        )

    joined = trips.join(side("pickup"), "pickup_zone_id", "left").join(side("dropoff"), "dropoff_zone_id", "left")
    words = [
        F.coalesce(f"{name}_{what}", F.lit("Unknown")).alias(f"{name}_{what}")
        for name in ("pickup", "dropoff")
        for what in ("borough", "zone")
    ]
    carried = ("passenger_count", "trip_distance", "fare_amount", "tip_amount", "total_amount", "payment_label")
    return joined.select("trip_id", "pickup_date", "pickup_hour", *words, *carried)


def daily_trips(trips: DataFrame) -> DataFrame:
    return trips.groupBy("pickup_date").agg(
        F.count(F.lit(1)).alias("trips"),
        F.sum("passenger_count").alias("riders"),
        total("trip_distance").alias("total_distance"),
        total("fare_amount").alias("total_fares"),
    )


def payment_mix(trips: DataFrame) -> DataFrame:
    return trips.groupBy("pickup_date", "payment_label").agg(
        F.count(F.lit(1)).alias("trips"),
        F.sum("fare_amount").alias("fare_total"),
        F.sum("tip_amount").alias("tip_total"),
    )


def hourly_profile(trips: DataFrame) -> DataFrame:
    return trips.groupBy("pickup_hour").agg(
        F.count(F.lit(1)).alias("trips"), mean_money(F.sum("fare_amount"), F.count(F.lit(1))).alias("average_fare")
    )


def trip_lengths(trips: DataFrame) -> DataFrame:
    far = F.col("trip_distance")
    bucket = F.when(far < 2, BUCKETS[0]).when(far <= 6, BUCKETS[1]).otherwise(BUCKETS[2])
    return trips.groupBy("pickup_date", bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("trips"), mean_money(F.sum("trip_distance"), F.count(F.lit(1))).alias("average_distance")
    )


def ordered_lengths(lengths: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), F.col("bucket"))
    return lengths.orderBy("pickup_date", rank)


def borough_mart(labeled: DataFrame, boroughs: Sequence[str], inside: bool = True) -> DataFrame:
    """Per-day totals of pickups in the named boroughs, or in none of them."""
    chosen = F.col("pickup_borough").isin(*boroughs)
    return labeled.filter(chosen if inside else ~chosen).groupBy("pickup_date").agg(
        F.count(F.lit(1)).alias("trips"),
        F.sum("fare_amount").alias("fares_total"),
        F.sum("tip_amount").alias("tips_total"),
    )


def borough_marts(labeled: DataFrame, boroughs: Sequence[str], other: str = "Other") -> DataFrame:
    """Every borough's mart in one pass over the journeys; what is in none of them is `other`."""
    named = F.when(F.col("pickup_borough").isin(*boroughs), F.col("pickup_borough")).otherwise(other)
    return labeled.groupBy(named.alias("borough"), "pickup_date").agg(
        F.count(F.lit(1)).alias("trips"),
        F.sum("fare_amount").alias("fares_total"),
        F.sum("tip_amount").alias("tips_total"),
    )


def borough_weeks(marts: DataFrame) -> DataFrame:
    """Every borough's one-row rollup, in one pass over the marts."""
    return marts.groupBy("borough").agg(
        F.sum("trips").alias("trips"),
        total("fares_total").alias("fares_total"),
        total("tips_total").alias("tips_total"),
        earliest_best("pickup_date", "trips").alias("busiest_date"),
    )


def borough_week(mart: DataFrame, label: str) -> DataFrame:
    return mart.agg(
        F.lit(label).alias("borough"),
        F.sum("trips").alias("trips"),
        total("fares_total").alias("fares_total"),
        total("tips_total").alias("tips_total"),
        earliest_best("pickup_date", "trips").alias("busiest_date"),
    )


def stack(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def city_week(daily: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row from two sources."""
    days = daily.agg(
        F.sum("trips").alias("trips"),
        F.sum("riders").alias("riders"),
        F.round(F.sum("total_distance"), 2).alias("total_distance"),
        F.round(F.sum("total_fares"), 2).alias("total_fares"),
    )
    far = lengths.agg(F.sum(F.when(F.col("bucket") == "long", F.col("trips")).otherwise(0)).alias("n"), F.sum("trips").alias("d"))
    return side_by_side(days, far.select(half_up(F.col("n"), F.col("d"), 4).alias("long_trip_share")))


def fare_summary(daily: DataFrame, mix: DataFrame) -> DataFrame:
    card = F.sum(F.when(F.col("payment_label") == "card", F.col("fare_total")).otherwise(F.lit(0).cast(MONEY)))
    shares = mix.groupBy("pickup_date").agg(share(card, F.sum("fare_total")).alias("card_share"))
    return daily.select("pickup_date", "total_fares").join(shares, "pickup_date")


def tips_by_payment(mix: DataFrame) -> DataFrame:
    rate = F.coalesce(share(F.sum("tip_total"), F.sum("fare_total")), F.lit(0.0))
    return mix.groupBy("payment_label").agg(
        F.sum("trips").alias("trips"),
        total("fare_total").alias("fare_total"),
        total("tip_total").alias("tip_total"),
        rate.alias("tip_rate"),
    )


def revenue_overview(fares: DataFrame, tips: DataFrame) -> DataFrame:
    mean_share = half_up(F.sum(F.round(F.col("card_share") * 10000).cast("long")), F.count("card_share") * 10000, 4)
    week = fares.agg(F.round(F.sum("total_fares"), 2).alias("total_fares_week"), mean_share.alias("card_share_week"))
    best = tips.agg(
        earliest_best("payment_label", "tip_rate").alias("best_tip_payment"), F.max("tip_rate").alias("best_tip_rate")
    )
    return side_by_side(week, best)


def cross_borough(labeled: DataFrame) -> DataFrame:
    return labeled.groupBy("pickup_borough", "dropoff_borough").agg(F.count(F.lit(1)).alias("trips"))


def dropoff_mix(labeled: DataFrame) -> DataFrame:
    counted = labeled.groupBy("dropoff_borough").agg(F.count(F.lit(1)).alias("trips"))
    return counted.orderBy(F.desc("trips"), "dropoff_borough")


def zone_leaders(labeled: DataFrame, top: int = 15) -> DataFrame:
    """The busiest pickup zones; only the top rows are ever gathered to be numbered."""
    counted = labeled.groupBy(F.col("pickup_zone").alias("zone_name"), F.col("pickup_borough").alias("borough")).agg(
        F.count(F.lit(1)).alias("trips")
    )
    order = [F.desc("trips"), F.asc("zone_name"), F.asc("borough")]
    leaders = counted.orderBy(*order).limit(top)
    return leaders.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "zone_name", "borough", "trips")


def movement_summary(flows: DataFrame, leaders: DataFrame, dropoffs: DataFrame) -> DataFrame:
    pair = F.struct("pickup_borough", "dropoff_borough", "trips")
    top = flows.agg(F.min_by(pair, F.struct(-F.col("trips"), F.col("pickup_borough"), F.col("dropoff_borough"))).alias("t")).select(
        F.col("t.pickup_borough").alias("top_flow_pickup"),
        F.col("t.dropoff_borough").alias("top_flow_dropoff"),
        F.col("t.trips").alias("top_flow_trips"),
    )
    zone = leaders.filter("rank = 1").agg(F.max("zone_name").alias("busiest_zone"), F.max("trips").alias("busiest_zone_trips"))
    ended = dropoffs.agg(earliest_best("dropoff_borough", "trips").alias("top_dropoff_borough"))
    return side_by_side(top, zone, ended)


def weekday_profile(daily: DataFrame, riders: str = "riders") -> DataFrame:
    """Trips and riders by day name; the rider column is named by its role."""
    day = F.date_format("pickup_date", "EEEE").alias("weekday")
    return daily.groupBy(day).agg(F.sum("trips").alias("trips"), F.sum(riders).alias("riders"))


def weekend_summary(daily: DataFrame, riders: str = "riders") -> DataFrame:
    weekend = F.weekday("pickup_date") >= 5
    pick = lambda name, side: F.sum(F.when(side, F.col(name)).otherwise(0))
    return daily.agg(
        pick("trips", ~weekend).alias("weekday_trips"),
        pick("trips", weekend).alias("weekend_trips"),
        pick(riders, ~weekend).alias("weekday_riders"),
        pick(riders, weekend).alias("weekend_riders"),
    )


def rider_overview(weekdays: DataFrame, hours: DataFrame) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col("weekday"))
    days = weekdays.agg(
        F.min_by("weekday", F.struct(-F.col("trips"), place)).alias("busiest_weekday"), F.sum("riders").alias("riders_week")
    )
    peak = hours.agg(earliest_best("pickup_hour", "trips").alias("busiest_hour"), F.max("trips").alias("trips_at_peak_hour"))
    return side_by_side(days, peak)


def touching(labeled: DataFrame, word: str = "Airport") -> DataFrame:
    seen = F.col("pickup_zone").contains(word) | F.col("dropoff_zone").contains(word)
    return labeled.filter(seen).select(
        "trip_id", "pickup_date", "pickup_zone", "dropoff_zone", "fare_amount", "total_amount"
    )


def airport_daily(trips: DataFrame) -> DataFrame:
    return trips.groupBy("pickup_date").agg(F.count(F.lit(1)).alias("trips"), F.sum("fare_amount").alias("fares_total"))


def airport_week(daily: DataFrame) -> DataFrame:
    return daily.agg(
        F.sum("trips").alias("trips"),
        total("fares_total").alias("fares_total"),
        earliest_best("pickup_date", "trips").alias("busiest_date"),
    )


def rename_change(df: DataFrame, one: str, other: str) -> DataFrame:
    """The same rows with one column renamed, whichever way the recorded columns call for."""
    return df.withColumnRenamed(one, other) if one in df.columns else df.withColumnRenamed(other, one)


def self_check(writes: DataFrame, reads: DataFrame, seeds: DataFrame) -> DataFrame:
    """Tables written twice and tables read that nothing produces, which a sound plan has none of."""
    twice = writes.groupBy("flow", "dataset").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    unmade = (
        reads.select("flow", "dataset")
        .distinct()
        .join(writes.select("flow", "dataset"), ["flow", "dataset"], "left_anti")
        .join(seeds, ["flow", "dataset"], "left_anti")
    )
    said = lambda df, word: df.groupBy("flow").agg(F.count(F.lit(1)).alias("tables")).withColumn("problem", F.lit(word))
    return said(twice, "several writers").unionByName(said(unmade, "read but never produced"))
