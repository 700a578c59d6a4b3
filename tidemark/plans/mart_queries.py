"""The built tables over journeys and orders derived from the whole order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.fingerprint import fingerprint
from tidemark.operators.change import change_kind
from tidemark.plans import marts as M
from tidemark.plans.registry import query

BOROUGHS = ("AFRICA", "AMERICA", "ASIA", "EUROPE")
LISTED = ", ".join(f"'{b}'" for b in BOROUGHS)
POSITION = ["trip_id", "passenger_count", "l_partkey", "l_suppkey", "l_quantity", "fare_amount"]


def ratio(n: str, d: str, digits: int) -> str:
    """n / d of whole numbers, rounded half up."""
    s = 10**digits
    return f"CASE WHEN ({d}) <> 0 THEN CAST((2 * {s} * CAST({n} AS HUGEINT) + CAST({d} AS HUGEINT)) // (2 * CAST({d} AS HUGEINT)) AS DOUBLE) / {s} END"


BUILT = {
    "clean": """
        SELECT order_id, customer, CAST(order_total AS DECIMAL(18, 2)) AS order_total, CAST(order_date AS DATE) AS order_date FROM (
          SELECT order_id, array_to_string(list_transform(string_split(regexp_replace(trim(customer), ' +', ' ', 'g'), ' '),
                   lambda w: upper(w[1]) || lower(w[2:])), ' ') AS customer, order_total, order_date FROM {raw_orders}) WHERE order_total > 0""",
    "ct": """
        SELECT trip_id, CAST(pickup_datetime AS DATE) AS pickup_date, CAST(hour(pickup_datetime) AS INT) AS pickup_hour, pickup_zone_id, dropoff_zone_id, passenger_count,
               CAST(round(trip_distance, 2) AS DECIMAL(18, 2)) AS trip_distance, CAST(round(fare_amount, 2) AS DECIMAL(18, 2)) AS fare_amount,
               CAST(round(tip_amount, 2) AS DECIMAL(18, 2)) AS tip_amount, CAST(round(total_amount, 2) AS DECIMAL(18, 2)) AS total_amount,
               CASE payment_type WHEN 1 THEN 'card' WHEN 2 THEN 'cash' WHEN 3 THEN 'no_charge' WHEN 4 THEN 'dispute' END AS payment_label
        FROM {trips} WHERE dropoff_datetime > pickup_datetime""",
    "cz": "SELECT zone_id, trim(zone_name) AS zone_name, borough FROM {zones}",
    "lt": """
        SELECT trip_id, pickup_date, pickup_hour, coalesce(p.borough, 'Unknown') AS pickup_borough, coalesce(p.zone_name, 'Unknown') AS pickup_zone,
               coalesce(d.borough, 'Unknown') AS dropoff_borough, coalesce(d.zone_name, 'Unknown') AS dropoff_zone, passenger_count, trip_distance,
               fare_amount, tip_amount, total_amount, payment_label
        FROM {ct} LEFT JOIN {cz} p ON p.zone_id = pickup_zone_id LEFT JOIN {cz} d ON d.zone_id = dropoff_zone_id""",
    "dt": """SELECT pickup_date, count(*) AS trips, CAST(sum(passenger_count) AS BIGINT) AS riders, CAST(sum(trip_distance) AS DOUBLE) AS total_distance,
                CAST(sum(fare_amount) AS DOUBLE) AS total_fares, sum(trip_distance) AS d2, sum(fare_amount) AS f2 FROM {ct} GROUP BY 1""",
    "pm": "SELECT pickup_date, payment_label, count(*) AS trips, sum(fare_amount) AS fare_total, sum(tip_amount) AS tip_total FROM {ct} GROUP BY 1, 2",
    "hp": f"SELECT pickup_hour, count(*) AS trips, {ratio('100 * sum(fare_amount)', '100 * count(*)', 2)} AS average_fare FROM {{ct}} GROUP BY 1",
    "tl": f"""SELECT pickup_date, CASE WHEN trip_distance < 2 THEN 'short' WHEN trip_distance <= 6 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS trips,
                {ratio('100 * sum(trip_distance)', '100 * count(*)', 2)} AS average_distance FROM {{ct}} GROUP BY 1, 2""",
    "marts": f"""SELECT CASE WHEN pickup_borough IN ({LISTED}) THEN pickup_borough ELSE 'Other' END AS borough, pickup_date, count(*) AS trips,
                sum(fare_amount) AS fares_total, sum(tip_amount) AS tips_total FROM {{lt}} GROUP BY 1, 2""",
    "weeks": """SELECT borough, CAST(sum(trips) AS BIGINT) AS trips, CAST(sum(fares_total) AS DOUBLE) AS fares_total, CAST(sum(tips_total) AS DOUBLE) AS tips_total,
                min_by(pickup_date, (-trips, pickup_date)) AS busiest_date FROM {marts} GROUP BY 1""",
    "fs": f"""SELECT pickup_date, total_fares, card_share FROM {{dt}} JOIN (SELECT pickup_date,
                {ratio("100 * coalesce(sum(fare_total) FILTER (payment_label = 'card'), 0)", '100 * sum(fare_total)', 4)} AS card_share FROM {{pm}} GROUP BY 1) USING (pickup_date)""",
    "tp": f"""SELECT payment_label, CAST(sum(trips) AS BIGINT) AS trips, CAST(sum(fare_total) AS DOUBLE) AS fare_total, CAST(sum(tip_total) AS DOUBLE) AS tip_total,
                coalesce({ratio('100 * sum(tip_total)', '100 * sum(fare_total)', 4)}, 0) AS tip_rate FROM {{pm}} GROUP BY 1""",
    "cb": "SELECT pickup_borough, dropoff_borough, count(*) AS trips FROM {lt} GROUP BY 1, 2",
    "dm": "SELECT dropoff_borough, count(*) AS trips FROM {lt} GROUP BY 1",
    "zl": """SELECT * FROM (SELECT row_number() OVER (ORDER BY count(*) DESC, pickup_zone, pickup_borough) AS rank, pickup_zone AS zone_name, pickup_borough AS borough, count(*) AS trips
                FROM {lt} GROUP BY pickup_zone, pickup_borough) WHERE rank <= 15""",
    "wp": "SELECT dayname(pickup_date) AS weekday, CAST(sum(trips) AS BIGINT) AS trips, CAST(sum(riders) AS BIGINT) AS riders FROM {dt} GROUP BY 1",
    "ap": """SELECT trip_id, pickup_date, pickup_zone, dropoff_zone, fare_amount, total_amount FROM {lt}
                WHERE contains(pickup_zone, 'Airport') OR contains(dropoff_zone, 'Airport')""",
    "ad": "SELECT pickup_date, count(*) AS trips, sum(fare_amount) AS fares_total FROM {ap} GROUP BY 1",
}
CENT = ("fare_amount", "tip_amount", "total_amount", "trip_distance", "fare_total", "tip_total", "fares_total", "tips_total", "order_total")


def plain(df):
    """Decimals as doubles, so both engines print them alike."""
    return df.select(*[F.col(c).cast("double").alias(c) if c in CENT else F.col(c) for c in df.columns])


def doubles(view: str, *columns: str) -> str:
    swapped = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({swapped}) FROM {{{view}}}"


def trips(e):
    return M.clean_trips(e.trips)


def labeled(e):
    return M.label_trips(trips(e), M.clean_zones(e.zones))


@query("p1_clean_orders", doubles("clean", "order_total"), **BUILT)
def _(e):
    return plain(M.clean_orders(e.raw_orders))


@query(
    "p2_daily_revenue",
    f"""SELECT order_date, CAST(sum(order_total) AS DOUBLE) AS total_revenue, count(*) AS order_count,
        {ratio('100 * sum(order_total)', '100 * count(*)', 2)} AS average_order_value FROM {{clean}} GROUP BY 1""",
    **BUILT,
)
def _(e):
    return M.daily_revenue(M.clean_orders(e.raw_orders))


@query(
    "p4_first_per_day",
    f"""SELECT trip_id, passenger_count, l_partkey, l_suppkey, l_quantity FROM (
          SELECT *, row_number() OVER (PARTITION BY CAST(pickup_datetime AS DATE) ORDER BY {', '.join(POSITION)}) AS nth FROM {{trips}}
          WHERE passenger_count > 0 AND trip_distance > 0 AND fare_amount > 0 AND total_amount > 0) WHERE nth <= 300""",
)
def _(e):
    first = M.first_per_day(e.trips, POSITION)
    return first.select("trip_id", "passenger_count", "l_partkey", "l_suppkey", "l_quantity")


@query("s2_read_trips", "SELECT trip_id, passenger_count, payment_type, pickup_zone_id, dropoff_zone_id FROM {trips}")
def _(e):
    return e.trips.select("trip_id", "passenger_count", "payment_type", "pickup_zone_id", "dropoff_zone_id")


@query("p5_clean_trips", doubles("ct", "trip_distance", "fare_amount", "tip_amount", "total_amount"), **BUILT)
def _(e):
    return plain(trips(e))


@query("p6_clean_zones", "SELECT * FROM {cz}", **BUILT)
def _(e):
    return M.clean_zones(e.zones)


@query("p7_labeled_trips", doubles("lt", "trip_distance", "fare_amount", "tip_amount", "total_amount"), **BUILT)
def _(e):
    return plain(labeled(e))


@query("p8_daily_trips", "SELECT pickup_date, trips, riders, total_distance, total_fares FROM {dt}", **BUILT)
def _(e):
    return M.daily_trips(trips(e))


@query("p9_payment_mix", doubles("pm", "fare_total", "tip_total"), **BUILT)
def _(e):
    return plain(M.payment_mix(trips(e)))


@query("p10_hourly_profile", "SELECT * FROM {hp}", **BUILT)
def _(e):
    return M.hourly_profile(trips(e))


@query("p11_trip_lengths", "SELECT * FROM {tl}", **BUILT)
def _(e):
    return M.ordered_lengths(M.trip_lengths(trips(e)))


@query("p12_borough_marts", f"SELECT borough, pickup_date, trips, CAST(fares_total AS DOUBLE) AS fares_total, CAST(tips_total AS DOUBLE) AS tips_total FROM {{marts}} WHERE borough <> 'Other'", **BUILT)
def _(e):
    return plain(M.borough_marts(labeled(e), BOROUGHS)).filter("borough <> 'Other'")


@query("p13_borough_mart_other", "SELECT pickup_date, trips, CAST(fares_total AS DOUBLE) AS fares_total, CAST(tips_total AS DOUBLE) AS tips_total FROM {marts} WHERE borough = 'Other'", **BUILT)
def _(e):
    return plain(M.borough_mart(labeled(e), BOROUGHS, inside=False))


@query("p14_borough_week", "SELECT * FROM {weeks} WHERE borough <> 'Other'", **BUILT)
def _(e):
    marks = labeled(e)
    return M.stack([M.borough_week(M.borough_mart(marks, [b]), b) for b in BOROUGHS])


@query("p14_p15_borough_weeks", "SELECT * FROM {weeks} ORDER BY borough", **BUILT)
def _(e):
    return M.borough_weeks(M.borough_marts(labeled(e), BOROUGHS)).orderBy("borough")


@query("p15_stacked_weeks", "SELECT * FROM {weeks}", **BUILT)
def _(e):
    marks = labeled(e)
    inside = [M.borough_week(M.borough_mart(marks, [b]), b) for b in BOROUGHS]
    return M.stack([*inside, M.borough_week(M.borough_mart(marks, BOROUGHS, inside=False), "Other")])


@query(
    "p16_city_week",
    f"""SELECT CAST(sum(trips) AS BIGINT) AS trips, CAST(sum(riders) AS BIGINT) AS riders, CAST(sum(d2) AS DOUBLE) AS total_distance, CAST(sum(f2) AS DOUBLE) AS total_fares,
        (SELECT {ratio("coalesce(sum(trips) FILTER (bucket = 'long'), 0)", 'sum(trips)', 4)} FROM {{tl}}) AS long_trip_share FROM {{dt}}""",
    **BUILT,
)
def _(e):
    return M.city_week(M.daily_trips(trips(e)), M.trip_lengths(trips(e)))


@query("p17_fare_summary", "SELECT * FROM {fs}", **BUILT)
def _(e):
    return M.fare_summary(M.daily_trips(trips(e)), M.payment_mix(trips(e)))


@query("p18_tips_by_payment", "SELECT * FROM {tp}", **BUILT)
def _(e):
    return M.tips_by_payment(M.payment_mix(trips(e)))


@query(
    "p19_revenue_overview",
    f"""SELECT (SELECT CAST(sum(f2) AS DOUBLE) FROM {{dt}}) AS total_fares_week,
        (SELECT {ratio('sum(CAST(round(card_share * 10000) AS BIGINT))', '10000 * count(card_share)', 4)} FROM {{fs}}) AS card_share_week,
        (SELECT min_by(payment_label, (-tip_rate, payment_label)) FROM {{tp}}) AS best_tip_payment, (SELECT max(tip_rate) FROM {{tp}}) AS best_tip_rate""",
    **BUILT,
)
def _(e):
    mix = M.payment_mix(trips(e))
    return M.revenue_overview(M.fare_summary(M.daily_trips(trips(e)), mix), M.tips_by_payment(mix))


@query("p20_cross_borough", "SELECT * FROM {cb}", **BUILT)
def _(e):
    return M.cross_borough(labeled(e))


@query("p21_dropoff_mix", "SELECT * FROM {dm} ORDER BY trips DESC, dropoff_borough", **BUILT)
def _(e):
    return M.dropoff_mix(labeled(e))


@query("p22_zone_leaders", "SELECT * FROM {zl}", **BUILT)
def _(e):
    return M.zone_leaders(labeled(e))


@query(
    "p23_movement_summary",
    """SELECT (SELECT min_by(pickup_borough, (-trips, pickup_borough, dropoff_borough)) FROM {cb}) AS top_flow_pickup,
              (SELECT min_by(dropoff_borough, (-trips, pickup_borough, dropoff_borough)) FROM {cb}) AS top_flow_dropoff,
              (SELECT max(trips) FROM {cb}) AS top_flow_trips, (SELECT zone_name FROM {zl} WHERE rank = 1) AS busiest_zone,
              (SELECT trips FROM {zl} WHERE rank = 1) AS busiest_zone_trips, (SELECT min_by(dropoff_borough, (-trips, dropoff_borough)) FROM {dm}) AS top_dropoff_borough""",
    **BUILT,
)
def _(e):
    marks = labeled(e)
    return M.movement_summary(M.cross_borough(marks), M.zone_leaders(marks), M.dropoff_mix(marks))


@query("p24_weekday_profile", "SELECT * FROM {wp}", **BUILT)
def _(e):
    return M.weekday_profile(M.daily_trips(trips(e)))


@query(
    "p25_weekend_summary",
    """SELECT CAST(sum(trips) FILTER (isodow(pickup_date) < 6) AS BIGINT) AS weekday_trips, CAST(sum(trips) FILTER (isodow(pickup_date) > 5) AS BIGINT) AS weekend_trips,
              CAST(sum(riders) FILTER (isodow(pickup_date) < 6) AS BIGINT) AS weekday_riders, CAST(sum(riders) FILTER (isodow(pickup_date) > 5) AS BIGINT) AS weekend_riders FROM {dt}""",
    **BUILT,
)
def _(e):
    return M.weekend_summary(M.daily_trips(trips(e)))


@query(
    "p26_rider_overview",
    """SELECT (SELECT min_by(weekday, (-trips, list_position(['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'], weekday))) FROM {wp}) AS busiest_weekday,
              (SELECT CAST(sum(riders) AS BIGINT) FROM {wp}) AS riders_week, (SELECT min_by(pickup_hour, (-trips, pickup_hour)) FROM {hp}) AS busiest_hour,
              (SELECT max(trips) FROM {hp}) AS trips_at_peak_hour""",
    **BUILT,
)
def _(e):
    return M.rider_overview(M.weekday_profile(M.daily_trips(trips(e))), M.hourly_profile(trips(e)))


@query("p27_airport_trips", doubles("ap", "fare_amount", "total_amount"), **BUILT)
def _(e):
    return plain(M.touching(labeled(e)))


@query("p28_airport_daily", doubles("ad", "fares_total"), **BUILT)
def _(e):
    return plain(M.airport_daily(M.touching(labeled(e))))


@query(
    "p29_airport_week",
    "SELECT CAST(sum(trips) AS BIGINT) AS trips, CAST(sum(fares_total) AS DOUBLE) AS fares_total, min_by(pickup_date, (-trips, pickup_date)) AS busiest_date FROM {ad}",
    **BUILT,
)
def _(e):
    return M.airport_week(M.airport_daily(M.touching(labeled(e))))


@query("p30_rename_is_schema_only", "SELECT 'schema' AS kind, (SELECT count(*) FROM {dt}) AS row_count", **BUILT)
def _(e):
    before = M.daily_trips(trips(e))
    was = fingerprint(before, "daily_trips").select("dataset", F.col("schema_fp").alias("s"), F.col("content_fp").alias("c"))
    now = fingerprint(M.rename_change(before, "riders", "passengers"), "daily_trips")
    kind = change_kind(F.col("s"), F.col("c"), F.col("schema_fp"), F.col("content_fp"))
    return now.join(was, "dataset").select(kind.alias("kind"), "row_count")


@query(
    "p31_plan_self_check",
    """SELECT flow, count(*) AS tables, 'several writers' AS problem FROM (SELECT flow, dataset FROM {writes} GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1
       UNION ALL SELECT flow, count(*), 'read but never produced' FROM (SELECT DISTINCT flow, dataset FROM {reads} r
         WHERE NOT EXISTS (SELECT 1 FROM {writes} w WHERE w.flow = r.flow AND w.dataset = r.dataset)
           AND NOT EXISTS (SELECT 1 FROM {outside} o WHERE o.flow = r.flow AND o.dataset = r.dataset)) GROUP BY 1""",
)
def _(e):
    return M.self_check(e.writes, e.reads, e.outside.select("flow", "dataset"))
