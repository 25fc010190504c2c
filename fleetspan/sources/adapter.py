"""Transit-shaped tables derived from the star-schema tables: pings from events, plans from nations, jams from orders.

Every derivation is a projection or a grouping of a given table, so the tables grow with it. 30 days of events are folded to a week, each user is a vehicle
of one line and direction with two trips a day, a ping's timetable time lies `value` seconds before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Users of a district, which has five lines with stops of their own, so that lines and stops grow with users.
USERS = 150
#: Stops of a line; days of the folded week; the first of them is a Monday.
STOPS, DAYS, MONDAY = 6, 7, "2024-01-01"
WEEK_US = 1_704_067_200_000_000
DAY_US = 86_400_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, agency_id, vehicle_id, trip_id, line, direction_id, stop_id, seq, day, created_us, received_us, sched_us, lat, lon, event_type."""
    return pings_of(_table(spark, sf_dir, "events"))


def pings_of(events: DataFrame) -> DataFrame:
    """The same of an events table or stream."""
    e = events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")) - WEEK_US)
    day = F.pmod(F.floor(F.col("us") / DAY_US), F.lit(DAYS))
    of_day = F.pmod(F.col("us"), F.lit(DAY_US))
    e = e.select("event_id", "user_id", "event_type", F.round(F.col("value") * 1_000_000).cast("long").alias("late_us"), day.cast("int").alias("d"), of_day.alias("of_day"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    created = F.lit(WEEK_US) + F.col("d") * F.lit(DAY_US) + F.lit(6 * 3600 * 1_000_000) + F.floor(F.col("of_day") / 2)
    e = e.withColumn("created_us", created.cast("long"))
    s = F.pmod("k", F.lit(STOPS)).cast("int")
    district = F.floor(F.col("user_id") / USERS)
    half = F.floor(F.col("of_day") / (DAY_US / 2)).cast("int")
    return e.select(
        "event_id",
        F.concat(F.lit("A"), F.pmod("user_id", F.lit(5)).cast("string")).alias("agency_id"),
        F.concat(F.lit("V"), F.col("user_id").cast("string")).alias("vehicle_id"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.col("d").cast("string"), half.cast("string")).alias("trip_id"),
        F.concat(F.lit("L"), (district * 5 + F.pmod("user_id", F.lit(5))).cast("string")).alias("line"),
        F.pmod(F.floor(F.col("user_id") / 5), F.lit(2)).cast("string").alias("direction_id"),
        F.concat(F.lit("S"), (district * STOPS + s).cast("string")).alias("stop_id"),
        (s + 1).alias("seq"),
        F.date_add(F.lit(MONDAY).cast("date"), F.col("d")).alias("day"),
        "created_us",
        (F.col("created_us") + F.col("late_us")).alias("received_us"),
        (F.col("created_us") - F.col("late_us")).alias("sched_us"),
        ((s * 400 + F.pmod("event_id", F.lit(97)) + 3_870_000) / 100_000).alias("lat"),  # in whole units: rounded once, like a decimal
        ((F.pmod("user_id", F.lit(5)) * 300 + F.pmod(district, F.lit(500)) * 2000 + F.pmod("event_id", F.lit(89)) - 920_000) / 100_000).alias("lon"),
        "event_type",
    )


def plan_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, agency_id, active_from, active_until: plans of each agency follow each other, and each overlaps the next by a day."""
    n = _table(spark, sf_dir, "nation")
    start = F.pmod(F.floor(F.col("n_nationkey") / 5), F.lit(5)) * 2
    return n.select(
        F.col("n_nationkey").cast("long").alias("id"),
        F.concat(F.lit("A"), F.pmod("n_nationkey", F.lit(5)).cast("string")).alias("agency_id"),
        F.date_add(F.lit(MONDAY).cast("date"), start.cast("int")).alias("active_from"),
        F.date_add(F.lit(MONDAY).cast("date"), (start + 2).cast("int")).alias("active_until"),
    )


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trip_id, stop_id, stop_sequence, sched_us, clock: the timetable of each trip, one row a stop."""
    p = pings(spark, sf_dir).groupBy("day", "trip_id", "line", "direction_id", "stop_id", "seq").agg(F.min("sched_us").alias("sched_us"))
    seconds = F.floor((F.col("sched_us") - F.unix_date("day").cast("long") * DAY_US) / 1_000_000)
    clock = F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.pmod(F.floor(seconds / 60), F.lit(60)), F.pmod(seconds, F.lit(60)))
    return p.select("day", "trip_id", "line", "direction_id", "stop_id", F.col("seq").alias("stop_sequence"), "sched_us", clock.alias("clock"))


#: Intensity labels of jam reports, by order priority 1 to 5.
INTENSITIES = ["80% - 61%", "60% - 41%", "40% - 21%", "20% - 1%", "Via bloqueada"]


def jams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jam_id, geometry_wkt, intensity, day, minute, speed_kmh: orders as jam reports on a road of nine pieces."""
    o = _table(spark, sf_dir, "orders")
    piece = F.pmod("o_custkey", F.lit(9))
    at = lambda i: F.format_string("%.3f %.3f", F.lit(-9.2) + (piece + i) * 0.001, F.lit(38.7) + (piece + i) * 0.001)
    level = F.substring("o_orderpriority", 1, 1).cast("int")
    return o.select(
        F.col("o_orderkey").alias("jam_id"),
        F.concat(F.lit("LINESTRING("), at(0), F.lit(", "), at(1), F.lit(")")).alias("geometry_wkt"),
        F.element_at(F.array(*map(F.lit, INTENSITIES)), level).alias("intensity"),
        F.to_date("o_orderdate").alias("day"),
        (F.pmod("o_orderkey", F.lit(48)) * 30).cast("int").alias("minute"),
        F.when(F.pmod("o_orderkey", F.lit(7)) > 0, F.round(F.col("o_totalprice") / 10000, 3)).alias("speed_kmh"),
    )


def scenario_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line, scenario, k, day, seed, saved, vehicles, hold, wait: line items as rows of a scenario study."""
    i = _table(spark, sf_dir, "lineitem")
    return i.select(
        F.col("l_returnflag").alias("line"),
        F.col("l_linenumber").cast("string").alias("scenario"),
        F.col("l_linestatus").alias("k"),
        F.pmod(F.col("l_orderkey"), F.lit(5)).cast("int").alias("day"),
        F.col("l_suppkey").alias("seed"),
        (F.col("l_quantity") - 20 + F.col("l_linenumber") * 4).alias("saved"),
        F.pmod(F.col("l_linenumber"), F.lit(3)).cast("int").alias("vehicles"),
        (F.col("l_linenumber") * 7 % 5).cast("int").alias("hold"),
        (F.col("l_linenumber") * 3 % 4).cast("int").alias("wait"),
    )
