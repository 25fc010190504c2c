"""A vehicle's day, snapshots at a time, and pairs of near buses."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspan.functions import geo
from fleetspan.functions.stats import percentiles

SECOND = 1_000_000
#: Seconds: a report gap that is listed; when a ping is stale, and when it is gone.
REPORT_GAP, STALE, GONE = 120, 60, 120
EARTH = 6_371_000.0
METRES_A_DEGREE = 111_320.0


def _day() -> Window:
    return Window.partitionBy("day", "agency_id", "vehicle_id").orderBy("created_us", "event_id")


def line_periods(pings: DataFrame) -> DataFrame:
    """Runs of consecutive pings of one line and trip: start, end, number."""
    w = _day()
    key = F.struct("line", "trip_id")
    p = pings.withColumn("new", F.when(key.eqNullSafe(F.lag(key).over(w)), 0).otherwise(1)).withColumn("period", F.sum("new").over(w))
    return p.groupBy("day", "agency_id", "vehicle_id", "period", "line", "trip_id").agg(F.min("created_us").alias("starts"), F.max("created_us").alias("ends"), F.count("*").alias("pings"))


def report_gaps(pings: DataFrame, least: int = REPORT_GAP) -> DataFrame:
    """Pauses of more than `least` seconds between a vehicle's pings, and whether its line, trip, stop or area (of its geohash, five characters) changed."""
    w = _day()
    p = pings.withColumn("area", geo.geohash(F.col("lat"), F.col("lon"), 5))
    flags = {"line": "line", "trip": "trip_id", "stop": "stop_id", "area": "area"}
    p = p.withColumn("b", F.lag(F.struct("created_us", *flags.values())).over(w))
    p = p.withColumn("gap_s", F.bround((F.col("created_us") - F.col("b.created_us")) / SECOND).cast("long")).where(F.col("created_us") - F.col("b.created_us") > least * SECOND)
    return p.select("day", "vehicle_id", "event_id", "gap_s", *[(~F.col(f"b.{c}").eqNullSafe(F.col(c))).alias(f"{name}_changed") for name, c in flags.items()])


def encounters(pings: DataFrame) -> DataFrame:
    """The first ping of each run of one trip and stop."""
    w = _day()
    key = F.struct("trip_id", "stop_id")
    return pings.withColumn("same", key.eqNullSafe(F.lag(key).over(w))).where("not same").select("day", "vehicle_id", "trip_id", "stop_id", "created_us", "event_id")


def day_lines(pings: DataFrame) -> DataFrame:
    """Per vehicle, day and line: trips, stops, pings, first and last."""
    return pings.groupBy("day", "vehicle_id", "line").agg(F.array_join(F.array_sort(F.collect_set("trip_id")), ",").alias("trips"), F.countDistinct("stop_id").alias("stops"), F.count("*").alias("pings"), F.min("created_us").alias("first_us"), F.max("created_us").alias("last_us"))


def snapshot(pings: DataFrame, at_us: int) -> DataFrame:
    """The latest ping of each vehicle up to a time and not older than GONE seconds, with its age; over STALE it is stale."""
    p = pings.where(F.col("created_us").between(at_us - GONE * SECOND, at_us))
    s = p.groupBy("agency_id", "vehicle_id").agg(F.max_by(F.struct("event_id", "created_us", "lat", "lon", "line"), F.struct("created_us", "event_id")).alias("p"))
    age = (F.lit(at_us) - F.col("p.created_us")) / SECOND
    return s.select("agency_id", "vehicle_id", "p.event_id", "p.line", age.alias("age_s"), (age > STALE).alias("stale"))


def ticks(pings: DataFrame, step: int) -> DataFrame:
    """The latest ping of each vehicle at each tick of `step` seconds at which it is not gone."""
    first = F.ceil(F.col("created_us") / (step * SECOND)) * step * SECOND
    p = pings.withColumn("tick", F.explode(F.sequence(first, F.greatest(first, F.floor((F.col("created_us") + GONE * SECOND) / (step * SECOND)) * step * SECOND), F.lit(step * SECOND))))
    p = p.where(F.col("tick") - F.col("created_us") <= GONE * SECOND)
    return p.groupBy("tick", "agency_id", "vehicle_id").agg(F.max_by(F.struct("line", "direction_id", "lat", "lon"), F.struct("created_us", "event_id")).alias("p")).select("tick", "agency_id", "vehicle_id", "p.*")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(a))


def near_pairs(at: DataFrame, metres: float, keys: tuple[str, ...] = ("tick", "agency_id", "line", "direction_id")) -> DataFrame:
    """Pairs of vehicles of one key at most so far apart, anywhere on the globe.

    Places are put in rows of latitude and, in each row, in as many equal cells around the globe as keep them wide enough at the row's cold end. A vehicle is joined
    with the nine cells around its place in its own and both neighbouring rows' cells, so only neighbours meet.
    """
    high = math.degrees(metres / EARTH) * 1.001
    row = F.floor(F.col("lat") / high)

    def cells(r: Column) -> Column:
        cold = F.least((F.greatest(F.abs(r), F.abs(r + 1)) + 1) * high, F.lit(90.0))
        return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(cold)) / (1.6 * high)))  # a chord's longitudes differ by less than pi / 2 times its share of the circle

    place = lambda r: F.floor((F.col("lon") + 180) / 360 * cells(r))
    a = at.select(*keys, F.col("vehicle_id").alias("v1"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), row.alias("y"), F.pmod(place(row), cells(row)).alias("x"))
    around = F.array_distinct(F.array(*[F.struct((row + j).alias("y"), F.pmod(place(row + j) + i, cells(row + j)).alias("x")) for j in (-1, 0, 1) for i in (-1, 0, 1)]))
    b = at.select(*keys, F.col("vehicle_id").alias("v2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.explode(around).alias("c")).select(*keys, "v2", "lat2", "lon2", "c.*")
    m = haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return a.join(b, [*keys, "x", "y"]).where("v1 < v2").withColumn("metres", m).where(F.col("metres") <= metres).select(*keys, "v1", "v2", "metres")


def contract(pings: DataFrame, order: str = "event_id", chunk: int = 1 << 16) -> DataFrame:
    """One row: violations of each rule of the replay contract. unsorted: rows earlier than the row before them in the file, whose rows `order` numbers.

    Order is checked within chunks of row numbers, and then between the ends of chunks, so that no task has the whole file.
    """
    p = pings.withColumn("chunk", F.floor(F.col(order) / chunk))
    p = p.withColumn("back", F.lag("created_us").over(Window.partitionBy("chunk").orderBy(order)) > F.col("created_us"))
    bad = lambda c, most: F.count_if(F.isnull(c) | F.isnan(c) | (F.abs(c) > most))
    g = p.groupBy("chunk").agg(F.count("*").alias("pings"), F.count_if("back").alias("unsorted"), (bad(F.col("lat"), 90) + bad(F.col("lon"), 180)).alias("no_place"), F.count_if(F.coalesce(F.trim("vehicle_id"), F.lit("")) == "").alias("no_vehicle"), F.count_if(F.col("received_us") < F.col("created_us")).alias("early"), F.min_by("created_us", order).alias("first"), F.max_by("created_us", order).alias("last"))
    g = g.withColumn("seam", F.coalesce(F.lag("last").over(Window.orderBy("chunk")) > F.col("first"), F.lit(False)))  # a row a chunk
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return g.agg(total("pings"), (F.coalesce(F.sum("unsorted"), F.lit(0)) + F.count_if("seam")).alias("unsorted"), total("no_place"), total("no_vehicle"), total("early"))


def latency(pings: DataFrame) -> DataFrame:
    """Median seconds between a ping and its receipt, per agency."""
    p = pings.select("agency_id", ((F.col("received_us") - F.col("created_us")) / SECOND).alias("late"))
    return percentiles(p, ["agency_id"], "late", {"median_s": 0.5}).join(p.groupBy("agency_id").agg(F.count("*").alias("pings")), "agency_id")
