"""Data-quality reports on pings, timetables, tracks and jams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspan.functions.stats import percentiles
from fleetspan.operators.passages import TRIP
from fleetspan.operators.vehicles import haversine

SECOND = 1_000_000


def share(c: Column) -> Column:
    return F.avg(c.cast("double"))


def ping_quality(p: DataFrame) -> DataFrame:
    """Per agency: pings, those without a stop and with one that is no number, vehicles and those that other agencies use too, share of re-sends, median latency."""
    keys = ["agency_id", "vehicle_id", "trip_id", "stop_id"]
    stop = F.coalesce("stop_id", F.lit(""))
    copies = p.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(stop == "").alias("no_stop"), F.count_if(~stop.rlike("^[0-9]*$")).alias("odd_stop"))
    a = copies.groupBy("agency_id").agg(F.sum("n").alias("pings"), F.sum("no_stop").alias("no_stop"), F.sum("odd_stop").alias("odd_stop"), F.countDistinct("vehicle_id").alias("vehicles"), (1 - F.count("*") / F.sum("n")).alias("repeat_share"))
    used = copies.select("agency_id", "vehicle_id").distinct().withColumn("agencies", F.count("*").over(Window.partitionBy("vehicle_id")))
    shared = used.groupBy("agency_id").agg(F.count_if(F.col("agencies") > 1).alias("shared_vehicles"))
    late = percentiles(p.select("agency_id", ((F.col("received_us") - F.col("created_us")) / SECOND).alias("late")), ["agency_id"], "late", {"median_latency_s": 0.5})
    return a.join(shared, "agency_id").join(late, "agency_id")


def timetable_quality(v: DataFrame, seconds: Column) -> DataFrame:
    """One row: visits, trips, share at or past 24:00, share of flat trips."""
    t = v.groupBy("trip_id").agg(F.count("*").alias("n"), F.count_if(seconds >= 86400).alias("past"), (F.min(seconds) == F.max(seconds)).alias("flat"))
    return t.agg(F.sum("n").alias("visits"), F.count("*").alias("trips"), (F.sum("past") / F.sum("n")).alias("past_share"), share(F.col("flat")).alias("flat_share"))


def jam_quality(j: DataFrame) -> DataFrame:
    """Per intensity: reports, share without speed, median speed, days, and half hours of a day that have any."""
    g = j.groupBy("intensity").agg(F.count("*").alias("reports"), share(F.col("speed_kmh").isNull()).alias("no_speed"), F.countDistinct("day").alias("days"), F.countDistinct("minute").alias("half_hours"))
    return g.join(percentiles(j, ["intensity"], "speed_kmh", {"median_kmh": 0.5}), "intensity", "left")


def headway_fallacy(p: DataFrame) -> DataFrame:
    """One row: of consecutive pings at a stop, the share that comes from one vehicle, and distinct vehicle pairs."""
    w = Window.partitionBy("day", "stop_id").orderBy("created_us", "event_id")
    q = p.withColumn("b", F.lag("vehicle_id").over(w)).where("b is not null")
    g = q.groupBy("b", "vehicle_id").agg(F.count("*").alias("n"))
    return g.agg((F.sum(F.when(F.col("b") == F.col("vehicle_id"), F.col("n")).otherwise(0)) / F.sum("n")).alias("same_share"), F.count_if(F.col("b") != F.col("vehicle_id")).alias("pairs"))


def leaps(p: DataFrame) -> DataFrame:
    """Pings with seconds and km/h since the vehicle's ping before."""
    w = Window.partitionBy("day", "vehicle_id").orderBy("created_us", "event_id")
    q = p.withColumn("b", F.lag(F.struct("lat", "lon", "created_us", "seq", "trip_id")).over(w))
    s = (F.col("created_us") - F.col("b.created_us")) / SECOND
    m = haversine(F.col("b.lat"), F.col("b.lon"), F.col("lat"), F.col("lon"))
    return q.withColumns({"since_s": s, "moved_m": m, "kmh": F.when(s > 0, m / s * 3.6)})


def track_quality(p: DataFrame) -> DataFrame:
    """Per line: median ping interval, share of leaps over 120 km/h, of stationary pings (under 3 m), of steps back in a trip's sequence."""
    q = leaps(p).where("b is not null")
    back = F.when(F.col("b.trip_id") == F.col("trip_id"), (F.col("seq") < F.col("b.seq")).cast("double"))
    return q.groupBy("line").agg(F.percentile("since_s", 0.5).alias("interval_s"), share(F.col("kmh") > 120).alias("leaps"), share(F.col("moved_m") < 3).alias("still"), F.avg(back).alias("backwards"))


def cramers_v(rows: DataFrame, flag: Column, category: str) -> DataFrame:
    """One row: bias-corrected Cramer's V of a flag and a category, from their contingency counts."""
    t = rows.select(flag.alias("f"), F.col(category).alias("c")).groupBy("f", "c").agg(F.count("*").alias("o"))
    f, c = t.groupBy("f").agg(F.sum("o").alias("nf")), t.groupBy("c").agg(F.sum("o").alias("nc"))
    n = t.agg(F.sum("o").alias("n"))
    cells = f.crossJoin(c).crossJoin(F.broadcast(n)).join(t, ["f", "c"], "left")  # two flags by the categories, and one row
    e = F.col("nf") * F.col("nc") / F.col("n")
    s = cells.agg(F.sum(F.pow(F.coalesce("o", F.lit(0)) - e, 2) / e).alias("chi2"), F.max("n").alias("n"), F.countDistinct("f").alias("r"), F.countDistinct("c").alias("k"))
    rr = F.col("r") - F.pow(F.col("r") - 1, 2) / (F.col("n") - 1)
    kk = F.col("k") - F.pow(F.col("k") - 1, 2) / (F.col("n") - 1)
    phi = F.greatest(F.lit(0.0), F.col("chi2") / F.col("n") - (F.col("r") - 1) * (F.col("k") - 1) / (F.col("n") - 1))
    least = F.least(rr - 1, kk - 1)
    return s.select(F.when(least > 0, F.sqrt(phi / least)).otherwise(0.0).alias("v"), "n")


def coverage(p: DataFrame, visits: DataFrame) -> DataFrame:
    """Per line: quartiles of the share of a trip's planned stops that were seen, and the share of trips under half."""
    planned = visits.groupBy("trip_id").agg(F.count("*").alias("planned"))
    t = p.groupBy(*TRIP, "line").agg(F.countDistinct("stop_id").alias("seen")).join(planned, "trip_id").withColumn("c", F.col("seen") / F.col("planned"))
    q = F.percentile("c", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return t.groupBy("line").agg(q.alias("q"), share(F.col("c") < 0.5).alias("low_share")).select("line", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("q2"), F.get("q", F.lit(2)).alias("q3"), "low_share")


def mechanisms(p: DataFrame) -> DataFrame:
    """Per line: bunched passages whose leader is late, whose follower is early; correlation of a gap's ratio with that three stops before."""
    v = p.where("valid")
    return v.groupBy("line").agg(F.count_if("bunched").alias("bunched"), F.avg(F.when(F.col("bunched"), (F.col("lead_delay") > 120).cast("double"))).alias("leader_late"), F.avg(F.when(F.col("bunched"), (F.col("delay") < 60).cast("double"))).alias("follower_early"), F.corr("ratio", "ratio_prev3").alias("persistence"))


def knock_on(p: DataFrame, chain: DataFrame) -> DataFrame:
    """By the time between two trips of a vehicle in quarter hours (up to an hour and more): trips, mean first delay, share that starts early."""
    first = p.groupBy(*TRIP).agg(F.min_by("delay", F.struct("seq", "t")).alias("d"))
    t = chain.join(first, TRIP).withColumn("layover", F.least(F.lit(4), F.floor(F.col("gap_s") / 900)).cast("int"))
    return t.groupBy("layover").agg(F.count("*").alias("trips"), F.avg("d").alias("mean_delay"), share(F.col("d") < 0).alias("early_share"))


def segment_delays(p: DataFrame, least: int) -> DataFrame:
    """Per consecutive stops: number, mean, deviation and 90th percentile of the delay that is added."""
    w = Window.partitionBy(*TRIP).orderBy("seq", "t")
    q = p.withColumn("b", F.lag(F.struct("stop_id", "delay")).over(w)).where("b is not null").withColumn("added", F.col("delay") - F.col("b.delay"))
    g = q.groupBy(F.col("b.stop_id").alias("from_stop"), F.col("stop_id").alias("to_stop")).agg(F.count("*").alias("n"), F.avg("added").alias("mean"), F.stddev_samp("added").alias("sd"), F.percentile("added", 0.9).alias("p90"))
    return g.where(F.col("n") >= least)


def mean_rank(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Rows with the mean rank of a value among all; from counts of distinct values."""
    counts = rows.groupBy(value).agg(F.count("*").alias("_n"))
    # values are dealt to ranges first, so that a running sum needs no single task: sums of ranges are few
    ranged = counts.repartitionByRange(value).withColumn("_p", F.spark_partition_id())
    before = ranged.groupBy("_p").agg(F.sum("_n").alias("_s")).withColumn("_before", F.sum("_s").over(Window.orderBy("_p")) - F.col("_s"))
    w = Window.partitionBy("_p").orderBy(value)
    ranks = ranged.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.sum("_n").over(w) - (F.col("_n") - 1) / 2)
    return rows.join(ranks.select(value, name), value)


def jam_speed_relation(j: DataFrame) -> DataFrame:
    """One row: Spearman correlation of intensity (as a ratio) and speed, and plain correlation after each half hour's means are removed."""
    rows = j.where("r is not null and speed_kmh is not null")
    ranked = mean_rank(mean_rank(rows, "r", "rank_r"), "speed_kmh", "rank_s")
    w = Window.partitionBy("minute")
    q = ranked.withColumns({"dr": F.col("r") - F.avg("r").over(w), "ds": F.col("speed_kmh") - F.avg("speed_kmh").over(w)})
    return q.agg(F.corr("rank_r", "rank_s").alias("spearman"), F.corr("dr", "ds").alias("within"), F.count("*").alias("n"))


def rates_by(p: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of gaps under a quarter and under half of plan."""
    return p.where("valid").groupBy(*keys).agg(F.count("*").alias("n"), share(F.col("ratio") < 0.25).alias("under_quarter"), share(F.col("ratio") < 0.5).alias("under_half"))


def cell_hours(p: DataFrame, cell: Column, hour: Column) -> DataFrame:
    """Pings and vehicles per cell, day and hour."""
    return p.groupBy(cell.alias("cell"), "day", hour.alias("hour")).agg(F.count("*").alias("pings"), F.countDistinct("vehicle_id").alias("vehicles"))
