"""Stop passages, timetable repair and headways: pings and a timetable to gaps between consecutive buses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
#: Seconds: delays beyond are not trusted; planned gaps outside of the range are not judged; a corridor gap below is bunched.
MOST_DELAY, PLANNED_GAP, CORRIDOR_GAP = 1800, (120, 3600), 60
#: A gap below this share of the planned one is bunched.
BUNCHED_RATIO = 0.25
#: Observed passages ahead that a label looks at.
LOOK_AHEAD = {"line": 10, "corridor": 5}
TRIP = ["day", "trip_id", "vehicle_id"]
#: Who competes for the place in front at a stop.
GROUP = {"line": ["day", "line", "direction_id", "stop_id"], "corridor": ["day", "stop_id"]}
#: Ties of time are broken so everywhere.
TIES = ["t", "trip_id", "vehicle_id"]


def upper_median(values: Column) -> Column:
    """The middle one of the sorted values, the upper of two."""
    v = F.array_sort(F.collect_list(values))
    return F.element_at(v, (F.floor(F.count(values) / 2) + 1).cast("int"))


def first_visits(visits: DataFrame) -> DataFrame:
    """Of each trip and stop the visit of the lowest sequence: seq, sched_us, clock, line, direction_id; and last_seq of the trip."""
    v = visits.groupBy("trip_id", "stop_id").agg(F.min_by(F.struct("stop_sequence", "sched_us", "clock", "line", "direction_id"), "stop_sequence").alias("v"), F.max("stop_sequence").alias("most"))
    last = F.max("most").over(Window.partitionBy("trip_id"))
    return v.select("trip_id", "stop_id", F.col("v.stop_sequence").alias("seq"), "v.sched_us", "v.clock", "v.line", "v.direction_id", last.alias("last_seq"))


def stop_passages(pings: DataFrame, visits: DataFrame) -> DataFrame:
    """One row per day, trip, vehicle and stop: t is the last ping that reports the stop, at the trip's last planned stop the first. Unplanned stops drop out."""
    seen = pings.where("stop_id <> ''").groupBy("agency_id", *TRIP, "stop_id").agg(F.min("created_us").alias("t_first"), F.max("created_us").alias("t_pass"))
    p = seen.join(first_visits(visits), ["trip_id", "stop_id"])
    p = p.withColumn("is_last", F.col("seq") == F.col("last_seq")).withColumn("t", F.when(F.col("is_last"), F.col("t_first")).otherwise(F.col("t_pass")))
    return p.withColumn("delay", (F.col("t") - F.col("sched_us")) / SECOND)


def flat_trips(visits: DataFrame, seconds: Column) -> DataFrame:
    """trip_id, start, flat: a trip is flat if all its clocks are equal."""
    return visits.groupBy("trip_id").agg(F.min(seconds).alias("start"), (F.max(seconds) == F.min(seconds)).alias("flat"))


def typical_offsets(visits: DataFrame, seconds: Column, keys: list[str]) -> DataFrame:
    """keys, stop_id, offset_s: the median planned run time from the start to each stop, from trips that aren't flat."""
    rows = visits.withColumn("s", seconds).join(flat_trips(visits, seconds).where("not flat"), "trip_id")
    return rows.groupBy(*keys, "stop_id").agg(F.percentile(F.col("s") - F.col("start"), 0.5).alias("offset_s"))


def line_offsets(offsets: DataFrame, keys: list[str]) -> DataFrame:
    """The upper median of the finer offsets."""
    return offsets.groupBy(*keys, "stop_id").agg(upper_median(F.col("offset_s")).alias("offset_s"))


def suspect_trips(passages: DataFrame) -> DataFrame:
    """Trips whose upper median delay is beyond MOST_DELAY in size, with that median."""
    m = passages.groupBy(*TRIP).agg(upper_median(F.col("delay")).alias("median_delay"))
    return m.where(F.abs("median_delay") > MOST_DELAY)


def without_suspects(passages: DataFrame) -> DataFrame:
    """Passages of all other trips, in one pass; rows come out dealt by vehicle day, as previous_trip_delay() needs them."""
    delays = F.array_sort(F.collect_list("delay").over(Window.partitionBy(*TRIP)))  # a trip's stops, no more
    median = F.try_element_at(delays, (F.floor(F.size(delays) / 2) + 1).cast("int"))
    p = passages.repartition("day", "vehicle_id").withColumn("median_delay", median)
    return p.where(F.coalesce(F.abs("median_delay") <= MOST_DELAY, F.lit(True))).drop("median_delay")


def previous_trip_delay(passages: DataFrame) -> DataFrame:
    """Passages with prev_trip_delay: the delay at the last stop of the vehicle's trip before, if that was passed before this trip's first stop and the delay is trusted.

    Trips follow each other by the time at their first stop; first and last stop are those of the lowest and highest sequence.
    """
    trip = trip_window()
    day = Window.partitionBy("day", "vehicle_id").orderBy("begins", "trip_id", "seq", "t", "stop_id")
    p = passages.withColumn("begins", F.first("t").over(trip))
    p = p.withColumn("b", F.lag(F.struct("t", "delay")).over(day)).withColumn("b", F.first("b").over(trip))
    good = (F.col("b.t") <= F.col("begins")) & (F.abs("b.delay") <= MOST_DELAY)
    return p.withColumn("prev_trip_delay", F.when(good, F.col("b.delay"))).drop("b", "begins")


def headways(passages: DataFrame, mode: str = "line") -> DataFrame:
    """Passages with the bus in front (leader_*), hw, sched_hw, lead_delay, same_line, valid, ratio and bunched."""
    w = Window.partitionBy(*GROUP[mode]).orderBy(*TIES)
    lead = F.lag(F.struct("trip_id", "vehicle_id", "line", "t", "sched_us", "delay")).over(w)
    p = passages.withColumn("l", lead)
    p = p.withColumns({
        "leader_trip": F.col("l.trip_id"),
        "leader_vehicle": F.col("l.vehicle_id"),
        "leader_line": F.col("l.line"),
        "hw": (F.col("t") - F.col("l.t")) / SECOND,
        "sched_hw": (F.col("sched_us") - F.col("l.sched_us")) / SECOND,
        "lead_delay": F.col("l.delay"),
        "same_line": F.col("l.line") == F.col("line"),
    }).drop("l")
    return judged(p, mode)


def judged(p: DataFrame, mode: str) -> DataFrame:
    good = F.col("sched_hw").between(*PLANNED_GAP) & (F.abs("delay") <= MOST_DELAY) & (F.abs("lead_delay") <= MOST_DELAY) & F.col("hw").isNotNull()
    p = p.withColumn("valid", F.coalesce(good, F.lit(False)))
    p = p.withColumn("ratio", F.when(F.col("valid"), F.col("hw") / F.col("sched_hw")))
    close = F.col("hw") < CORRIDOR_GAP if mode == "corridor" else F.col("ratio") < BUNCHED_RATIO
    return p.withColumn("bunched", F.coalesce(F.col("valid") & close, F.lit(False)))


def trip_window() -> Window:
    """A trip's passages in stop order."""
    return Window.partitionBy(*TRIP).orderBy("seq", "t", "stop_id")


def labelled(passages: DataFrame, ahead: int = LOOK_AHEAD["line"]) -> DataFrame:
    """progress within the observed trip, the ratio three stops before, and the label: any bunched among the next passages, null at the last one."""
    w = trip_window()
    whole = Window.partitionBy(*TRIP)
    label = F.max("bunched").over(w.rowsBetween(1, ahead))
    return passages.withColumns({"progress": F.col("seq") / F.max("seq").over(whole), "ratio_prev3": F.lag("ratio", 3).over(w), "label": label})


def trip_stops(visits: DataFrame) -> DataFrame:
    """trip_id, stops: the planned stops in order."""
    s = F.array_sort(F.collect_list(F.struct("stop_sequence", "stop_id")))
    return visits.groupBy("trip_id").agg(F.transform(s, lambda x: x["stop_id"]).alias("stops"))


def shared_next(passages: DataFrame, stops: DataFrame, ahead: int = 5) -> DataFrame:
    """Passages with shared_next: the share of the next planned stops that the leader serves too; 1 or 0.5 by same_line where unknown, 0 at the end."""
    own = stops.withColumnRenamed("stops", "own")
    lead = stops.select(F.col("trip_id").alias("leader_trip"), F.col("stops").alias("lead"))
    p = passages.join(own, "trip_id", "left").join(lead, "leader_trip", "left")
    at = F.array_position("own", F.col("stop_id")).cast("int")
    nxt = F.when(at > 0, F.slice("own", at + 1, F.lit(ahead)))
    share = F.when(F.size(nxt) > 0, F.size(F.filter(nxt, lambda s: F.array_contains("lead", s))) / F.size(nxt)).otherwise(0.0)
    unknown = F.col("own").isNull() | F.col("lead").isNull() | (at == 0)
    fallback = F.when(F.coalesce("same_line", F.lit(False)), 1.0).otherwise(0.5)
    return p.withColumn("shared_next", F.when(unknown, fallback).otherwise(share)).drop("own", "lead")


def top_pairs(passages: DataFrame, most: int = 8) -> DataFrame:
    """Vehicle pairs by stops at which the one bunched behind the other; a top-k report."""
    b = passages.where("bunched").groupBy("vehicle_id", "leader_vehicle").agg(F.count("*").alias("stops"), F.min("hw").alias("min_gap"), F.min("t").alias("first_us"), F.max("t").alias("last_us"))
    return b.orderBy(F.desc("stops"), "first_us", "vehicle_id", "leader_vehicle").limit(most)
