"""A window of the day for some lines: which passages are kept and shown, their points along a route, and the window's summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspan.functions import clock
from fleetspan.operators import passages
from fleetspan.operators.passages import TRIP


def within(start: str, end: str) -> Column:
    """Whether t is in the window of the operating day between two clocks, both included; an end before the start is on the next day."""
    a, b = (int(x[:2]) * 3600 + int(x[3:5]) * 60 for x in (start, end))
    at = lambda s: clock.wall_us(F.col("day"), F.lit(s))
    return F.col("t").between(at(a), at(b + (86400 if b < a else 0)))


def kept_headways(trusted: DataFrame, pairs: DataFrame, mode: str = "line") -> DataFrame:
    """Judged and labelled passages of the chosen (line, direction_id) pairs, a bounded request: the trip before is looked up among all passages, the bus in front among the kept ones alone, as their order is chains first, then the filter."""
    chained = passages.previous_trip_delay(trusted)
    kept = chained.join(F.broadcast(pairs.select("line", "direction_id").distinct()), ["line", "direction_id"], "left_semi")
    return passages.labelled(passages.headways(kept, mode), passages.LOOK_AHEAD[mode])


def route_positions(visits: DataFrame) -> DataFrame:
    """line, direction_id, stop_id, y: the stops of the longest planned trip, the least id of equal ones, each at its first place, counted from 0."""
    s = F.array_sort(F.collect_list(F.struct("stop_sequence", "stop_id")))  # a trip's stops
    t = visits.groupBy("line", "direction_id", "trip_id").agg(F.count("*").alias("n"), s.alias("s"))
    best = t.groupBy("line", "direction_id").agg(F.min_by("s", F.struct((-F.col("n")).alias("n"), F.col("trip_id"))).alias("s"))
    return best.select("line", "direction_id", F.posexplode(F.array_distinct(F.transform("s", lambda x: x["stop_id"]))).alias("y", "stop_id"))


def points(p: DataFrame, shown: Column, route: DataFrame) -> DataFrame:
    """Points of trips that are shown at least once, with all their passages at the route's stops, shown or not. route: stop_id and y, of one route or, with line and direction_id, of each passage's own.

    y is the stop's position, times are microseconds, gaps and delays seconds; prob is null where p has none.
    """
    keys = [c for c in ("line", "direction_id", "stop_id") if c in route.columns]
    seen = p.withColumn("seen", F.max(shown).over(Window.partitionBy(*TRIP))).where("seen")
    prob = F.round("prob", 4) if "prob" in p.columns else F.lit(None).cast("double")
    return seen.join(route, keys).select(
        *TRIP, "line", "direction_id", "stop_id", "seq", "y", "t", "hw", "sched_hw", F.round("ratio", 3).alias("ratio"), "delay", "leader_vehicle", "leader_line", "bunched", prob.alias("prob"), F.col("label").alias("bunched_within"))


def summary(p: DataFrame, shown: Column, keys: list[str]) -> DataFrame:
    """Per keys of the shown passages: trips, passages, bunched ones, and those bunched behind a bus of another line."""
    other = F.col("bunched") & ~F.coalesce("same_line", F.lit(False))
    return p.where(shown).groupBy(*keys).agg(F.count_distinct(*TRIP).alias("trips"), F.count("*").alias("passages"), F.count_if("bunched").alias("bunched"), F.count_if(other).alias("cross_line"))
