"""The observation query: pings of a local clock window with their plan, route and schedule; and single-file extracts."""

from __future__ import annotations

import datetime as dt
import re
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspan.functions import clock

ZONE = ZoneInfo("Europe/Lisbon")
SECOND = 1_000_000
#: Seconds before a window that are read too, so that a replay starts with vehicles in place; hours of a window at most.
PREHISTORY, MOST_HOURS = 120, 4
#: Who saw what, when and where: the order of observations.
ORDER = ["created_us", "agency_id", "vehicle_id", "received_us", "lat", "lon", "trip_id", "stop_id", "event_id"]


def window_us(day: str, start: str, end: str) -> tuple[int, int]:
    """Microseconds of a local window HH:MM-HH:MM, which may cross midnight. Raises ValueError if it is malformed, empty, over MOST_HOURS, or at a clock change."""
    if not all(re.fullmatch(r"[0-2]\d:[0-5]\d", c) for c in (start, end)):
        raise ValueError("Use an ISO date and HH:MM local times.")
    at = [dt.datetime.combine(dt.date.fromisoformat(day), dt.time.fromisoformat(c)) for c in (start, end)]
    if at[1] < at[0]:
        at[1] += dt.timedelta(days=1)
    utc = []
    for local in at:
        ways = {local.replace(tzinfo=ZONE, fold=f).astimezone(dt.UTC) for f in (0, 1)}
        if len(ways) != 1 or next(iter(ways)).astimezone(ZONE).replace(tzinfo=None) != local:
            raise ValueError("This local time doesn't exist or comes twice.")
        utc.append(ways.pop())
    if not dt.timedelta(0) < utc[1] - utc[0] <= dt.timedelta(hours=MOST_HOURS):
        raise ValueError(f"A window has more than none and at most {MOST_HOURS} hours.")
    return tuple(int(u.timestamp()) * SECOND for u in utc)


def observations(pings: DataFrame, plans: DataFrame, visits: DataFrame, window: tuple[int, int], cells: list[str] | None = None, agencies: list[str] | None = None, lines: list[str] | None = None, focus: list[str] | None = None) -> DataFrame:
    """Pings of the window and PREHISTORY before it, in the cells and of the agencies and lines asked for (None: all), without who drives.

    plans: agency_id, day, package_id, one row a key. visits: trip_id, stop_id, seq, sched_us, clock, line, direction_id, one row a trip and stop, the trip's first visit there.
    A ping without a plan or a planned stop stays, unmatched. diff_s: seconds behind the stop's clock on the ping's own service day.
    """
    p = pings.where(F.col("created_us").between(window[0] - PREHISTORY * SECOND, window[1]))
    for name, some in (("cell", cells), ("agency_id", agencies), ("line", lines)):
        p = p.where(F.col(name).isin(some)) if some is not None else p
    v = visits.select("trip_id", "stop_id", F.col("seq").alias("stop_sequence"), "clock")
    j = p.join(plans.select("agency_id", "day", "package_id"), ["agency_id", "day"], "left").join(v, ["trip_id", "stop_id"], "left")
    reference = F.when(F.col("package_id").isNotNull(), clock.reference_us(F.col("created_us"), F.col("clock")))
    j = j.withColumns({"matched": F.col("package_id").isNotNull() & F.col("stop_sequence").isNotNull(), "in_window": F.col("created_us") >= window[0], "diff_s": F.bround((F.col("created_us") - reference) / SECOND).cast("long")})
    j = j.withColumn("is_focus", F.col("matched") & (F.col("line").isin(focus) if focus else F.lit(False)))
    return j.select(*ORDER, "day", "line", "direction_id", "package_id", "stop_sequence", "matched", "in_window", "is_focus", "diff_s")


def first_observations(found: DataFrame, most: int) -> DataFrame:
    """A report of the first `most` in ORDER."""
    return found.orderBy(*ORDER).limit(most)


def observation_counts(found: DataFrame) -> DataFrame:
    """One row: observations, those inside the window, matched and not, of the focus and around it."""
    return found.agg(F.count("*").alias("observations"), F.count_if("in_window").alias("in_window"), F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("unmatched"), F.count_if("is_focus").alias("focus"), F.count_if(~F.col("is_focus")).alias("context"))


def extract(raw: DataFrame, agencies: list[str], window: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Of raw string pings: observations of the window and PREHISTORY (equal ones once, with their earliest receipt); and one row of counts of what was read and skipped.

    A row is skipped for the first reason that holds: another operator, invalid, outside the window.
    """
    number = {c: F.col(c).try_cast("long") for c in ("created_at", "received_at")} | {c: F.col(c).try_cast("double") for c in ("latitude", "longitude")}
    at, receipt, lat, lon = number.values()
    inside = lambda x, most: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= most)
    good = at.isNotNull() & receipt.isNotNull() & inside(lat, 90) & inside(lon, 180) & (F.coalesce("vehicle_id", F.lit("")) != "")
    near = at.between(window[0] // 1000 - PREHISTORY * 1000, window[1] // 1000)
    reason = F.when(~F.coalesce(F.col("agency_id").isin(agencies), F.lit(False)), "operator").when(~good, "invalid").when(~near, "outside")
    r = raw.withColumn("skipped", reason)
    key = ["agency_id", "vehicle_id", "created_at", "latitude", "longitude", "trip_id", "stop_id"]
    found = r.where("skipped is null").withColumns(number).groupBy(*key).agg(F.min("received_at").alias("received_at"), F.count("*").alias("copies"))
    one = r.agg(F.count("*").alias("rows_read"), *[F.count_if(F.col("skipped") == x).alias(f"skipped_{x}") for x in ("operator", "invalid", "outside")])
    kept = found.agg(F.coalesce(F.sum("copies") - F.count("*"), F.lit(0)).alias("duplicates"), F.count("*").alias("observations"), F.count_if(F.col("created_at") >= window[0] // 1000).alias("in_window"))
    return found.drop("copies"), one.crossJoin(F.broadcast(kept))  # one row each


def follower_before(p: DataFrame, stale_min: float = 30) -> DataFrame:
    """Passages with f_ratio and f_hw of the bus behind: its latest passage strictly before, where this trip and vehicle were its leader; null if that is over stale_min old."""
    mine = p.select("day", "trip_id", "vehicle_id", "t", F.struct(*p.columns).alias("row"), F.lit(None).cast("struct<t:long,ratio:double,hw:double>").alias("f"))
    behind = p.where("leader_trip is not null").select("day", F.col("leader_trip").alias("trip_id"), F.col("leader_vehicle").alias("vehicle_id"), "t", F.struct("t", "ratio", "hw").alias("f"))
    w = Window.partitionBy("day", "trip_id", "vehicle_id").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    both = mine.unionByName(behind, allowMissingColumns=True).withColumn("f", F.last("f", ignorenulls=True).over(w)).where("row is not null")
    age = (F.col("row.t") - F.col("f.t")) / SECOND / 60
    fresh = lambda c: F.when(age <= stale_min, F.col(f"f.{c}")).alias(f"f_{c}")
    return both.select("row.*", age.alias("f_age"), fresh("ratio"), fresh("hw"))


def offline_features(p: DataFrame, horizons: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """Of passages in stop order: dwell, own run from the stop before, mean dwell of three stops, stops left, minutes in the trip, and labels at several horizons."""
    w = Window.partitionBy("day", "trip_id", "vehicle_id").orderBy("seq", "t", "stop_id")
    whole = Window.partitionBy("day", "trip_id", "vehicle_id")
    q = p.withColumn("dwell", (F.col("t") - F.col("t_first")) / SECOND)
    label = {f"y{k}": F.max("bunched").over(w.rowsBetween(1, k)) for k in horizons}
    return q.withColumns({"run1": (F.col("t") - F.lag("t").over(w)) / SECOND, "dwell_mean3": F.avg("dwell").over(w.rowsBetween(-2, 0)), "stops_left": F.col("last_seq") - F.col("seq"), "t_in_trip": (F.col("t") - F.min("t").over(whole)) / SECOND / 60} | label)


def steady(p: DataFrame) -> DataFrame:
    """Without flicker: of each day, trip, vehicle and stop the last passage."""
    w = Window.partitionBy("day", "trip_id", "vehicle_id", "stop_id").orderBy(F.desc("t"))
    return p.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def pattern_headways(p: DataFrame) -> DataFrame:
    """Gaps, as observed and as planned, to the bus before of the same line and direction at the stop (own_) and of any line (any_)."""
    def gaps(name: str, keys: list[str]) -> dict[str, Column]:
        w = Window.partitionBy("day", *keys, "stop_id")
        return {f"{name}_hw": (F.col("t") - F.lag("t").over(w.orderBy("t", "trip_id", "vehicle_id"))) / SECOND, f"{name}_planned": (F.col("sched_us") - F.lag("sched_us").over(w.orderBy("sched_us", "trip_id", "vehicle_id"))) / SECOND}

    return p.withColumns(gaps("own", ["line", "direction_id"]) | gaps("any", []))


def planned_together(p: DataFrame, close_s: float = 60, apart_s: float = 120) -> DataFrame:
    """Per line of pattern_headways(): passages close behind any bus, and the share of those that the plan puts closer than apart_s."""
    near = F.col("any_hw") < close_s
    return p.groupBy("line").agg(F.count_if(near).alias("close"), F.avg(F.when(near, (F.col("any_planned") < apart_s).cast("double"))).alias("planned_share"))


def onset_target(p: DataFrame, ahead: int = 5, below: float = 0.5) -> DataFrame:
    """Passages with target: the ratio falls below `below` at a stop ahead-2 to ahead stops on, behind the same leader; null where none is seen there."""
    w = Window.partitionBy("day", "trip_id", "vehicle_id", "leader_trip").orderBy("seq", "t", "stop_id").rowsBetween(ahead - 2, ahead)
    return p.where("leader_trip is not null").withColumn("target", F.min("ratio").over(w) < below)
