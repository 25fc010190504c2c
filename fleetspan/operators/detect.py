"""The rule detector: consecutive reports that are close though planned apart, grouped to episodes, rolled up to weeks and heatmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspan.functions import clock

SECOND = 1_000_000
#: Seconds: reports at most so far apart, planned at least so far apart; a longer pause splits episodes.
MOST_GAP, LEAST_PLANNED, PAUSE = 180, 300, 1200
#: Stops of an episode from which on it is a run of stops.
LEAST_STOPS = 2


def stop_reports(pings: DataFrame, keys: tuple[str, ...] = ("day", "vehicle_id", "trip_id", "line", "direction_id", "stop_id")) -> DataFrame:
    """First and last report and their number for each group."""
    return pings.groupBy(*keys).agg(F.min("created_us").alias("first_us"), F.max("created_us").alias("last_us"), F.count("*").alias("observations"))


def nearest_visits(reports: DataFrame, visits: DataFrame) -> DataFrame:
    """Reports with the visit of their stop whose planned time is nearest (ties: lower sequence; untimed visits last): visit_seq, planned_us, diff_s. Null if there is none."""
    v = visits.select("trip_id", "stop_id", F.col("stop_sequence").alias("visit_seq"), F.col("sched_us").alias("planned_us"))
    both = reports.join(v, ["trip_id", "stop_id"], "left")
    away = F.abs(F.col("planned_us") - F.col("first_us"))
    order = F.struct(away.isNull().alias("n"), away.alias("a"), F.col("visit_seq").alias("s"))
    cols = [c for c in reports.columns]
    best = both.groupBy(*cols).agg(F.min_by(F.struct("visit_seq", "planned_us"), order).alias("b"))
    return best.select(*cols, "b.visit_seq", "b.planned_us", F.bround((F.col("first_us") - F.col("b.planned_us")) / SECOND).cast("long").alias("diff_s"))


def candidates(matched: DataFrame, most_gap: int = MOST_GAP, least_planned: int = LEAST_PLANNED) -> DataFrame:
    """Consecutive first reports of a line, direction and stop by different trips: at most most_gap seconds apart, planned at least least_planned apart."""
    w = Window.partitionBy("day", "line", "direction_id", "stop_id").orderBy("first_us", "trip_id", "vehicle_id")
    m = matched.where("planned_us is not null").withColumn("b", F.lag(F.struct("trip_id", "vehicle_id", "first_us", "planned_us")).over(w))
    gap = F.floor((F.col("first_us") - F.col("b.first_us")) / SECOND)
    planned = F.floor(F.abs(F.col("planned_us") - F.col("b.planned_us")) / SECOND)
    m = m.withColumns({"observed_gap": gap, "planned_gap": planned}).where((F.col("b.trip_id") != F.col("trip_id")) & (gap <= most_gap) & (planned >= least_planned))
    return m.select("day", "line", "direction_id", "stop_id", "visit_seq", F.col("b.trip_id").alias("first_trip"), F.col("b.vehicle_id").alias("first_vehicle"), F.col("trip_id").alias("second_trip"), F.col("vehicle_id").alias("second_vehicle"), F.col("b.first_us").alias("t1"), F.col("first_us").alias("t2"), "observed_gap", "planned_gap")


def pair_key() -> Column:
    """The two buses in either order: whole (trip, vehicle) pairs are sorted, not their parts."""
    return F.concat_ws("|", F.transform(F.array_sort(F.array(F.struct(F.col("first_trip").alias("t"), F.col("first_vehicle").alias("v")), F.struct(F.col("second_trip").alias("t"), F.col("second_vehicle").alias("v")))), lambda x: F.concat_ws("/", x["t"], x["v"])))


def islands(found: DataFrame, pause: int = PAUSE) -> DataFrame:
    """Candidates with pair and island, which counts the pauses of over `pause` seconds before them."""
    w = Window.partitionBy("day", "line", "direction_id", "pair").orderBy("t2", "stop_id")
    c = found.withColumn("pair", pair_key())
    return c.withColumn("new", F.when(F.col("t2") - F.lag("t2").over(w) > pause * SECOND, 1).otherwise(0)).withColumn("island", F.sum("new").over(w)).drop("new")


def episodes(found: DataFrame, pause: int = PAUSE) -> DataFrame:
    """Candidates of one pair whose pauses are not over `pause` seconds: bounds, stops, gaps and class."""
    keys = ["day", "line", "direction_id", "pair"]
    at = F.struct("t2", "stop_id")
    e = islands(found, pause).groupBy(*keys, "island").agg(
        F.min("t1").alias("starts"), F.max("t2").alias("ends"), F.min_by("stop_id", at).alias("first_stop"), F.max_by("stop_id", at).alias("last_stop"),
        F.count("*").alias("evidence"), F.countDistinct("stop_id").alias("stops"), F.min("observed_gap").alias("min_gap"), F.max("planned_gap").alias("max_planned"))
    return e.withColumn("class", F.when(F.col("stops") >= LEAST_STOPS, "multi_stop").otherwise("single_point"))


def latest_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Of the completed runs the latest for each key, by completion, then id."""
    w = Window.partitionBy(*keys).orderBy(F.col("completed_us").desc_nulls_last(), F.desc("run_id"))
    return runs.where("status = 'completed'").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def latest_scoped(runs: DataFrame, keys: list[str], line: str | None = None) -> DataFrame:
    """latest_runs() by scope: without a line, runs of all lines only; with one, any run that has it (full_scope, lines)."""
    return latest_runs(runs.where(F.col("full_scope") if line is None else F.array_contains("lines", line)), keys)


def unfinished(wanted: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys wanted that no completed run has."""
    return wanted.select(*keys).distinct().join(runs.where("status = 'completed'").select(*keys), keys, "left_anti")


def week_totals(runs: DataFrame, found: DataFrame) -> DataFrame:
    """For each line of the runs' selections: analysed days, episodes, those of several stops, evidence. A line that was analysed without a find has zeros."""
    own = latest_runs(runs.withColumn("line", F.explode("lines")), ["day", "agency_id", "line"])
    e = found.select("run_id", "line", "class", "evidence")
    j = own.join(e, ["run_id", "line"], "left")
    return j.groupBy("line").agg(F.countDistinct("day").alias("days"), F.count("class").alias("episodes"), F.count_if(F.col("class") == "multi_stop").alias("multi_stop"), F.coalesce(F.sum("evidence"), F.lit(0)).alias("evidence"))


def heatmap(evidence: DataFrame, days: DataFrame) -> DataFrame:
    """Per directed stop section and half hour of the day: distinct episodes, distinct days, episodes per analysed day. 48 cells a section; zero where analysed, null if no day was.

    evidence: section, episode, day, t1, t2; days: the analysed days.
    """
    middle = F.floor((F.col("t1") + F.col("t2")) / 2)
    e = evidence.withColumn("minute", clock.half_hour(middle))
    grid = evidence.select("section").distinct().select("section", F.explode(F.sequence(F.lit(0), F.lit(1410), F.lit(30))).alias("minute"))
    cells = e.groupBy("section", "minute").agg(F.countDistinct("episode").alias("episodes"), F.countDistinct("day").alias("days"))
    n = days.agg(F.countDistinct("day").alias("analysed"))
    out = grid.join(cells, ["section", "minute"], "left").crossJoin(F.broadcast(n))  # n is one row
    some = F.col("analysed") > 0
    count = F.when(some, F.coalesce("episodes", F.lit(0)))
    return out.select("section", "minute", count.alias("episodes"), F.when(some, F.coalesce("days", F.lit(0))).alias("days"), F.when(some, count / F.col("analysed")).alias("per_day"))


def run_counts(found: DataFrame) -> DataFrame:
    """Per day of an analysis: lines with candidates, candidates, episodes, and those of either class."""
    e = episodes(found).groupBy("day").agg(F.count("*").alias("episodes"), F.count_if(F.col("class") == "multi_stop").alias("multi_stop"), F.count_if(F.col("class") == "single_point").alias("single_point"))
    return found.groupBy("day").agg(F.countDistinct("line").alias("lines"), F.count("*").alias("candidates")).join(e, "day")


def overlaps(first_us: Column, last_us: Column, begin: int, end: int) -> Column:
    """Whether a run's local minutes overlap a window of minutes of the day, begin before end or, over midnight, after it."""
    minute = lambda us: F.hour(clock.local(us)) * 60 + F.minute(clock.local(us))
    a, b = minute(first_us), minute(last_us)
    return (a < end) & (b >= begin) if begin < end else (a < end) | (b >= begin)
