"""Headway KPIs of observed passages, run times, and choices from scenario tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspan.operators.passages import BUNCHED_RATIO, PLANNED_GAP, TRIP

SECOND = 1_000_000


def planned(p: DataFrame) -> DataFrame:
    """Passages with a gap to judge: hw, not below 0, and a planned one in PLANNED_GAP. short: the gap is below BUNCHED_RATIO of the plan."""
    g = p.where(F.col("hw").isNotNull() & F.col("sched_hw").between(*PLANNED_GAP))
    return g.withColumns({"short": F.col("hw") / F.col("sched_hw") < BUNCHED_RATIO, "hw": F.greatest("hw", F.lit(0.0))})


def headway_kpis(p: DataFrame) -> DataFrame:
    """Per line and direction, over planned(): gaps and the bunched share of all; over stops with at least three gaps the mean variation, each stop alike, and the excess wait by gaps."""
    g = planned(p).groupBy("line", "direction_id", "stop_id").agg(F.count("*").alias("n"), F.avg("hw").alias("mean"), F.stddev_pop("hw").alias("sd"), F.sum("hw").alias("s"), F.sum(F.col("hw") * F.col("hw")).alias("ss"), F.count_if("short").alias("b"))
    wait = F.col("ss") / (2 * F.col("s")) - F.col("mean") / 2
    many = (F.col("n") >= 3) & (F.col("s") > 0)
    return g.groupBy("line", "direction_id").agg(F.sum("n").alias("gaps"), (F.sum("b") / F.sum("n")).alias("bunched_share"), F.avg(F.when(many, F.col("sd") / F.col("mean"))).alias("cv"), (F.sum(F.when(many, wait * F.col("n"))) / F.sum(F.when(many, F.col("n")))).alias("excess_wait_s"))


def trip_times(p: DataFrame) -> DataFrame:
    """Per line and direction: trips and mean time from their first to their last stop."""
    at = F.struct("seq", "t")
    t = p.groupBy(*TRIP, "line", "direction_id").agg(((F.max_by("t", at) - F.min_by("t", at)) / SECOND).alias("s"))
    return t.groupBy("line", "direction_id").agg(F.count("*").alias("trips"), F.avg("s").alias("trip_s"))


def starts(p: DataFrame) -> DataFrame:
    """Trips with their first and last stop's sequence, time and plan; usual: where most trips of the line and direction start (the lowest of several); dispatchable: not after that, or the second stop."""
    at = F.struct("seq", "t")
    ends = lambda f: f(F.struct("seq", "t", "sched_us"), at)
    t = p.groupBy(*TRIP, "line", "direction_id").agg(ends(F.min_by).alias("a"), ends(F.max_by).alias("b"))
    t = t.select(*TRIP, "line", "direction_id", F.col("a.seq").alias("first_seq"), F.col("a.t").alias("begins"), F.col("a.sched_us").alias("planned_us"), F.col("b.seq").alias("last_seq"), F.col("b.t").alias("ends"))
    often = t.groupBy("line", "direction_id", "first_seq").agg(F.count("*").alias("n"))
    usual = often.groupBy("line", "direction_id").agg(F.max_by("first_seq", F.struct("n", -F.col("first_seq"))).alias("usual"))
    return t.join(usual, ["line", "direction_id"]).withColumn("dispatchable", F.col("first_seq") <= F.greatest("usual", F.lit(2)))


def unbroken(trips: DataFrame, most: float = 2.0) -> DataFrame:
    """Trips of starts() without those that took more than `most` times the median time a stop of their line and direction, as records broken."""
    pace = (F.col("ends") - F.col("begins")) / SECOND / F.greatest(F.col("last_seq") - F.col("first_seq"), F.lit(1))
    t = trips.withColumn("pace_s", pace)
    usual = t.groupBy("line", "direction_id").agg(F.percentile("pace_s", 0.5).alias("usual_pace_s"))
    return t.join(usual, ["line", "direction_id"]).where(F.col("pace_s") <= most * F.col("usual_pace_s"))


#: Limits of the classes of a departure's gap ratio.
EDGES = [0.25, 0.5, 0.75, 0.9, 1.1]


def departure_buckets(p: DataFrame) -> DataFrame:
    """By the gap ratio at the first stop of dispatchable trips, in classes between EDGES: trips, and how many are short of plan at a later stop."""
    w = Window.partitionBy(*TRIP).orderBy("seq", "t")
    q = p.withColumns({"n": F.row_number().over(w), "fit": F.col("hw").isNotNull() & F.col("sched_hw").between(*PLANNED_GAP)}).withColumn("r", F.when(F.col("fit"), F.col("hw") / F.col("sched_hw")))
    t = q.groupBy(*TRIP).agg(F.max(F.when(F.col("n") == 1, F.col("r"))).alias("dep"), F.coalesce(F.max(F.when(F.col("n") > 1, F.col("r") < BUNCHED_RATIO)), F.lit(False)).alias("later"))
    t = t.join(starts(p).where("dispatchable").select(*TRIP), TRIP, "left_semi")
    classes = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in zip(EDGES, EDGES[1:], strict=False)])
    c = t.withColumn("c", F.explode(classes)).where((F.col("dep") >= F.col("c.low")) & (F.col("dep") < F.col("c.high")))
    return c.groupBy(F.col("c.low").alias("low"), F.col("c.high").alias("high")).agg(F.count("*").alias("trips"), F.count_if("later").alias("bunch_later"))


def bucket_order(buckets: DataFrame) -> DataFrame:
    """departure_buckets() with the rate of later bunching, 0 without trips, and nth: 0 for the class that bunches most, equal ones by their lower limit."""
    rate = F.coalesce(F.col("bunch_later") / F.nullif("trips", F.lit(0)), F.lit(0.0))
    w = Window.partitionBy().orderBy(F.desc("rate"), "low")  # a row a class
    return buckets.withColumn("rate", rate).withColumn("nth", F.row_number().over(w) - 1)


def pooled(p: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys the bunched share over all lines in percent, as a ratio of sums over planned(): long lines weigh more than short ones. Null without gaps."""
    g = planned(p).groupBy(*keys, "line", "direction_id").agg(F.count("*").alias("n"), F.count_if("short").alias("b"))
    return g.groupBy(*keys).agg(F.count_distinct("line").alias("lines"), F.sum("n").alias("gaps"), (100 * F.sum("b") / F.nullif(F.sum("n"), F.lit(0))).alias("bunched_pct"))


def growth(p: DataFrame) -> DataFrame:
    """Per line, over planned(): short gaps' share in the first 40 % of trips and in the last 40 %, ends included."""
    part = lambda c: F.avg(F.when(c, F.col("short").cast("double")))
    return planned(p).groupBy("line").agg(part(F.col("progress") <= 0.4).alias("early"), part(F.col("progress") >= 0.6).alias("late"))


def extra_buses(p: DataFrame, buffer_s: float) -> DataFrame:
    """Per line: buses that a longer turnaround of buffer_s costs by the median planned gap of dispatchable trips, the larger of both directions."""
    w = Window.partitionBy("day", "line", "direction_id").orderBy("planned_us", "trip_id", "vehicle_id")
    t = starts(p).where("dispatchable").withColumn("gap", (F.col("planned_us") - F.lag("planned_us").over(w)) / SECOND)
    d = t.where("gap > 0").groupBy("line", "direction_id").agg(F.ceil(2 * F.lit(buffer_s) / F.percentile("gap", 0.5)).alias("buses"))
    return d.groupBy("line").agg(F.max("buses").alias("buses"))


def run_bank(p: DataFrame, most: float = 1800, keep: tuple[str, ...] = ()) -> DataFrame:
    """Observed times from one stop to the next of consecutive sequence, with columns to keep."""
    w = Window.partitionBy(*TRIP).orderBy("seq", "t")
    q = p.withColumn("x", F.lead(F.struct("stop_id", "seq", "t")).over(w)).withColumn("run_s", (F.col("x.t") - F.col("t")) / SECOND)
    return q.where((F.col("x.seq") == F.col("seq") + 1) & F.col("run_s").between(0, most)).select("day", "trip_id", "line", F.col("stop_id").alias("from_stop"), F.col("x.stop_id").alias("to_stop"), "t", "run_s", *keep)


def local_median(bank: DataFrame, widths_s: tuple[int, ...] = (900, 1800, 3600), least: int = 5, at: str = "t", name: str = "median_s", asks: DataFrame | None = None) -> DataFrame:
    """asks (the bank itself unless given) with the median run of their segment around their time `at`, in the narrowest width with at least `least` runs, else over all.

    Time is cut into blocks as long as the widest width, and a row meets the runs of its own and both neighbouring blocks only; so no frame holds more than
    a segment's runs of three blocks, however long the history is.
    """
    asks = bank if asks is None else asks
    widest = max(widths_s) * SECOND
    block = lambda t: F.floor(F.col(t) / widest)
    segment = ["from_stop", "to_stop"]
    runs = bank.select(*segment, F.col("t").alias("u"), F.col("run_s").alias("run"), block("t").alias("block"))
    times = asks.select(*segment, F.col(at).alias("v")).distinct()  # the answer depends on segment and time alone
    q = times.select(*segment, "v", F.explode(F.array(*[block("v") + i for i in (-1, 0, 1)])).alias("block"))
    near = q.join(runs, [*segment, "block"]).withColumn("apart", F.abs(F.col("u") - F.col("v"))).where(F.col("apart") <= widest)
    inside = [F.when(F.col("apart") <= w * SECOND, F.col("run")) for w in widths_s]
    found = near.groupBy(*segment, "v").agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(inside)], *[F.percentile(c, 0.5).alias(f"m{i}") for i, c in enumerate(inside)])
    every = bank.groupBy(*segment).agg(F.percentile("run_s", 0.5).alias("all_runs"))
    best = F.coalesce(*[F.when(F.col(f"n{i}") >= least, F.col(f"m{i}")) for i in range(len(widths_s))])
    found = found.select(*segment, F.col("v").alias(at), best.alias("near_median"))
    return asks.join(found, [*segment, at], "left").join(every, segment, "left").withColumn(name, F.coalesce("near_median", "all_runs")).drop("near_median", "all_runs")


def shift_error(bank: DataFrame, apart_s: float = 300) -> DataFrame:
    """Per segment: mean error of taking the run before, if at least apart_s earlier, for this one: as it is, and scaled by the local medians' ratio (0.5 to 2); which is better."""
    w = Window.partitionBy("from_stop", "to_stop").orderBy("t", "trip_id", "day")
    b = bank.withColumn("x", F.lag(F.struct("t", "run_s")).over(w)).where(F.col("t") - F.col("x.t") >= apart_s * SECOND)
    b = b.select("from_stop", "to_stop", "t", "run_s", F.col("x.t").alias("t0"), F.col("x.run_s").alias("r0"))
    b = local_median(bank, at="t0", name="before", asks=local_median(bank, name="after", asks=b))
    factor = F.when(F.col("before") > 0, F.least(F.lit(2.0), F.greatest(F.lit(0.5), F.col("after") / F.col("before")))).otherwise(1.0)
    error = lambda c: F.avg(F.abs(F.col("run_s") - c))
    g = b.groupBy("from_stop", "to_stop").agg(F.count("*").alias("n"), error(F.col("r0")).alias("mae_s"), error(F.col("r0") * factor).alias("scaled_mae_s"))
    return g.withColumn("better", F.when(F.col("mae_s") <= F.col("scaled_mae_s"), "unscaled").otherwise("scaled"))


def dwell_slope(p: DataFrame, most: float = 1200, longest: float = 1800) -> DataFrame:
    """Per line: least-squares slope of the run to the next stop less its local median on the headway's deviation from plan, within `most` seconds."""
    b = run_bank(p, longest, ("hw", "sched_hw"))
    q = local_median(run_bank(p, longest), asks=planned(b).withColumn("dev", F.col("hw") - F.col("sched_hw")).where(F.abs("dev") <= most))
    return q.groupBy("line").agg(F.count("*").alias("n"), F.regr_slope(F.col("run_s") - F.col("median_s"), F.col("dev")).alias("slope"))


def scenarios(rows: DataFrame) -> DataFrame:
    """Per line and scenario over its (k, day) cases: the mean saved, the worst and best case means, the least 5th percentile over a case's seeds (by index floor(0.05 (n - 1))), robust if all of those save."""
    if "wait" not in rows.columns:  # a study without terminal waits
        rows = rows.withColumn("wait", F.lit(0))
    v = F.array_sort(F.collect_list("saved"))  # a case's seeds
    p5 = F.element_at(v, (F.floor((F.count("saved") - 1) * 0.05) + 1).cast("int"))
    c = rows.groupBy("line", "scenario", "k", "day").agg(F.avg("saved").alias("saved"), p5.alias("p5"), F.max("vehicles").alias("vehicles"), F.avg("hold").alias("hold"), F.avg("wait").alias("wait"))
    g = c.groupBy("line", "scenario").agg(F.avg("saved").alias("mean_saved"), F.min("saved").alias("worst"), F.max("saved").alias("best"), F.min("p5").alias("p5"), F.max("vehicles").alias("vehicles"), F.avg("hold").alias("hold"), F.avg("wait").alias("wait"))
    return g.withColumn("robust", F.col("p5") > 0)


def cheapest(options: DataFrame, near: Column, cost: list) -> DataFrame:
    """Per line, of its robust options the cheapest by cost, then scenario, among those that `near` accepts against `top`, the line's best saving."""
    o = options.where("robust").withColumn("top", F.max("mean_saved").over(Window.partitionBy("line"))).where(near)
    w = Window.partitionBy("line").orderBy(*cost, "scenario")
    return o.withColumn("n", F.row_number().over(w)).where("n = 1").select("line", "scenario", "mean_saved", "vehicles", "hold", "wait")


def shortest_hold(options: DataFrame, share: float = 0.75) -> DataFrame:
    """Per line: of all options with at least this share of the best saving the one with the shortest hold."""
    o = options.withColumn("top", F.max("mean_saved").over(Window.partitionBy("line"))).where((F.col("top") > 0) & (F.col("mean_saved") >= share * F.col("top")))
    w = Window.partitionBy("line").orderBy("hold", F.desc("mean_saved"), "scenario")
    return o.withColumn("n", F.row_number().over(w)).where("n = 1").select("line", "scenario", "mean_saved", "hold")


def recommended(options: DataFrame, share: float = 0.75) -> DataFrame:
    """The cheapest by vehicles, hold, then terminal wait, with at least this share of the best saving."""
    return cheapest(options, F.col("mean_saved") >= share * F.col("top"), ["vehicles", "hold", "wait"])


def best_change(options: DataFrame) -> DataFrame:
    """The biggest saving, where options within 1 second or 5 % count as equal; of those the cheapest by vehicles, then hold and wait together."""
    return cheapest(options.where("mean_saved > 0"), F.col("mean_saved") >= F.col("top") - F.greatest(F.lit(1.0), 0.05 * F.col("top")), ["vehicles", F.col("hold") + F.col("wait")])


def interpolated(p: DataFrame, visits: DataFrame) -> DataFrame:
    """trip_id, vehicle_id, seq, t, seen: all planned stops of each seen trip; unseen ones between two seen are placed linearly by sequence, and times never decrease."""
    trips = p.select(*TRIP).distinct()
    grid = trips.join(visits.select("trip_id", F.col("stop_sequence").alias("seq")), "trip_id")
    q = grid.join(p.select(*TRIP, "seq", "t"), [*TRIP, "seq"], "left")
    w = Window.partitionBy(*TRIP).orderBy("seq")
    here = F.when(F.col("t").isNotNull(), F.struct("seq", "t"))
    q = q.withColumns({"a": F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "b": F.first(here, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    at = F.col("a.t") + (F.col("b.t") - F.col("a.t")) * (F.col("seq") - F.col("a.seq")) / (F.col("b.seq") - F.col("a.seq"))
    q = q.withColumn("u", F.coalesce(F.col("t").cast("double"), at)).where("u is not null")
    return q.select(*TRIP, "seq", F.max("u").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("t"), F.col("t").isNotNull().alias("seen"))


def vehicle_chain(p: DataFrame, most_s: float = 60) -> DataFrame:
    """Trips with their vehicle's trip before, if that ended by their start, the time between, and the layover that they need: that time, most_s at most."""
    w = Window.partitionBy("day", "vehicle_id").orderBy("begins", "trip_id")
    t = starts(p).select(*TRIP, "begins", "ends").withColumn("x", F.lag(F.struct("trip_id", "ends")).over(w)).where(F.col("x.ends") <= F.col("begins"))
    gap = (F.col("begins") - F.col("x.ends")) / SECOND
    return t.select(*TRIP, F.col("x.trip_id").alias("trip_before"), gap.alias("gap_s"), F.least(F.lit(most_s), gap).alias("layover_s"))


def bunched_runs(p: DataFrame) -> DataFrame:
    """Runs of bunched passages of a trip: first and last sequence and length."""
    w = Window.partitionBy(*TRIP).orderBy("seq", "t")
    q = p.withColumn("new", F.when(F.col("bunched").eqNullSafe(F.lag("bunched").over(w)), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return q.where("bunched").groupBy(*TRIP, "run").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("stops"))


def held(p: DataFrame, holds: DataFrame) -> DataFrame:
    """Passages moved by all holds of their trip up to their stop. holds: trip_id, seq, hold_s."""
    w = Window.partitionBy(*TRIP).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    q = p.join(holds, ["trip_id", "seq"], "left")
    return q.withColumn("t_held", F.col("t") + F.sum(F.coalesce("hold_s", F.lit(0))).over(w) * SECOND)

