"""Weekly findings over headway-judged passages, which have day, hour, block, weekday beside their own columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspan.functions import clock
from fleetspan.operators.passages import TRIP

HOT, HOT_DAYS, ON_PLAN, NEAR_START = 2.0, 5, 0.8, 0.15


def calendar(p: DataFrame) -> DataFrame:
    """Passages with local hour, block, weekday name and whether it is a working day."""
    t = clock.local(F.col("t"))
    return p.withColumns({"hour": F.hour(t), "block": clock.block(F.hour(t)), "dow": F.date_format("day", "EEE"), "working": clock.is_weekday(F.col("day"))})


def share(c: Column) -> Column:
    return F.avg(c.cast("double"))


def line_ranking(p: DataFrame) -> DataFrame:
    """Per line and direction, on working days: valid passages, bunched ones, their rate, the share of all bunching, the median planned gap."""
    g = p.where("valid and working").groupBy("line", "direction_id").agg(F.count("*").alias("passages"), F.count_if("bunched").alias("bunched"), F.percentile("sched_hw", 0.5).alias("planned_gap"))
    total = F.sum("bunched").over(Window.partitionBy())  # one row a line and direction, counted already
    return g.withColumns({"rate": F.col("bunched") / F.col("passages"), "share": F.col("bunched") / F.nullif(total, F.lit(0))})


def base_rate(p: DataFrame) -> DataFrame:
    """One row: the network's bunched share on working days."""
    return p.where("valid and working").agg(share(F.col("bunched")).alias("base"))


def slot_rates(p: DataFrame, slot: str) -> DataFrame:
    """line, direction_id, slot and day of working days: bunched passages b, their rate, and the network's rate base, which is added up from the same counts, so that passages are counted once."""
    d = p.where("valid and working").groupBy("line", "direction_id", slot, "day").agg(F.count("bunched").alias("n"), F.count_if("bunched").alias("b"))
    base = d.agg((F.sum("b") / F.nullif(F.sum("n"), F.lit(0))).alias("base"))
    return d.crossJoin(F.broadcast(base)).withColumn("rate", F.col("b") / F.nullif("n", F.lit(0)))  # one row


def hot_slots(p: DataFrame, slot: str, hot: float = HOT) -> DataFrame:
    """Per line, direction and slot (hour or block) of working days: observed days, hot days (rate at least `hot` times the base) and the mean daily rate."""
    return slot_rates(p, slot).groupBy("line", "direction_id", slot).agg(F.count("*").alias("days"), F.count_if(F.col("rate") >= hot * F.col("base")).alias("hot_days"), F.avg("rate").alias("mean_rate"))


def recurring(slots: DataFrame, days: int = HOT_DAYS) -> DataFrame:
    """Slots that were seen and hot on all working days."""
    return slots.where((F.col("days") == days) & (F.col("hot_days") == days))


def terminal_trips(p: DataFrame, near: float = NEAR_START) -> DataFrame:
    """Trips whose first valid passage is near their start: its ratio, delay, progress and the delay of the trip before, and whether and how often any valid passage is bunched."""
    at = F.struct("seq", "t")
    g = p.where("valid").groupBy(*TRIP).agg(F.min_by(F.struct("line", "direction_id", "working", "hour", "block", "ratio", "delay", "prev_trip_delay", "progress", "stop_id"), at).alias("f"), F.max("bunched").alias("any_bunched"), F.count_if("bunched").alias("times_bunched"))
    g = g.select(*TRIP, "f.line", "f.direction_id", "f.working", "f.hour", "f.block", F.col("f.ratio").alias("dep_ratio"), F.col("f.delay").alias("dep_delay"), "f.prev_trip_delay", F.col("f.progress").alias("first_progress"), F.col("f.stop_id").alias("first_stop"), "any_bunched", "times_bunched")
    return g.where(F.col("first_progress") < near)


def departure_class(ratio: Column) -> Column:
    return F.when(ratio < 0, None).when(ratio < 0.5, "too close").when(ratio < 0.8, "close").when(ratio < 1.2, "on plan").when(ratio < 99, "late")


def departures(trips: DataFrame) -> DataFrame:
    """Working days' trips by how the departure gap compares with the plan: number, share of all, share that bunches, and the class's share of these trips' bunched passages."""
    t = trips.where("working and dep_ratio is not null").withColumn("class", departure_class(F.col("dep_ratio")))
    g = t.groupBy("class").agg(F.count("*").alias("trips"), share(F.col("any_bunched")).alias("p_bunch"), F.sum("times_bunched").alias("times"))
    every = Window.partitionBy()  # a row a class
    g = g.withColumns({"share": F.col("trips") / F.sum("trips").over(every), "bunching_share": F.col("times") / F.greatest(F.sum("times").over(every), F.lit(1))})
    return g.where("class is not null").drop("times")


def onsets(p: DataFrame) -> DataFrame:
    """Passages with onset: bunched, and not so at the trip's valid passage before."""
    w = Window.partitionBy(*TRIP).orderBy("seq", "t")
    return p.where("valid").withColumn("onset", F.col("bunched") & ~F.coalesce(F.lag("bunched").over(w), F.lit(False)))


def hotspots(p: DataFrame, least: int, days: int = HOT_DAYS, most: int = 80) -> DataFrame:
    """Stops bunched on all working days with enough passages, by bunched passages, with their three most bunched lines and the hour of most bunching; a top-k report."""
    w = p.where("valid and working")
    g = w.groupBy("stop_id").agg(F.count("*").alias("passages"), F.count_if("bunched").alias("bunched"), F.countDistinct(F.when(F.col("bunched"), F.col("day"))).alias("days"))
    top = g.where((F.col("days") >= days) & (F.col("passages") >= least)).withColumn("rate", F.col("bunched") / F.col("passages")).orderBy(F.desc("bunched"), "stop_id").limit(most)
    bad = w.where("bunched")
    order = lambda c: F.struct((-F.col("n")).alias("n"), F.col(c))
    lines = bad.groupBy("stop_id", "line").agg(F.count("*").alias("n")).groupBy("stop_id").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(order("line"))), 1, 3), lambda x: x["line"]), ",").alias("lines"))
    hours = bad.groupBy("stop_id", "hour").agg(F.count("*").alias("n")).groupBy("stop_id").agg(F.min_by("hour", order("hour")).alias("peak_hour"))
    return top.join(lines, "stop_id", "left").join(hours, "stop_id", "left")


def shared_stops(p: DataFrame, least_passages: int, least_stops: int) -> DataFrame:
    """Pairs of line directions of different lines, the lower first, by stops that both serve often enough."""
    s = p.where("valid").groupBy("line", "direction_id", "stop_id").count().where(F.col("count") >= least_passages)
    a = s.select("stop_id", F.col("line").alias("line1"), F.col("direction_id").alias("dir1"))
    b = s.select("stop_id", F.col("line").alias("line2"), F.col("direction_id").alias("dir2"))
    return a.join(b, "stop_id").where("line1 < line2").groupBy("line1", "dir1", "line2", "dir2").agg(F.count("*").alias("stops")).where(F.col("stops") >= least_stops)


def follows_other_line(p: DataFrame) -> DataFrame:
    """Valid passages whose bus in front at the stop is of another line: gap and the planned gap's size, in seconds."""
    w = Window.partitionBy("day", "stop_id").orderBy("t", "trip_id", "vehicle_id")
    v = p.where("valid").withColumn("b", F.lag(F.struct("line", "direction_id", "t", "sched_us", "trip_id")).over(w)).where(F.col("b.line") != F.col("line"))
    return v.select("day", "stop_id", "trip_id", "line", "direction_id", "hour", "working", F.col("b.line").alias("line_before"), F.col("b.direction_id").alias("dir_before"), F.col("b.trip_id").alias("trip_before"), ((F.col("t") - F.col("b.t")) / 1_000_000).alias("gap"), (F.abs(F.col("sched_us") - F.col("b.sched_us")) / 1_000_000).alias("planned_gap"))


def pile_ups(p: DataFrame, pairs: DataFrame, close: float, planned_apart: float, least_run: int) -> DataFrame:
    """Per pair of lines that share stops: on working days, runs of stops at which two of their buses pass closely, days with such runs, share that is planned together,
    the first hour of most runs; and of all passages behind a bus of the other line the share that is close."""
    f = follows_other_line(p)
    lower = F.col("line") < F.col("line_before")
    f = f.withColumns({"line1": F.least("line", "line_before"), "line2": F.greatest("line", "line_before"), "dir1": F.when(lower, F.col("direction_id")).otherwise(F.col("dir_before")), "dir2": F.when(lower, F.col("dir_before")).otherwise(F.col("direction_id"))})
    f = f.join(pairs.select("line1", "dir1", "line2", "dir2"), ["line1", "dir1", "line2", "dir2"], "left_semi").withColumn("near", F.col("gap") < close)
    # one pass: passages of a run first, those that aren't close in their pair's count only
    e = f.groupBy("day", "trip_id", "trip_before", "line1", "line2").agg(F.count("*").alias("passages"), F.count_if("near").alias("n"), (share(F.when(F.col("near"), F.col("planned_gap") < planned_apart)) > 0.5).alias("planned"), F.min(F.when(F.col("near"), F.col("hour"))).alias("hour"), F.max("working").alias("working"))
    run = F.col("working") & (F.col("n") >= least_run)
    g = e.groupBy("line1", "line2", "hour").agg(F.sum("passages").alias("passages"), F.sum("n").alias("n"), F.count_if(run).alias("events"), F.collect_set(F.when(run, F.col("day"))).alias("days"), F.count_if(run & F.col("planned")).alias("planned"))
    g = g.groupBy("line1", "line2").agg(F.sum("events").alias("events"), F.size(F.array_distinct(F.flatten(F.collect_list("days")))).cast("long").alias("days"), (F.sum("planned") / F.sum("events")).alias("planned_share"), F.min_by("hour", F.struct((-F.col("events")).alias("n"), F.col("hour"))).alias("peak_hour"), (F.sum("n") / F.sum("passages")).alias("close_share"))
    return g.where("events > 0")


def cell(lat: Column, lon: Column, size: float = 0.005) -> Column:
    """Key of a cell of about 500 m."""
    return F.concat_ws("_", F.floor(lat / size).cast("string"), F.floor(lon / (size * 1.2)).cast("string"))


def stop_places(pings: DataFrame) -> DataFrame:
    """Median place of each stop over the last ping of each trip and vehicle at it."""
    last = pings.groupBy("trip_id", "vehicle_id", "stop_id").agg(F.max_by(F.struct("lat", "lon"), F.struct("created_us", "event_id")).alias("x"))
    return last.groupBy("stop_id").agg(F.percentile("x.lat", 0.5).alias("lat"), F.percentile("x.lon", 0.5).alias("lon"))


def area_passages(p: DataFrame, places: DataFrame, on_plan: float = ON_PLAN, near: float = NEAR_START) -> DataFrame:
    """Working days' passages of trips that left on plan, with onset, the onsets expected of their line, direction and block, and the cell of their stop; stops without a place drop out after expectations are taken."""
    v = onsets(p.where("working"))
    first = p.where("valid and working").groupBy(*TRIP).agg(F.min_by(F.struct("ratio", "progress"), F.struct("seq", "t")).alias("f"))
    v = v.join(first, TRIP).where((F.col("f.ratio") >= on_plan) & (F.col("f.progress") < near))
    w = Window.partitionBy("line", "direction_id", "block")
    v = v.withColumn("expected", F.avg(F.col("onset").cast("double")).over(w))
    return v.join(places.select("stop_id", "lat", "lon").where("lat is not null"), "stop_id").withColumn("cell", cell(F.col("lat"), F.col("lon")))


def areas(v: DataFrame) -> DataFrame:
    """Per cell of area_passages(): passages, onsets, those expected, days with clearly more than expected, their ratio."""
    d = v.groupBy("cell", "day").agg(F.count("*").alias("n"), F.count_if("onset").alias("o"), F.sum("expected").alias("e"))
    g = d.groupBy("cell").agg(F.sum("n").alias("passages"), F.sum("o").alias("onsets"), F.sum("e").alias("expected"), F.count_if(F.col("o") > 1.2 * F.col("e")).alias("days"))
    return g.withColumn("ratio", F.col("onsets") / F.nullif("expected", F.lit(0.0)))


def hot_areas(p: DataFrame, places: DataFrame, on_plan: float = ON_PLAN, near: float = NEAR_START) -> DataFrame:
    """Per cell, over working days' trips that left on plan: onsets, those expected of the lines, directions and blocks that pass, and days with clearly more than expected."""
    return areas(area_passages(p, places, on_plan, near))


#: A hot area has at least so many times the expected onsets, so many onsets, on so many days.
AREA_RATIO, AREA_ONSETS, AREA_DAYS = 1.3, 30, 4


def most_frequent(rows: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """key, values: its `most` commonest values, equal ones in order."""
    n = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), value))
    top = n.withColumn("r", rank).where(F.col("r") <= most)
    return top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("r", F.col(value).alias("value"), "n"))).alias("values"))


def hot_area_list(v: DataFrame, ratio: float = AREA_RATIO, onsets: int = AREA_ONSETS, days: int = AREA_DAYS) -> DataFrame:
    """Hot cells of area_passages(): middle, ratio, days, onsets a working day, lines that pass, the five lines and four stops of most onsets, and peak hours: those with at least 0.6 of the busiest hour's onsets."""
    hot = areas(v).where((F.col("onsets") >= onsets) & (F.col("ratio") >= ratio) & (F.col("days") >= days))
    at = v.join(hot.select("cell"), "cell", "left_semi")
    on = at.where("onset")
    middle = at.groupBy("cell").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count_distinct("line").alias("lines"))
    hours = on.groupBy("cell", "hour").agg(F.count("*").alias("n"))
    peaks = hours.withColumn("top", F.max("n").over(Window.partitionBy("cell"))).where(F.col("n") >= 0.6 * F.col("top"))
    names = lambda c: F.array_join(F.transform("values", lambda x: x["value"]), ",").alias(c)
    g = hot.select("cell", "ratio", "days", (F.col("onsets") / HOT_DAYS).alias("onsets_a_day")).join(middle, "cell")
    g = g.join(most_frequent(on, "cell", "line", 5).select("cell", names("top_lines")), "cell", "left")
    g = g.join(most_frequent(on, "cell", "stop_id", 4).select("cell", names("top_stops")), "cell", "left")
    return g.join(hour_ranges(peaks, ["cell"]).withColumnRenamed("hours", "peak_hours"), "cell", "left")


def area_summary(p: DataFrame, v: DataFrame, places: DataFrame, ratio: float = AREA_RATIO, onsets: int = AREA_ONSETS, days: int = AREA_DAYS) -> DataFrame:
    """One row: cells with passages of working days, the share of bunching and of passages in the ten cells with most bunching, onsets a working day of trips that left on plan, and the share of those in hot areas."""
    raw = p.where("valid and working").groupBy("stop_id").agg(F.count("*").alias("n"), F.count_if("bunched").alias("b"))
    raw = raw.join(places.select("stop_id", "lat", "lon").where("lat is not null"), "stop_id").groupBy(cell(F.col("lat"), F.col("lon")).alias("cell")).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    top = raw.orderBy(F.desc("b"), "cell").limit(10).agg(F.sum("b").alias("top_b"), F.sum("n").alias("top_n"))  # a top-k report
    every = raw.agg(F.count("*").alias("cells"), F.sum("b").alias("b"), F.sum("n").alias("n"))
    hot = (F.col("onsets") >= onsets) & (F.col("ratio") >= ratio) & (F.col("days") >= days)
    road = areas(v).agg(F.coalesce(F.sum("onsets"), F.lit(0)).alias("o"), F.coalesce(F.sum(F.when(hot, F.col("onsets"))), F.lit(0)).alias("h"))
    one = every.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(road))  # one row each
    return one.select("cells", (F.col("top_b") / F.nullif("b", F.lit(0))).alias("top10_bunching"), (F.col("top_n") / F.nullif("n", F.lit(0))).alias("top10_visits"), (F.col("o") / HOT_DAYS).alias("onsets_a_day"), (F.col("h") / F.greatest("o", F.lit(1))).alias("hot_share"))


def hour_ranges(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, hours: the distinct hours of each key as ranges of consecutive ones, 'HH:00-HH:00', comma-joined."""
    w = Window.partitionBy(*keys).orderBy("hour")
    r = rows.select(*keys, "hour").distinct().withColumn("island", F.col("hour") - F.row_number().over(w)).groupBy(*keys, "island").agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    r = r.withColumn("range", F.format_string("%02d:00-%02d:00", F.col("a"), F.col("b") + 1))
    return r.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("range")), ",").alias("hours"))


#: A problem: a line and direction in a block of the day.
SLOT = ["line", "direction_id", "block"]


def causes(trips: DataFrame) -> DataFrame:
    """Per slot, of working days' trips: the share that the vehicle's trip before left over 300 s late and that of too close departures, against the network's, and the cause that they point to."""
    t = trips.where("working")
    late, near = share(F.coalesce(F.col("prev_trip_delay") > 300, F.lit(False))), share(F.coalesce(F.col("dep_ratio") < 0.8, F.lit(False)))
    g = t.groupBy(*SLOT).agg(F.count("*").alias("trips"), late.alias("late"), near.alias("near"))
    g = g.crossJoin(F.broadcast(t.agg(late.alias("all_late"), near.alias("all_near"))))  # one row
    cause = F.when(F.col("late") >= 1.5 * F.col("all_late"), "turnaround").when(F.col("near") >= 1.3 * F.col("all_near"), "dispatch").otherwise("road")
    return g.select(*SLOT, "trips", "late", "near", cause.alias("cause"))


def slot_passages(p: DataFrame, slots: DataFrame) -> DataFrame:
    """Valid passages in problem slots, with onset: bunched, and not so at the trip's passage before in the same slot."""
    w = Window.partitionBy(*TRIP, *SLOT).orderBy("seq", "t")
    return p.where("valid").join(slots.select(*SLOT), SLOT, "left_semi").withColumn("onset", F.col("bunched") & ~F.coalesce(F.lag("bunched").over(w), F.lit(False)))


def slot_days(v: DataFrame) -> DataFrame:
    """Per slot and day of the week: bunched share, of slot_passages()."""
    return v.groupBy(*SLOT, "dow").agg(F.count("*").alias("passages"), share(F.col("bunched")).alias("rate"))


def slot_hours(p: DataFrame, slots: DataFrame, hot: float = HOT, hot_days: int = 4, least: int = 60) -> DataFrame:
    """Per problem slot the hours of its line and direction with enough passages on working days: rate, and whether the hour is a hot one of the slot's own block."""
    h = p.where("valid and working").groupBy("line", "direction_id", "hour").agg(F.count("*").alias("passages"), F.first("block").alias("of"))
    h = h.where(F.col("passages") >= least).join(hot_slots(p, "hour", hot), ["line", "direction_id", "hour"])
    h = h.crossJoin(F.broadcast(base_rate(p)))  # one row
    own = F.col("of") == F.col("block")
    is_hot = own & (F.col("mean_rate") >= hot * F.col("base")) & (F.col("hot_days") >= hot_days)
    return slots.select(*SLOT).join(h, ["line", "direction_id"]).select(*SLOT, "hour", "passages", F.col("mean_rate").alias("rate"), own.alias("in_block"), is_hot.alias("hot"))


def slot_stops(v: DataFrame, least: int = 20, days: int = HOT_DAYS, most: int = 5) -> DataFrame:
    """Per slot the stops with enough passages on working days, in order: median sequence, rate, onsets, days with bunching; worst marks the `most` of the highest rate among those bunched on `days` days."""
    g = v.where("working").groupBy(*SLOT, "stop_id").agg(F.percentile("seq", 0.5).alias("seq"), F.count("*").alias("passages"), share(F.col("bunched")).alias("rate"), F.count_if("onset").alias("onsets"), F.count_distinct(F.when(F.col("bunched"), F.col("day"))).alias("days"))
    rank = F.row_number().over(Window.partitionBy(*SLOT, F.col("days") >= days).orderBy(F.desc("rate"), "stop_id"))  # a slot's stops
    return g.where(F.col("passages") >= least).withColumn("worst", (F.col("days") >= days) & (rank <= most))


def slot_onsets(v: DataFrame) -> DataFrame:
    """Per slot, on working days: onsets, their median progress, and the share of them in a trip's first quarter."""
    on = v.where("working and onset")
    return on.groupBy(*SLOT).agg(F.count("*").alias("onsets"), F.percentile("progress", 0.5).alias("median_progress"), share(F.col("progress") < 0.25).alias("first_quarter"))


def slot_terminals(trips: DataFrame, slots: DataFrame) -> DataFrame:
    """Per slot the stop where most of its working days' trips begin, of equal ones the least, and how many do."""
    n = trips.where("working").join(slots.select(*SLOT), SLOT, "left_semi").groupBy(*SLOT, "first_stop").agg(F.count("*").alias("n"))
    return n.groupBy(*SLOT).agg(F.min_by("first_stop", F.struct(-F.col("n"), "first_stop")).alias("terminal"), F.max("n").alias("trips"))


def problem_list(p: DataFrame, trips: DataFrame, slots: DataFrame) -> DataFrame:
    """A row a problem slot: rate on working days, its multiple of the network's, bunched passages and trips a working day, planned headway in minutes, cause with its evidence, and where onsets lie."""
    v = slot_passages(p, slots)
    g = v.where("working").groupBy(*SLOT).agg(share(F.col("bunched")).alias("rate"), F.count_if("bunched").alias("bunched"), F.count_distinct("day").alias("days"))
    plan = p.where("valid").join(slots.select("line", "direction_id").distinct(), ["line", "direction_id"], "left_semi").groupBy("line", "direction_id").agg((F.percentile("sched_hw", 0.5) / 60).alias("planned_min"))
    g = g.join(plan, ["line", "direction_id"]).crossJoin(F.broadcast(base_rate(p)))  # one row
    g = g.join(causes(trips), SLOT, "left").join(slot_onsets(v), SLOT, "left").join(slot_terminals(trips, slots).drop("trips"), SLOT, "left")
    day = lambda c: (F.col(c) / HOT_DAYS).alias(f"{c}_a_day")
    return g.select(*SLOT, "rate", (F.col("rate") / F.nullif("base", F.lit(0.0))).alias("times_network"), day("bunched"), day("trips"), "planned_min", "late", "near", F.coalesce("cause", F.lit("road")).alias("cause"), "median_progress", "first_quarter", "terminal")


def headline(p: DataFrame) -> DataFrame:
    """One row: bunched shares of working days and weekends, and the five lines' that bunch most on working days share of that bunching and of passages."""
    g = p.where("valid").groupBy("line", "working").agg(F.count("*").alias("n"), F.count_if("bunched").alias("b"))
    top = F.row_number().over(Window.partitionBy("working").orderBy(F.desc("b"), "line")) <= 5  # a row a line, counted already
    g = g.withColumn("top", F.col("working") & top)
    part = lambda c, x: F.sum(F.when(c, F.col(x)))
    on, off = F.col("working"), ~F.col("working")
    return g.agg((part(on, "b") / F.nullif(part(on, "n"), F.lit(0))).alias("working_rate"), (part(off, "b") / F.nullif(part(off, "n"), F.lit(0))).alias("weekend_rate"), (part(F.col("top"), "b") / F.nullif(part(on, "b"), F.lit(0))).alias("top5_share"), (part(F.col("top"), "n") / F.nullif(part(on, "n"), F.lit(0))).alias("top5_passages"))


def headline_causes(p: DataFrame, trips: DataFrame, hot: float = HOT, hot_days: int = HOT_DAYS, days: int = HOT_DAYS, peak: float = 1.5) -> DataFrame:
    """One row beside headline(): bunched passages a working day, recurring blocks and their share of bunching, hours whose rate is `peak` times the network's,
    trips that leave too close and their share of bunching, and of all working days' terminal trips the shares that leave under 0.8 of plan and follow a trip over 300 s late."""
    b = slot_rates(p, "block").groupBy("line", "direction_id", "block").agg(((F.count("*") == days) & (F.count_if(F.col("rate") >= hot * F.col("base")) >= hot_days)).alias("again"), F.sum("b").alias("b"))
    blocks = b.agg((F.sum("b") / HOT_DAYS).alias("bunched_a_day"), F.count_if("again").alias("recurring_blocks"), (F.coalesce(F.sum(F.when(F.col("again"), F.col("b"))), F.lit(0)) / F.nullif(F.sum("b"), F.lit(0))).alias("recurring_share"))
    h = p.where("valid and working").groupBy("hour").agg(F.count("*").alias("n"), F.count_if("bunched").alias("b"))
    every = Window.partitionBy()  # a row an hour
    busy = h.withColumn("base", F.sum("b").over(every) / F.sum("n").over(every)).where(F.col("b") / F.col("n") >= peak * F.col("base"))
    hours = hour_ranges(busy.withColumn("k", F.lit(0)), ["k"]).agg(F.max("hours").alias("peak_hours"))
    near = F.col("class").isin("too close", "close")
    part = lambda c: F.sum(F.when(near, F.col(c)).otherwise(0.0))
    left = departures(trips).agg(part("share").alias("close_trips"), part("bunching_share").alias("close_bunching"))
    yes = lambda c: share(F.coalesce(c, F.lit(False)))
    net = trips.where("working").agg(yes(F.col("dep_ratio") < 0.8).alias("network_close"), yes(F.col("prev_trip_delay") > 300).alias("network_late"))
    return blocks.crossJoin(F.broadcast(hours)).crossJoin(F.broadcast(left)).crossJoin(F.broadcast(net))  # one row each


def first_problems(p: DataFrame, hot: float = HOT, days: int = HOT_DAYS, hot_days: int = HOT_DAYS) -> DataFrame:
    """Per line and direction its first problem: blocks that recur on working days before all others, then by bunched passages."""
    d = slot_rates(p, "block")
    g = d.groupBy("line", "direction_id", "block").agg(((F.count("*") == days) & (F.count_if(F.col("rate") >= hot * F.col("base")) >= hot_days)).alias("recurring"), F.sum("b").alias("bunched"))
    w = Window.partitionBy("line", "direction_id").orderBy(F.desc("recurring"), F.desc("bunched"), "block")
    return g.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
