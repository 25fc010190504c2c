"""Jam reports matched to road pieces, and section speeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspan.functions import geo
from fleetspan.sources.files import shared

#: Metres of a grid cell, from a piece's middle to a jam, and of a piece; cosine of the largest angle.
CELL, NEAR, PIECE, ALIGNED = 100.0, 25.0, 25.0, 0.8660254037844387


def speed_ratio(intensity: Column) -> Column:
    """Middle of a band 'a% - b%' in percent, 0 for a closed road, null for anything else. The labels are taken at face value."""
    band = r"^\s*([0-9]+)\s*%?\s*-\s*([0-9]+)\s*%?\s*$"
    high, low = (F.regexp_extract(intensity, band, i).try_cast("double") for i in (1, 2))
    return F.when(F.lower(intensity).like("%bloqueada%"), 0.0).when((high <= 100) & (high - low < 30), (high + low) / 2)


def traffic_band(ratio: Column) -> Column:
    return F.when(ratio.isNull(), "unknown").when(ratio <= 20, "stopped").when(ratio <= 40, "heavy").when(ratio <= 60, "slow").when(ratio <= 100, "light").otherwise("unknown")


def grouped(jams: DataFrame, *keys: str) -> DataFrame:
    """Jams per geometry, intensity, day (and keys): reports, mean of finite speeds from 0 on, how many those are."""
    s = F.when(F.col("speed_kmh") >= 0, F.col("speed_kmh"))
    return jams.groupBy("geometry_wkt", "intensity", "day", *keys).agg(F.count("*").alias("reports"), F.avg(s).alias("speed_kmh"), F.count(s).alias("speed_reports"))


def matches(road: DataFrame, jam_lines: DataFrame) -> DataFrame:
    """piece of road, geometry: each jam geometry once for each piece whose middle is near to one of its segments, along or against it.

    Both sides meet in grid cells; a jam segment stands in all cells of its box, widened by NEAR.
    """
    r = road.withColumns({"mx": (F.col("x1") + F.col("x2")) / 2, "my": (F.col("y1") + F.col("y2")) / 2, "ux": (F.col("x2") - F.col("x1")) / F.nullif("metres", F.lit(0.0)), "uy": (F.col("y2") - F.col("y1")) / F.nullif("metres", F.lit(0.0))})
    r = r.select("road", "seg", "piece", "mx", "my", "ux", "uy", F.floor(F.col("mx") / CELL).alias("cx"), F.floor(F.col("my") / CELL).alias("cy"))
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - NEAR) / CELL), F.floor((F.greatest(a, b) + NEAR) / CELL))
    j = jam_lines.select("geometry_wkt", F.col("x1").alias("jx1"), F.col("y1").alias("jy1"), F.col("x2").alias("jx2"), F.col("y2").alias("jy2"))
    j = j.withColumn("cx", F.explode(span(F.col("jx1"), F.col("jx2")))).withColumn("cy", F.explode(span(F.col("jy1"), F.col("jy2"))))
    both = r.join(j, ["cx", "cy"])
    length = F.hypot(F.col("jx2") - F.col("jx1"), F.col("jy2") - F.col("jy1"))
    turn = F.abs(F.col("ux") * (F.col("jx2") - F.col("jx1")) + F.col("uy") * (F.col("jy2") - F.col("jy1"))) / F.nullif(length, F.lit(0.0))
    close = geo.segment_distance(F.col("mx"), F.col("my"), F.col("jx1"), F.col("jy1"), F.col("jx2"), F.col("jy2")) <= NEAR
    return both.where(close & (turn >= ALIGNED)).select("road", "seg", "piece", "geometry_wkt").distinct()


def evidence_sets(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(road, seg, piece and set; set and geometry_wkt) of matches(): pieces that match the same geometries have the same evidence, so it is worked out once a set, however many roads run there."""
    p = found.groupBy("road", "seg", "piece").agg(F.array_sort(F.collect_set("geometry_wkt")).alias("g"))
    p = shared(p.withColumn("set", F.sha2(F.to_json("g"), 256)), "evidence-sets")
    return p.drop("g"), p.dropDuplicates(["set"]).select("set", F.explode("g").alias("geometry_wkt"))


def section_speed(matched: DataFrame, jams: DataFrame, keys: list[str]) -> DataFrame:
    """Per section: mean over days, each day alike, of the report-weighted ratio and speed; reports and days. No match is unknown, not free."""
    j = matched.join(jams, "geometry_wkt").withColumn("r", speed_ratio(F.col("intensity")))
    d = j.groupBy(*keys, "day").agg((F.sum(F.col("r") * F.col("reports")) / F.sum(F.when(F.col("r").isNotNull(), F.col("reports")))).alias("ratio"), (F.sum(F.col("speed_kmh") * F.col("speed_reports")) / F.nullif(F.sum(F.when(F.col("speed_kmh").isNotNull(), F.col("speed_reports"))), F.lit(0))).alias("speed"), F.sum("reports").alias("reports"))
    return d.groupBy(*keys).agg(F.avg("ratio").alias("ratio"), F.avg("speed").alias("speed"), F.sum("reports").alias("reports"), F.count("ratio").alias("days"))


def piece_speeds(road: DataFrame, found: DataFrame, jams: DataFrame) -> DataFrame:
    """Each piece of road with what its jams say (section_speed() of reports whose intensity is known): ratio, speed, reports, days; none: nulls and zeros."""
    of, sets = evidence_sets(found)
    known = section_speed(sets, jams.where(speed_ratio(F.col("intensity")).isNotNull()), ["set"])
    p = road.select("road", "seg", "piece", "metres").join(of, ["road", "seg", "piece"], "left").join(known, "set", "left").drop("set")
    return p.withColumns({"ratio": F.round("ratio", 1), "speed": F.round("speed", 1), "reports": F.coalesce("reports", F.lit(0)), "days": F.coalesce("days", F.lit(0))})


def sections(speeds: DataFrame) -> DataFrame:
    """Pieces of piece_speeds() that follow each other with equal evidence as one section: its number, metres and evidence."""
    w = Window.partitionBy("road").orderBy("seg", "piece")
    same = F.lit(True)
    for c in ("ratio", "speed", "reports", "days"):
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    p = speeds.withColumn("new", F.when((F.row_number().over(w) > 1) & same, 0).otherwise(1)).withColumn("section", F.sum("new").over(w))
    return p.groupBy("road", "section").agg(F.sum("metres").alias("metres"), F.count("*").alias("pieces"), *[F.first(c).alias(c) for c in ("ratio", "speed", "reports", "days")])


def coverage(speeds: DataFrame) -> DataFrame:
    """Per road: metres in all, and of the pieces that some day's jams cover."""
    return speeds.groupBy("road").agg(F.sum("metres").alias("metres"), F.coalesce(F.sum(F.when(F.col("days") > 0, F.col("metres"))), F.lit(0.0)).alias("matched_metres"))


def time_cells(road: DataFrame, found: DataFrame, jams: DataFrame) -> DataFrame:
    """Per road and half hour: the ratio by length of pieces on each day, averaged over days; days; reports, each record once; the share of the road's metres with any.

    Roads that touch the same evidence_sets() are of one kind; they differ in metres only. Days of a kind and half hour with ratios on the same sets add up set by set, so a road weighs
    sums over days by its metres and meets no single day. jams: grouped() with minute.
    """
    at = ["road", "seg", "piece"]
    j = jams.withColumn("r", speed_ratio(F.col("intensity"))).where("r is not null")
    of, sets = evidence_sets(found)
    parts = road.select(*at, "metres").join(of, at).groupBy("road", "set").agg(F.sum("metres").alias("metres"))
    roads = parts.groupBy("road").agg(F.array_sort(F.collect_list(F.struct("set", "metres"))).alias("p"))
    roads = shared(roads.select("road", F.sha2(F.to_json("p.set"), 256).alias("kind"), F.col("p.set").alias("sets"), F.col("p.metres").alias("m")), "road-kinds")
    kinds = roads.dropDuplicates(["kind"]).select("kind", F.posexplode("sets").alias("i", "set"))
    slots = sets.join(j, "geometry_wkt").groupBy("set", "minute", "day").agg((F.sum(F.col("r") * F.col("reports")) / F.sum("reports")).alias("r"))
    days = kinds.join(slots, "set").groupBy("kind", "minute", "day").agg(F.array_sort(F.collect_list(F.struct("i", "r"))).alias("there"))
    sums = days.select("kind", "minute", F.col("there.i").alias("which"), F.explode("there").alias("x")).groupBy("kind", "minute", "which", F.col("x.i").alias("i")).agg(F.sum("x.r").alias("r"), F.count("*").alias("n"))
    alike = sums.groupBy("kind", "minute", "which").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "r"))).alias("x"))
    cells = alike.groupBy("kind", "minute").agg(F.array_sort(F.collect_list(F.struct("which", "n", "x"))).alias("alike"), F.sum("n").alias("days"))
    told = j.groupBy("geometry_wkt", "minute").agg(F.sum("reports").alias("reports"))
    reports = kinds.join(sets, "set").select("kind", "geometry_wkt").distinct().join(told, "geometry_wkt").groupBy("kind", "minute").agg(F.sum("reports").alias("reports"))
    total = lambda items, value: F.aggregate(items, F.lit(0.0), lambda acc, x: acc + value(x))
    weight = lambda i: F.get("m", i)
    base = lambda a: F.get(a["x"], F.lit(0))["r"]  # noqa: E731  the mean is taken from here on, so equal ratios give it without an error of rounding
    ratio = total(F.col("alike"), lambda a: base(a) + total(a["x"], lambda x: (x["r"] - base(a)) * weight(x["i"])) / total(a["which"], weight)) / F.col("days")
    covered = total(F.array_distinct(F.flatten(F.col("alike.which"))), weight)
    whole = road.groupBy("road").agg(F.sum("metres").alias("metres"))
    met = roads.join(cells.join(reports, ["kind", "minute"]), "kind").join(whole, "road")
    return met.select("road", "minute", ratio.alias("ratio"), "days", "reports", (covered / F.col("metres")).alias("coverage"))


def plot_cells(cells: DataFrame, begin: int, end: int, heavy: float = 40) -> DataFrame:
    """time_cells() on a plot of minutes begin to end: every road at every half hour, known or not, flagged where the traffic is heavy."""
    ticks = cells.select("road").distinct().select("road", F.explode(F.sequence(F.lit(begin), F.lit(end - 30), F.lit(30))).alias("minute"))
    return ticks.join(cells.select("road", "minute", "ratio"), ["road", "minute"], "left").withColumn("heavy", F.coalesce(F.col("ratio") <= heavy, F.lit(False)))


def stop_paths(stops: DataFrame, shapes: DataFrame, most: float = 100.0) -> DataFrame:
    """trip_id, stop_sequence, along, off: each trip's stops projected in order on its shape, in metres along and from it; null where no edge is within `most` metres.

    Stops of a trip are placed one after the other, each not before the last: a fold over the trip's ordered stops that carries how far it has come. A trip
    has some tens of stops. stops: trip_id, shape_id, stop_sequence, x, y; shapes: shape_id, points (array of x, y).
    """
    number = lambda name: F.lit(None).cast("double").alias(name)
    pairs = F.arrays_zip(F.slice("points", F.lit(1), F.size("points") - 1).alias("a"), F.slice("points", F.lit(2), F.size("points") - 1).alias("b"))
    long = F.transform(pairs, lambda p: F.hypot(p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"]))
    s = shapes.where(F.size("points") > 1).select("shape_id", pairs.alias("pairs"), long.alias("long"))
    edges = F.transform("pairs", lambda p, i: F.struct(p["a"]["x"].alias("ax"), p["a"]["y"].alias("ay"), p["b"]["x"].alias("bx"), p["b"]["y"].alias("by"), F.get("long", i).alias("n"), F.aggregate(F.slice("long", F.lit(1), i), F.lit(0.0), lambda acc, x: acc + x).alias("start")))
    s = s.select("shape_id", F.filter(edges, lambda e: e["n"] > 0).alias("edges"))
    t = stops.groupBy("trip_id", "shape_id").agg(F.array_sort(F.collect_list(F.struct("stop_sequence", "x", "y"))).alias("stops")).join(s, "shape_id")

    def nearest(stop, floor):
        def better(best, e):
            u = F.least(F.greatest(((stop["x"] - e["ax"]) * (e["bx"] - e["ax"]) + (stop["y"] - e["ay"]) * (e["by"] - e["ay"])) / e["n"], F.lit(0.0)), e["n"])
            off = F.hypot(stop["x"] - e["ax"] - (e["bx"] - e["ax"]) * u / e["n"], stop["y"] - e["ay"] - (e["by"] - e["ay"]) * u / e["n"])
            ok = (e["start"] + u >= floor) & (off <= most) & (best["off"].isNull() | (off < best["off"] - 1e-9))
            return F.when(ok, F.struct((e["start"] + u).alias("along"), off.alias("off"))).otherwise(best)

        return F.aggregate("edges", F.struct(number("along"), number("off")), better)

    def place(acc, stop):
        best = nearest(stop, acc["floor"])
        row = F.struct(stop["stop_sequence"].alias("stop_sequence"), best["along"].alias("along"), best["off"].alias("off"))
        return F.struct(F.coalesce(best["along"] + 0.01, acc["floor"]).alias("floor"), F.concat(acc["placed"], F.array(row)).alias("placed"))

    none = F.array().cast("array<struct<stop_sequence:int,along:double,off:double>>")
    placed = F.aggregate("stops", F.struct(F.lit(0.0).alias("floor"), none.alias("placed")), place)["placed"]
    return t.select("trip_id", F.explode(placed).alias("p")).select("trip_id", "p.*")
