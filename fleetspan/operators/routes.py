"""Linear referencing: stops, road pieces, traffic and bunching evidence placed by metres along a route's shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspan.functions import clock, geo
from fleetspan.operators import traffic

#: Metres of a bin in which sections and pieces of a shape meet.
BIN = 500.0
#: Shapes drawn from stop to stop for want of a road geometry begin so; no traffic is matched to them.
CHORDS = "stops-"
HALF_HOUR_US = 1_800_000_000


def reference_trips(visits: DataFrame) -> DataFrame:
    """line, direction_id, trip_id: the trip with most stops, of equal ones the one of the least id."""
    n = visits.groupBy("line", "direction_id", "trip_id").agg(F.count("*").alias("n"))
    return n.groupBy("line", "direction_id").agg(F.min_by("trip_id", F.struct(-F.col("n"), "trip_id")).alias("trip_id"))


def stop_sections(stops: DataFrame, placed: DataFrame) -> DataFrame:
    """Each trip's stops and the next: road (a key), from_stop, to_stop, their sequences, and lo and hi, metres along the shape, null where a stop has no place or the next isn't further on.

    ambiguous tells a pair of stops that the trip calls at twice in this order. stops: trip_id, shape_id, stop_sequence, stop_id; placed: traffic.stop_paths().
    """
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    own = stops.select("trip_id", "shape_id", "stop_sequence", "stop_id").join(placed.select("trip_id", "stop_sequence", "along"), ["trip_id", "stop_sequence"], "left")
    s = own.withColumn("next", F.lead(F.struct("stop_id", "stop_sequence", "along")).over(w)).where("next is not null")
    ahead = F.col("next.along") > F.col("along")
    s = s.select("trip_id", "shape_id", F.concat_ws("|", "trip_id", F.col("stop_sequence").cast("string")).alias("road"), F.col("stop_id").alias("from_stop"), F.col("next.stop_id").alias("to_stop"), F.col("stop_sequence").alias("from_sequence"), F.col("next.stop_sequence").alias("to_sequence"), F.when(ahead, F.col("along")).alias("lo"), F.when(ahead, F.col("next.along")).alias("hi"))
    return s.withColumn("ambiguous", F.count("*").over(Window.partitionBy("trip_id", "from_stop", "to_stop")) > 1)


def shape_pieces(lines: DataFrame) -> DataFrame:
    """shape_id, seg, piece, x1, y1, x2, y2, metres, start and end (metres along the shape). lines: shape_id, points (lon, lat)."""
    p = geo.pieces(geo.segments(lines, "points", ["shape_id"]), ["shape_id"]).where("metres > 0")
    end = F.sum("metres").over(Window.partitionBy("shape_id").orderBy("seg", "piece"))
    return p.withColumn("end", end).withColumn("start", F.col("end") - F.col("metres"))


def section_pieces(sections: DataFrame, pieces: DataFrame) -> DataFrame:
    """road, seg, piece, x1, y1, x2, y2, metres: the parts of a shape's pieces that lie on each section. Intervals of a shape meet in bins of BIN metres, each pair in the first that both have."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / BIN), F.floor(F.col(b) / BIN)))
    s = sections.where("lo is not null").select("road", "shape_id", "lo", "hi").withColumn("bin", cells("lo", "hi"))
    p = pieces.withColumn("bin", cells("start", "end"))
    left, right = F.greatest("lo", "start"), F.least("hi", "end")
    both = s.join(p, ["shape_id", "bin"]).where((right > left) & (F.floor(left / BIN) == F.col("bin")))
    at = lambda c, x: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * (x - F.col("start")) / F.col("metres")
    ends = {f"{c}{i}": at(c, x) for c in "xy" for i, x in ((1, left), (2, right))}
    return both.select("road", "seg", "piece", *[x.alias(c) for c, x in ends.items()], (right - left).alias("metres"))


def section_traffic(sections: DataFrame, pieces: DataFrame, jams: DataFrame) -> DataFrame:
    """Each section with metres, available (whether it has a geometry) and a row for each half hour with matched reports: minute, ratio, days, reports, coverage; one row of nulls where there are none. jams: grouped() with minute."""
    on = section_pieces(sections, pieces)
    lines = geo.segments(jams.select("geometry_wkt").distinct().withColumn("points", geo.line_points(F.col("geometry_wkt"))).where("points is not null"), "points", ["geometry_wkt"])
    cells = traffic.time_cells(on, traffic.matches(on, lines), jams)
    metres = F.coalesce(F.col("hi") - F.col("lo"), F.lit(0.0))
    return sections.withColumns({"metres": metres, "available": F.col("lo").isNotNull()}).join(cells, "road", "left")


def route_speeds(pieces: DataFrame, jams: DataFrame) -> DataFrame:
    """traffic.piece_speeds() of shapes: road is the shape. Shapes drawn from stop to stop match nothing."""
    road = pieces.withColumnRenamed("shape_id", "road")
    lines = geo.segments(jams.select("geometry_wkt").distinct().withColumn("points", geo.line_points(F.col("geometry_wkt"))).where("points is not null"), "points", ["geometry_wkt"])
    return traffic.piece_speeds(road, traffic.matches(road.where(~F.col("road").startswith(CHORDS)), lines), jams)


def ignored_reports(jams: DataFrame) -> DataFrame:
    """One row: reports whose intensity is no band or whose geometry is no line, and all."""
    useless = traffic.speed_ratio(F.col("intensity")).isNull() | geo.line_points(F.col("geometry_wkt")).isNull()
    return jams.agg(F.coalesce(F.sum(F.when(useless, F.col("reports"))), F.lit(0)).alias("ignored"), F.coalesce(F.sum("reports"), F.lit(0)).alias("reports"))


def plot_cells(shown: DataFrame, cells: DataFrame, begin_us: int, end_us: int, heavy: float = 40) -> DataFrame:
    """Half hours of a plot from begin_us to end_us for each pair of stops shown that is just one section: start and end within the plot, ratio, heavy, and how strongly it is drawn.

    shown: place, trip_id, from_stop, to_stop, from_sequence and to_sequence (null: any); cells: section_traffic(). A pair that several sections have is left out, as it may be another leg.
    """
    sections = cells.select("trip_id", "road", "from_stop", "to_stop", F.col("from_sequence").alias("f"), F.col("to_sequence").alias("t")).distinct()
    same = lambda a, b: F.col(a).isNull() | (F.col(a) == F.col(b))
    met = shown.join(sections, ["trip_id", "from_stop", "to_stop"]).where(same("from_sequence", "f") & same("to_sequence", "t"))
    one = met.withColumn("n", F.count("*").over(Window.partitionBy("trip_id", "place"))).where("n = 1").select("trip_id", "place", "road")
    first = begin_us // HALF_HOUR_US * HALF_HOUR_US
    ticks = one.withColumn("tick", F.explode(F.sequence(F.lit(first), F.lit(end_us - 1), F.lit(HALF_HOUR_US)))).withColumn("minute", clock.half_hour(F.col("tick")))
    r = ticks.join(cells.select("road", "minute", "ratio", "days", "coverage"), ["road", "minute"], "left")
    is_heavy = F.coalesce(F.col("ratio") <= heavy, F.lit(False))
    strength = F.when(is_heavy, F.when(F.col("days") < 2, 0.08).otherwise(0.1 + 0.1 * F.col("coverage"))).otherwise(0.0)
    return r.select("trip_id", "place", F.greatest(F.col("tick"), F.lit(begin_us)).alias("start_us"), F.least(F.col("tick") + HALF_HOUR_US, F.lit(end_us)).alias("end_us"), "ratio", is_heavy.alias("heavy"), strength.alias("opacity"))


def evidence_of(candidates: DataFrame, before: DataFrame) -> DataFrame:
    """Candidates with the section that they came by: from_stop (null where the trip's plan has no stop before) and to_stop. before: trip_id, stop_id, stop_before."""
    b = before.select(F.col("trip_id").alias("second_trip"), "stop_id", F.col("stop_before").alias("from_stop"))
    return candidates.join(b, ["second_trip", "stop_id"], "left").withColumn("to_stop", F.col("stop_id"))


def counted(group: Column, analysed: Column, day: Column) -> list[Column]:
    """Distinct episodes, distinct days and episodes a day analysed; null where no day was."""
    some, n = analysed > 0, F.count_distinct(group)
    return [F.when(some, n).alias("episodes"), F.when(some, F.count_distinct(day)).alias("days"), F.when(some, F.round(n / analysed, 4)).alias("per_day")]


def section_heatmap(sections: DataFrame, evidence: DataFrame, analysed: int, cells: bool = False) -> DataFrame:
    """Sections (with line and direction_id) with status, episodes, days and per_day, of all day or of each of its 48 half hours. An ambiguous pair of stops takes no evidence and has no counts.

    evidence: line, direction_id, from_stop, to_stop, episode, day, t1, t2.
    """
    keys = ["line", "direction_id", "from_stop", "to_stop"]
    middle = F.floor((F.col("t1") + F.col("t2")) / 2)
    e = evidence.select(*keys, "episode", "day", clock.half_hour(middle).alias("minute"))
    s = sections.withColumn("analysed", F.when(F.col("ambiguous"), 0).otherwise(F.lit(analysed)))
    own = [*keys, "road", "from_sequence", "to_sequence", "ambiguous", "analysed"]
    if cells:
        s, keys, own = s.withColumn("minute", F.explode(F.sequence(F.lit(0), F.lit(1410), F.lit(30)))), [*keys, "minute"], [*own, "minute"]
    met = s.join(e.withColumn("plain", F.lit(False)), on=[*[s[k].eqNullSafe(e[k]) for k in keys], s["ambiguous"] == F.col("plain")], how="left").select(*[s[c] for c in own], e["episode"], e["day"])
    status = F.when(F.col("ambiguous"), "ambiguous_stop_pair").when(F.col("analysed") > 0, "available").otherwise("not_analyzed")
    return met.groupBy(*own).agg(*counted(F.col("episode"), F.first("analysed"), F.col("day"))).withColumn("status", status).drop("analysed", "ambiguous")


def located(sections: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: distinct episodes of all evidence and of what lies on a section that isn't ambiguous, and evidence without a section of its own."""
    keys = ["line", "direction_id", "from_stop", "to_stop"]
    on = sections.where("not ambiguous").select(*keys).distinct().withColumn("on", F.lit(True))
    return evidence.join(on, keys, "left").agg(F.count_distinct("episode").alias("episodes"), F.count_distinct(F.when(F.col("on"), F.col("episode"))).alias("mapped_episodes"), F.count_if(F.col("from_stop").isNull()).alias("unlocated"))
