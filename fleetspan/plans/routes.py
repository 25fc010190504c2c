"""Queries of linear referencing: traffic and bunching by the stop sections of routes' shapes, against brute force over all pieces and sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspan.functions import geo
from fleetspan.operators import catalogue, detect, routes, traffic
from fleetspan.plans.book import Book, plain
from fleetspan.plans.detector import candidates_of
from fleetspan.plans.oracle import sql
from fleetspan.plans.reports import RATIO
from fleetspan.sources import adapter, files

BOOK = Book()
#: A plot from 07:10 to 10:50 of the first day.
PLOT = (1_704_067_200_000_000 + 430 * 60_000_000, 1_704_067_200_000_000 + 650 * 60_000_000)
SIDE = {0: 0.0, 1: 0.0001, 2: 0.001}


def jam_rows(spark, sf, *keys):
    """Jam reports, some of an unknown intensity or without a line."""
    j = adapter.jams(spark, sf)
    at = lambda n: F.pmod("jam_id", F.lit(n)) == 0
    j = j.withColumns({"intensity": F.when(at(11), "Desconhecida").otherwise(F.col("intensity")), "geometry_wkt": F.when(at(13), "POINT(-9.2 38.7)").otherwise(F.col("geometry_wkt"))})
    return traffic.grouped(j, *keys)


def side(number):
    return F.when(number % 3 == 0, SIDE[0]).when(number % 3 == 1, SIDE[1]).otherwise(SIDE[2])


def shapes_of(spark, sf):
    """line, direction_id, shape_id, points of each line: along the jams' road, some metres to its side, and away from it at the end. Each eighth line has none but a chord."""
    lines = adapter.visits(spark, sf).select("line", "direction_id").distinct().withColumn("k", F.substring("line", 2, 9).cast("long"))
    points = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct((F.lit(-9.2) + i * 0.001 + side(F.col("k"))).alias("lon"), (F.lit(38.7) + F.least(i, F.lit(8)) * 0.001).alias("lat")))
    return lines.select("line", "direction_id", F.concat(F.when(F.col("k") % 8 == 7, routes.CHORDS).otherwise(""), "line", F.lit("/"), "direction_id").alias("shape_id"), points.alias("points"))


def sections_of(spark, sf):
    """Sections of each line's reference trip, with line and direction_id; its stops lie near the shape, one of each ninth line far from it."""
    v = adapter.visits(spark, sf)
    shapes = shapes_of(spark, sf)
    s = v.join(routes.reference_trips(v), ["line", "direction_id", "trip_id"], "left_semi").join(shapes, ["line", "direction_id"])
    k, i = F.substring("line", 2, 9).cast("long"), F.col("stop_sequence") - 1
    far = F.when((k % 9 == 4) & (F.col("stop_sequence") == 3), 0.01).otherwise(0.0)
    x, y = geo.metres(F.lit(38.7) + i * 0.0016 + far, F.lit(-9.2) + i * 0.0016 + side(k) + 0.0001)
    stops = s.select("line", "direction_id", "trip_id", "shape_id", "stop_id", F.col("stop_sequence").cast("int").alias("stop_sequence"), x.alias("x"), y.alias("y"))
    px, py = (lambda p: geo.metres(p["lat"], p["lon"])[0]), (lambda p: geo.metres(p["lat"], p["lon"])[1])
    placed = traffic.stop_paths(stops, shapes.select("shape_id", F.transform("points", lambda p: F.struct(px(p).alias("x"), py(p).alias("y"))).alias("points")))
    return routes.stop_sections(stops, placed).join(stops.select("trip_id", "line", "direction_id").distinct(), "trip_id"), shapes


def traffic_of(spark, sf):
    sections, shapes = sections_of(spark, sf)
    jams = jam_rows(spark, sf, "minute")
    return routes.section_traffic(files.shared(sections, "sections"), routes.shape_pieces(shapes), jams)


K = "substr(line, 2)::BIGINT"
SIDES = f"CASE WHEN {K} % 3 = 0 THEN 0.0 WHEN {K} % 3 = 1 THEN 0.0001 ELSE 0.001 END::DOUBLE"
MX, MY = f"{geo.METRES_A_DEGREE}::DOUBLE * cos(radians({geo.REFERENCE_LAT}::DOUBLE))", f"{geo.METRES_A_DEGREE}::DOUBLE"
#: Brute force: each stop against all pieces of its shape, each section against all of them, each of these parts against all jam segments.
PARTS = {
    "reference": "SELECT line, direction_id, arg_min(trip_id, (-n, trip_id)) AS trip_id FROM (SELECT line, direction_id, trip_id, count(*) AS n FROM visits GROUP BY 1, 2, 3) GROUP BY 1, 2",
    "shape_ids": f"SELECT *, (CASE WHEN {K} % 8 = 7 THEN 'stops-' ELSE '' END) || line || '/' || direction_id AS shape_id FROM (SELECT DISTINCT line, direction_id FROM visits)",
    "corners": f"SELECT line, direction_id, shape_id, i, (-9.2::DOUBLE + i * 0.001::DOUBLE + {SIDES}) * {MX} AS x, (38.7::DOUBLE + least(i, 8) * 0.001::DOUBLE) * {MY} AS y FROM shape_ids, (SELECT unnest(range(10)) AS i)",
    "straight": "SELECT a.line, a.direction_id, a.shape_id, a.i AS seg, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS len FROM corners a JOIN corners b ON a.shape_id = b.shape_id AND b.i = a.i + 1",
    "shape_cut": "SELECT *, x1 + (x2 - x1) * piece / n AS px, y1 + (y2 - y1) * piece / n AS py, x1 + (x2 - x1) * (piece + 1) / n AS qx, y1 + (y2 - y1) * (piece + 1) / n AS qy, len / n AS metres, sum(len / n) OVER (PARTITION BY shape_id ORDER BY seg, piece) - len / n AS start FROM (SELECT *, unnest(range(n)) AS piece FROM (SELECT *, greatest(1, ceil(len / 25))::INT AS n FROM straight))",
    "route_stops": f"SELECT trip_id, line, direction_id, shape_id, stop_id, stop_sequence, (-9.2::DOUBLE + (stop_sequence - 1) * 0.0016::DOUBLE + {SIDES} + 0.0001::DOUBLE) * {MX} AS x, (38.7::DOUBLE + (stop_sequence - 1) * 0.0016::DOUBLE + CASE WHEN {K} % 9 = 4 AND stop_sequence = 3 THEN 0.01 ELSE 0 END::DOUBLE) * {MY} AS y FROM visits JOIN reference USING (line, direction_id, trip_id) JOIN shape_ids USING (line, direction_id)",
    "projected": """SELECT trip_id, stop_sequence, min(off) AS off, arg_min(along, (round(off, 6), along)) AS along FROM (SELECT trip_id, stop_sequence, start + u * metres AS along, sqrt((x - px - u * (qx - px)) ** 2 + (y - py - u * (qy - py)) ** 2) AS off FROM (
      SELECT s.trip_id, s.stop_sequence, s.x, s.y, c.px, c.py, c.qx, c.qy, c.start, c.metres, least(1, greatest(0, ((x - px) * (qx - px) + (y - py) * (qy - py)) / metres ** 2)) AS u FROM route_stops s JOIN shape_cut c USING (shape_id))) GROUP BY 1, 2""",
    "sections": """SELECT *, count(*) OVER (PARTITION BY trip_id, from_stop, to_stop) > 1 AS ambiguous FROM (SELECT trip_id, line, direction_id, shape_id, trip_id || '|' || stop_sequence AS road, stop_id AS from_stop, lead(stop_id) OVER w AS to_stop, stop_sequence AS from_sequence, lead(stop_sequence) OVER w AS to_sequence,
      CASE WHEN lead(along) OVER w > along THEN along END AS lo, CASE WHEN lead(along) OVER w > along THEN lead(along) OVER w END AS hi FROM (SELECT s.*, CASE WHEN off <= 100 THEN along END AS along FROM route_stops s JOIN projected USING (trip_id, stop_sequence)) WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence)) WHERE to_stop IS NOT NULL""",
    "parts": """SELECT road, seg, piece, r - l AS metres, px + (qx - px) * (l - start) / metres AS px, py + (qy - py) * (l - start) / metres AS py, px + (qx - px) * (r - start) / metres AS qx, py + (qy - py) * (r - start) / metres AS qy
      FROM (SELECT s.road, c.*, greatest(lo, start) AS l, least(hi, start + metres) AS r FROM sections s JOIN shape_cut c USING (shape_id) WHERE lo IS NOT NULL) WHERE r > l""",
    "odd_jams": "SELECT * REPLACE (CASE WHEN jam_id % 11 = 0 THEN 'Desconhecida' ELSE intensity END AS intensity, CASE WHEN jam_id % 13 = 0 THEN 'POINT(-9.2 38.7)' ELSE geometry_wkt END AS geometry_wkt) FROM jams",
    "jam_lines": f"SELECT geometry_wkt, p[1]::DOUBLE * {MX} AS jx, p[2]::DOUBLE * {MY} AS jy, p[3]::DOUBLE * {MX} AS kx, p[4]::DOUBLE * {MY} AS ky FROM (SELECT DISTINCT geometry_wkt, string_split(replace(replace(replace(geometry_wkt, 'LINESTRING(', ''), ')', ''), ', ', ' '), ' ') AS p FROM odd_jams WHERE geometry_wkt LIKE 'LINE%')",
}


def met(parts: str) -> str:
    """Pairs of parts and jam geometries that match."""
    return f"""SELECT * FROM (SELECT *, least(1, greatest(0, ((mx - jx) * (kx - jx) + (my - jy) * (ky - jy)) / ((kx - jx) ** 2 + (ky - jy) ** 2))) AS u FROM (SELECT p.*, j.*, (px + qx) / 2 AS mx, (py + qy) / 2 AS my FROM {parts} p CROSS JOIN jam_lines j))
      WHERE sqrt((mx - jx - u * (kx - jx)) ** 2 + (my - jy - u * (ky - jy)) ** 2) <= 25 AND abs((qx - px) * (kx - jx) + (qy - py) * (ky - jy)) / (metres * sqrt((kx - jx) ** 2 + (ky - jy) ** 2)) >= 0.8660254037844387"""


PARTS |= {
    "hits": met("parts"),
    "slots": f"SELECT geometry_wkt, day, intensity, minute, count(*) AS reports, any_value({RATIO}) AS r FROM odd_jams WHERE ({RATIO}) IS NOT NULL GROUP BY 1, 2, 3, 4",
    "part_slots": "SELECT road, seg, piece, any_value(metres) AS metres, minute, day, sum(r * reports) / sum(reports) AS r FROM hits JOIN slots USING (geometry_wkt) GROUP BY road, seg, piece, minute, day",
    "section_cells": """SELECT road, minute, ratio, days, reports, covered / (SELECT sum(metres) FROM parts p WHERE p.road = a.road) AS coverage FROM (SELECT road, minute, avg(r) AS ratio, count(*) AS days FROM (SELECT road, minute, day, sum(r * metres) / sum(metres) AS r FROM part_slots GROUP BY 1, 2, 3) GROUP BY 1, 2) a
      JOIN (SELECT road, minute, sum(metres) AS covered FROM (SELECT DISTINCT road, minute, seg, piece, metres FROM part_slots) GROUP BY 1, 2) b USING (road, minute) JOIN (SELECT road, minute, sum(reports)::BIGINT AS reports FROM (SELECT DISTINCT road, geometry_wkt FROM hits) JOIN slots USING (geometry_wkt) GROUP BY 1, 2) c USING (road, minute)""",
}


@BOOK.add("a27_stop_sections", sql("SELECT road, from_stop, to_stop, from_sequence::INT AS from_sequence, to_sequence::INT AS to_sequence, round(coalesce(hi - lo, 0), 3) AS metres, lo IS NOT NULL AS available, minute, round(ratio, 4) AS ratio, days, reports, round(coverage, 4) AS coverage FROM sections LEFT JOIN section_cells USING (road)", **PARTS))
def _(spark, sf):
    t = traffic_of(spark, sf)
    return t.select("road", "from_stop", "to_stop", "from_sequence", "to_sequence", F.round("metres", 3).alias("metres"), "available", "minute", F.round("ratio", 4).alias("ratio"), "days", "reports", F.round("coverage", 4).alias("coverage"))


@BOOK.add("a70_section_plot", sql(f"""SELECT s.road, greatest(tick, {PLOT[0]}) AS start_us, least(tick + 1800000000, {PLOT[1]}) AS end_us, round(ratio, 4) AS ratio, coalesce(ratio <= 40, false) AS heavy, round(CASE WHEN ratio <= 40 THEN CASE WHEN days < 2 THEN 0.08 ELSE 0.1 + 0.1 * coverage END ELSE 0 END, 4) AS opacity
  FROM (SELECT road FROM sections s WHERE (SELECT count(*) FROM sections o WHERE o.trip_id = s.trip_id AND o.from_stop = s.from_stop AND o.to_stop = s.to_stop) = 1) s CROSS JOIN (SELECT unnest(range({PLOT[0] // 1_800_000_000 * 1_800_000_000}, {PLOT[1]}, 1800000000)) AS tick) LEFT JOIN section_cells c ON c.road = s.road AND c.minute = (tick // 60000000) % 1440""", **PARTS))
def _(spark, sf):
    t = files.shared(traffic_of(spark, sf), "section-traffic")
    shown = t.select("trip_id", F.col("road").alias("place"), "from_stop", "to_stop", F.lit(None).cast("int").alias("from_sequence"), F.lit(None).cast("int").alias("to_sequence")).distinct()
    return plain(routes.plot_cells(shown, t, *PLOT), 4).withColumnRenamed("place", "road").drop("trip_id")


ROUTE = {
    "route_hits": met("(SELECT shape_id, seg, piece, px, py, qx, qy, metres FROM shape_cut WHERE shape_id NOT LIKE 'stops-%')"),
    "rows": f"SELECT geometry_wkt, day, intensity, count(*) AS reports, avg(speed_kmh) AS speed, count(speed_kmh) AS ns, any_value({RATIO}) AS r FROM odd_jams WHERE ({RATIO}) IS NOT NULL GROUP BY 1, 2, 3",
    "by_day": "SELECT shape_id, seg, piece, day, sum(r * reports) / sum(reports) AS ratio, sum(speed * ns) / nullif(sum(CASE WHEN speed IS NOT NULL THEN ns END), 0) AS speed, sum(reports) AS reports FROM route_hits JOIN rows USING (geometry_wkt) GROUP BY 1, 2, 3, 4",
    "by_piece": "SELECT c.shape_id, c.seg, c.piece, c.metres, round(s.ratio, 1) AS ratio, round(s.speed, 1) AS speed, coalesce(s.reports, 0)::BIGINT AS reports, coalesce(s.days, 0)::BIGINT AS days FROM shape_cut c LEFT JOIN (SELECT shape_id, seg, piece, avg(ratio) AS ratio, avg(speed) AS speed, sum(reports) AS reports, count(*) AS days FROM by_day GROUP BY 1, 2, 3) s USING (shape_id, seg, piece)",
}


def route_speeds_of(spark, sf):
    return routes.route_speeds(routes.shape_pieces(shapes_of(spark, sf)), jam_rows(spark, sf))


@BOOK.add("a26_route_coverage", sql("SELECT shape_id AS road, round(sum(metres), 3) AS metres, round(coalesce(sum(metres) FILTER (days > 0), 0), 3) AS matched_metres FROM by_piece GROUP BY 1", **(PARTS | ROUTE)))
def _(spark, sf):
    return plain(traffic.coverage(route_speeds_of(spark, sf)), 3)


@BOOK.add("w26_route_sections", sql("""SELECT shape_id AS road, section::BIGINT AS section, round(sum(metres), 3) AS metres, count(*) AS pieces, any_value(reports) AS reports, any_value(days) AS days FROM (SELECT *, sum(fresh) OVER (PARTITION BY shape_id ORDER BY seg, piece) AS section FROM (
  SELECT *, CASE WHEN lag(piece) OVER w IS NOT NULL AND ratio IS NOT DISTINCT FROM lag(ratio) OVER w AND speed IS NOT DISTINCT FROM lag(speed) OVER w AND reports = lag(reports) OVER w AND days = lag(days) OVER w THEN 0 ELSE 1 END AS fresh FROM by_piece WINDOW w AS (PARTITION BY shape_id ORDER BY seg, piece))) GROUP BY 1, 2""", **(PARTS | ROUTE)))
def _(spark, sf):
    return plain(traffic.sections(route_speeds_of(spark, sf)).select("road", "section", "metres", "pieces", "reports", "days"), 3)


@BOOK.add("a26_ignored_reports", sql(f"SELECT count(*) FILTER (({RATIO}) IS NULL OR geometry_wkt LIKE 'POINT%') AS ignored, count(*) AS reports FROM odd_jams", odd_jams=PARTS["odd_jams"]))
def _(spark, sf):
    return routes.ignored_reports(jam_rows(spark, sf))


EVIDENCE = PARTS | {
    "proof": "SELECT i.line, i.direction_id, v.stop_before AS from_stop, i.stop_id AS to_stop, i.pair || i.island || i.day AS episode, i.day, t1, t2 FROM islands i LEFT JOIN (SELECT trip_id, stop_id, lag(stop_id) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS stop_before FROM visits) v ON v.trip_id = second_trip AND v.stop_id = i.stop_id",
    "analysed": "SELECT count(DISTINCT day) AS n FROM pings",
}


def proof_of(spark, sf):
    """Evidence of episodes with the section that the later bus came by."""
    before = catalogue.previous_stops(adapter.visits(spark, sf))
    e = routes.evidence_of(detect.islands(candidates_of(spark, sf)), before)
    return e.withColumn("episode", F.concat("pair", F.col("island").cast("string"), F.col("day").cast("string")))


def analysed_of(spark, sf):
    return adapter.pings(spark, sf).select("day").distinct().count()


@BOOK.add("a20_stop_heatmap", sql("""SELECT s.road, s.from_stop, s.to_stop, CASE WHEN ambiguous THEN 'ambiguous_stop_pair' ELSE 'available' END AS status, CASE WHEN NOT ambiguous THEN count(DISTINCT episode) END AS episodes, CASE WHEN NOT ambiguous THEN count(DISTINCT p.day) END AS days, CASE WHEN NOT ambiguous THEN round(count(DISTINCT episode) / any_value(n), 4) END AS per_day
  FROM sections s CROSS JOIN analysed LEFT JOIN proof p ON p.line = s.line AND p.direction_id = s.direction_id AND p.from_stop = s.from_stop AND p.to_stop = s.to_stop AND NOT ambiguous GROUP BY s.road, s.from_stop, s.to_stop, ambiguous""", **EVIDENCE))
def _(spark, sf):
    h = routes.section_heatmap(sections_of(spark, sf)[0], proof_of(spark, sf), analysed_of(spark, sf))
    return plain(h.select("road", "from_stop", "to_stop", "status", "episodes", "days", "per_day"), 4)


@BOOK.add("a20_stop_cells", sql("""SELECT s.road, m AS minute, CASE WHEN NOT ambiguous THEN count(DISTINCT episode) END AS episodes, CASE WHEN NOT ambiguous THEN count(DISTINCT p.day) END AS days
  FROM sections s CROSS JOIN (SELECT (unnest(range(0, 1411, 30)))::INT AS m) LEFT JOIN proof p ON p.line = s.line AND p.direction_id = s.direction_id AND p.from_stop = s.from_stop AND p.to_stop = s.to_stop AND NOT ambiguous AND ((t1 + t2) // 2 // 60000000 % 1440) // 30 * 30 = m GROUP BY s.road, m, ambiguous""", **EVIDENCE))
def _(spark, sf):
    return routes.section_heatmap(sections_of(spark, sf)[0], proof_of(spark, sf), analysed_of(spark, sf), cells=True).select("road", "minute", "episodes", "days")


@BOOK.add("a21_located_history", sql("SELECT count(DISTINCT episode) AS episodes, count(DISTINCT episode) FILTER (EXISTS (SELECT 1 FROM sections s WHERE p.line = s.line AND p.direction_id = s.direction_id AND p.from_stop = s.from_stop AND p.to_stop = s.to_stop AND NOT ambiguous)) AS mapped_episodes, count(*) FILTER (from_stop IS NULL) AS unlocated FROM proof p", **EVIDENCE))
def _(spark, sf):
    return routes.located(sections_of(spark, sf)[0], proof_of(spark, sf))
