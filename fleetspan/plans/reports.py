"""Queries of KPIs, traffic and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspan.functions import geo
from fleetspan.operators import kpis, passages, quality, traffic
from fleetspan.plans.base import FLAT, flat_visits, judged_of
from fleetspan.plans.book import Book, plain
from fleetspan.plans.oracle import FRAGMENTS, sql
from fleetspan.sources import adapter

BOOK = Book()

FRAGMENTS |= {
    "bank": "SELECT day, trip_id, line, stop_id AS from_stop, stop1 AS to_stop, t, (t1 - t) / 1e6 AS run_s FROM (SELECT *, lead(stop_id) OVER w AS stop1, lead(seq) OVER w AS seq1, lead(t) OVER w AS t1 FROM feat WINDOW w AS (PARTITION BY day, trip_id, vehicle_id ORDER BY seq, t)) WHERE seq1 = seq + 1 AND (t1 - t) / 1e6 BETWEEN 0 AND 18000",
    "options": """SELECT line, scenario, avg(saved) AS mean_saved, min(saved) AS worst, max(saved) AS best, min(p5) AS p5, max(vehicles) AS vehicles, avg(hold) AS hold, avg(wait) AS wait, bool_and(p5 > 0) AS robust FROM (
      SELECT line, scenario, k, day, avg(saved) AS saved, list_sort(list(saved))[floor(0.05 * (count(*) - 1))::INT + 1] AS p5, max(vehicles) AS vehicles, avg(hold) AS hold, avg(wait) AS wait FROM kpi_rows GROUP BY 1, 2, 3, 4) GROUP BY 1, 2""",
    "fit": "SELECT *, hw / sched_hw < 0.25 AS short, greatest(hw, 0) AS gap FROM feat WHERE hw IS NOT NULL AND sched_hw BETWEEN 120 AND 3600",
    "begun": "SELECT *, first_seq <= greatest(usual, 2) AS dispatchable FROM (SELECT day, trip_id, vehicle_id, line, direction_id, min(seq) AS first_seq, max(seq) AS last_seq, arg_min(t, (seq, t)) AS begins, arg_max(t, (seq, t)) AS ends, arg_min(sched_us, (seq, t)) AS planned_us FROM feat GROUP BY ALL) JOIN (SELECT line, direction_id, arg_max(first_seq, (n, -first_seq)) AS usual FROM (SELECT line, direction_id, first_seq, count(*) AS n FROM (SELECT line, direction_id, min(seq) AS first_seq FROM feat GROUP BY day, trip_id, vehicle_id, line, direction_id) GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (line, direction_id)",
    "bank_gaps": "SELECT day, trip_id, line, stop_id AS from_stop, stop1 AS to_stop, t, (t1 - t) / 1e6 AS run_s, hw, sched_hw FROM (SELECT *, lead(stop_id) OVER w AS stop1, lead(seq) OVER w AS seq1, lead(t) OVER w AS t1 FROM feat WINDOW w AS (PARTITION BY day, trip_id, vehicle_id ORDER BY seq, t)) WHERE seq1 = seq + 1 AND (t1 - t) / 1e6 BETWEEN 0 AND 18000",
    "jam_rows": "SELECT geometry_wkt, intensity, day, count(*) AS reports, avg(speed_kmh) AS speed_kmh, count(speed_kmh) AS speed_reports FROM (SELECT * REPLACE (CASE WHEN speed_kmh >= 0 THEN speed_kmh END AS speed_kmh) FROM jams) GROUP BY 1, 2, 3",
    "steps": "SELECT *, (created_us - us0) / 1e6 AS since_s, 2 * 6371000.0 * asin(sqrt(pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2))) AS moved_m FROM (SELECT *, lag(created_us) OVER w AS us0, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(seq) OVER w AS seq0, lag(trip_id) OVER w AS trip0 FROM pings WINDOW w AS (PARTITION BY day, vehicle_id ORDER BY created_us, event_id)) WHERE us0 IS NOT NULL",
}


@BOOK.add("a40_headway_kpis", sql("SELECT line, direction_id, sum(n)::BIGINT AS gaps, round(sum(b) / sum(n), 6) AS bunched_share, round(avg(sd / mean) FILTER (n >= 3 AND s > 0), 6) AS cv, round(sum((ss / (2 * s) - mean / 2) * n) FILTER (n >= 3 AND s > 0) / sum(n) FILTER (n >= 3 AND s > 0), 4) AS excess_wait_s FROM (SELECT line, direction_id, stop_id, count(*) AS n, avg(gap) AS mean, stddev_pop(gap) AS sd, sum(gap) AS s, sum(gap * gap) AS ss, count(*) FILTER (short) AS b FROM fit GROUP BY 1, 2, 3) GROUP BY 1, 2"))
def _(spark, sf):
    k = kpis.headway_kpis(judged_of(spark, sf))
    return plain(k.withColumn("excess_wait_s", F.round("excess_wait_s", 4)))


@BOOK.add("a40_trip_times", sql("SELECT line, direction_id, count(*) AS trips, round(avg((ends - begins) / 1e6), 4) AS trip_s FROM begun GROUP BY 1, 2"))
def _(spark, sf):
    return plain(kpis.trip_times(judged_of(spark, sf)), 4)


@BOOK.add("w22_dispatchable", sql("SELECT day::VARCHAR AS day, trip_id, vehicle_id, first_seq, usual, dispatchable FROM begun"))
def _(spark, sf):
    return plain(kpis.starts(judged_of(spark, sf)).select("day", "trip_id", "vehicle_id", "first_seq", "usual", "dispatchable"))


@BOOK.add("w23_unbroken", sql("SELECT day::VARCHAR AS day, trip_id, vehicle_id, round(pace, 6) AS pace_s FROM (SELECT *, median(pace) OVER (PARTITION BY line, direction_id) AS usual_pace FROM (SELECT *, (ends - begins) / 1e6 / greatest(last_seq - first_seq, 1) AS pace FROM begun)) WHERE pace <= 2 * usual_pace"))
def _(spark, sf):
    return plain(kpis.unbroken(kpis.starts(judged_of(spark, sf))).select("day", "trip_id", "vehicle_id", "pace_s"))


@BOOK.add("a41_departure_buckets", sql("SELECT low::DOUBLE AS low, high::DOUBLE AS high, count(*) AS trips, count(*) FILTER (later) AS bunch_later FROM (SELECT day, trip_id, vehicle_id, max(r) FILTER (n = 1) AS dep, coalesce(bool_or(r < 0.25) FILTER (n > 1), false) AS later FROM (SELECT *, CASE WHEN hw IS NOT NULL AND sched_hw BETWEEN 120 AND 3600 THEN hw / sched_hw END AS r, row_number() OVER (PARTITION BY day, trip_id, vehicle_id ORDER BY seq, t) AS n FROM feat) GROUP BY 1, 2, 3) SEMI JOIN (SELECT * FROM begun WHERE dispatchable) USING (day, trip_id, vehicle_id), (VALUES (0.25, 0.5), (0.5, 0.75), (0.75, 0.9), (0.9, 1.1)) c(low, high) WHERE dep >= low AND dep < high GROUP BY 1, 2"))
def _(spark, sf):
    return plain(kpis.departure_buckets(judged_of(spark, sf)))


@BOOK.add("a42_growth", sql("SELECT line, round(avg(short::INT) FILTER (progress <= 0.4), 6) AS early, round(avg(short::INT) FILTER (progress >= 0.6), 6) AS late FROM fit GROUP BY 1"))
def _(spark, sf):
    return plain(kpis.growth(judged_of(spark, sf)))


@BOOK.add("a43_extra_buses", sql("SELECT line, max(buses)::BIGINT AS buses FROM (SELECT line, direction_id, ceil(240.0 / median(gap)) AS buses FROM (SELECT *, (planned_us - lag(planned_us) OVER (PARTITION BY day, line, direction_id ORDER BY planned_us, trip_id, vehicle_id)) / 1e6 AS gap FROM begun WHERE dispatchable) WHERE gap > 0 GROUP BY 1, 2) GROUP BY 1"))
def _(spark, sf):
    return kpis.extra_buses(judged_of(spark, sf), 120)


def bank(spark, sf):
    """Runs of up to five hours, since derived trips are slow."""
    return kpis.run_bank(judged_of(spark, sf), 18000)


@BOOK.add("a44_run_bank", sql("SELECT day::VARCHAR AS day, trip_id, from_stop, to_stop, round(run_s, 6) AS run_s FROM bank"))
def _(spark, sf):
    return plain(bank(spark, sf).select("day", "trip_id", "from_stop", "to_stop", "run_s"))


@BOOK.add("a45_local_median", sql("SELECT b.day::VARCHAR AS day, b.trip_id, b.from_stop, b.to_stop, round(CASE WHEN n1 >= 5 THEN m1 WHEN n2 >= 5 THEN m2 WHEN n3 >= 5 THEN m3 ELSE m END, 4) AS median_s FROM bank b JOIN (SELECT from_stop, to_stop, median(run_s) AS m FROM bank GROUP BY 1, 2) a USING (from_stop, to_stop), LATERAL (SELECT count(*) FILTER (abs(c.t - b.t) <= 900000000) AS n1, median(c.run_s) FILTER (abs(c.t - b.t) <= 900000000) AS m1, count(*) FILTER (abs(c.t - b.t) <= 1800000000) AS n2, median(c.run_s) FILTER (abs(c.t - b.t) <= 1800000000) AS m2, count(*) AS n3, median(c.run_s) AS m3 FROM bank c WHERE c.from_stop = b.from_stop AND c.to_stop = b.to_stop AND abs(c.t - b.t) <= 3600000000) x"))
def _(spark, sf):
    return plain(kpis.local_median(bank(spark, sf)).select("day", "trip_id", "from_stop", "to_stop", "median_s"), 4)


# the median of a run's segment around a time of row b, from all runs of the segment
LOCAL = "(SELECT CASE WHEN n1 >= 5 THEN m1 WHEN n2 >= 5 THEN m2 WHEN n3 >= 5 THEN m3 ELSE m END FROM (SELECT count(*) FILTER (abs(c.t - {at}) <= 900000000) AS n1, median(c.run_s) FILTER (abs(c.t - {at}) <= 900000000) AS m1, count(*) FILTER (abs(c.t - {at}) <= 1800000000) AS n2, median(c.run_s) FILTER (abs(c.t - {at}) <= 1800000000) AS m2, count(*) FILTER (abs(c.t - {at}) <= 3600000000) AS n3, median(c.run_s) FILTER (abs(c.t - {at}) <= 3600000000) AS m3, median(c.run_s) AS m FROM bank c WHERE c.from_stop = b.from_stop AND c.to_stop = b.to_stop))"


@BOOK.add("a46_shift_error", sql(f"SELECT from_stop, to_stop, count(*) AS n, round(avg(abs(run_s - r0)), 4) AS mae_s, round(avg(abs(run_s - r0 * f)), 4) AS scaled_mae_s, CASE WHEN avg(abs(run_s - r0)) <= avg(abs(run_s - r0 * f)) THEN 'unscaled' ELSE 'scaled' END AS better FROM (SELECT *, CASE WHEN before > 0 THEN least(2.0, greatest(0.5, after / before)) ELSE 1.0 END AS f FROM (SELECT b.*, {LOCAL.format(at='b.t')} AS after, {LOCAL.format(at='b.t0')} AS before FROM (SELECT *, lag(run_s) OVER w AS r0, lag(t) OVER w AS t0 FROM bank WINDOW w AS (PARTITION BY from_stop, to_stop ORDER BY t, trip_id, day)) b WHERE t - t0 >= 300000000)) GROUP BY 1, 2"))
def _(spark, sf):
    return plain(kpis.shift_error(bank(spark, sf)), 4)


@BOOK.add("a47_dwell_slope", sql(f"SELECT line, count(*) AS n, round(regr_slope(run_s - m, dev), 4) AS slope FROM (SELECT b.line, b.run_s, b.dev, {LOCAL.format(at='b.t')} AS m FROM (SELECT *, greatest(hw, 0) - sched_hw AS dev FROM bank_gaps WHERE hw IS NOT NULL AND sched_hw BETWEEN 120 AND 3600) b WHERE abs(dev) <= 1200) GROUP BY 1"))
def _(spark, sf):
    return plain(kpis.dwell_slope(judged_of(spark, sf), longest=18000), 4)


@BOOK.add("a48_scenarios", sql("SELECT line, scenario, round(mean_saved, 4) AS mean_saved, round(worst, 4) AS worst, round(best, 4) AS best, round(p5, 4) AS p5, vehicles, round(hold, 4) AS hold, round(wait, 4) AS wait, robust FROM options"))
def _(spark, sf):
    return plain(kpis.scenarios(adapter.scenario_kpis(spark, sf)), 4)


@BOOK.add("a49_recommended", sql("SELECT line, scenario, round(mean_saved, 4) AS mean_saved, vehicles, round(hold, 4) AS hold, round(wait, 4) AS wait FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY vehicles, hold, wait, scenario) AS r FROM (SELECT *, max(mean_saved) OVER (PARTITION BY line) AS top FROM options WHERE robust) WHERE mean_saved >= 0.75 * top) WHERE r = 1"))
def _(spark, sf):
    return plain(kpis.recommended(kpis.scenarios(adapter.scenario_kpis(spark, sf))), 4)


@BOOK.add("a50_best_change", sql("SELECT line, scenario, round(mean_saved, 4) AS mean_saved, vehicles, round(hold, 4) AS hold, round(wait, 4) AS wait FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY vehicles, hold + wait, scenario) AS r FROM (SELECT *, max(mean_saved) OVER (PARTITION BY line) AS top FROM options WHERE robust AND mean_saved > 0) WHERE mean_saved >= top - greatest(1.0, 0.05 * top)) WHERE r = 1"))
def _(spark, sf):
    return plain(kpis.best_change(kpis.scenarios(adapter.scenario_kpis(spark, sf))), 4)


@BOOK.add("a51_shortest_hold", sql("SELECT line, scenario, round(mean_saved, 4) AS mean_saved, round(hold, 4) AS hold FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY hold, mean_saved DESC, scenario) AS r FROM (SELECT *, max(mean_saved) OVER (PARTITION BY line) AS top FROM options) WHERE top > 0 AND mean_saved >= 0.75 * top) WHERE r = 1"))
def _(spark, sf):
    return plain(kpis.shortest_hold(kpis.scenarios(adapter.scenario_kpis(spark, sf))), 4)


@BOOK.add("w24_chain", sql("SELECT day::VARCHAR AS day, trip_id, vehicle_id, trip_before, round((begins - e0) / 1e6, 6) AS gap_s, round(least(60, (begins - e0) / 1e6), 6) AS layover_s FROM (SELECT *, lag(trip_id) OVER w AS trip_before, lag(ends) OVER w AS e0 FROM begun WINDOW w AS (PARTITION BY day, vehicle_id ORDER BY begins, trip_id)) WHERE e0 <= begins"))
def _(spark, sf):
    return plain(kpis.vehicle_chain(judged_of(spark, sf)))


#: What is seen of trips when sign-ups aren't taken as pings: a source with stops that no ping reports.
SPARSE = {"seen": "SELECT agency_id, day, trip_id, vehicle_id, stop_id, min(created_us) AS t_first, max(created_us) AS t_pass FROM pings WHERE event_type <> 'signup' GROUP BY ALL"}


def sparse(spark, sf):
    return passages.stop_passages(adapter.pings(spark, sf).where("event_type <> 'signup'"), adapter.visits(spark, sf))


@BOOK.add("w21_interpolated", sql("""SELECT day::VARCHAR AS day, trip_id, seq, round(max(u) OVER (PARTITION BY day, trip_id, vehicle_id ORDER BY seq), 0) AS t, seen FROM (
  SELECT day, trip_id, vehicle_id, seq, t IS NOT NULL AS seen, coalesce(t::DOUBLE, ta + (tb - ta) * (seq - aseq) / (bseq - aseq)) AS u FROM (
    SELECT g.*, p.t, last_value(p.t IGNORE NULLS) OVER a AS ta, last_value(CASE WHEN p.t IS NOT NULL THEN g.seq END IGNORE NULLS) OVER a AS aseq, first_value(p.t IGNORE NULLS) OVER b AS tb, first_value(CASE WHEN p.t IS NOT NULL THEN g.seq END IGNORE NULLS) OVER b AS bseq
    FROM (SELECT DISTINCT day, trip_id, vehicle_id, v.stop_sequence AS seq FROM stop_passages JOIN (SELECT trip_id, stop_sequence FROM visits) v USING (trip_id)) g LEFT JOIN stop_passages p USING (day, trip_id, vehicle_id, seq)
    WINDOW a AS (PARTITION BY g.day, g.trip_id, g.vehicle_id ORDER BY g.seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY g.day, g.trip_id, g.vehicle_id ORDER BY g.seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))) WHERE u IS NOT NULL""", **SPARSE))
def _(spark, sf):
    return plain(kpis.interpolated(sparse(spark, sf), adapter.visits(spark, sf)).select("day", "trip_id", "seq", F.round("t", 0).alias("t"), "seen"))


@BOOK.add("w27_bunched_runs", sql("SELECT day::VARCHAR AS day, trip_id, vehicle_id, run::BIGINT AS run, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS stops FROM (SELECT *, sum(fresh) OVER (PARTITION BY day, trip_id, vehicle_id ORDER BY seq, t) AS run FROM (SELECT *, CASE WHEN lag(bunched) OVER (PARTITION BY day, trip_id, vehicle_id ORDER BY seq, t) = bunched THEN 0 ELSE 1 END AS fresh FROM feat)) WHERE bunched GROUP BY 1, 2, 3, 4"))
def _(spark, sf):
    return plain(kpis.bunched_runs(judged_of(spark, sf)))


@BOOK.add("w28_held", sql("SELECT day::VARCHAR AS day, trip_id, seq, t + sum(CASE WHEN seq IN (2, 4) THEN 30 ELSE 0 END) OVER (PARTITION BY day, trip_id, vehicle_id ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT * 1000000 AS t_held FROM feat"))
def _(spark, sf):
    p = judged_of(spark, sf)
    holds = p.select("trip_id", "seq").distinct().where("seq in (2, 4)").withColumn("hold_s", F.lit(30))
    return plain(kpis.held(p, holds).select("day", "trip_id", "seq", "t_held"))


@BOOK.add("a23_jam_groups", sql("SELECT geometry_wkt, intensity, day::VARCHAR AS day, reports, round(speed_kmh, 5) AS speed_kmh, speed_reports FROM jam_rows"))
def _(spark, sf):
    return plain(traffic.grouped(adapter.jams(spark, sf)), 5)


@BOOK.add("x21_jam_points", sql("SELECT geometry_wkt, count(*) AS n, 2 AS points FROM jams GROUP BY 1"))
def _(spark, sf):
    g = adapter.jams(spark, sf).groupBy("geometry_wkt").agg(F.count("*").alias("n"))
    return g.select("geometry_wkt", "n", F.size(geo.line_points(F.col("geometry_wkt"))).alias("points"))


RATIO = "CASE intensity WHEN '80% - 61%' THEN 70.5 WHEN '60% - 41%' THEN 50.5 WHEN '40% - 21%' THEN 30.5 WHEN '20% - 1%' THEN 10.5 WHEN 'Via bloqueada' THEN 0.0 END"


@BOOK.add("x11_bands", sql(f"SELECT intensity, count(*) AS n, {RATIO} AS ratio, CASE WHEN {RATIO} <= 20 THEN 'stopped' WHEN {RATIO} <= 40 THEN 'heavy' WHEN {RATIO} <= 60 THEN 'slow' ELSE 'light' END AS band FROM jams GROUP BY 1"))
def _(spark, sf):
    g = adapter.jams(spark, sf).groupBy("intensity").agg(F.count("*").alias("n")).withColumn("ratio", traffic.speed_ratio(F.col("intensity")))
    return plain(g.withColumn("band", traffic.traffic_band(F.col("ratio"))))


def matched(spark, sf):
    """The road of all jam geometries end to end, in pieces, and the geometries that match each piece."""
    lines = adapter.jams(spark, sf).select("geometry_wkt").distinct().withColumn("points", geo.line_points(F.col("geometry_wkt")))
    jam = geo.segments(lines, "points", ["geometry_wkt"])
    road = geo.pieces(geo.segments(lines.withColumn("road", F.col("geometry_wkt")), "points", ["road"]), ["road"])
    return road, traffic.matches(road, jam)


#: Brute force for the grid join: every piece of road against every segment.
ROADS = {
    "drawn": f"""SELECT geometry_wkt, p[1]::DOUBLE * {geo.METRES_A_DEGREE} * cos(radians({geo.REFERENCE_LAT})) AS x1, p[2]::DOUBLE * {geo.METRES_A_DEGREE} AS y1, p[3]::DOUBLE * {geo.METRES_A_DEGREE} * cos(radians({geo.REFERENCE_LAT})) AS x2, p[4]::DOUBLE * {geo.METRES_A_DEGREE} AS y2
      FROM (SELECT DISTINCT geometry_wkt, string_split(replace(replace(replace(geometry_wkt, 'LINESTRING(', ''), ')', ''), ', ', ' '), ' ') AS p FROM jams)""",
    "cut": "SELECT geometry_wkt AS road, x1, y1, x2, y2, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS len, unnest(range(n)) AS piece, n FROM (SELECT *, greatest(1, ceil(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) / 25))::INT AS n FROM drawn)",
    "matched_pieces": """SELECT DISTINCT road, piece, metres, geometry_wkt FROM (SELECT *, least(1, greatest(0, ((mx - jx1) * dx + (my - jy1) * dy) / (dx * dx + dy * dy))) AS u FROM (
      SELECT c.road, c.piece, c.len / c.n AS metres, d.geometry_wkt, c.x1 + (c.x2 - c.x1) * (c.piece + 0.5) / c.n AS mx, c.y1 + (c.y2 - c.y1) * (c.piece + 0.5) / c.n AS my, d.x1 AS jx1, d.y1 AS jy1, d.x2 - d.x1 AS dx, d.y2 - d.y1 AS dy, (c.x2 - c.x1) / c.len AS ux, (c.y2 - c.y1) / c.len AS uy FROM cut c CROSS JOIN drawn d))
      WHERE sqrt((mx - jx1 - u * dx) ** 2 + (my - jy1 - u * dy) ** 2) <= 25 AND abs(ux * dx + uy * dy) / sqrt(dx * dx + dy * dy) >= 0.8660254037844387""",
}


@BOOK.add("j14_jam_match", sql("SELECT road, count(*) AS matches, count(DISTINCT geometry_wkt) AS geometries FROM matched_pieces GROUP BY 1", **ROADS))
def _(spark, sf):
    return matched(spark, sf)[1].groupBy("road").agg(F.count("*").alias("matches"), F.countDistinct("geometry_wkt").alias("geometries"))


ROADS |= {
    "known": f"SELECT geometry_wkt, day, intensity, reports, speed_kmh, speed_reports, r FROM (SELECT *, {RATIO} AS r FROM jam_rows) WHERE r IS NOT NULL",
    "by_day": "SELECT road, piece, day, sum(r * reports) / sum(reports) AS ratio, sum(speed_kmh * speed_reports) / nullif(sum(CASE WHEN speed_kmh IS NOT NULL THEN speed_reports END), 0) AS speed, sum(reports) AS reports FROM matched_pieces JOIN known USING (geometry_wkt) GROUP BY 1, 2, 3",
    "by_piece": "SELECT c.road, c.piece, c.len / c.n AS metres, round(s.ratio, 1) AS ratio, round(s.speed, 1) AS speed, coalesce(s.reports, 0)::BIGINT AS reports, coalesce(s.days, 0)::BIGINT AS days FROM cut c LEFT JOIN (SELECT road, piece, avg(ratio) AS ratio, avg(speed) AS speed, sum(reports) AS reports, count(*) AS days FROM by_day GROUP BY 1, 2) s USING (road, piece)",
}


@BOOK.add("a25_section_speed", sql("SELECT road, piece, round(metres, 4) AS metres, ratio, speed, reports, days FROM by_piece", **ROADS))
def _(spark, sf):
    return plain(piece_speeds(spark, sf).select("road", "piece", "metres", "ratio", "speed", "reports", "days"), 4)


def piece_speeds(spark, sf):
    road, found = matched(spark, sf)
    return traffic.piece_speeds(road, found, traffic.grouped(adapter.jams(spark, sf)))


@BOOK.add("w26_sections", sql("SELECT road, section::BIGINT AS section, round(sum(metres), 4) AS metres, count(*) AS pieces, any_value(reports) AS reports, any_value(days) AS days FROM (SELECT *, sum(fresh) OVER (PARTITION BY road ORDER BY piece) AS section FROM (SELECT *, CASE WHEN lag(piece) OVER w IS NOT NULL AND ratio IS NOT DISTINCT FROM lag(ratio) OVER w AND speed IS NOT DISTINCT FROM lag(speed) OVER w AND reports = lag(reports) OVER w AND days = lag(days) OVER w THEN 0 ELSE 1 END AS fresh FROM by_piece WINDOW w AS (PARTITION BY road ORDER BY piece))) GROUP BY 1, 2", **ROADS))
def _(spark, sf):
    return plain(traffic.sections(piece_speeds(spark, sf)).select("road", "section", "metres", "pieces", "reports", "days"), 4)


@BOOK.add("a26_road_coverage", sql("SELECT road, round(sum(metres), 4) AS metres, round(coalesce(sum(metres) FILTER (days > 0), 0), 4) AS matched_metres FROM by_piece GROUP BY 1", **ROADS))
def _(spark, sf):
    return plain(traffic.coverage(piece_speeds(spark, sf)), 4)


ROADS |= {
    "slots": f"SELECT geometry_wkt, day, intensity, minute, count(*) AS reports, any_value({RATIO}) AS r FROM jams WHERE ({RATIO}) IS NOT NULL GROUP BY 1, 2, 3, 4",
    "piece_slots": "SELECT road, piece, any_value(metres) AS metres, minute, day, sum(r * reports) / sum(reports) AS r FROM matched_pieces JOIN slots USING (geometry_wkt) GROUP BY road, piece, minute, day",
    "cells": """SELECT road, minute, ratio, days, reports, covered / (SELECT sum(len / n) FROM cut c WHERE c.road = a.road) AS coverage FROM (SELECT road, minute, avg(r) AS ratio, count(*) AS days FROM (SELECT road, minute, day, sum(r * metres) / sum(metres) AS r FROM piece_slots GROUP BY 1, 2, 3) GROUP BY 1, 2) a
      JOIN (SELECT road, minute, sum(metres) AS covered FROM (SELECT DISTINCT road, minute, piece, metres FROM piece_slots) GROUP BY 1, 2) b USING (road, minute) JOIN (SELECT road, minute, sum(reports)::BIGINT AS reports FROM (SELECT DISTINCT road, geometry_wkt FROM matched_pieces) JOIN slots USING (geometry_wkt) GROUP BY 1, 2) c USING (road, minute)""",
}


def cells_of(spark, sf):
    road, found = matched(spark, sf)
    return traffic.time_cells(road, found, traffic.grouped(adapter.jams(spark, sf), "minute"))


@BOOK.add("a24_jam_slots", sql("SELECT geometry_wkt, intensity, day::VARCHAR AS day, minute, count(*) AS reports FROM jams GROUP BY ALL"))
def _(spark, sf):
    return plain(traffic.grouped(adapter.jams(spark, sf), "minute").select("geometry_wkt", "intensity", "day", "minute", "reports"))


@BOOK.add("a27_time_cells", sql("SELECT road, minute, round(ratio, 5) AS ratio, days, reports, round(coverage, 5) AS coverage FROM cells", **ROADS))
def _(spark, sf):
    return plain(cells_of(spark, sf), 5)


@BOOK.add("a70_plot_cells", sql("SELECT road, t AS minute, round(ratio, 5) AS ratio, coalesce(ratio <= 40, false) AS heavy FROM (SELECT DISTINCT road FROM cells) CROSS JOIN (SELECT (unnest(range(420, 601, 30)))::INT AS t) LEFT JOIN (SELECT road, minute AS t, ratio FROM cells) USING (road, t)", **ROADS))
def _(spark, sf):
    return plain(traffic.plot_cells(cells_of(spark, sf), 420, 630), 5)


@BOOK.add("s21_jam_coverage", sql("SELECT count(*) AS rows, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, count(DISTINCT day) AS days, count(DISTINCT geometry_wkt) AS zones FROM jams"))
def _(spark, sf):
    return plain(adapter.jams(spark, sf).agg(F.count("*").alias("rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.countDistinct("day").alias("days"), F.countDistinct("geometry_wkt").alias("zones")))


@BOOK.add("x24_stop_paths")
def _(spark, sf):
    v = adapter.visits(spark, sf)
    stops = v.select("trip_id", F.concat("line", F.lit("-"), "direction_id").alias("shape_id"), F.col("stop_sequence").cast("int").alias("stop_sequence"), (F.col("stop_sequence") * 400.0).alias("x"), (F.pmod(F.xxhash64("trip_id"), F.lit(50)) * 1.0).alias("y"))
    shapes = v.groupBy(F.concat("line", F.lit("-"), "direction_id").alias("shape_id")).agg(F.array_sort(F.collect_set(F.struct((F.col("stop_sequence") * 400.0).alias("x"), F.lit(0.0).alias("y")))).alias("points"))
    return traffic.stop_paths(stops, shapes)


@BOOK.add("a55_ping_quality", sql("SELECT a.agency_id, pings, no_stop, odd_stop, vehicles, shared_vehicles, round(1 - groups / pings, 6) AS repeat_share, round(late, 6) AS median_latency_s FROM (SELECT agency_id, sum(n)::BIGINT AS pings, sum(z)::BIGINT AS no_stop, sum(n)::BIGINT AS odd_stop, count(DISTINCT vehicle_id) AS vehicles, count(*) AS groups FROM (SELECT agency_id, vehicle_id, trip_id, stop_id, count(*) AS n, count(*) FILTER (stop_id = '') AS z FROM pings GROUP BY 1, 2, 3, 4) GROUP BY 1) a JOIN (SELECT agency_id, median((received_us - created_us) / 1e6) AS late, count(DISTINCT CASE WHEN vehicle_id IN (SELECT vehicle_id FROM pings GROUP BY 1 HAVING count(DISTINCT agency_id) > 1) THEN vehicle_id END) AS shared_vehicles FROM pings GROUP BY 1) b USING (agency_id)"))
def _(spark, sf):
    return plain(quality.ping_quality(adapter.pings(spark, sf)))


@BOOK.add("a56_timetable_quality", sql("SELECT sum(n)::BIGINT AS visits, count(*) AS trips, round(sum(past) / sum(n), 6) AS past_share, round(avg(flat::INT), 6) AS flat_share FROM (SELECT trip_id, count(*) AS n, count(*) FILTER (s >= 86400) AS past, min(s) = max(s) AS flat FROM flat_visits GROUP BY 1)", flat_visits=FLAT))
def _(spark, sf):
    return plain(quality.timetable_quality(flat_visits(spark, sf), F.col("s")))


@BOOK.add("a57_jam_quality", sql("SELECT intensity, count(*) AS reports, round(avg((speed_kmh IS NULL)::INT), 6) AS no_speed, round(median(speed_kmh), 5) AS median_kmh, count(DISTINCT day) AS days, count(DISTINCT minute) AS half_hours FROM jams GROUP BY 1"))
def _(spark, sf):
    return plain(quality.jam_quality(adapter.jams(spark, sf)).withColumn("median_kmh", F.round("median_kmh", 5)))


@BOOK.add("a58_headway_fallacy", sql("SELECT round(avg((v0 = vehicle_id)::INT), 6) AS same_share, count(DISTINCT CASE WHEN v0 <> vehicle_id THEN v0 || '|' || vehicle_id END) AS pairs FROM (SELECT *, lag(vehicle_id) OVER (PARTITION BY day, stop_id ORDER BY created_us, event_id) AS v0 FROM pings) WHERE v0 IS NOT NULL"))
def _(spark, sf):
    return plain(quality.headway_fallacy(adapter.pings(spark, sf)))


@BOOK.add("a59_track_quality", sql("SELECT line, round(median(since_s), 5) AS interval_s, round(avg((since_s > 0 AND moved_m / since_s * 3.6 > 120)::INT), 6) AS leaps, round(avg((moved_m < 3)::INT), 6) AS still, round(avg(CASE WHEN trip0 = trip_id THEN (seq < seq0)::INT END), 6) AS backwards FROM steps GROUP BY 1"))
def _(spark, sf):
    return plain(quality.track_quality(adapter.pings(spark, sf)).withColumn("interval_s", F.round("interval_s", 5)))


@BOOK.add("a60_cramers_v", sql("""SELECT round(CASE WHEN least(rr - 1, kk - 1) > 0 THEN sqrt(phi / least(rr - 1, kk - 1)) ELSE 0 END, 6) AS v, n::BIGINT AS n FROM (
  SELECT n, r - pow(r - 1, 2) / (n - 1) AS rr, k - pow(k - 1, 2) / (n - 1) AS kk, greatest(0, chi2 / n - (r - 1) * (k - 1) / (n - 1)) AS phi FROM (
    SELECT sum(pow(coalesce(o, 0) - e, 2) / e) AS chi2, max(n) AS n, count(DISTINCT f) AS r, count(DISTINCT c) AS k FROM (
      SELECT a.f, b.c, o, nf * nc / n AS e, n FROM (SELECT f, count(*) AS nf FROM flags GROUP BY 1) a CROSS JOIN (SELECT c, count(*) AS nc FROM flags GROUP BY 1) b CROSS JOIN (SELECT count(*) AS n FROM flags) LEFT JOIN (SELECT f, c, count(*) AS o FROM flags GROUP BY 1, 2) t ON t.f = a.f AND t.c = b.c)))""", flags="SELECT received_us - created_us > 60000000 AS f, event_type AS c FROM pings"))
def _(spark, sf):
    return plain(quality.cramers_v(adapter.pings(spark, sf), (F.col("received_us") - F.col("created_us")) > 60_000_000, "event_type"))


@BOOK.add("a61_coverage", sql("SELECT line, round(quantile_cont(c, 0.25), 6) AS q1, round(quantile_cont(c, 0.5), 6) AS q2, round(quantile_cont(c, 0.75), 6) AS q3, round(avg((c < 0.5)::INT), 6) AS low_share FROM (SELECT line, count(DISTINCT stop_id) / any_value(planned) AS c FROM stop_passages JOIN (SELECT trip_id, count(*) AS planned FROM visits GROUP BY 1) USING (trip_id) GROUP BY day, trip_id, vehicle_id, line) GROUP BY 1", **SPARSE))
def _(spark, sf):
    return plain(quality.coverage(sparse(spark, sf), adapter.visits(spark, sf)))


@BOOK.add("a62_mechanisms", sql("SELECT line, count(*) FILTER (bunched) AS bunched, round(avg((lead_delay > 120)::INT) FILTER (bunched), 6) AS leader_late, round(avg((delay < 60)::INT) FILTER (bunched), 6) AS follower_early, round(corr(ratio, ratio_prev3), 5) AS persistence FROM feat WHERE valid GROUP BY 1"))
def _(spark, sf):
    return plain(quality.mechanisms(judged_of(spark, sf)).withColumn("persistence", F.round("persistence", 5)))


@BOOK.add("a63_knock_on", sql("SELECT layover, count(*) AS trips, round(avg(d), 6) AS mean_delay, round(avg((d < 0)::INT), 6) AS early_share FROM (SELECT c.*, f.d, least(4, floor((begins - e0) / 1e6 / 900))::INT AS layover FROM (SELECT *, lag(ends) OVER (PARTITION BY day, vehicle_id ORDER BY begins, trip_id) AS e0 FROM begun) c JOIN (SELECT day, trip_id, vehicle_id, arg_min(delay, (seq, t)) AS d FROM feat GROUP BY ALL) f USING (day, trip_id, vehicle_id) WHERE e0 <= begins) GROUP BY 1"))
def _(spark, sf):
    p = judged_of(spark, sf)
    return plain(quality.knock_on(p, kpis.vehicle_chain(p)))


@BOOK.add("a64_segment_delays", sql("SELECT stop0 AS from_stop, stop_id AS to_stop, count(*) AS n, round(avg(delay - d0), 4) AS mean, round(stddev_samp(delay - d0), 4) AS sd, round(quantile_cont(delay - d0, 0.9), 4) AS p90 FROM (SELECT *, lag(stop_id) OVER w AS stop0, lag(delay) OVER w AS d0 FROM feat WINDOW w AS (PARTITION BY day, trip_id, vehicle_id ORDER BY seq, t)) WHERE stop0 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 50"))
def _(spark, sf):
    return plain(quality.segment_delays(judged_of(spark, sf), 50), 4)


@BOOK.add("a65_jam_speed", sql(f"SELECT round(corr(rank_r, rank_s), 5) AS spearman, round(corr(r - mr, speed_kmh - ms), 5) AS within, count(*) AS n FROM (SELECT *, avg(r) OVER (PARTITION BY minute) AS mr, avg(speed_kmh) OVER (PARTITION BY minute) AS ms, rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2 AS rank_r, rank() OVER (ORDER BY speed_kmh) + (count(*) OVER (PARTITION BY speed_kmh) - 1) / 2 AS rank_s FROM (SELECT *, {RATIO} AS r FROM jams) WHERE r IS NOT NULL AND speed_kmh IS NOT NULL)"))
def _(spark, sf):
    return plain(quality.jam_speed_relation(adapter.jams(spark, sf).withColumn("r", traffic.speed_ratio(F.col("intensity")))), 5)


@BOOK.add("a68_rates_by_hour", sql("SELECT line, hour, count(*) AS n, round(avg((ratio < 0.25)::INT), 6) AS under_quarter, round(avg((ratio < 0.5)::INT), 6) AS under_half FROM feat WHERE valid GROUP BY 1, 2"))
def _(spark, sf):
    from fleetspan.operators.findings import calendar

    return plain(quality.rates_by(calendar(judged_of(spark, sf)), ["line", "hour"]))


@BOOK.add("a69_cell_hours", sql("SELECT floor(lat / 0.005)::INT || '_' || floor(lon / (0.005 * 1.2))::INT AS cell, day::VARCHAR AS day, hour(make_timestamp(created_us)) AS hour, count(*) AS pings, count(DISTINCT vehicle_id) AS vehicles FROM pings GROUP BY ALL"))
def _(spark, sf):
    from fleetspan.operators.findings import cell

    return plain(quality.cell_hours(adapter.pings(spark, sf), cell(F.col("lat"), F.col("lon")), F.hour(F.timestamp_micros("created_us"))))
