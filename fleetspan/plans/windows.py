"""Queries of repaired timetables, windows of chosen lines, hot areas in whole and pooled rates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetspan.operators import catalogue, diagram, kpis, passages
from fleetspan.operators import findings as f
from fleetspan.plans.base import judged_of, trusted_of
from fleetspan.plans.book import Book, plain
from fleetspan.plans.findings import week
from fleetspan.plans.oracle import FRAGMENTS, sql
from fleetspan.sources import adapter

BOOK = Book()
ROUTE = ["line", "direction_id", "day"]

#: The fragments of a timetable in which some trips are flat, and visits as repaired; passages without a plan have no delay.
REPAIRED = {
    "plain_visits": FRAGMENTS["visits"],
    "flat_plan": "SELECT day, trip_id, line, direction_id, stop_id, stop_sequence, CASE WHEN trip_id LIKE '%1-0-_' THEN min(sched_us) OVER t ELSE sched_us END AS sched_us, CASE WHEN trip_id LIKE '%1-0-_' THEN min(clock) OVER t ELSE clock END AS clock FROM plain_visits WINDOW t AS (PARTITION BY trip_id)",
    "clocked": "SELECT *, split_part(clock, ':', 1)::INT * 3600 + split_part(clock, ':', 2)::INT * 60 + split_part(clock, ':', 3)::INT AS s FROM flat_plan",
    "trip_starts": "SELECT trip_id, min(s) AS start, min(s) = max(s) AS flat FROM clocked GROUP BY 1",
    "route_times": "SELECT line, direction_id, day, stop_id, quantile_cont(s - start, 0.5) AS offset_s FROM clocked JOIN trip_starts USING (trip_id) WHERE NOT flat GROUP BY ALL",
    "line_times": "SELECT line, direction_id, stop_id, list_sort(list(offset_s))[count(*) // 2 + 1] AS offset_s FROM route_times GROUP BY 1, 2, 3",
    "visits": """SELECT c.day, c.trip_id, c.line, c.direction_id, c.stop_id, stop_sequence, clock, CASE WHEN flat THEN sched_us + round(coalesce(r.offset_s, l.offset_s) * 1000000)::BIGINT ELSE sched_us END AS sched_us FROM clocked c JOIN trip_starts USING (trip_id)
      LEFT JOIN route_times r ON r.line = c.line AND r.direction_id = c.direction_id AND r.day = c.day AND r.stop_id = c.stop_id LEFT JOIN line_times l ON l.line = c.line AND l.direction_id = c.direction_id AND l.stop_id = c.stop_id""",
    "trusted": "SELECT * FROM stop_passages ANTI JOIN (SELECT day, trip_id, vehicle_id FROM stop_passages GROUP BY ALL HAVING abs(list_sort(list(delay) FILTER (delay IS NOT NULL))[count(delay) // 2 + 1]) > 1800) USING (day, trip_id, vehicle_id)",
}


def flat_timetable(spark, sf):
    """The timetable with some trips flat, which repeat their first time at all stops."""
    v, trip, some = adapter.visits(spark, sf), Window.partitionBy("trip_id"), F.col("trip_id").like("%1-0-_")
    return v.select("day", "trip_id", "line", "direction_id", "stop_id", "stop_sequence", *[F.when(some, F.min(c).over(trip)).otherwise(F.col(c)).alias(c) for c in ("sched_us", "clock")])


def repaired_passages(spark, sf):
    return passages.stop_passages(adapter.pings(spark, sf), catalogue.replanned(flat_timetable(spark, sf), ROUTE))


@BOOK.add("a01_repaired_passages", sql("SELECT day::VARCHAR AS day, trip_id, vehicle_id, stop_id, seq, last_seq, is_last, t, sched_us, round(delay, 6) AS delay FROM stop_passages", **REPAIRED))
def _(spark, sf):
    return plain(repaired_passages(spark, sf).select("day", "trip_id", "vehicle_id", "stop_id", "seq", "last_seq", "is_last", "t", "sched_us", "delay"))


@BOOK.add("w01_repaired_headways", sql("SELECT day::VARCHAR AS day, trip_id, stop_id, leader_trip, round(hw, 6) AS hw, round(sched_hw, 6) AS sched_hw, valid, round(ratio, 6) AS ratio, bunched FROM judged", **REPAIRED))
def _(spark, sf):
    p = passages.headways(passages.without_suspects(repaired_passages(spark, sf)))
    return plain(p.select("day", "trip_id", "stop_id", "leader_trip", "hw", "sched_hw", "valid", "ratio", "bunched"))


#: A request: lines with their directions, and a window of the day.
PAIRS = [("L0", "0"), ("L1", "1"), ("L2", "0"), ("L3", "1")]
START, END = "08:00", "10:00"
WINDOW = "t BETWEEN epoch_us(day::TIMESTAMP) + 28800000000 AND epoch_us(day::TIMESTAMP) + 36000000000"
KEPT = {
    "kept": f"SELECT * FROM chained WHERE (line, direction_id) IN ({', '.join(map(str, PAIRS))})",
    "kept_fronts": "SELECT *, lag(line) OVER w AS leader_line, lag(vehicle_id) OVER w AS leader_vehicle, (t - lag(t) OVER w) / 1e6 AS hw, (sched_us - lag(sched_us) OVER w) / 1e6 AS sched_hw, lag(delay) OVER w AS lead_delay FROM kept WINDOW w AS (PARTITION BY day, stop_id ORDER BY t, trip_id, vehicle_id)",
    "kept_valid": "SELECT *, coalesce(sched_hw BETWEEN 120 AND 3600 AND abs(delay) <= 1800 AND abs(lead_delay) <= 1800, false) AS valid FROM kept_fronts",
    "kept_judged": "SELECT *, valid AND hw < 60 AS bunched, CASE WHEN valid THEN hw / sched_hw END AS ratio FROM kept_valid",
    "kept_labelled": "SELECT *, max(bunched) OVER (PARTITION BY day, trip_id, vehicle_id ORDER BY seq, t, stop_id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS label FROM kept_judged",
    "longest": "SELECT line, direction_id, trip_id FROM (SELECT line, direction_id, trip_id, row_number() OVER (PARTITION BY line, direction_id ORDER BY count(*) DESC, trip_id) AS r FROM visits GROUP BY 1, 2, 3) WHERE r = 1",
    "positions": "SELECT line, direction_id, stop_id, row_number() OVER (PARTITION BY line, direction_id ORDER BY min(stop_sequence), stop_id) - 1 AS y FROM visits SEMI JOIN longest USING (line, direction_id, trip_id) GROUP BY 1, 2, 3",
}


def kept_of(spark, sf):
    return diagram.kept_headways(trusted_of(spark, sf), spark.createDataFrame(PAIRS, "line string, direction_id string"), "corridor")


@BOOK.add("f13_kept_lines", sql("SELECT day::VARCHAR AS day, trip_id, stop_id, round(prev_trip_delay, 6) AS prev_trip_delay, leader_line, round(hw, 6) AS hw, bunched, label FROM kept_labelled WHERE " + WINDOW, **KEPT))
def _(spark, sf):
    p = kept_of(spark, sf).where(diagram.within(START, END))
    return plain(p.select("day", "trip_id", "stop_id", "prev_trip_delay", "leader_line", "hw", "bunched", "label"))


POINTS = "SELECT p.day::VARCHAR AS day, p.trip_id, p.vehicle_id, p.line, p.direction_id, p.stop_id, seq, y, t, round(hw, 6) AS hw, round(sched_hw, 6) AS sched_hw, round(ratio, 3) AS ratio, round(delay, 6) AS delay, leader_vehicle, bunched, label AS bunched_within FROM {} p SEMI JOIN (SELECT day, trip_id, vehicle_id FROM {} WHERE " + WINDOW + ") x USING (day, trip_id, vehicle_id) JOIN positions r ON {}"


@BOOK.add("f09_diagram", sql(POINTS.format("feat", "feat", "r.line = p.line AND r.direction_id = p.direction_id AND r.stop_id = p.stop_id"), **KEPT))
def _(spark, sf):
    """Every line and direction along its own route."""
    d = diagram.points(judged_of(spark, sf), diagram.within(START, END), diagram.route_positions(adapter.visits(spark, sf)))
    return plain(d.drop("leader_line", "prob"))


@BOOK.add("f09_corridor_diagram", sql(POINTS.format("kept_labelled", "kept_labelled", "r.line = 'L0' AND r.direction_id = '0' AND r.stop_id = p.stop_id"), **KEPT))
def _(spark, sf):
    """The chosen lines along the first one's route."""
    route = diagram.route_positions(adapter.visits(spark, sf)).where((F.col("line") == PAIRS[0][0]) & (F.col("direction_id") == PAIRS[0][1])).select("stop_id", "y")
    return plain(diagram.points(kept_of(spark, sf), diagram.within(START, END), route).drop("leader_line", "prob"))


@BOOK.add("a12_cross_line", sql("SELECT line, count(DISTINCT (day, trip_id, vehicle_id)) AS trips, count(*) AS passages, count(*) FILTER (bunched) AS bunched, count(*) FILTER (bunched AND leader_line <> line) AS cross_line FROM (SELECT *, valid AND hw < 60 AS bunched FROM c2) WHERE " + WINDOW + " GROUP BY 1",
  c1="SELECT *, lag(line) OVER w AS leader_line, (t - lag(t) OVER w) / 1e6 AS hw, (sched_us - lag(sched_us) OVER w) / 1e6 AS sched_hw, lag(delay) OVER w AS lead_delay FROM trusted WINDOW w AS (PARTITION BY day, stop_id ORDER BY t, trip_id, vehicle_id)",
  c2="SELECT *, coalesce(sched_hw BETWEEN 120 AND 3600 AND abs(delay) <= 1800 AND abs(lead_delay) <= 1800, false) AS valid FROM c1"))
def _(spark, sf):
    return diagram.summary(passages.headways(trusted_of(spark, sf), "corridor"), diagram.within(START, END), ["line"])


#: Limits for derived passages, which are fewer than a network's.
AREA = {"ratio": 1.0, "onsets": 1, "days": 1}
AREAS = {
    "places": "SELECT stop_id, median(lat) AS lat, median(lon) AS lon FROM (SELECT stop_id, arg_max(lat, (created_us, event_id)) AS lat, arg_max(lon, (created_us, event_id)) AS lon FROM pings GROUP BY trip_id, vehicle_id, stop_id) GROUP BY 1",
    "celled_stops": "SELECT *, floor(lat / 0.005)::INT || '_' || floor(lon / (0.005 * 1.2))::INT AS area FROM places",
    "departed": "SELECT day, trip_id, vehicle_id FROM feat WHERE valid AND working GROUP BY ALL HAVING arg_min(ratio, (seq, t)) >= 0.8 AND arg_min(progress, (seq, t)) < 0.5",
    "on_plan": "SELECT *, avg(onset::INT) OVER (PARTITION BY line, direction_id, block) AS expected FROM onset_rows SEMI JOIN departed USING (day, trip_id, vehicle_id) WHERE working",
    "in_areas": "SELECT * FROM on_plan JOIN celled_stops USING (stop_id)",
    "area_rows": "SELECT area, sum(o)::BIGINT AS onsets, sum(e) AS expected, count(*) FILTER (o > 1.2 * e) AS days FROM (SELECT area, day, count(*) FILTER (onset) AS o, sum(expected) AS e FROM in_areas GROUP BY 1, 2) GROUP BY 1",
    "hot_rows": "SELECT *, onsets / expected AS ratio FROM area_rows WHERE onsets >= 1 AND onsets / nullif(expected, 0) >= 1.0 AND days >= 1",
    "ranked_lines": "SELECT area, string_agg(line, ',' ORDER BY r) AS top_lines FROM (SELECT area, line, row_number() OVER (PARTITION BY area ORDER BY count(*) DESC, line) AS r FROM in_areas WHERE onset GROUP BY 1, 2) WHERE r <= 5 GROUP BY 1",
    "ranked_stops": "SELECT area, string_agg(stop_id, ',' ORDER BY r) AS top_stops FROM (SELECT area, stop_id, row_number() OVER (PARTITION BY area ORDER BY count(*) DESC, stop_id) AS r FROM in_areas WHERE onset GROUP BY 1, 2) WHERE r <= 4 GROUP BY 1",
    "busy_hours": "SELECT area, hour FROM (SELECT area, hour, count(*) AS n, max(count(*)) OVER (PARTITION BY area) AS top FROM in_areas WHERE onset GROUP BY 1, 2) WHERE n >= 0.6 * top",
    "ranges": "SELECT area, string_agg(range, ',' ORDER BY range) AS peak_hours FROM (SELECT area, printf('%02d:00-%02d:00', min(hour), max(hour) + 1) AS range FROM (SELECT *, hour - row_number() OVER (PARTITION BY area ORDER BY hour) AS island FROM busy_hours) GROUP BY area, island) GROUP BY 1",
}


@BOOK.add("a37_area_list", sql("SELECT area AS cell, round(ratio, 6) AS ratio, days, round(onsets / 5, 6) AS onsets_a_day, lat, lon, lines, top_lines, top_stops, peak_hours FROM hot_rows JOIN (SELECT area, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, count(DISTINCT line) AS lines FROM in_areas GROUP BY 1) m USING (area) LEFT JOIN ranked_lines USING (area) LEFT JOIN ranked_stops USING (area) LEFT JOIN ranges USING (area)", **AREAS))
def _(spark, sf):
    v = f.area_passages(week(spark, sf), f.stop_places(adapter.pings(spark, sf)), near=0.5)
    return plain(f.hot_area_list(v, **AREA))


@BOOK.add("a37_area_summary", sql("""SELECT cells, round(top_b / nullif(b, 0), 6) AS top10_bunching, round(top_n / nullif(n, 0), 6) AS top10_visits, round(o / 5, 6) AS onsets_a_day, round(h / greatest(o, 1), 6) AS hot_share
  FROM (SELECT count(*) AS cells, sum(b) AS b, sum(n) AS n FROM raw_cells), (SELECT sum(b) AS top_b, sum(n) AS top_n FROM (SELECT * FROM raw_cells ORDER BY b DESC, area LIMIT 10)), (SELECT coalesce(sum(onsets), 0) AS o FROM area_rows), (SELECT coalesce(sum(onsets), 0) AS h FROM hot_rows)""",
  raw_cells="SELECT area, count(*) AS n, count(*) FILTER (bunched) AS b FROM feat JOIN celled_stops USING (stop_id) WHERE valid AND working GROUP BY 1", **AREAS))
def _(spark, sf):
    p, places = week(spark, sf), f.stop_places(adapter.pings(spark, sf))
    return plain(f.area_summary(p, f.area_passages(p, places, near=0.5), places, **AREA))


@BOOK.add("a38_headline_causes", sql("""SELECT round(bunched / 5, 6) AS bunched_a_day, blocks AS recurring_blocks, round(again / nullif(bunched, 0), 6) AS recurring_share, peak_hours, close_trips, close_bunching, network_close, network_late FROM (SELECT sum(b) AS bunched, count(*) FILTER (again) AS blocks, coalesce(sum(b) FILTER (again), 0) AS again FROM block_rows),
  (SELECT string_agg(range, ',' ORDER BY range) AS peak_hours FROM (SELECT printf('%02d:00-%02d:00', min(hour), max(hour) + 1) AS range FROM (SELECT hour, hour - row_number() OVER (ORDER BY hour) AS island FROM (SELECT hour FROM feat, base_rate WHERE valid AND working GROUP BY hour, base HAVING avg(bunched::INT) >= 1.5 * base)) GROUP BY island)),
  (SELECT round(count(*) FILTER (near) / nullif(count(*), 0), 6) AS close_trips, round(sum(CASE WHEN near THEN times_bunched ELSE 0 END) / greatest(sum(times_bunched), 1), 6) AS close_bunching FROM (SELECT *, dep_ratio >= 0 AND dep_ratio < 0.8 AS near FROM terminal WHERE working AND dep_ratio IS NOT NULL)),
  (SELECT round(avg(coalesce(dep_ratio < 0.8, false)::INT), 6) AS network_close, round(avg(coalesce(prev_trip_delay > 300, false)::INT), 6) AS network_late FROM terminal WHERE working)""",
  block_rows="SELECT count(*) = 5 AND count(*) FILTER (rate >= 2.0 * base) >= 2 AS again, sum(b) AS b FROM (SELECT line, direction_id, block, day, avg(bunched::INT) AS rate, count(*) FILTER (bunched) AS b FROM feat WHERE valid AND working GROUP BY ALL), base_rate GROUP BY line, direction_id, block"))
def _(spark, sf):
    p = week(spark, sf)
    return plain(f.headline_causes(p, f.terminal_trips(p, 0.35), hot_days=2))


@BOOK.add("a67_pooled", sql("SELECT day::VARCHAR AS day, count(DISTINCT line) AS lines, count(*) AS gaps, round(100 * count(*) FILTER (short) / count(*), 6) AS bunched_pct FROM fit GROUP BY 1"))
def _(spark, sf):
    return plain(kpis.pooled(judged_of(spark, sf), ["day"]))


@BOOK.add("a67_bucket_order")
def _(spark, sf):
    return plain(kpis.bucket_order(kpis.departure_buckets(judged_of(spark, sf))))


def _bucket_twin() -> str:
    from fleetspan.plans.reports import BOOK as reports

    return f"SELECT *, round(bunch_later / trips, 6) AS rate, row_number() OVER (ORDER BY bunch_later / trips DESC, low) - 1 AS nth FROM ({reports.oracles['a41_departure_buckets']})"


BOOK.oracles["a67_bucket_order"] = _bucket_twin()
