"""Queries of the weekly findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspan.operators import findings as f
from fleetspan.plans.base import judged_of
from fleetspan.plans.book import Book, plain
from fleetspan.plans.oracle import FRAGMENTS, sql
from fleetspan.sources import adapter

BOOK = Book()
#: Passages of a line and direction at a stop from which on it counts as shared.
SHARED = 20

FRAGMENTS |= {
    "base_rate": "SELECT avg(bunched::INT) AS base FROM feat WHERE valid AND working",
    "terminal": """SELECT * FROM (SELECT day, trip_id, vehicle_id, arg_min(line, (seq, t)) AS line, arg_min(direction_id, (seq, t)) AS direction_id, arg_min(working, (seq, t)) AS working, arg_min(block, (seq, t)) AS block, arg_min_null(ratio, (seq, t)) AS dep_ratio, arg_min_null(delay, (seq, t)) AS dep_delay, arg_min_null(prev_trip_delay, (seq, t)) AS prev_trip_delay, arg_min(progress, (seq, t)) AS first_progress, arg_min(stop_id, (seq, t)) AS first_stop, max(bunched) AS any_bunched, count(*) FILTER (bunched) AS times_bunched FROM feat WHERE valid GROUP BY ALL) WHERE first_progress < 0.35""",
    "onset_rows": "SELECT *, bunched AND NOT coalesce(lag(bunched) OVER (PARTITION BY day, trip_id, vehicle_id ORDER BY seq, t), false) AS onset FROM feat WHERE valid",
    "follows": "SELECT *, (t - t0) / 1e6 AS gap, abs(sched_us - s0) / 1e6 AS planned_gap FROM (SELECT *, lag(line) OVER w AS line0, lag(direction_id) OVER w AS dir0, lag(t) OVER w AS t0, lag(sched_us) OVER w AS s0, lag(trip_id) OVER w AS trip0 FROM feat WHERE valid WINDOW w AS (PARTITION BY day, stop_id ORDER BY t, trip_id, vehicle_id)) WHERE line0 <> line",
    "line_stops": f"SELECT line, direction_id, stop_id FROM feat WHERE valid GROUP BY ALL HAVING count(*) >= {SHARED}",
    "line_pairs": "SELECT a.line AS line1, a.direction_id AS dir1, b.line AS line2, b.direction_id AS dir2, count(*) AS stops FROM line_stops a JOIN line_stops b ON a.stop_id = b.stop_id AND a.line < b.line GROUP BY ALL HAVING count(*) >= 2",
}


def week(spark, sf):
    return f.calendar(judged_of(spark, sf))


@BOOK.add("a28_lines", sql("SELECT line, direction_id, count(*) AS passages, count(*) FILTER (bunched) AS bunched, round(median(sched_hw), 6) AS planned_gap, round(count(*) FILTER (bunched) / count(*), 6) AS rate, round(count(*) FILTER (bunched) / nullif(sum(count(*) FILTER (bunched)) OVER (), 0), 6) AS share FROM feat WHERE valid AND working GROUP BY 1, 2"))
def _(spark, sf):
    return plain(f.line_ranking(week(spark, sf)))


def hot(slot):
    return sql(f"SELECT line, direction_id, {slot}, count(*) AS days, count(*) FILTER (rate >= 2.0 * base) AS hot_days, round(avg(rate), 6) AS mean_rate FROM (SELECT line, direction_id, {slot}, day, avg(bunched::INT) AS rate FROM feat WHERE valid AND working GROUP BY ALL), base_rate GROUP BY 1, 2, 3")


@BOOK.add("a29_hot_hours", hot("hour"))
def _(spark, sf):
    return plain(f.hot_slots(week(spark, sf), "hour"))


@BOOK.add("a30_hot_blocks", hot("block"))
def _(spark, sf):
    return plain(f.hot_slots(week(spark, sf), "block"))


@BOOK.add("a30_recurring", "SELECT line, direction_id, block, mean_rate FROM (" + hot("block") + ") WHERE days = 5 AND hot_days >= 2")
def _(spark, sf):
    s = f.hot_slots(week(spark, sf), "block")
    return plain(s.where("days = 5 and hot_days >= 2").select("line", "direction_id", "block", "mean_rate"))


@BOOK.add("a31_terminal_trips", sql("SELECT day::VARCHAR AS day, trip_id, line, working, round(dep_ratio, 6) AS dep_ratio, round(dep_delay, 6) AS dep_delay, round(prev_trip_delay, 6) AS prev_trip_delay, first_stop, any_bunched FROM terminal"))
def _(spark, sf):
    return plain(f.terminal_trips(week(spark, sf), 0.35).select("day", "trip_id", "line", "working", "dep_ratio", "dep_delay", "prev_trip_delay", "first_stop", "any_bunched"))


@BOOK.add("a32_departures", sql("SELECT class, trips, p_bunch, share, bunching_share FROM (SELECT class, count(*) AS trips, round(avg(any_bunched::INT), 6) AS p_bunch, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(sum(times_bunched) / greatest(sum(sum(times_bunched)) OVER (), 1), 6) AS bunching_share FROM (SELECT *, CASE WHEN dep_ratio < 0 THEN NULL WHEN dep_ratio < 0.5 THEN 'too close' WHEN dep_ratio < 0.8 THEN 'close' WHEN dep_ratio < 1.2 THEN 'on plan' WHEN dep_ratio < 99 THEN 'late' END AS class FROM terminal WHERE working AND dep_ratio IS NOT NULL) GROUP BY 1) WHERE class IS NOT NULL"))
def _(spark, sf):
    return plain(f.departures(f.terminal_trips(week(spark, sf), 0.35)))


@BOOK.add("a33_slot_profile", sql("SELECT line, direction_id, block, stop_id, count(*) AS passages, round(avg(bunched::INT), 6) AS rate FROM feat WHERE valid AND working GROUP BY ALL HAVING count(*) >= 20"))
def _(spark, sf):
    p = week(spark, sf).where("valid and working")
    return plain(p.groupBy("line", "direction_id", "block", "stop_id").agg(F.count("*").alias("passages"), f.share(F.col("bunched")).alias("rate")).where("passages >= 20"))


FRAGMENTS |= {
    "network": "SELECT avg(bunched::INT) AS base FROM feat WHERE valid AND working",
    "problems": """SELECT line, direction_id, block FROM (SELECT *, row_number() OVER (PARTITION BY line, direction_id ORDER BY recurring DESC, bunched DESC, block) AS r FROM (
      SELECT line, direction_id, block, count(*) = 5 AND count(*) FILTER (rate >= 2.0 * base) >= 2 AS recurring, sum(b) AS bunched FROM (SELECT line, direction_id, block, day, avg(bunched::INT) AS rate, count(*) FILTER (bunched) AS b FROM feat WHERE valid AND working GROUP BY ALL), network GROUP BY 1, 2, 3)) WHERE r = 1""",
    "in_slots": "SELECT *, bunched AND NOT coalesce(lag(bunched) OVER (PARTITION BY day, trip_id, vehicle_id, block ORDER BY seq, t), false) AS onset FROM feat SEMI JOIN problems USING (line, direction_id, block) WHERE valid",
    "slot_causes": """SELECT line, direction_id, block, trips, late, near, CASE WHEN late >= 1.5 * all_late THEN 'turnaround' WHEN near >= 1.3 * all_near THEN 'dispatch' ELSE 'road' END AS cause FROM (
      SELECT line, direction_id, block, count(*) AS trips, avg(coalesce(prev_trip_delay > 300, false)::INT) AS late, avg(coalesce(dep_ratio < 0.8, false)::INT) AS near FROM terminal WHERE working GROUP BY 1, 2, 3), (SELECT avg(coalesce(prev_trip_delay > 300, false)::INT) AS all_late, avg(coalesce(dep_ratio < 0.8, false)::INT) AS all_near FROM terminal WHERE working)""",
}


def slots_of(p):
    return f.first_problems(p, hot_days=2)


@BOOK.add("a34_causes", sql("SELECT line, direction_id, block, trips, round(late, 6) AS late, round(near, 6) AS near, cause FROM slot_causes"))
def _(spark, sf):
    return plain(f.causes(f.terminal_trips(week(spark, sf), 0.35)))


@BOOK.add("a33_by_day", sql("SELECT line, direction_id, block, strftime(day, '%a') AS dow, count(*) AS passages, round(avg(bunched::INT), 6) AS rate FROM in_slots GROUP BY ALL"))
def _(spark, sf):
    p = week(spark, sf)
    return plain(f.slot_days(f.slot_passages(p, slots_of(p))))


@BOOK.add("a33_by_hour", sql("""SELECT s.line, s.direction_id, s.block, hour, passages, round(rate, 6) AS rate, own = s.block AS in_block, own = s.block AND rate >= 2.0 * base AND hot >= 1 AS hot FROM problems s JOIN (
  SELECT line, direction_id, hour, any_value(block) AS own, sum(n)::BIGINT AS passages, avg(day_rate) AS rate, count(*) FILTER (day_rate >= 2.0 * base) AS hot FROM (SELECT line, direction_id, hour, block, day, count(*) AS n, avg(bunched::INT) AS day_rate FROM feat WHERE valid AND working GROUP BY ALL), network GROUP BY 1, 2, 3) h USING (line, direction_id), network WHERE passages >= 3"""))
def _(spark, sf):
    p = week(spark, sf)
    return plain(f.slot_hours(p, slots_of(p), hot_days=1, least=3))


@BOOK.add("a33_stops", sql("""SELECT line, direction_id, block, stop_id, seq, passages, round(rate, 6) AS rate, onsets, days, days >= 1 AND row_number() OVER (PARTITION BY line, direction_id, block, days >= 1 ORDER BY rate DESC, stop_id) <= 2 AS worst FROM (
  SELECT line, direction_id, block, stop_id, median(seq) AS seq, count(*) AS passages, avg(bunched::INT) AS rate, count(*) FILTER (onset) AS onsets, count(DISTINCT CASE WHEN bunched THEN day END) AS days FROM in_slots WHERE working GROUP BY 1, 2, 3, 4) WHERE passages >= 2"""))
def _(spark, sf):
    p = week(spark, sf)
    return plain(f.slot_stops(f.slot_passages(p, slots_of(p)), least=2, days=1, most=2))


@BOOK.add("a33_onsets", sql("SELECT line, direction_id, block, count(*) AS onsets, round(median(progress), 6) AS median_progress, round(avg((progress < 0.25)::INT), 6) AS first_quarter FROM in_slots WHERE working AND onset GROUP BY 1, 2, 3"))
def _(spark, sf):
    p = week(spark, sf)
    return plain(f.slot_onsets(f.slot_passages(p, slots_of(p))))


@BOOK.add("a33_terminals", sql("SELECT line, direction_id, block, arg_min(first_stop, (-n, first_stop)) AS terminal, max(n) AS trips FROM (SELECT line, direction_id, block, first_stop, count(*) AS n FROM terminal SEMI JOIN problems USING (line, direction_id, block) WHERE working GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"))
def _(spark, sf):
    p = week(spark, sf)
    return f.slot_terminals(f.terminal_trips(p, 0.35), slots_of(p))


@BOOK.add("a33_problems", sql("""SELECT g.line, g.direction_id, g.block, round(rate, 6) AS rate, round(rate / nullif(base, 0), 6) AS times_network, round(bunched / 5, 6) AS bunched_a_day, round(trips / 5, 6) AS trips_a_day, round(planned, 6) AS planned_min, round(late, 6) AS late, round(near, 6) AS near, coalesce(cause, 'road') AS cause, round(mp, 6) AS median_progress, round(fq, 6) AS first_quarter, terminal
  FROM (SELECT line, direction_id, block, avg(bunched::INT) AS rate, count(*) FILTER (bunched) AS bunched, median(CASE WHEN onset THEN progress END) AS mp, avg(CASE WHEN onset THEN (progress < 0.25)::INT END) AS fq FROM in_slots WHERE working GROUP BY 1, 2, 3) g
  JOIN (SELECT line, direction_id, median(sched_hw) / 60 AS planned FROM feat WHERE valid GROUP BY 1, 2) USING (line, direction_id) CROSS JOIN network LEFT JOIN slot_causes c ON c.line = g.line AND c.direction_id = g.direction_id AND c.block = g.block
  LEFT JOIN (SELECT line, direction_id, block, arg_min(first_stop, (-n, first_stop)) AS terminal FROM (SELECT line, direction_id, block, first_stop, count(*) AS n FROM terminal WHERE working GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) t ON t.line = g.line AND t.direction_id = g.direction_id AND t.block = g.block"""))
def _(spark, sf):
    p = week(spark, sf)
    return plain(f.problem_list(p, f.terminal_trips(p, 0.35), slots_of(p)))


@BOOK.add("a35_hotspots", sql("""SELECT t.*, l.lines, h.peak_hour FROM (SELECT * FROM (SELECT stop_id, count(*) AS passages, count(*) FILTER (bunched) AS bunched, count(DISTINCT CASE WHEN bunched THEN day END) AS days, round(count(*) FILTER (bunched) / count(*), 6) AS rate FROM feat WHERE valid AND working GROUP BY 1) WHERE days >= 3 AND passages >= 10 ORDER BY bunched DESC, stop_id LIMIT 80) t
  JOIN (SELECT stop_id, string_agg(line, ',' ORDER BY r) AS lines FROM (SELECT stop_id, line, row_number() OVER (PARTITION BY stop_id ORDER BY count(*) DESC, line) AS r FROM feat WHERE valid AND working AND bunched GROUP BY 1, 2) WHERE r <= 3 GROUP BY 1) l USING (stop_id)
  JOIN (SELECT stop_id, hour AS peak_hour FROM (SELECT stop_id, hour, row_number() OVER (PARTITION BY stop_id ORDER BY count(*) DESC, hour) AS r FROM feat WHERE valid AND working AND bunched GROUP BY 1, 2) WHERE r = 1) h USING (stop_id)"""))
def _(spark, sf):
    return plain(f.hotspots(week(spark, sf), least=10, days=3))


@BOOK.add("j18_shared_stops", sql("SELECT * FROM line_pairs"))
def _(spark, sf):
    return f.shared_stops(week(spark, sf), SHARED, 2)


@BOOK.add("w11_other_line", sql("SELECT day::VARCHAR AS day, stop_id, trip_id, line, line0 AS line_before, round(gap, 6) AS gap, round(planned_gap, 6) AS planned_gap FROM follows"))
def _(spark, sf):
    return plain(f.follows_other_line(week(spark, sf)).select("day", "stop_id", "trip_id", "line", "line_before", "gap", "planned_gap"))


@BOOK.add("a36_pile_ups", sql("""SELECT line1, line2, events, days, planned_share, peak_hour, close_share FROM (SELECT line1, line2, count(*) AS events, count(DISTINCT day) AS days, round(avg(planned::INT), 6) AS planned_share FROM runs GROUP BY 1, 2)
  JOIN (SELECT line1, line2, hour AS peak_hour FROM (SELECT line1, line2, hour, row_number() OVER (PARTITION BY line1, line2 ORDER BY count(*) DESC, hour) AS r FROM runs GROUP BY 1, 2, 3) WHERE r = 1) USING (line1, line2)
  JOIN (SELECT line1, line2, round(avg((gap < 300)::INT), 6) AS close_share FROM both_lines GROUP BY 1, 2) USING (line1, line2)""",
  both_lines="SELECT * FROM (SELECT *, least(line, line0) AS line1, greatest(line, line0) AS line2, CASE WHEN line < line0 THEN direction_id ELSE dir0 END AS dir1, CASE WHEN line < line0 THEN dir0 ELSE direction_id END AS dir2 FROM follows) SEMI JOIN line_pairs USING (line1, dir1, line2, dir2)",
  runs="SELECT day, trip_id, trip0, line1, line2, avg((planned_gap < 120)::INT) > 0.5 AS planned, min(hour) AS hour FROM both_lines WHERE gap < 300 AND working GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 1"))
def _(spark, sf):
    p = week(spark, sf)
    return plain(f.pile_ups(p, f.shared_stops(p, SHARED, 2), 300, 120, 1))


@BOOK.add("w10_onsets", sql("SELECT line, day::VARCHAR AS day, count(*) AS passages, count(*) FILTER (onset) AS onsets FROM onset_rows GROUP BY 1, 2"))
def _(spark, sf):
    return plain(f.onsets(week(spark, sf)).groupBy("line", "day").agg(F.count("*").alias("passages"), F.count_if("onset").alias("onsets")))


@BOOK.add("a37_hot_areas", sql("""SELECT cell, sum(n)::BIGINT AS passages, sum(o)::BIGINT AS onsets, round(sum(e), 6) AS expected, count(*) FILTER (o > 1.2 * e) AS days, round(sum(o) / nullif(sum(e), 0), 6) AS ratio FROM (
  SELECT cell, day, count(*) AS n, count(*) FILTER (onset) AS o, sum(expected) AS e FROM (
    SELECT v.*, floor(lat / 0.005)::INT || '_' || floor(lon / (0.005 * 1.2))::INT AS cell, avg(onset::INT) OVER (PARTITION BY line, direction_id, block) AS expected
    FROM (SELECT *, bunched AND NOT coalesce(lag(bunched) OVER (PARTITION BY day, trip_id, vehicle_id ORDER BY seq, t), false) AS onset FROM feat WHERE valid AND working) v
    JOIN (SELECT day, trip_id, vehicle_id, arg_min(ratio, (seq, t)) AS dep, arg_min(progress, (seq, t)) AS fp FROM feat WHERE valid AND working GROUP BY ALL) d USING (day, trip_id, vehicle_id)
    JOIN places USING (stop_id) WHERE dep >= 0.8 AND fp < 0.5) GROUP BY 1, 2) GROUP BY 1""", places="SELECT stop_id, median(lat) AS lat, median(lon) AS lon FROM (SELECT stop_id, arg_max(lat, (created_us, event_id)) AS lat, arg_max(lon, (created_us, event_id)) AS lon FROM pings GROUP BY trip_id, vehicle_id, stop_id) GROUP BY 1"))
def _(spark, sf):
    return plain(f.hot_areas(week(spark, sf), f.stop_places(adapter.pings(spark, sf)), near=0.5))


@BOOK.add("w25_hour_ranges", sql("SELECT line, string_agg(range, ',' ORDER BY range) AS hours FROM (SELECT line, printf('%02d:00-%02d:00', min(hour), max(hour) + 1) AS range FROM (SELECT line, hour, hour - row_number() OVER (PARTITION BY line ORDER BY hour) AS island FROM (SELECT DISTINCT line, hour FROM feat WHERE bunched)) GROUP BY line, island) GROUP BY 1"))
def _(spark, sf):
    return f.hour_ranges(week(spark, sf).where("bunched"), ["line"])


@BOOK.add("a38_headline", sql("SELECT round(avg(bunched::INT) FILTER (working), 6) AS working_rate, round(avg(bunched::INT) FILTER (NOT working), 6) AS weekend_rate, round(count(*) FILTER (bunched AND working AND line IN (SELECT line FROM busiest)) / nullif(count(*) FILTER (bunched AND working), 0), 6) AS top5_share, round(count(*) FILTER (working AND line IN (SELECT line FROM busiest)) / nullif(count(*) FILTER (working), 0), 6) AS top5_passages FROM feat WHERE valid", busiest="SELECT line FROM feat WHERE valid AND working GROUP BY 1 ORDER BY count(*) FILTER (bunched) DESC, line LIMIT 5"))
def _(spark, sf):
    return plain(f.headline(week(spark, sf)))


@BOOK.add("a39_moves", "SELECT cause, string_agg(DISTINCT line, ',' ORDER BY line) AS lines FROM (" + BOOK.oracles["a34_causes"] + ") GROUP BY 1")
def _(spark, sf):
    c = f.causes(f.terminal_trips(week(spark, sf), 0.35))
    return c.groupBy("cause").agg(F.array_join(F.array_sort(F.collect_set("line")), ",").alias("lines"))
