"""Queries of the rule detector, vehicle days and replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspan.operators import detect, vehicles
from fleetspan.plans.book import Book, plain
from fleetspan.plans.oracle import FRAGMENTS, sql
from fleetspan.sources import adapter

BOOK = Book()

FRAGMENTS |= {
    "reports": "SELECT day, vehicle_id, trip_id, line, direction_id, stop_id, min(created_us) AS first_us, max(created_us) AS last_us, count(*) AS observations FROM pings GROUP BY ALL",
    "matched": """SELECT r.*, visit_seq, planned_us FROM (SELECT r.*, v.stop_sequence AS visit_seq, v.sched_us AS planned_us, row_number() OVER (PARTITION BY r.day, r.vehicle_id, r.trip_id, r.line, r.direction_id, r.stop_id ORDER BY v.sched_us IS NULL, abs(v.sched_us - r.first_us), v.stop_sequence) AS rn
      FROM reports r LEFT JOIN visits v ON v.trip_id = r.trip_id AND v.stop_id = r.stop_id) r WHERE rn = 1""",
    "cand": """SELECT * FROM (SELECT day, line, direction_id, stop_id, visit_seq, lag(trip_id) OVER w AS first_trip, lag(vehicle_id) OVER w AS first_vehicle, trip_id AS second_trip, vehicle_id AS second_vehicle, lag(first_us) OVER w AS t1, first_us AS t2,
      floor((first_us - lag(first_us) OVER w) / 1000000)::BIGINT AS observed_gap, floor(abs(planned_us - lag(planned_us) OVER w) / 1000000)::BIGINT AS planned_gap FROM matched WHERE planned_us IS NOT NULL WINDOW w AS (PARTITION BY day, line, direction_id, stop_id ORDER BY first_us, trip_id, vehicle_id))
      WHERE first_trip <> second_trip AND observed_gap <= 600 AND planned_gap >= 300""",
    "paired": "SELECT *, CASE WHEN (first_trip, first_vehicle) <= (second_trip, second_vehicle) THEN first_trip || '/' || first_vehicle || '|' || second_trip || '/' || second_vehicle ELSE second_trip || '/' || second_vehicle || '|' || first_trip || '/' || first_vehicle END AS pair FROM cand",
    "islands": "SELECT *, sum(fresh) OVER (PARTITION BY day, line, direction_id, pair ORDER BY t2, stop_id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN t2 - lag(t2) OVER (PARTITION BY day, line, direction_id, pair ORDER BY t2, stop_id) > 1200000000 THEN 1 ELSE 0 END AS fresh FROM paired)",
    "eps": "SELECT day, line, direction_id, pair, island, min(t1) AS starts, max(t2) AS ends, arg_min(stop_id, (t2, stop_id)) AS first_stop, arg_max(stop_id, (t2, stop_id)) AS last_stop, count(*) AS evidence, count(DISTINCT stop_id) AS stops, min(observed_gap) AS min_gap, max(planned_gap) AS max_planned, CASE WHEN count(DISTINCT stop_id) >= 2 THEN 'multi_stop' ELSE 'single_point' END AS class FROM islands GROUP BY 1, 2, 3, 4, 5",
}


def reports_of(spark, sf):
    return detect.stop_reports(adapter.pings(spark, sf))


def matched_of(spark, sf):
    return detect.nearest_visits(reports_of(spark, sf), adapter.visits(spark, sf))


def candidates_of(spark, sf):
    """With reports up to ten minutes apart, since derived pings are sparse."""
    return detect.candidates(matched_of(spark, sf), most_gap=600)


def episodes_of(spark, sf):
    return detect.episodes(candidates_of(spark, sf))


@BOOK.add("a03_stop_reports", sql("SELECT * REPLACE (day::VARCHAR AS day) FROM reports"))
def _(spark, sf):
    return plain(reports_of(spark, sf))


@BOOK.add("a02_runs", sql("SELECT day::VARCHAR AS day, vehicle_id, trip_id, line, direction_id, min(created_us) AS first_us, max(created_us) AS last_us, count(*) AS observations FROM pings GROUP BY ALL"))
def _(spark, sf):
    return plain(detect.stop_reports(adapter.pings(spark, sf), ("day", "vehicle_id", "trip_id", "line", "direction_id")))


@BOOK.add("a04_lines_observed", sql("SELECT DISTINCT day::VARCHAR AS day, agency_id, line FROM pings"))
def _(spark, sf):
    return plain(adapter.pings(spark, sf).select("day", "agency_id", "line").distinct())


@BOOK.add("a05_lines_of_window", sql("SELECT line, direction_id, count(DISTINCT trip_id) AS trips FROM pings WHERE hour(make_timestamp(created_us)) BETWEEN 8 AND 9 GROUP BY 1, 2 HAVING count(DISTINCT trip_id) >= 3"))
def _(spark, sf):
    p = adapter.pings(spark, sf).where(F.hour(F.timestamp_micros("created_us")).between(8, 9))
    return p.groupBy("line", "direction_id").agg(F.countDistinct("trip_id").alias("trips")).where("trips >= 3")


@BOOK.add("j10_nearest_visit", sql("SELECT day::VARCHAR AS day, vehicle_id, trip_id, stop_id, visit_seq, planned_us, round_even((first_us - planned_us) / 1000000, 0)::BIGINT AS diff_s FROM matched"))
def _(spark, sf):
    return plain(matched_of(spark, sf).select("day", "vehicle_id", "trip_id", "stop_id", "visit_seq", "planned_us", "diff_s"))


@BOOK.add("a71_run_records", sql("SELECT day::VARCHAR AS day, trip_id, min(planned_us) AS planned_start, max(planned_us) AS planned_end, count(*) AS stops, count(*) FILTER (observations > 1) AS repeated FROM matched GROUP BY ALL"))
def _(spark, sf):
    return plain(matched_of(spark, sf).groupBy("day", "trip_id").agg(F.min("planned_us").alias("planned_start"), F.max("planned_us").alias("planned_end"), F.count("*").alias("stops"), F.count_if(F.col("observations") > 1).alias("repeated")))


@BOOK.add("w13_candidates", sql("SELECT * REPLACE (day::VARCHAR AS day) FROM cand"))
def _(spark, sf):
    return plain(candidates_of(spark, sf))


@BOOK.add("a18_episodes", sql("SELECT * REPLACE (day::VARCHAR AS day, island::BIGINT AS island) FROM eps"))
def _(spark, sf):
    return plain(episodes_of(spark, sf))


@BOOK.add("a13_episode_summary", sql("SELECT line, count(*) AS episodes, count(*) FILTER (class = 'multi_stop') AS multi_stop, sum(evidence)::BIGINT AS evidence, min(min_gap) AS min_gap, max(max_planned) AS max_planned FROM eps GROUP BY 1"))
def _(spark, sf):
    return episodes_of(spark, sf).groupBy("line").agg(F.count("*").alias("episodes"), F.count_if(F.col("class") == "multi_stop").alias("multi_stop"), F.sum("evidence").alias("evidence"), F.min("min_gap").alias("min_gap"), F.max("max_planned").alias("max_planned"))


RUNS = """SELECT (row_number() OVER (ORDER BY day, agency_id))::BIGINT AS x, day, agency_id, hash_id AS run_id, completed_us, status, lines FROM (
  SELECT day, agency_id, k * 100 + epoch(day::TIMESTAMP)::BIGINT // 86400 % 100 AS hash_id, k, max(created_us) + k AS completed_us, CASE WHEN k = 2 AND agency_id = 'A2' THEN 'failed' ELSE 'completed' END AS status, list(DISTINCT line) AS lines
  FROM pings, (SELECT unnest([1, 2]) AS k) GROUP BY day, agency_id, k)"""


def runs_of(spark, sf):
    """Two analysis runs of each day and agency, one of them failed for one agency."""
    p = adapter.pings(spark, sf).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    r = p.groupBy("day", "agency_id", "k").agg((F.max("created_us") + F.col("k")).alias("completed_us"), F.collect_set("line").alias("lines"))
    return r.select("day", "agency_id", (F.col("k") * 100 + F.pmod(F.unix_date("day"), F.lit(100))).cast("long").alias("run_id"), "completed_us", F.when((F.col("k") == 2) & (F.col("agency_id") == "A2"), "failed").otherwise("completed").alias("status"), "lines")


@BOOK.add("a14_latest_runs", sql("SELECT agency_id, day::VARCHAR AS day, run_id, scope FROM (SELECT *, 'full' AS scope, row_number() OVER (PARTITION BY agency_id ORDER BY completed_us DESC, run_id DESC) AS r FROM runs WHERE status = 'completed' AND run_id >= 200 UNION ALL SELECT *, 'L1', row_number() OVER (PARTITION BY agency_id ORDER BY completed_us DESC, run_id DESC) FROM runs WHERE status = 'completed' AND list_contains(lines, 'L1')) WHERE r = 1", runs=RUNS))
def _(spark, sf):
    """Runs from number 200 on are of all lines."""
    r = runs_of(spark, sf).withColumn("full_scope", F.col("run_id") >= 200)
    whole, one = detect.latest_scoped(r, ["agency_id"]), detect.latest_scoped(r, ["agency_id"], "L1")
    return plain(whole.withColumn("scope", F.lit("full")).unionByName(one.withColumn("scope", F.lit("L1"))).select("agency_id", "day", "run_id", "scope"))


@BOOK.add("a15_week_totals", sql("""SELECT line, count(DISTINCT day) AS days, count(class) AS episodes, count(*) FILTER (class = 'multi_stop') AS multi_stop, coalesce(sum(evidence), 0)::BIGINT AS evidence FROM (
  SELECT o.line, o.day, e.class, e.evidence FROM (SELECT *, row_number() OVER (PARTITION BY day, agency_id, line ORDER BY completed_us DESC, run_id DESC) AS r FROM (SELECT * EXCLUDE (lines), unnest(lines) AS line FROM runs) WHERE status = 'completed') o
  LEFT JOIN (SELECT line, class, evidence, 200 + epoch(day::TIMESTAMP)::BIGINT // 86400 % 100 AS run_id FROM eps) e ON e.run_id = o.run_id AND e.line = o.line WHERE o.r = 1) GROUP BY 1""", runs=RUNS))
def _(spark, sf):
    e = episodes_of(spark, sf).withColumn("run_id", (200 + F.pmod(F.unix_date("day"), F.lit(100))).cast("long"))
    return detect.week_totals(runs_of(spark, sf), e)


@BOOK.add("a16_week_days", sql("""SELECT g.day::VARCHAR AS day, g.line, CASE WHEN analysed THEN coalesce(n, 0) END AS episodes
  FROM (SELECT d::DATE AS day, line FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-07', INTERVAL 1 DAY)) AS d) CROSS JOIN (SELECT DISTINCT line FROM pings)) g
  LEFT JOIN (SELECT DISTINCT day, true AS analysed FROM runs WHERE status = 'completed' AND agency_id <> 'A2') r USING (day) LEFT JOIN (SELECT day, line, count(*) AS n FROM eps GROUP BY 1, 2) e USING (day, line)""", runs=RUNS))
def _(spark, sf):
    week = spark.range(1).select(F.explode(F.sequence(F.lit(adapter.MONDAY).cast("date"), F.date_add(F.lit(adapter.MONDAY).cast("date"), 6))).alias("day"))
    runs = runs_of(spark, sf).where("status = 'completed' and agency_id <> 'A2'").select("day").distinct().withColumn("analysed", F.lit(True))
    lines = adapter.pings(spark, sf).select("line").distinct()
    e = episodes_of(spark, sf).groupBy("day", "line").agg(F.count("*").alias("n"))
    grid = lines.crossJoin(F.broadcast(week)).join(runs, "day", "left").join(e, ["day", "line"], "left")  # seven days
    return plain(grid.select("day", "line", F.when(F.col("analysed"), F.coalesce("n", F.lit(0))).alias("episodes")))


EVIDENCE = "SELECT line || ':' || direction_id || ':' || stop_id AS section, pair || island AS episode, day, t1, t2 FROM islands"


@BOOK.add("a20_heatmap", sql("""SELECT s.section, m AS minute, coalesce(episodes, 0) AS episodes, coalesce(days, 0) AS days, round(coalesce(episodes, 0) / (SELECT count(DISTINCT day) FROM pings), 6) AS per_day
  FROM (SELECT DISTINCT section FROM evidence) s CROSS JOIN (SELECT (unnest(range(0, 1411, 30)))::INT AS m) LEFT JOIN (SELECT section, (hour(x) * 60 + minute(x) // 30 * 30)::INT AS minute, count(DISTINCT episode) AS episodes, count(DISTINCT day) AS days FROM (SELECT *, make_timestamp((t1 + t2) // 2) AS x FROM evidence) GROUP BY 1, 2) c ON c.section = s.section AND c.minute = m""", evidence=EVIDENCE))
def _(spark, sf):
    from pyspark.sql import Window

    c = candidates_of(spark, sf).withColumn("pair", detect.pair_key())
    w = Window.partitionBy("day", "line", "direction_id", "pair").orderBy("t2", "stop_id")
    c = c.withColumn("new", F.when(F.col("t2") - F.lag("t2").over(w) > detect.PAUSE * detect.SECOND, 1).otherwise(0)).withColumn("island", F.sum("new").over(w))
    e = c.select(F.concat_ws(":", "line", "direction_id", "stop_id").alias("section"), F.concat("pair", F.col("island").cast("string")).alias("episode"), "day", "t1", "t2")
    return plain(detect.heatmap(e, adapter.pings(spark, sf).select("day")))


FRAGMENTS |= {"ordered": "SELECT *, lag(line) OVER w AS line0, lag(trip_id) OVER w AS trip0, lag(stop_id) OVER w AS stop0, lag(created_us) OVER w AS us0, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(seq) OVER w AS seq0 FROM pings WINDOW w AS (PARTITION BY day, agency_id, vehicle_id ORDER BY created_us, event_id)"}


@BOOK.add("w15_periods", sql("SELECT day::VARCHAR AS day, agency_id, vehicle_id, period::BIGINT AS period, line, trip_id, min(created_us) AS starts, max(created_us) AS ends, count(*) AS pings FROM (SELECT *, sum(CASE WHEN line0 = line AND trip0 = trip_id THEN 0 ELSE 1 END) OVER (PARTITION BY day, agency_id, vehicle_id ORDER BY created_us, event_id) AS period FROM ordered) GROUP BY ALL"))
def _(spark, sf):
    return plain(vehicles.line_periods(adapter.pings(spark, sf)))


@BOOK.add("w16_report_gaps", sql("SELECT day::VARCHAR AS day, vehicle_id, event_id, round_even((created_us - us0) / 1000000, 0)::BIGINT AS gap_s, line0 <> line AS line_changed, trip0 <> trip_id AS trip_changed, stop0 <> stop_id AS stop_changed, cell0 <> cell AS area_changed FROM (SELECT *, lag(line) OVER w AS line0, lag(trip_id) OVER w AS trip0, lag(stop_id) OVER w AS stop0, lag(cell) OVER w AS cell0, lag(created_us) OVER w AS us0 FROM celled WINDOW w AS (PARTITION BY day, agency_id, vehicle_id ORDER BY created_us, event_id)) WHERE created_us - us0 > 120000000"))
def _(spark, sf):
    return plain(vehicles.report_gaps(adapter.pings(spark, sf)))


@BOOK.add("w17_encounters", sql("SELECT day::VARCHAR AS day, vehicle_id, trip_id, stop_id, created_us, event_id FROM ordered WHERE trip0 IS DISTINCT FROM trip_id OR stop0 IS DISTINCT FROM stop_id"))
def _(spark, sf):
    return plain(vehicles.encounters(adapter.pings(spark, sf)))


@BOOK.add("w18_day_lines", sql("SELECT day::VARCHAR AS day, vehicle_id, line, string_agg(DISTINCT trip_id, ',' ORDER BY trip_id) AS trips, count(DISTINCT stop_id) AS stops, count(*) AS pings, min(created_us) AS first_us, max(created_us) AS last_us FROM pings GROUP BY ALL"))
def _(spark, sf):
    return plain(vehicles.day_lines(adapter.pings(spark, sf)))


NOON = adapter.WEEK_US + 12 * 3600 * 1_000_000


@BOOK.add("r01_snapshot", sql(f"SELECT agency_id, vehicle_id, arg_max(event_id, (created_us, event_id)) AS event_id, arg_max(line, (created_us, event_id)) AS line, round(({NOON} - max(created_us)) / 1e6, 6) AS age_s, ({NOON} - max(created_us)) / 1e6 > 60 AS stale FROM pings WHERE created_us BETWEEN {NOON - 120_000_000} AND {NOON} GROUP BY 1, 2"))
def _(spark, sf):
    return plain(vehicles.snapshot(adapter.pings(spark, sf), NOON))


TICKS = """SELECT tick, agency_id, vehicle_id, arg_max(line, (created_us, event_id)) AS line, arg_max(direction_id, (created_us, event_id)) AS direction_id, arg_max(lat, (created_us, event_id)) AS lat, arg_max(lon, (created_us, event_id)) AS lon
  FROM (SELECT *, unnest(generate_series((created_us + 59999999) // 60000000 * 60000000, (created_us + 120000000) // 60000000 * 60000000, 60000000)) AS tick FROM pings) WHERE tick - created_us <= 120000000 GROUP BY 1, 2, 3"""
NEAR = """SELECT * FROM (SELECT a.tick, a.agency_id, a.line, a.direction_id, a.vehicle_id AS v1, b.vehicle_id AS v2, 2 * 6371000.0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) AS metres
  FROM at_ticks a JOIN at_ticks b ON a.tick = b.tick AND a.agency_id = b.agency_id AND a.line = b.line AND a.direction_id = b.direction_id AND a.vehicle_id < b.vehicle_id) WHERE metres <= 300"""


@BOOK.add("j13_near_pairs", sql("SELECT tick, agency_id, line, direction_id, v1, v2, round(metres, 3) AS metres FROM near", at_ticks=TICKS, near=NEAR))
def _(spark, sf):
    return plain(vehicles.near_pairs(vehicles.ticks(adapter.pings(spark, sf), 60), 300), 3)


@BOOK.add("r02_timeline", sql("SELECT t.tick, count(n.v1) AS pairs FROM (SELECT DISTINCT tick FROM at_ticks) t LEFT JOIN near n USING (tick) GROUP BY 1", at_ticks=TICKS, near=NEAR))
def _(spark, sf):
    at = vehicles.ticks(adapter.pings(spark, sf), 60)
    found = vehicles.near_pairs(at, 300).groupBy("tick").agg(F.count("*").alias("pairs"))
    return at.select("tick").distinct().join(found, "tick", "left").select("tick", F.coalesce("pairs", F.lit(0)).alias("pairs"))


@BOOK.add("r03_contract", sql("SELECT count(*) AS pings, count(*) FILTER (us0 > created_us) AS unsorted, count(*) FILTER (lat IS NULL OR isnan(lat) OR abs(lat) > 90) + count(*) FILTER (lon IS NULL OR isnan(lon) OR abs(lon) > 180) AS no_place, count(*) FILTER (trim(coalesce(vehicle_id, '')) = '') AS no_vehicle, count(*) FILTER (received_us < created_us) AS early FROM (SELECT *, lag(created_us) OVER (ORDER BY event_id) AS us0 FROM pings)"))
def _(spark, sf):
    return vehicles.contract(adapter.pings(spark, sf), chunk=4096)


@BOOK.add("r04_latency", sql("SELECT agency_id, round(median((received_us - created_us) / 1e6), 6) AS median_s, count(*) AS pings FROM pings GROUP BY 1"))
def _(spark, sf):
    return plain(vehicles.latency(adapter.pings(spark, sf)))
