"""Queries on pings, plans, passages and headways."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspan.functions import clock, geo
from fleetspan.operators import features, ingest, passages
from fleetspan.plans.book import Book, plain
from fleetspan.plans.oracle import FRAGMENTS, sql
from fleetspan.sources import adapter

BOOK = Book()

FRAGMENTS |= {
    "seen": "SELECT agency_id, day, trip_id, vehicle_id, stop_id, min(created_us) AS t_first, max(created_us) AS t_pass FROM pings GROUP BY ALL",
    "planned": "SELECT trip_id, stop_id, min(stop_sequence) AS seq, arg_min(sched_us, stop_sequence) AS sched_us, arg_min(line, stop_sequence) AS line, arg_min(direction_id, stop_sequence) AS direction_id FROM visits GROUP BY 1, 2",
    "lasts": "SELECT trip_id, max(stop_sequence) AS last_seq FROM visits GROUP BY 1",
    "stop_passages": "SELECT *, (t - sched_us) / 1e6 AS delay FROM (SELECT s.*, p.seq, p.sched_us, p.line, p.direction_id, last_seq, seq = last_seq AS is_last, CASE WHEN seq = last_seq THEN t_first ELSE t_pass END AS t FROM seen s JOIN planned p USING (trip_id, stop_id) JOIN lasts USING (trip_id))",
    "trusted": "SELECT * FROM stop_passages ANTI JOIN (SELECT day, trip_id, vehicle_id FROM stop_passages GROUP BY ALL HAVING abs(list_sort(list(delay))[count(*) // 2 + 1]) > 1800) USING (day, trip_id, vehicle_id)",
    "chained": """SELECT p.*, c.prev_trip_delay FROM trusted p JOIN (
      SELECT day, trip_id, vehicle_id, CASE WHEN before_ends <= begins AND abs(before_delay) <= 1800 THEN before_delay END AS prev_trip_delay FROM (
        SELECT *, lag(ends) OVER w AS before_ends, lag(last_delay) OVER w AS before_delay FROM (
          SELECT day, trip_id, vehicle_id, arg_min(t, (seq, t, stop_id)) AS begins, arg_max(t, (seq, t, stop_id)) AS ends, arg_max(delay, (seq, t, stop_id)) AS last_delay FROM trusted GROUP BY ALL)
        WINDOW w AS (PARTITION BY day, vehicle_id ORDER BY begins, trip_id))) c USING (day, trip_id, vehicle_id)""",
    "fronts": """SELECT *, lag(trip_id) OVER w AS leader_trip, lag(vehicle_id) OVER w AS leader_vehicle, (t - lag(t) OVER w) / 1e6 AS hw, (sched_us - lag(sched_us) OVER w) / 1e6 AS sched_hw, lag(delay) OVER w AS lead_delay
      FROM chained WINDOW w AS (PARTITION BY day, line, direction_id, stop_id ORDER BY t, trip_id, vehicle_id)""",
    "judged": "SELECT *, coalesce(valid AND ratio < 0.25, false) AS bunched FROM (SELECT *, CASE WHEN valid THEN hw / sched_hw END AS ratio FROM (SELECT *, coalesce(sched_hw BETWEEN 120 AND 3600 AND abs(delay) <= 1800 AND abs(lead_delay) <= 1800, false) AS valid FROM fronts))",
    "feat": """SELECT *, seq / max(seq) OVER (PARTITION BY day, trip_id, vehicle_id) AS progress, lag(ratio, 3) OVER w AS ratio_prev3, max(bunched) OVER (w ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS label,
      hour(make_timestamp(t)) AS hour, dayofweek(day) BETWEEN 1 AND 5 AS working, strftime(day, '%a') AS dow,
      CASE WHEN hour(make_timestamp(t)) BETWEEN 6 AND 9 THEN '06-10' WHEN hour(make_timestamp(t)) BETWEEN 10 AND 15 THEN '10-16' WHEN hour(make_timestamp(t)) BETWEEN 16 AND 20 THEN '16-21' WHEN hour(make_timestamp(t)) BETWEEN 21 AND 23 THEN '21-24' ELSE 'night' END AS block
      FROM judged WINDOW w AS (PARTITION BY day, trip_id, vehicle_id ORDER BY seq, t, stop_id)""",
}


BITS = " || ".join(f"substring('{geo.ALPHABET}', ({' + '.join(f'(({'x' if i % 2 == 0 else 'y'} >> {(12 if i % 2 == 0 else 11) - i // 2}) & 1) * {2 ** (4 - i % 5)}' for i in range(5 * c, 5 * c + 5))})::INT + 1, 1)" for c in range(5))
FRAGMENTS |= {"celled": f"SELECT *, {BITS} AS cell FROM (SELECT *, floor((lon + 180) / 360 * 8192)::INT AS x, floor((lat + 90) / 180 * 4096)::INT AS y FROM pings)"}


def passages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.stop_passages(adapter.pings(spark, sf_dir), adapter.visits(spark, sf_dir))


def trusted_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.without_suspects(passages_of(spark, sf_dir))


def judged_of(spark: SparkSession, sf_dir: str, mode: str = "line") -> DataFrame:
    return passages.labelled(passages.headways(passages.previous_trip_delay(trusted_of(spark, sf_dir)), mode), passages.LOOK_AHEAD[mode])


RAW = """SELECT event_id, event_type AS source, CASE WHEN event_id % 37 = 0 THEN ' ' ELSE 'V' || user_id END AS vehicle_id, CASE WHEN event_id % 41 = 0 THEN 'nan' WHEN event_id % 43 = 0 THEN '181' ELSE '38.7' END AS latitude,
  CASE WHEN event_id % 47 = 0 THEN 'x' ELSE '1704067200000' END AS created_at, CASE WHEN event_id % 53 = 0 THEN 'bad' ELSE 'eyckp' END AS geohash_5 FROM events"""
REASON = "CASE WHEN trim(vehicle_id) = '' THEN 'identifier' WHEN latitude <> '38.7' THEN 'coordinates' WHEN created_at = 'x' THEN 'timestamp_or_date' WHEN geohash_5 = 'bad' THEN 'geohash' END"


def raw_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as raw pings with faults, all strings."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    every = lambda n: F.pmod("event_id", F.lit(n)) == 0
    return e.select(
        "event_id", F.col("event_type").alias("source"), F.col("event_id").cast("string").alias("_id"), F.lit("A1").alias("agency_id"),
        F.when(every(37), " ").otherwise(F.concat(F.lit("V"), F.col("user_id").cast("string"))).alias("vehicle_id"),
        F.when(every(41), "nan").when(every(43), "181").otherwise("38.7").alias("latitude"), F.lit("-9.1").alias("longitude"),
        F.when(every(47), "x").otherwise("1704067200000").alias("created_at"), F.lit("1704067200000").alias("received_at"), F.lit("20240101").alias("operational_date"), F.when(every(53), "bad").otherwise("eyckp").alias("geohash_5"), *[F.lit("x").alias(c) for c in ("driver_id", "stop_id", "trip_id")])


@BOOK.add("s03_reject_reasons", sql(f"SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM checked GROUP BY 1", raw_pings=RAW, checked=f"SELECT {REASON} AS reason FROM raw_pings"))
def _(spark, sf):
    return ingest.reject_reason(raw_of(spark, sf)).groupBy(F.coalesce("reject_reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@BOOK.add("s07_counters", sql("SELECT source, count(*) AS rows_read, count(*) FILTER (reason IS NULL) AS valid_rows, count(DISTINCT CASE WHEN reason IS NULL THEN vehicle_id END) AS inserted, count(*) FILTER (reason IS NULL) - count(DISTINCT CASE WHEN reason IS NULL THEN vehicle_id END) AS duplicates, count(*) FILTER (reason = 'column_count') AS column_count, count(*) FILTER (reason = 'identifier') AS identifier, count(*) FILTER (reason = 'coordinates') AS coordinates, count(*) FILTER (reason = 'timestamp_or_date') AS timestamp_or_date, count(*) FILTER (reason = 'geohash') AS geohash FROM checked GROUP BY 1", raw_pings=RAW, checked=f"SELECT source, vehicle_id, {REASON} AS reason FROM raw_pings"))
def _(spark, sf):
    return ingest.counters(ingest.reject_reason(raw_of(spark, sf)), "source", ["vehicle_id"])


SAME = ["agency_id", "vehicle_id", "trip_id", "stop_id"]


@BOOK.add("s05_dedup", sql("SELECT agency_id, vehicle_id, trip_id, stop_id, min(received_us) AS received_us, arg_min(event_id, (received_us, event_id)) AS event_id, arg_min(event_type, (received_us, event_id)) AS event_type, count(*) AS copies FROM pings GROUP BY 1, 2, 3, 4"))
def _(spark, sf):
    return ingest.dedup(adapter.pings(spark, sf), SAME)


@BOOK.add("s06_provenance", sql("SELECT agency_id, vehicle_id, trip_id, stop_id, event_type, min(received_us) AS received_us, count(*) AS rows FROM pings GROUP BY 1, 2, 3, 4, 5"))
def _(spark, sf):
    return ingest.provenance(adapter.pings(spark, sf), SAME, "event_type")


@BOOK.add("s08_availability", sql("SELECT cell, day::VARCHAR AS date, agency_id, count(*) AS pings, min(created_us) AS first_us, max(created_us) AS last_us FROM celled GROUP BY ALL"))
def _(spark, sf):
    return plain(ingest.availability(adapter.pings(spark, sf), geo.geohash(F.col("lat"), F.col("lon"), 5)))


@BOOK.add("s23_portable", sql("SELECT event_id, agency_id, vehicle_id, 'redacted' AS driver_id, trip_id, created_us, 'all' AS mode FROM pings WHERE agency_id IN ('A1', 'A3') UNION ALL SELECT event_id, agency_id, vehicle_id, 'redacted', trip_id, created_us, 'lines' FROM pings WHERE agency_id IN ('A1', 'A3') AND line IN ('L1')"))
def _(spark, sf):
    p = adapter.pings(spark, sf).withColumn("driver_id", F.concat(F.lit("D"), "vehicle_id"))
    both = ingest.portable(p, ["A1", "A3"]).withColumn("mode", F.lit("all")).unionByName(ingest.portable(p, ["A1", "A3"], lines=["L1"]).withColumn("mode", F.lit("lines")))
    return both.select("event_id", "agency_id", "vehicle_id", "driver_id", "trip_id", "created_us", "mode")


@BOOK.add("s26_stop_places", sql("SELECT stop_id, round(median(lat), 4) AS lat, round(median(lon), 4) AS lon FROM (SELECT stop_id, arg_max(lat, (created_us, event_id)) AS lat, arg_max(lon, (created_us, event_id)) AS lon FROM pings GROUP BY trip_id, vehicle_id, stop_id) GROUP BY 1"))
def _(spark, sf):
    from fleetspan.operators import findings

    return plain(findings.stop_places(adapter.pings(spark, sf)), 4)


@BOOK.add("s27_parity", sql("SELECT (SELECT count(*) FROM (SELECT agency_id, vehicle_id, trip_id, stop_id, created_us FROM a EXCEPT ALL SELECT agency_id, vehicle_id, trip_id, stop_id, created_us FROM b)) AS only_a, (SELECT count(*) FROM (SELECT agency_id, vehicle_id, trip_id, stop_id, created_us FROM b EXCEPT ALL SELECT agency_id, vehicle_id, trip_id, stop_id, created_us FROM a)) AS only_b, (SELECT count(*) FROM a JOIN b USING (agency_id, vehicle_id, trip_id, stop_id, created_us) WHERE a.received_us <> b.received_us) AS receipts_differ", a="SELECT * FROM pings WHERE event_type <> 'error'", b="SELECT * REPLACE (CASE WHEN event_type = 'click' THEN received_us + 1 ELSE received_us END AS received_us) FROM pings WHERE event_type <> 'view'"))
def _(spark, sf):
    p = adapter.pings(spark, sf)
    other = p.where("event_type <> 'view'").withColumn("received_us", F.col("received_us") + F.when(F.col("event_type") == "click", 1).otherwise(0))
    return ingest.parity(p.where("event_type <> 'error'"), other, ingest.IDENTITY)


@BOOK.add("s14_public_lines", sql("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 4 > 0 THEN 'M' || printf('%02d', p_partkey % 100) WHEN p_partkey % 2 = 0 THEN 'N' || p_partkey WHEN p_partkey % 5 = 0 THEN 'R' || p_partkey ELSE CASE WHEN p_partkey % 4 > 0 THEN 'M' || printf('%02d', p_partkey % 100) || '_' || p_partkey ELSE 'x' || p_partkey END END AS line FROM part"))
def _(spark, sf):
    k = F.col("p_partkey")
    text = k.cast("string")
    route = F.when(k % 4 > 0, F.concat(F.lit("M"), F.format_string("%02d", k % 100), F.lit("_"), text)).otherwise(F.concat(F.lit("x"), text))
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select("p_partkey", ingest.public_line(F.when(k % 3 == 0, "HF16N").otherwise("A"), route, F.when(k % 2 == 0, F.concat(F.lit("N"), text)).otherwise(" "), F.when(k % 5 == 0, F.concat(F.lit("R"), text))).alias("line"))


@BOOK.add("j01_latest_plan", sql("SELECT agency_id, day::VARCHAR AS day, max(id) AS package_id FROM (SELECT DISTINCT agency_id, day FROM pings) JOIN packages USING (agency_id) WHERE day BETWEEN active_from AND active_until GROUP BY ALL"))
def _(spark, sf):
    return plain(ingest.latest_plan(adapter.pings(spark, sf), adapter.plan_packages(spark, sf)))


@BOOK.add("j02_all_plans", sql("SELECT agency_id, day::VARCHAR AS day, id AS package_id FROM (SELECT DISTINCT agency_id, day FROM pings) JOIN packages USING (agency_id) WHERE day BETWEEN active_from AND active_until"))
def _(spark, sf):
    return plain(ingest.all_plans(adapter.pings(spark, sf), adapter.plan_packages(spark, sf)))


@BOOK.add("j03_resolved_pings", sql("SELECT agency_id, day::VARCHAR AS day, coalesce(package_id, -1) AS package_id, count(*) AS pings, count(v.stop_sequence) AS matched FROM pings p LEFT JOIN (SELECT agency_id, day, max(id) AS package_id FROM (SELECT DISTINCT agency_id, day FROM pings) JOIN packages USING (agency_id) WHERE day BETWEEN active_from AND active_until GROUP BY ALL) USING (agency_id, day) LEFT JOIN (SELECT * FROM visits WHERE stop_sequence > 1) v ON v.trip_id = p.trip_id AND v.stop_id = p.stop_id GROUP BY 1, 2, 3"))
def _(spark, sf):
    p = adapter.pings(spark, sf)
    plans = ingest.latest_plan(p, adapter.plan_packages(spark, sf))
    v = adapter.visits(spark, sf).where("stop_sequence > 1").select("trip_id", "stop_id", "stop_sequence")
    j = p.join(plans, ["agency_id", "day"], "left").join(v, ["trip_id", "stop_id"], "left")
    return plain(j.groupBy("agency_id", "day", F.coalesce("package_id", F.lit(-1)).alias("package_id")).agg(F.count("*").alias("pings"), F.count("stop_sequence").alias("matched")))


@BOOK.add("f11_plan_overlap", sql("SELECT id, agency_id, valid_before::VARCHAR AS valid_before FROM (SELECT *, max(active_until) OVER (PARTITION BY agency_id ORDER BY active_from, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS valid_before FROM packages) WHERE valid_before >= active_from"))
def _(spark, sf):
    return plain(ingest.overlapping_plans(adapter.plan_packages(spark, sf)).select("id", "agency_id", "valid_before"))


AREAS = ["eycknw", "eyckqb", "eycknvb"]


@BOOK.add("f04_geofence", sql("SELECT event_id FROM pings WHERE " + " OR ".join(f"lat >= {a!r} AND lat < {b!r} AND lon >= {c!r} AND lon < {d!r}" for a, b, c, d in map(geo.geohash_bounds, AREAS))))
def _(spark, sf):
    """Pings in cells of five to seven characters, each by its own prefix."""
    p = adapter.pings(spark, sf).withColumn("cell", geo.geohash(F.col("lat"), F.col("lon"), 7))
    return p.where(ingest.in_areas(F.col("cell"), AREAS)).select("event_id")


@BOOK.add("f16_cleaned", sql("""SELECT day::VARCHAR AS day, count(*) AS pings, count(stop) AS with_stop FROM (SELECT *, CASE WHEN event_type = 'error' THEN NULL ELSE stop_id END AS stop, (created_us - lag(created_us) OVER w) / 1e6 AS pause,
  2 * 6371000.0 * asin(sqrt(pow(sin(radians(lat - lag(lat) OVER w) / 2), 2) + cos(radians(lag(lat) OVER w)) * cos(radians(lat)) * pow(sin(radians(lon - lag(lon) OVER w) / 2), 2))) AS m FROM pings WHERE agency_id IN ('A0', 'A1', 'A2') WINDOW w AS (PARTITION BY day, agency_id, vehicle_id ORDER BY created_us, event_id))
  WHERE coalesce(m / nullif(pause, 0) * 3.6 <= 1.5, true) AND coalesce(pause <= 7200, true) GROUP BY 1"""))
def _(spark, sf):
    """With limits for derived pings, which are slow and far apart."""
    p = adapter.pings(spark, sf).withColumn("stop_id", F.when(F.col("event_type") == "error", ingest.SENTINEL).otherwise(F.col("stop_id")))
    return plain(ingest.cleaned(p, ["A0", "A1", "A2"], 1.5, 7200).groupBy("day").agg(F.count("*").alias("pings"), F.count("stop_id").alias("with_stop")))


@BOOK.add("j20_missing_dates", sql("SELECT agency_id, day::VARCHAR AS day FROM (SELECT DISTINCT agency_id, day FROM pings) EXCEPT SELECT agency_id, day::VARCHAR FROM pings WHERE event_type = 'error' AND agency_id < 'A3'"))
def _(spark, sf):
    p = adapter.pings(spark, sf)
    done = p.where("event_type = 'error' and agency_id < 'A3'").select("agency_id", "day")
    return plain(p.select("agency_id", "day").distinct().join(done, ["agency_id", "day"], "left_anti"))


@BOOK.add("j08_tuple_semi", sql("SELECT event_id FROM pings WHERE (line, direction_id) IN (SELECT line, direction_id FROM pings WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) % 2 = 0)"))
def _(spark, sf):
    p = adapter.pings(spark, sf)
    some = p.where("event_type = 'error'").groupBy("line", "direction_id").count().where("count % 2 = 0")
    return p.join(some, ["line", "direction_id"], "left_semi").select("event_id")


@BOOK.add("j05_first_visits", sql("SELECT trip_id, stop_id, seq, sched_us FROM planned"))
def _(spark, sf):
    return passages.first_visits(adapter.visits(spark, sf)).select("trip_id", "stop_id", F.col("seq"), "sched_us")


@BOOK.add("a01_passages", sql("SELECT day::VARCHAR AS day, trip_id, vehicle_id, stop_id, line, direction_id, seq, last_seq, is_last, t, t_first, round(delay, 6) AS delay FROM stop_passages"))
def _(spark, sf):
    return plain(passages_of(spark, sf).select("day", "trip_id", "vehicle_id", "stop_id", "line", "direction_id", "seq", "last_seq", "is_last", "t", "t_first", "delay"))



FLAT = "SELECT day, trip_id, line, direction_id, stop_id, CASE WHEN trip_id LIKE '%1-0-_' THEN first_s ELSE s END AS s FROM (SELECT *, min(s) OVER (PARTITION BY trip_id) AS first_s FROM (SELECT *, split_part(clock, ':', 1)::INT * 3600 + split_part(clock, ':', 2)::INT * 60 + split_part(clock, ':', 3)::INT AS s FROM visits))"
OFFSETS = "SELECT line, direction_id, day, stop_id, quantile_cont(s - start, 0.5) AS offset_s FROM flat_visits JOIN (SELECT trip_id, min(s) AS start FROM flat_visits GROUP BY 1 HAVING min(s) < max(s)) USING (trip_id) GROUP BY ALL"


def flat_visits(spark, sf):
    """The timetable with some trips flat: s is the first clock of the trip at all its stops."""
    from pyspark.sql import Window

    v = adapter.visits(spark, sf).withColumn("s", clock.clock_seconds(F.col("clock")))
    return v.withColumn("s", F.when(F.col("trip_id").like("%1-0-_"), F.min("s").over(Window.partitionBy("trip_id"))).otherwise(F.col("s")))


@BOOK.add("a08_typical_offsets", sql("SELECT line, direction_id, day::VARCHAR AS day, stop_id, round(offset_s, 6) AS offset_s FROM offsets", flat_visits=FLAT, offsets=OFFSETS))
def _(spark, sf):
    return plain(passages.typical_offsets(flat_visits(spark, sf), F.col("s"), ["line", "direction_id", "day"]))


@BOOK.add("a09_line_offsets", sql("SELECT line, direction_id, stop_id, round(list_sort(list(offset_s))[count(*) // 2 + 1], 6) AS offset_s FROM offsets GROUP BY 1, 2, 3", flat_visits=FLAT, offsets=OFFSETS))
def _(spark, sf):
    o = passages.typical_offsets(flat_visits(spark, sf), F.col("s"), ["line", "direction_id", "day"])
    return plain(passages.line_offsets(o, ["line", "direction_id"]))


@BOOK.add("a10_median_delays", sql("SELECT day::VARCHAR AS day, trip_id, vehicle_id, round(m, 6) AS median_delay FROM (SELECT day, trip_id, vehicle_id, list_sort(list(delay * 20))[count(*) // 2 + 1] AS m FROM stop_passages GROUP BY ALL) WHERE abs(m) > 1800"))
def _(spark, sf):
    return plain(passages.suspect_trips(passages_of(spark, sf).withColumn("delay", F.col("delay") * 20)))


@BOOK.add("a07_stop_lists", sql("SELECT trip_id, string_agg(stop_id, ',' ORDER BY stop_sequence) AS stops FROM visits GROUP BY 1"))
def _(spark, sf):
    return passages.trip_stops(adapter.visits(spark, sf)).select("trip_id", F.array_join("stops", ",").alias("stops"))


@BOOK.add("a06_longest_pattern", sql("SELECT line, direction_id, trip_id, n FROM (SELECT *, row_number() OVER (PARTITION BY line, direction_id ORDER BY n DESC, trip_id) AS r FROM (SELECT line, direction_id, trip_id, count(*) AS n FROM visits GROUP BY ALL)) WHERE r = 1"))
def _(spark, sf):
    from pyspark.sql import Window

    g = adapter.visits(spark, sf).groupBy("line", "direction_id", "trip_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("line", "direction_id").orderBy(F.desc("n"), "trip_id")
    return g.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


@BOOK.add("w01_headways", sql("SELECT day::VARCHAR AS day, trip_id, stop_id, leader_trip, leader_vehicle, round(hw, 6) AS hw, round(sched_hw, 6) AS sched_hw, valid, round(ratio, 6) AS ratio, bunched FROM judged"))
def _(spark, sf):
    return plain(passages.headways(trusted_of(spark, sf)).select("day", "trip_id", "stop_id", "leader_trip", "leader_vehicle", "hw", "sched_hw", "valid", "ratio", "bunched"))


CORRIDOR = {
    "c1": "SELECT *, lag(trip_id) OVER w AS leader_trip, lag(line) OVER w AS leader_line, (t - lag(t) OVER w) / 1e6 AS hw, (sched_us - lag(sched_us) OVER w) / 1e6 AS sched_hw, lag(delay) OVER w AS lead_delay FROM trusted WINDOW w AS (PARTITION BY day, stop_id ORDER BY t, trip_id, vehicle_id)",
    "c2": "SELECT *, leader_line = line AS same_line, coalesce(sched_hw BETWEEN 120 AND 3600 AND abs(delay) <= 1800 AND abs(lead_delay) <= 1800, false) AS valid FROM c1",
}


@BOOK.add("w01c_corridor", sql("SELECT day::VARCHAR AS day, trip_id, stop_id, leader_trip, same_line, round(hw, 6) AS hw, valid, coalesce(valid AND hw < 60, false) AS bunched FROM c2", **CORRIDOR))
def _(spark, sf):
    return plain(passages.headways(trusted_of(spark, sf), "corridor").select("day", "trip_id", "stop_id", "leader_trip", "same_line", "hw", "valid", "bunched"))


@BOOK.add("x28_shared_next", sql("""SELECT day::VARCHAR AS day, trip_id, stop_id, round(CASE WHEN lead IS NULL THEN CASE WHEN same_line THEN 1.0 ELSE 0.5 END WHEN len(nxt) = 0 THEN 0 ELSE len(list_filter(nxt, lambda s: list_contains(lead, s))) / len(nxt) END, 6) AS shared_next
  FROM (SELECT c2.*, b.stops AS lead, a.stops[list_position(a.stops, stop_id) + 1 : list_position(a.stops, stop_id) + 5] AS nxt FROM c2 JOIN lists a ON a.trip_id = c2.trip_id LEFT JOIN lists b ON b.trip_id = leader_trip)""", lists="SELECT trip_id, list(stop_id ORDER BY stop_sequence) AS stops FROM visits GROUP BY 1", **CORRIDOR))
def _(spark, sf):
    p = passages.headways(trusted_of(spark, sf), "corridor")
    return plain(passages.shared_next(p, passages.trip_stops(adapter.visits(spark, sf))).select("day", "trip_id", "stop_id", "shared_next"))


@BOOK.add("w03_prev_trip", sql("SELECT day::VARCHAR AS day, trip_id, vehicle_id, stop_id, round(prev_trip_delay, 6) AS prev_trip_delay FROM chained"))
def _(spark, sf):
    return plain(passages.previous_trip_delay(trusted_of(spark, sf)).select("day", "trip_id", "vehicle_id", "stop_id", "prev_trip_delay"))


@BOOK.add("w05_labels", sql("SELECT day::VARCHAR AS day, trip_id, stop_id, round(progress, 6) AS progress, round(ratio_prev3, 6) AS ratio_prev3, label FROM feat"))
def _(spark, sf):
    return plain(judged_of(spark, sf).select("day", "trip_id", "stop_id", "progress", "ratio_prev3", "label"))


FRAGMENTS |= {
    "hist": """SELECT *, hw - lag(hw) OVER w AS close1, (hw - lag(hw, 3) OVER w) / 3 AS close3, (hw - lag(hw, 5) OVER w) / 5 AS close5, (delay - lag(delay, 3) OVER w) / 60 AS delay_change3,
      CASE WHEN row_number() OVER w > 1 THEN (leader_trip IS DISTINCT FROM lag(leader_trip) OVER w)::INT END AS leader_changed FROM feat WINDOW w AS (PARTITION BY day, trip_id, vehicle_id ORDER BY seq, t, stop_id)""",
    "led": "SELECT *, lag(ratio) OVER w AS lead_ratio, lag(close3) OVER w AS lead_close3 FROM hist WINDOW w AS (PARTITION BY day, line, direction_id, stop_id ORDER BY t, trip_id, vehicle_id)",
    "recent": "SELECT a.day, a.trip_id, a.vehicle_id, a.stop_id, avg(abs(ln(least(3.0, greatest(0.05, j.ratio))))) FILTER (j.ratio IS NOT NULL) AS line_irreg30, count(j.ratio) AS line_n30 FROM judged a LEFT JOIN judged j ON j.day = a.day AND j.line = a.line AND j.direction_id = a.direction_id AND j.t BETWEEN a.t - 1800000000 AND a.t - 1 GROUP BY ALL",
    "irregular": "SELECT l.*, x.line_irreg30, x.line_n30 FROM led l JOIN recent x USING (day, trip_id, vehicle_id, stop_id)",
}


def context_of(spark, sf):
    return features.irregularity(features.leader_state(features.trip_history(judged_of(spark, sf))))


@BOOK.add("w06_history", sql("SELECT day::VARCHAR AS day, trip_id, stop_id, round(close1, 6) AS close1, round(close3, 6) AS close3, round(close5, 6) AS close5, round(delay_change3, 6) AS delay_change3, leader_changed FROM hist"))
def _(spark, sf):
    return plain(features.trip_history(judged_of(spark, sf)).select("day", "trip_id", "stop_id", "close1", "close3", "close5", "delay_change3", "leader_changed"))


@BOOK.add("w07_leader_state", sql("SELECT day::VARCHAR AS day, trip_id, stop_id, round(lead_ratio, 6) AS lead_ratio, round(lead_close3, 6) AS lead_close3 FROM led"))
def _(spark, sf):
    return plain(features.leader_state(features.trip_history(judged_of(spark, sf))).select("day", "trip_id", "stop_id", "lead_ratio", "lead_close3"))


@BOOK.add("w08_irregularity", sql("SELECT day::VARCHAR AS day, trip_id, stop_id, round(line_irreg30, 6) AS line_irreg30, line_n30 FROM irregular"))
def _(spark, sf):
    return plain(context_of(spark, sf).select("day", "trip_id", "stop_id", "line_irreg30", "line_n30"))


NAMED = """SELECT *, ln(least(3.0, greatest(0.05, greatest(0, hw / sched_hw)))) AS log_ratio, CASE WHEN ratio_prev3 IS NOT NULL THEN least(3.0, greatest(-3.0, greatest(0, hw / sched_hw) - ratio_prev3)) ELSE 0 END AS trend, (lead_delay - delay) / 60 AS delay_gap_min, coalesce(prev_trip_delay / 60, 0) AS prev_trip_delay_min,
  (hour BETWEEN 7 AND 9)::INT AS peak_am, (hour BETWEEN 17 AND 19)::INT AS peak_pm, ln(greatest(hw, 5.0) / 60) AS log_gap, sin((hour + minute(make_timestamp(t)) / 60) * 2 * pi() / 24) AS hour_sin FROM irregular WHERE hw IS NOT NULL AND sched_hw <> 0"""


@BOOK.add("m01_features", sql("SELECT day::VARCHAR AS day, trip_id, stop_id, round(log_ratio, 6) AS log_ratio, round(trend, 6) AS trend, round(delay_gap_min, 6) AS delay_gap_min, round(prev_trip_delay_min, 6) AS prev_trip_delay_min, peak_am, peak_pm, round(log_gap, 6) AS log_gap, round(hour_sin, 6) AS hour_sin FROM named", named=NAMED))
def _(spark, sf):
    p = features.named(context_of(spark, sf).where("hw is not null and sched_hw <> 0"))
    return plain(p.select("day", "trip_id", "stop_id", "log_ratio", "trend", "delay_gap_min", "prev_trip_delay_min", "peak_am", "peak_pm", "log_gap", "hour_sin"))


MODEL = {"log_ratio": (-0.9, -0.2, 0.6), "trend": (-0.3, 0.0, 0.5), "delay_gap_min": (0.4, 0.1, 2.0), "line_irreg30": (0.2, 0.5, 0.3)}


@BOOK.add("m02_linear_score", sql("SELECT day::VARCHAR AS day, trip_id, stop_id, round(1 / (1 + exp(-greatest(-50, least(50, -3.0 + -0.9 * (log_ratio - -0.2) / 0.6 + -0.3 * trend / 0.5 + 0.4 * (coalesce(delay_gap_min, 0.1) - 0.1) / 2.0 + 0.2 * (coalesce(line_irreg30, 0.5) - 0.5) / 0.3)))), 6) AS p FROM named", named=NAMED))
def _(spark, sf):
    p = features.named(context_of(spark, sf).where("hw is not null and sched_hw <> 0"))
    return plain(p.select("day", "trip_id", "stop_id", features.linear_score(MODEL, -3.0).alias("p")))


@BOOK.add("f12_scoreable", sql("SELECT line, count(*) FILTER (valid AND NOT bunched AND ratio >= 0.5) AS scoreable, count(*) AS passages FROM judged GROUP BY 1"))
def _(spark, sf):
    return judged_of(spark, sf).groupBy("line").agg(F.count_if(features.scoreable()).alias("scoreable"), F.count("*").alias("passages"))


@BOOK.add("a11_top_pairs", sql("SELECT vehicle_id, leader_vehicle, count(*) AS stops, round(min(hw), 6) AS min_gap, min(t) AS first_us, max(t) AS last_us FROM judged WHERE bunched GROUP BY 1, 2 ORDER BY stops DESC, first_us, vehicle_id, leader_vehicle LIMIT 8"))
def _(spark, sf):
    return plain(passages.top_pairs(judged_of(spark, sf)))


@BOOK.add("x01_clocks", sql("""SELECT trip_id, stop_id, epoch_us(day::TIMESTAMP) + (s + CASE WHEN s < 14400 THEN 86400 ELSE 0 END) * 1000000 AS scheduled, epoch_us(day::TIMESTAMP) + s * 1000000 AS service, epoch_us(day::TIMESTAMP) + s * 1000000 AS reference
  FROM (SELECT *, split_part(clock, ':', 1)::BIGINT * 3600 + split_part(clock, ':', 2)::BIGINT * 60 + split_part(clock, ':', 3)::BIGINT AS s FROM visits)"""))
def _(spark, sf):
    v = adapter.visits(spark, sf)
    return v.select("trip_id", "stop_id", clock.scheduled_us(F.col("day"), F.col("clock")).alias("scheduled"), clock.service_us(F.col("day"), F.col("clock")).alias("service"), clock.reference_us(F.col("sched_us") + 0, F.col("clock")).alias("reference"))


@BOOK.add("x05_half_hours", sql("SELECT (hour(make_timestamp(created_us)) * 60 + minute(make_timestamp(created_us)) // 30 * 30)::INT AS minute, date_trunc('week', day)::DATE::VARCHAR AS monday, count(*) AS n FROM pings GROUP BY 1, 2"))
def _(spark, sf):
    p = adapter.pings(spark, sf)
    return plain(p.groupBy(clock.half_hour(F.col("created_us")).alias("minute"), clock.monday(F.col("day")).alias("monday")).agg(F.count("*").alias("n")))






@BOOK.add("x17_geohash", sql(f"SELECT event_id, {BITS} AS geohash FROM (SELECT event_id, floor((lon + 180) / 360 * 8192)::INT AS x, floor((lat + 90) / 180 * 4096)::INT AS y FROM pings)"))
def _(spark, sf):
    return adapter.pings(spark, sf).select("event_id", geo.geohash(F.col("lat"), F.col("lon"), 5).alias("geohash"))
