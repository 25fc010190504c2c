"""Operators on small fixtures with results worked out by hand."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from fleetspan.functions import clock, geo
from fleetspan.operators import catalogue, detect, diagram, features, findings, ingest, kpis, passages, traffic, vehicles

DAY = dt.date(2026, 9, 1)
S = 1_000_000
BASE = 1_788_220_800 * S  # 1 Sep 2026, 00:00 UTC


def us(y, m, d, h=0, mi=0, s=0):
    return int(dt.datetime(y, m, d, h, mi, s, tzinfo=dt.timezone.utc).timestamp()) * S


def test_clock_rules(spark):
    d = spark.createDataFrame([(DAY, "25:10:00"), (DAY, "01:10:00"), (DAY, "bad"), (DAY, None), (DAY, "08:61:00")], "day date, c string")
    a = [r[0] for r in d.select(clock.scheduled_us(F.col("day"), F.col("c"))).collect()]
    assert a[0] == a[1] == us(2026, 9, 2, 0, 10)  # Lisbon is an hour ahead of UTC in September
    assert a[2] is None and a[3] is None
    b = [r[0] for r in d.select(clock.service_us(F.col("day"), F.col("c"))).collect()]
    assert b[1] == us(2026, 9, 1, 0, 10) and b[4] is None
    ping = spark.createDataFrame([(us(2026, 9, 2, 0, 30), "25:10:00")], "u long, c string")
    assert ping.select(clock.reference_us(F.col("u"), F.col("c"))).first()[0] == us(2026, 9, 2, 0, 10)


def test_half_hour_in_both_zones(spark):
    d = spark.createDataFrame([(us(2026, 9, 1, 23, 0),), (us(2026, 1, 1, 8, 5),)], "u long")
    assert [r[0] for r in d.select(clock.half_hour(F.col("u"))).collect()] == [0, 480]


def test_reject_reasons(spark):
    good = ["e", "A", "1704067200000", "d", "38.7", "-9.1", "20240101", "1704067200000", "s", "t", "v", "eyckp"]
    rows = []
    for at, value in ((None, None), (4, "nan"), (5, "181"), (10, " "), (2, "x"), (11, "bad"), (10, None), (6, "2024-01-01"), (10, "")):
        r = list(good)
        if at is not None:
            r[at] = value
        rows.append(tuple(r))
    d = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ingest.PING_COLUMNS))
    assert [r[0] for r in ingest.reject_reason(d).select("reject_reason").collect()] == [None, "coordinates", "coordinates", "identifier", "timestamp_or_date", "geohash", "column_count", "timestamp_or_date", "identifier"]  # a null is a field that a short row lacks


def test_dedup_keeps_the_earliest_receipt(spark):
    d = spark.createDataFrame([("A", "1", 5, "0001", "x"), ("A", "1", 3, "0003", "y"), ("A", "2", 9, "0002", "x")], "agency_id string, vehicle_id string, received_us long, event_id string, event_type string")
    got = {r.vehicle_id: (r.received_us, r.event_id, r.copies) for r in ingest.dedup(d, ["agency_id", "vehicle_id"]).collect()}
    assert got == {"1": (3, "0003", 2), "2": (9, "0002", 1)}


def three_trips(spark):
    """Trips over 8 stops, planned every 2 minutes; A falls behind, B follows 10 minutes later on time, C 20 minutes later."""
    rows = []
    for trip, start, late in (("A", 0, 60), ("B", 600, 0), ("C", 1200, 0)):
        for i in range(8):
            planned = BASE + (start + 120 * i) * S
            rows.append(("x", DAY, trip, "v" + trip, "742", "0", f"S{i + 1}", i + 1, planned, planned + late * i * S))
    cols = "agency_id string, day date, trip_id string, vehicle_id string, line string, direction_id string, stop_id string, seq int, sched_us long, t long"
    return spark.createDataFrame(rows, cols).withColumn("delay", (F.col("t") - F.col("sched_us")) / S)


def test_headways_and_labels(spark):
    p = passages.labelled(passages.headways(three_trips(spark)))
    got = {(r.trip_id, r.seq): r for r in p.collect()}
    assert (got["B", 1].hw, got["B", 1].sched_hw, got["B", 1].ratio) == (600, 600, 1.0)
    assert got["B", 8].hw == 180 and abs(got["B", 8].ratio - 0.3) < 1e-9 and not got["B", 8].bunched
    assert got["A", 1].hw is None and not got["A", 1].valid and got["A", 1].ratio is None
    assert got["B", 8].label is None and got["B", 1].label is False
    h = {(r.trip_id, r.seq): r for r in features.leader_state(features.trip_history(p)).collect()}
    assert h["B", 1].close1 is None and h["B", 2].close1 == -60 and h["B", 4].close3 == -60
    assert h["B", 4].leader_changed == 0 and h["C", 2].lead_ratio == got["B", 2].ratio


def test_corridor_takes_other_lines_in_front(spark):
    a = three_trips(spark).where("trip_id = 'A'")
    b = a.withColumns({"trip_id": F.lit("B"), "line": F.lit("738"), "t": F.col("t") + 20 * S, "sched_us": F.col("sched_us") + 300 * S}).withColumn("delay", F.lit(0.0))
    got = {(r.trip_id, r.seq): r for r in passages.headways(a.unionByName(b), "corridor").collect()}
    assert got["B", 2].hw == 20 and got["B", 2].bunched and got["B", 2].same_line is False
    assert all(r.leader_trip is None for r in passages.headways(a.unionByName(b)).collect())


def test_medians_of_both_kinds(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (20.0,)], "v double")
    assert d.agg(passages.upper_median(F.col("v"))).first()[0] == 10.0


def test_candidates_and_episode_split(spark):
    def report(trip, stop, first, planned):
        return (DAY, "v" + trip, trip, "755", "0", stop, BASE + first * S, BASE + planned * S, 1)

    rows = []
    for stop, at in (("S1", 0), ("S2", 1200), ("S3", 2401)):
        rows += [report("A", stop, at, at), report("B", stop, at + 120, at + 1800)]
    d = spark.createDataFrame(rows, "day date, vehicle_id string, trip_id string, line string, direction_id string, stop_id string, first_us long, planned_us long, visit_seq int")
    c = detect.candidates(d)
    assert [(r.observed_gap, r.planned_gap) for r in c.orderBy("t2").collect()] == [(120, 1800)] * 3
    e = detect.episodes(c).orderBy("starts").collect()
    assert [(r.stops, r["class"]) for r in e] == [(2, "multi_stop"), (1, "single_point")]  # 1200 s joins, 1201 s parts


def test_heatmap_null_is_not_zero(spark):
    ev = spark.createDataFrame([("s", "e1", DAY, us(2026, 9, 1, 15), us(2026, 9, 1, 15)), ("s", "e2", DAY, us(2026, 9, 1, 16), us(2026, 9, 1, 16))], "section string, episode string, day date, t1 long, t2 long")
    days = spark.createDataFrame([(DAY,), (DAY + dt.timedelta(1),)], "day date")
    rows = detect.heatmap(ev, days).collect()
    assert len(rows) == 48 and {r.minute: r.episodes for r in rows if r.episodes} == {960: 1, 1020: 1}
    assert all(r.episodes is None and r.per_day is None for r in detect.heatmap(ev, days.where("false")).collect())


def test_geohash_and_lines(spark):
    d = spark.createDataFrame([(38.7223, -9.1393)], "lat double, lon double")
    g = d.select(geo.geohash(F.col("lat"), F.col("lon"), 6)).first()[0]
    south, north, west, east = geo.geohash_bounds(g)
    assert south <= 38.7223 <= north and west <= -9.1393 <= east and len(g) == 6
    w = spark.createDataFrame([("LINESTRING(-9.1 38.7, -9.2 38.8)",), ("POINT(1 2)",), ("LINESTRING EMPTY",), ("LINESTRING(1 2 3, 4 5 6)",), ("LINESTRING(nan 1, 2 3)",), ("LINESTRING(200 1, 2 3)",), (None,)], "w string")
    assert [r[0] for r in w.select(F.coalesce(F.size(geo.line_points(F.col("w"))), F.lit(-1))).collect()] == [2, -1, -1, -1, -1, -1, -1]


def test_intensity_bands(spark):
    d = spark.createDataFrame([("80% - 61%",), ("40% - 21%",), ("Via bloqueada",), ("?",), ("80% - 1%",)], "i string")
    assert [r[0] for r in d.select(traffic.speed_ratio(F.col("i"))).collect()] == [70.5, 30.5, 0.0, None, None]


def test_jam_match_wants_near_and_aligned(spark):
    def lines(rows):
        return spark.createDataFrame(rows, "geometry_wkt string, seg int, x1 double, y1 double, x2 double, y2 double")

    road = spark.createDataFrame([("r", 0, 0, 0.0, 0.0, 25.0, 0.0, 25.0)], "road string, seg int, piece int, x1 double, y1 double, x2 double, y2 double, metres double")
    jam = lines([("along", 0, -50.0, 5.0, 90.0, 5.0), ("against", 0, 90.0, 5.0, -50.0, 5.0), ("crossing", 0, 10.0, -50.0, 10.0, 50.0), ("parallel", 0, -50.0, 111.0, 90.0, 111.0)])
    assert {r.geometry_wkt for r in traffic.matches(road, jam).collect()} == {"along", "against"}


def test_days_count_alike(spark):
    jams = spark.createDataFrame([("g", "20% - 1%", DAY, 100, 10.0, 100), ("g", "80% - 61%", DAY + dt.timedelta(1), 1, 30.0, 1)], "geometry_wkt string, intensity string, day date, reports long, speed_kmh double, speed_reports long")
    m = spark.createDataFrame([("r", "g")], "road string, geometry_wkt string")
    r = traffic.section_speed(m, jams, ["road"]).first()
    assert (r.ratio, r.speed, r.reports, r.days) == (40.5, 20.0, 101, 2)


def test_stop_paths_go_forward(spark):
    stops = spark.createDataFrame([("t", "s", 1, 0.0, 0.0), ("t", "s", 2, 100.0, 0.0), ("t", "s", 3, 0.0, 0.0)], "trip_id string, shape_id string, stop_sequence int, x double, y double")
    shape = spark.createDataFrame([("s", [(0.0, 0.0), (500.0, 0.0), (500.0, 100.0), (0.0, 100.0), (0.0, 0.0)])], "shape_id string, points array<struct<x:double,y:double>>")
    got = [r.along for r in traffic.stop_paths(stops, shape).orderBy("stop_sequence").collect()]
    assert got[0] < got[1] < got[2] and got[2] - got[1] > 900  # the repeated stop lies at the loop's end


def ping_rows(spark, rows):
    return spark.createDataFrame([(i, "A", *r) for i, r in enumerate(rows)], "event_id int, agency_id string, vehicle_id string, line string, direction_id string, trip_id string, stop_id string, day date, created_us long, lat double, lon double")


def test_vehicle_day(spark):
    p = ping_rows(spark, [("1", "755", "0", "T1", "S1", DAY, BASE, 38.7, -9.1), ("1", "755", "0", "T1", "S1", DAY, BASE + 30 * S, 38.7, -9.1), ("1", "28E", "0", "T2", "S2", DAY, BASE + 300 * S, 38.7, -9.1)])
    assert [(r.line, r.pings) for r in vehicles.line_periods(p).orderBy("period").collect()] == [("755", 2), ("28E", 1)]
    assert [(r.gap_s, r.trip_changed) for r in vehicles.report_gaps(p).collect()] == [(270, True)]
    assert vehicles.encounters(p).count() == 2


def test_snapshot_never_looks_ahead(spark):
    p = ping_rows(spark, [("1", "7", "0", "T", "S", DAY, BASE, 38.7, -9.1), ("1", "7", "0", "T", "S", DAY, BASE + 50 * S, 38.7, -9.1)])
    at = lambda s: [(r.age_s, r.stale) for r in vehicles.snapshot(p, BASE + s * S).collect()]
    assert at(49) == [(49.0, False)] and at(115) == [(65.0, True)] and at(171) == []


def test_near_pairs(spark):
    at = spark.createDataFrame([(0, "A", "7", "0", "1", 38.7, -9.1), (0, "A", "7", "0", "2", 38.7015, -9.1), (0, "A", "7", "0", "3", 38.75, -9.1), (0, "A", "8", "0", "4", 38.7, -9.1)], "tick long, agency_id string, line string, direction_id string, vehicle_id string, lat double, lon double")
    assert [(r.v1, r.v2) for r in vehicles.near_pairs(at, 300).collect()] == [("1", "2")]


def test_hour_ranges(spark):
    d = spark.createDataFrame([("a", h) for h in (16, 17, 18, 20, 20)], "k string, hour int")
    assert findings.hour_ranges(d, ["k"]).first().hours == "16:00-19:00,20:00-21:00"


def test_scenarios_and_choice(spark):
    rows = [("L", "H", "k", d, s, 10.0 + d, 0, 2) for d in range(2) for s in range(3)] + [("L", "T", "k", d, s, 14.0, 1, 0) for d in range(2) for s in range(3)] + [("L", "N", "k", d, 0, 30.0 * d - 1, 0, 0) for d in range(2)]
    d = spark.createDataFrame(rows, "line string, scenario string, k string, day int, seed int, saved double, vehicles int, hold int")
    s = kpis.scenarios(d)
    assert {r.scenario: r.robust for r in s.collect()} == {"H": True, "T": True, "N": False}
    assert kpis.recommended(s).first().scenario == "H" and kpis.best_change(s).first().scenario == "T"


def test_interpolation_fills_between_seen_stops(spark):
    p = three_trips(spark).where("trip_id = 'A' and seq in (2, 5)")
    v = three_trips(spark).where("trip_id = 'A'").select("trip_id", F.col("seq").alias("stop_sequence"))
    got = kpis.interpolated(p, v).orderBy("seq").collect()
    assert [r.seq for r in got] == [2, 3, 4, 5] and [r.seen for r in got] == [True, False, False, True]
    assert got[1].t - got[0].t == got[2].t - got[1].t == got[3].t - got[2].t


def test_empty_inputs(spark):
    none = three_trips(spark).where("false")
    assert passages.labelled(passages.headways(none)).count() == 0
    assert kpis.headway_kpis(passages.headways(none)).count() == 0


def test_local_windows():
    import pytest

    from fleetspan.operators import observe

    a, b = observe.window_us("2026-09-01", "23:00", "01:00")
    assert b - a == 7200 * S and a == us(2026, 9, 1, 22)
    for bad in (("x", "07:00", "08:00"), ("2026-09-01", "07:00", "12:00"), ("2026-09-01", "07:00", "07:00"), ("2026-09-01", "25:00", "26:00"), ("2026-10-25", "01:30", "02:30"), ("2026-03-29", "01:30", "02:30")):
        with pytest.raises(ValueError):
            observe.window_us(*bad)


def test_extract_counts_and_keeps_the_earliest_receipt(spark):
    from fleetspan.operators import observe

    start, end = 1_000_000, 2_000_000  # ms
    base = ("A", "1", start + 5, start + 9, "38.7", "-9.1", "t", "s")
    change = lambda **k: tuple({**dict(zip(COLUMNS, base, strict=True)), **k}.values())
    COLUMNS = ("agency_id", "vehicle_id", "created_at", "received_at", "latitude", "longitude", "trip_id", "stop_id")
    rows = [base, change(received_at=start + 7), change(latitude="nan"), change(agency_id="B"), change(created_at=start - 120_001), change(created_at=start - 120_000), change(created_at=start + 1000), change(created_at=end + 1)]
    raw = spark.createDataFrame([tuple(map(str, r)) for r in rows], ", ".join(f"{c} string" for c in COLUMNS))
    found, counts = observe.extract(raw, ["A"], (start * 1000, end * 1000))
    assert counts.first().asDict() == {"rows_read": 8, "skipped_operator": 1, "skipped_invalid": 1, "skipped_outside": 2, "duplicates": 1, "observations": 3, "in_window": 2}
    assert {r.created_at: r.received_at for r in found.collect()}[start + 5] == start + 7


def test_files_are_checked_inventoried_and_published(spark, tmp_path):
    import pytest

    from fleetspan.sources import files

    root = tmp_path / "tree" / "day"
    root.mkdir(parents=True)
    head = ",".join(ingest.PING_COLUMNS)
    (root / "a.csv").write_text("\ufeff" + head + "\n1,A,1,d,38.7,-9.1,20240101,2,s,t,v,eyckp\n", encoding="utf-8")
    (root / "b.csv").write_text(head + "\n2,A,1,d,38.7,-9.1,20240101,2,s,t,v,eyckp\n3,A,1,d,38.7,-9.1,20240101,2,s,t,v,eyckp\n")
    top = f"file:{tmp_path}/tree"
    assert sorted(r["_id"] for r in files.ping_files(spark, top).collect()) == ["1", "2", "3"]
    found = files.inventory(spark, top)
    one = files.fingerprint(found).first()
    assert one.files == 2 and {r.path for r in found.collect()} == {"day/a.csv", "day/b.csv"}
    known = spark.createDataFrame([r for r in found.collect() if r.path == "day/a.csv"], found.schema)
    assert [r.path for r in files.unread(found, known).collect()] == ["day/b.csv"]
    with pytest.raises(ValueError, match="has changed"):
        files.unread(found, known.withColumn("sha256", F.lit("other")))
    out = f"file:{tmp_path}/out"
    assert files.published(spark, spark.range(3), out, "v1").count() == 3
    with pytest.raises(ValueError, match="No rows"):
        files.published(spark, spark.range(0), out, "v2")
    assert files.active(spark, out).count() == 3
    assert files.progress(spark.createDataFrame([("day/a.csv", 1)], "path string, inserted long"), found).first().asDict() == {"files_done": 1, "observations": 1, "files": 2}
    (root / "c.csv").write_text("_id,agency_id\n1,2\n")
    with pytest.raises(Exception, match="lacks"):
        files.ping_files(spark, top).collect()
    (root / "c.csv").write_text(head + ",_id\n")
    with pytest.raises(Exception, match="twice"):
        files.ping_files(spark, top).collect()


def test_follower_is_strictly_before(spark):
    from fleetspan.operators import observe

    rows = [(DAY, "A", "1", 100 * S, None, None, 0.9, 1.0), (DAY, "B", "2", 100 * S, "A", "1", 0.5, 30.0), (DAY, "A", "1", 200 * S, None, None, 0.8, 1.0), (DAY, "A", "1", 2000 * S, None, None, 0.7, 1.0)]
    p = spark.createDataFrame(rows, "day date, trip_id string, vehicle_id string, t long, leader_trip string, leader_vehicle string, ratio double, hw double")
    got = {(r.trip_id, r.t // S): (r.f_ratio, r.f_hw) for r in observe.follower_before(p).collect()}
    assert got == {("A", 100): (None, None), ("B", 100): (None, None), ("A", 200): (0.5, 30.0), ("A", 2000): (None, None)}


def test_near_pairs_at_high_latitude(spark):
    at = spark.createDataFrame([(1, "A", "L", "0", "v1", 75.0, 179.9999), (1, "A", "L", "0", "v2", 75.0, -179.9999), (1, "A", "L", "0", "v3", 75.1, 179.9999)], "tick int, agency_id string, line string, direction_id string, vehicle_id string, lat double, lon double")
    assert [(r.v1, r.v2) for r in vehicles.near_pairs(at, 50).collect()] == [("v1", "v2")]


def test_near_pairs_equal_all_pairs(spark):
    import random

    r = random.Random(5)
    places = [(r.choice((0.0, 38.7, 60.0, 84.0, 89.99, -89.999)) + r.uniform(-0.005, 0.005), r.choice((0.0, 179.999, -179.999, -9.1)) + r.uniform(-0.004, 0.004)) for _ in range(300)]
    rows = [(1, "A", "L", "0", f"v{i:03d}", max(-90.0, min(90.0, lat)), (lon + 180) % 360 - 180) for i, (lat, lon) in enumerate(places)]
    at = spark.createDataFrame(rows, "tick int, agency_id string, line string, direction_id string, vehicle_id string, lat double, lon double")
    every = at.alias("a").join(at.alias("b"), F.col("a.vehicle_id") < F.col("b.vehicle_id")).withColumn("m", vehicles.haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))).where("m <= 150")
    want = {(x[0], x[1]) for x in every.select("a.vehicle_id", "b.vehicle_id").collect()}
    got = [(x.v1, x.v2) for x in vehicles.near_pairs(at, 150).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_percentiles_by_ranges(spark):
    from fleetspan.functions.stats import percentiles

    d = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 1000).cast("double").alias("v"))
    want = {r.k: (r.a, r.b) for r in d.groupBy("k").agg(F.percentile("v", 0.5).alias("a"), F.percentile("v", 0.93).alias("b")).collect()}
    assert {r.k: (r.a, r.b) for r in percentiles(d, ["k"], "v", {"a": 0.5, "b": 0.93}).collect()} == want


def test_flat_trips_take_their_routes_run_time(spark):
    rows = [(t, "742", "0", f"S{i}", i, f"08:{m:02d}:00") for t, at in (("A", (0, 4, 10)), ("B", (0, 6, 12)), ("C", (30, 30, 30))) for i, m in enumerate(at, 1)]
    rows += [("D", "742", "0", "S9", 1, "09:00:00")]  # one visit: flat, and no other trip stops there
    v = spark.createDataFrame(rows, "trip_id string, line string, direction_id string, stop_id string, stop_sequence int, clock string")
    v = v.withColumns({"day": F.lit(DAY), "sched_us": F.lit(BASE) + clock.clock_seconds(F.col("clock")).cast("long") * S})
    got = {(r.trip_id, r.stop_id): r.sched_us for r in catalogue.replanned(v, ["line", "direction_id", "day"]).collect()}
    minutes = {k: None if t is None else (t - BASE) / S / 60 - 480 for k, t in got.items()}
    assert [minutes["C", f"S{i}"] for i in (1, 2, 3)] == [30, 35, 41]  # medians of 4 and 6, of 10 and 12
    assert minutes["D", "S9"] is None and minutes["B", "S2"] == 6 and len(got) == 10
    pings = spark.createDataFrame([("x", DAY, "D", "v", "S9", BASE)], "agency_id string, day date, trip_id string, vehicle_id string, stop_id string, created_us long")
    assert passages.stop_passages(pings, catalogue.replanned(v, ["line", "direction_id", "day"])).first().delay is None


def test_only_kept_lines_are_in_front(spark):
    p = three_trips(spark)
    p = p.withColumn("line", F.when(F.col("trip_id") == "B", "738").otherwise(F.col("line")))
    one = diagram.kept_headways(p, spark.createDataFrame([("742", "0")], "line string, direction_id string"), "corridor")
    front = {r.trip_id: r.leader_trip for r in one.where("seq = 1").collect()}
    assert front == {"A": None, "C": "A"}
    both = diagram.kept_headways(p, spark.createDataFrame([("742", "0"), ("738", "0")], "line string, direction_id string"), "corridor")
    assert {r.trip_id: r.leader_trip for r in both.where("seq = 1").collect()} == {"A": None, "B": "A", "C": "B"}
    shown = F.col("t") >= BASE + 1500 * S
    route = spark.createDataFrame([("S1", 0), ("S8", 1)], "stop_id string, y int")
    got = {(r.trip_id, r.stop_id, r.y) for r in diagram.points(both, shown, route).collect()}
    assert got == {("C", "S1", 0), ("C", "S8", 1)}  # C starts before the window, and is drawn in whole
    assert [tuple(r) for r in diagram.summary(both, shown, ["line"]).collect()] == [("742", 1, 5, 0, 0)]  # at 1560, 1680, ... 2040 s


def test_windows_of_the_day(spark):
    rows = [("a", us(2026, 9, 1, 7)), ("b", us(2026, 9, 1, 9)), ("c", us(2026, 9, 1, 9, 0, 1)), ("d", us(2026, 9, 2, 0, 30))]
    d = spark.createDataFrame(rows, "k string, t long").withColumn("day", F.lit(DAY))
    assert [r.k for r in d.where(diagram.within("08:00", "10:00")).orderBy("k").collect()] == ["a", "b"]  # Lisbon is an hour ahead
    assert [r.k for r in d.where(diagram.within("22:00", "02:00")).collect()] == ["d"]


def test_pooled_rates_and_order_of_classes(spark):
    b = spark.createDataFrame([(0.25, 4, 1), (0.5, 2, 2), (0.75, 0, 0), (0.9, 8, 2)], "low double, trips long, bunch_later long")
    assert {r.low: r.nth for r in kpis.bucket_order(b).collect()} == {0.5: 0, 0.25: 1, 0.9: 2, 0.75: 3}
    p = passages.headways(three_trips(spark)).withColumn("line", F.when(F.col("seq") > 6, "1").otherwise("2"))
    p = p.withColumn("hw", F.when(F.col("seq") > 6, 0.0).otherwise(F.col("hw")))
    assert [(r.lines, r.gaps, r.bunched_pct) for r in kpis.pooled(p, []).collect()] == [(2, 16, 25.0)]
