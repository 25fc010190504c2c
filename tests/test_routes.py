"""Linear referencing on small shapes: bends, loops, repeated pairs of stops, missing places and many bins."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from fleetspan.operators import routes, traffic

KM = 1 / 111.32  # a kilometre in degrees of latitude
#: Midnight of a day on which local time is UTC.
WINTER = 1_704_067_200_000_000
PLACE = "trip_id string, shape_id string, stop_sequence int, stop_id string, x double, y double"


def lines(spark, shapes):
    rows = [(i, [{"lon": lon, "lat": lat} for lon, lat in points]) for i, points in shapes.items()]
    return spark.createDataFrame(rows, "shape_id string, points array<struct<lon:double,lat:double>>")


def at(lon, lat):
    import math

    return lon * 111_320.0 * math.cos(math.radians(38.72)), lat * 111_320.0


def placed(spark, shapes, stops):
    s = spark.createDataFrame([(t, sh, n, i, *at(*p)) for t, sh, n, i, p in stops], PLACE)
    xy = spark.createDataFrame([(i, [dict(zip("xy", at(*p), strict=True)) for p in points]) for i, points in shapes.items()], "shape_id string, points array<struct<x:double,y:double>>")
    return routes.stop_sections(s, traffic.stop_paths(s, xy)), routes.shape_pieces(lines(spark, shapes))


def test_a_bent_road_and_a_closed_loop(spark):
    bent = [(-9.15, 38.7), (-9.15, 38.7 + 0.5 * KM), (-9.15 + 0.6 * KM, 38.7 + 0.5 * KM)]
    loop = [(-9.15, 38.7), (-9.15, 38.7 + 0.3 * KM), (-9.145, 38.7 + 0.3 * KM), (-9.145, 38.7), (-9.15, 38.7)]
    stops = [("t", "bent", 1, "a", bent[0]), ("t", "bent", 2, "b", bent[2])] + [("u", "loop", i + 1, s, loop[k]) for i, (s, k) in enumerate([("a", 0), ("b", 1), ("a", 4)])]
    sections, pieces = placed(spark, {"bent": bent, "loop": loop}, stops)
    got = {r.road: r.hi - r.lo for r in sections.collect()}
    assert 900 < got["t|1"] < 1100 and abs(got["u|1"] - 300) < 1 and got["u|2"] > 900
    sums = {r.road: r["m"] for r in routes.section_pieces(sections, pieces).groupBy("road").agg(F.sum("metres").alias("m")).collect()}
    assert all(abs(sums[k] - v) < 1e-6 for k, v in got.items())


def test_stops_without_a_place(spark):
    road = [(-9.15, 38.7), (-9.15, 38.7 + KM)]
    stops = [("t", "r", 1, "a", road[0]), ("t", "r", 2, "b", (-9.1, 38.7)), ("t", "r", 3, "c", road[1]), ("u", "none", 1, "a", road[0]), ("u", "none", 2, "b", road[1])]
    sections, pieces = placed(spark, {"r": road}, stops)
    assert [(r.from_stop, r.lo, r.hi) for r in sections.orderBy("road").collect()] == [("a", None, None), ("b", None, None), ("a", None, None)]
    jams = spark.createDataFrame([], "geometry_wkt string, intensity string, day date, minute int, reports long, speed_kmh double, speed_reports long")
    assert {(r.available, r.minute, r.metres) for r in routes.section_traffic(sections, pieces, jams).collect()} == {(False, None, 0.0)}


def test_intervals_meet_once_in_any_bin(spark):
    r = random.Random(3)
    pieces, start = [], 0.0
    for i in range(120):
        m = r.choice([0.5, 25.0, 499.0, 1700.0])
        pieces.append(("s", i, 0, start, 0.0, start + m, 0.0, m, start, start + m))
        start += m
    sections = []
    for i in range(60):
        lo, hi = sorted(r.uniform(0, start) for _ in range(2))
        sections.append((f"r{i}", "s", lo, hi))
    p = spark.createDataFrame(pieces, "shape_id string, seg int, piece int, x1 double, y1 double, x2 double, y2 double, metres double, start double, end double")
    s = spark.createDataFrame(sections, "road string, shape_id string, lo double, hi double")
    got = {(x.road, x.seg): (round(x.x1, 6), round(x.x2, 6)) for x in routes.section_pieces(s, p).collect()}
    want = {(road, q[1]): (round(max(lo, q[8]), 6), round(min(hi, q[9]), 6)) for road, _, lo, hi in sections for q in pieces if min(hi, q[9]) > max(lo, q[8])}
    assert got == want


SECTION = "trip_id string, line string, direction_id string, road string, from_stop string, to_stop string, from_sequence int, to_sequence int, ambiguous boolean"
PROOF = "line string, direction_id string, from_stop string, to_stop string, episode int, day string, t1 long, t2 long"


def test_heatmap_counts_and_unknowns(spark):
    s = spark.createDataFrame([("t", "L", "0", "t|1", "a", "b", 1, 2, False), ("t", "L", "0", "t|2", "b", "a", 2, 3, True), ("t", "L", "0", "t|3", "b", "a", 4, 5, True)], SECTION)
    eight, ten = WINTER + 28_800_000_000, WINTER + 36_000_000_000
    e = spark.createDataFrame([("L", "0", "a", "b", 1, "d1", eight - 1, eight + 1), ("L", "0", "a", "b", 1, "d1", ten, ten), ("L", "0", "a", "b", 2, "d2", ten, ten), ("L", "0", "b", "a", 3, "d2", ten, ten), ("L", "1", "a", "b", 4, "d2", ten, ten), ("L", "0", None, "a", 5, "d2", ten, ten)], PROOF)
    got = {r.road: (r.status, r.episodes, r.days, r.per_day) for r in routes.section_heatmap(s, e, 2).collect()}
    assert got == {"t|1": ("available", 2, 2, 1.0), "t|2": ("ambiguous_stop_pair", None, None, None), "t|3": ("ambiguous_stop_pair", None, None, None)}
    cells = routes.section_heatmap(s, e, 2, cells=True)
    assert {r.minute: r.episodes for r in cells.where("road = 't|1' and episodes > 0").collect()} == {480: 1, 600: 2} and cells.where("road = 't|1'").count() == 48
    assert {(r.status, r.episodes) for r in routes.section_heatmap(s, e, 0).where("road = 't|1'").collect()} == {("not_analyzed", None)}
    assert routes.located(s, e).first().asDict() == {"episodes": 5, "mapped_episodes": 2, "unlocated": 1}


def test_plot_leaves_out_pairs_of_several_sections(spark):
    base = "trip_id string, road string, from_stop string, to_stop string, from_sequence int, to_sequence int, minute int, ratio double, days long, coverage double"
    cells = spark.createDataFrame([("t", "t|1", "a", "b", 1, 2, 480, 30.0, 2, 0.5), ("t", "t|2", "b", "a", 2, 3, 480, 50.0, 1, 1.0), ("t", "t|3", "a", "b", 3, 4, 480, 20.0, 1, 1.0)], base)
    shown = spark.createDataFrame([("t", 0, "a", "b", None, None), ("t", 1, "b", "a", None, None), ("t", 2, "a", "b", 3, 4)], "trip_id string, place int, from_stop string, to_stop string, from_sequence int, to_sequence int")
    h = 3_600_000_000
    begin = WINTER + 8 * h + 600_000_000
    got = {(r.place, r.start_us): (r.end_us, r.ratio, r.heavy, round(r.opacity, 4)) for r in routes.plot_cells(shown, cells, begin, WINTER + 9 * h).collect()}
    half = WINTER + 8 * h + 1_800_000_000
    assert got == {(1, begin): (half, 50.0, False, 0.0), (1, half): (WINTER + 9 * h, None, False, 0.0), (2, begin): (half, 20.0, True, 0.08), (2, half): (WINTER + 9 * h, None, False, 0.0)}


def test_chords_and_useless_reports(spark):
    road = [(-9.15, 38.7), (-9.15, 38.7 + 0.1 * KM)]
    wkt = f"LINESTRING(-9.15 38.7, -9.15 {38.7 + 0.1 * KM})"
    j = spark.createDataFrame([(wkt, "80% - 61%", 10, 20.0, 5), (wkt, "?", 3, None, 0), ("POINT(1 1)", "80% - 61%", 4, None, 0)], "geometry_wkt string, intensity string, reports long, speed_kmh double, speed_reports long").withColumn("day", F.lit("2026-09-01").cast("date"))
    speeds = routes.route_speeds(routes.shape_pieces(lines(spark, {"real": road, "stops-x": road})), j)
    got = {r.road: (round(r.metres, 3), round(r.matched_metres, 3)) for r in traffic.coverage(speeds).collect()}
    assert got == {"real": (100.0, 100.0), "stops-x": (100.0, 0.0)}
    assert routes.ignored_reports(j).first().asDict() == {"ignored": 7, "reports": 17}


def test_roads_share_the_evidence_of_equal_sets_of_geometries(spark):
    r = random.Random(5)
    jams = [(g, i, f"2026-09-{d:02}", m, r.randint(1, 9), None, 0) for g in "abc" for i in ("80% - 61%", "20% - 1%", "?") for d in range(1, 9) for m in (0, 30) if r.random() < 0.4]
    touched = [("", "a", "ab", "b", "c"), ("a", "ab", "b"), ("ab", "a", "b", "b"), ("c",), ("",)]
    pieces = [(f"r{n}", 0, i, round(r.uniform(1, 25), 2)) for n in range(40) for i in range(len(touched[n % 5]))]
    found = [(road, seg, i, g) for road, seg, i, _ in pieces for g in touched[int(road[1:]) % 5][i]]
    road = spark.createDataFrame(pieces, "road string, seg int, piece int, metres double")
    hits = spark.createDataFrame(found, "road string, seg int, piece int, geometry_wkt string")
    j = spark.createDataFrame(jams, "geometry_wkt string, intensity string, day string, minute int, reports long, speed_kmh double, speed_reports long")
    assert traffic.evidence_sets(hits)[1].select("set").distinct().count() == 4  # of 104 pieces that match any
    got = {(x.road, x.minute): (round(x.ratio, 6), x.days, x.reports, round(x.coverage, 6)) for x in traffic.time_cells(road, hits, j).collect()}
    want, worth = {}, {"80% - 61%": 70.5, "20% - 1%": 10.5}
    for name in {p[0] for p in pieces}:
        own = [p for p in pieces if p[0] == name]
        of = {p[2]: touched[int(name[1:]) % 5][p[2]] for p in own}
        for minute in (0, 30):
            days, seen = {}, set()
            for _, _, i, metres in own:
                for day in {x[2] for x in jams}:
                    mine = [(worth[x[1]], x[4]) for x in jams if x[0] in of[i] and x[1] in worth and (x[2], x[3]) == (day, minute)]
                    if mine:
                        days.setdefault(day, []).append((sum(v * n for v, n in mine) / sum(n for _, n in mine), metres))
                        seen.add(i)
            if days:
                ratio = sum(sum(v * m for v, m in d) / sum(m for _, m in d) for d in days.values()) / len(days)
                reports = sum(x[4] for x in jams if x[0] in set("".join(of.values())) and x[1] in worth and x[3] == minute)
                want[name, minute] = (round(ratio, 6), len(days), reports, round(sum(p[3] for p in own if p[2] in seen) / sum(p[3] for p in own), 6))
    assert got == want
