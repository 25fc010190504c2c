"""The CSV source and the life of an import, with the reference's fixtures, faults between batches and odd files."""

from __future__ import annotations

import csv
import io
import random
import threading

import pytest
from pyspark.sql import functions as F

from fleetspan.operators import catalogue, ingest
from fleetspan.sources import files, imports

HEAD = ingest.PING_COLUMNS


def line(**changes):
    row = dict(_id="1", agency_id="A", created_at="1788242400000", driver_id="private", latitude="38.7", longitude="-9.1", operational_date="20260901", received_at="1788242401000", stop_id="0002", trip_id="0007", vehicle_id="001", geohash_5="eycs2") | changes
    return [row[c] for c in HEAD]


def put(path, rows, head=HEAD, bom=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows([head, *rows])
    path.write_text(bom + text.getvalue(), encoding="utf-8")


def test_files_of_another_column_order_and_ragged_rows(spark, tmp_path):
    put(tmp_path / "t" / "a.csv", [line(_id="1"), line(_id="2") + ["more"], line(_id="3")[:-1], [], line(_id="4", driver_id='d,"e"')], bom="﻿")
    put(tmp_path / "t" / "x" / "b.csv", [line(_id="5", vehicle_id="  ", latitude="x")[::-1]], HEAD[::-1])
    put(tmp_path / "t" / "c.csv", [line(_id="6") + ["y"], line(_id="7", geohash_5=" eycs2 ") + [""]], [*HEAD, "spare"])
    rows = ingest.reject_reason(files.ping_files(spark, f"file:{tmp_path}/t"))
    got = {r["_id"]: (r.reject_reason, r.agency_id, r.driver_id) for r in rows.collect()}
    private = "private"
    assert got == {"1": (None, "A", private), "2": ("column_count", "A", private), "3": ("column_count", "A", private), "4": (None, "A", 'd,"e"'), "5": ("identifier", "A", private), "6": (None, "A", private), "7": (None, "A", private)}


@pytest.mark.parametrize("changes,reason", [({"created_at": "946684799999"}, "timestamp_or_date"), ({"received_at": "4133980800000"}, "timestamp_or_date"), ({"operational_date": "20260230"}, "timestamp_or_date"), ({"latitude": "nan"}, "coordinates"), ({"longitude": "181"}, "coordinates"), ({"geohash_5": "bad"}, "geohash"), ({"created_at": "946684800000"}, None)])
def test_reject_reasons(spark, changes, reason):
    raw = spark.createDataFrame([tuple(line(**changes))], ", ".join(f"`{c}` string" for c in HEAD))
    assert ingest.reject_reason(raw).first().reject_reason == reason


def test_splits_read_every_row_once(spark, tmp_path):
    r = random.Random(1)
    rows = [[str(i), "é" * r.randrange(40)] + [","] * r.randrange(2) for i in range(60)]
    put(tmp_path / "t" / "a.csv", rows, ["k", "v"])
    put(tmp_path / "t" / "b.csv", [], ["v", "k"])
    want = sorted((row[0], row[1], len(row) == 2) for row in rows)
    for size in ("9", "100", "100000"):
        frame = spark.read.format("named_csv").option("path", f"{tmp_path}/t").option("columns", '["v", "k"]').option("splitBytes", size)
        files.named_csv.register(spark)
        got = frame.load().collect()
        assert sorted((x.k, x.v, x.fault is None) for x in got) == want and len({x.at for x in got}) == 60


PACKAGE = {
    "agency": "agency_id,agency_name\n43,Synthetic operator\n", "feed_info": "feed_start_date,feed_end_date,feed_version\n20251001,20251031,test\n", "routes": "route_id,route_long_name\n0001,Synthetic route\n",
    "trips": "trip_id,route_id,shape_id,direction_id,service_id\n0002,0001,s,0,weekday\n", "stops": 'stop_id,stop_name,stop_lat,stop_lon\n0003,"Two\nlines",38.7,-9.1\n', "shapes": "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\ns,38.8,-9.2,10\ns,38.7,-9.1,2\n",
    "stop_times": "trip_id,stop_id,stop_sequence,arrival_time,departure_time\n0002,0003,10,25:10:00,25:11:00\n0002,missing,2,24:10:00,24:11:00\n", "calendar_dates": "service_id,date,exception_type\nweekday,20251001,1\n",
}


def package(tmp_path, **changes):
    for name, text in (PACKAGE | changes).items():
        (tmp_path / "plans" / "one").mkdir(parents=True, exist_ok=True)
        (tmp_path / "plans" / "one" / f"{name}.txt").write_text(text)
    return f"file:{tmp_path}/plans/one"


def test_packages_come_in_whole(spark, tmp_path):
    records = catalogue.checked(files.package_records(spark, package(tmp_path), "p"))
    assert {(r.table_name, r.row_number) for r in records.collect()} == {(t, i) for t, text in PACKAGE.items() for i in range(1, 3 if t in ("shapes", "stop_times") else 2)}
    assert records.where("table_name = 'stops'").first().data["stop_name"] == "Two\nlines"
    assert [(r.stop_id, r.stop_sequence, r.arrival_time) for r in catalogue.visits_of(records).orderBy("stop_sequence").collect()] == [("missing", 2, "24:10:00"), ("0003", 10, "25:10:00")]


@pytest.mark.parametrize("table,text,fault", [
    ("stops", "stop_id,stop_name,stop_lat,stop_lon\n0003,Stop,999,-9.1\n", "coordinates"), ("trips", "trip_id,route_id,shape_id\n1,1,s,more\n", "column_count"), ("trips", "trip_id,route_id\n1,1\n", "lacks shape_id"),
    ("routes", "route_id,x\n ,1\n", "identifier"), ("stop_times", "trip_id,stop_id,stop_sequence,arrival_time,departure_time\n1,1,-1,a,b\n", "sequence"), ("trips", "trip_id,stop_id,route_id,shape_id\n1,1,,s\n", "identifier"),
])
def test_a_fault_refuses_the_package(spark, tmp_path, table, text, fault):
    root = package(tmp_path, **{table: text})
    with pytest.raises(ValueError, match=f"{table}, row 1: {fault}"):
        catalogue.checked(files.package_records(spark, root, "p"))


def test_packages_are_known_by_their_contents(spark, tmp_path):
    package(tmp_path)
    root = f"file:{tmp_path}/plans"
    first = imports.new_packages(files.inventory(spark, root, "*.txt"), spark.createDataFrame([], "source_name string, checksum string"))
    assert [r.source_name for r in first.collect()] == ["one"]
    known = spark.createDataFrame(first.collect(), first.schema)
    assert imports.new_packages(files.inventory(spark, root, "*.txt"), known).count() == 0
    package(tmp_path, routes="route_id\n2\n")
    assert imports.new_packages(files.inventory(spark, root, "*.txt"), known).count() == 1


def tree(tmp_path):
    put(tmp_path / "in" / "a.csv", [line(_id="0001", agency_id="IA9T6"), line(_id="0002", latitude="nan"), line(_id="0004", agency_id="IA9T6", created_at="1788242460000", geohash_5="eycs8")])
    put(tmp_path / "in" / "b" / "c.csv", [line(_id="0003", agency_id="IA9T6", received_at="1788242400500"), line(_id="0005", agency_id="LTP61", longitude="-0.0"), line(_id="0006", vehicle_id="002")])
    return f"file:{tmp_path}/in", f"file:{tmp_path}/out"


def test_import_replay_resume_and_failure(spark, tmp_path, monkeypatch):
    root, out = tree(tmp_path)
    store = imports.Store(spark, out)
    first = imports.import_tree(spark, root, out, batch_bytes=1)
    assert first == imports.Imported(1, False, 2) and store.active() == 1
    rows = {r.event_id: r for r in store.observations().collect()}
    assert set(rows) == {"0003", "0004", "0005", "0006"} and rows["0003"].received_us == 1788242400500000 and rows["0003"].vehicle_id == "001"
    assert store.provenance().count() == 5 and str(rows["0005"].lon) == "0.0"
    assert sorted((r.path, r.rows_read, r.valid_rows, r.rejected) for r in store.manifest(1).collect()) == [("a.csv", 3, 2, {"coordinates": 1}), ("b/c.csv", 3, 3, {})]
    assert imports.import_tree(spark, root, out).unchanged

    commit, calls = imports.commit, []

    def fails_second(*a):
        calls.append(a)
        if len(calls) == 2:
            raise RuntimeError("killed between batches")
        commit(*a)

    monkeypatch.setattr(imports, "commit", fails_second)
    with pytest.raises(RuntimeError):
        imports.import_tree(spark, root, out, rebuild=True, batch_bytes=1)
    assert store.active() == 1 and store.manifest(2).count() == 1
    assert imports.progress(store, root).first().asDict() == {"version": 2, "status": "loading", "files_done": 1, "files": 2, "valid_rows": 2, "observations": 2}
    monkeypatch.setattr(imports, "commit", commit)
    assert imports.import_tree(spark, root, out, batch_bytes=1) == imports.Imported(2, False, 1)  # goes on after the first file
    assert store.active() == 2 and {tuple(r) for r in store.observations().collect()} == {tuple(r) for r in store.observations(1).collect()}

    put(tmp_path / "in" / "extra.csv", [line(_id="0009", vehicle_id="003")])
    with pytest.raises(ValueError, match="rebuild"):
        imports.import_tree(spark, root, out)
    assert imports.import_tree(spark, root, out, rebuild=True) == imports.Imported(3, False, 3)
    assert store.observations().count() == 5 and store.observations(2).count() == 4


def test_a_batch_that_was_half_written_is_written_over(spark, tmp_path, monkeypatch):
    root, out = tree(tmp_path)
    real = files.listed
    monkeypatch.setattr(files, "listed", lambda *a: (_ for _ in ()).throw(RuntimeError("killed before the manifest")))
    with pytest.raises(RuntimeError):
        imports.import_tree(spark, root, out)
    monkeypatch.setattr(files, "listed", real)
    assert imports.import_tree(spark, root, out) == imports.Imported(1, False, 2)
    assert imports.Store(spark, out).observations().count() == 4


def test_batches_are_read_at_once(spark, tmp_path, monkeypatch):
    """Each of two batches waits for the other to begin."""
    root, out = tree(tmp_path)
    commit, both = imports.commit, threading.Barrier(2, timeout=60)

    def meets(*a):
        both.wait()
        commit(*a)

    monkeypatch.setattr(imports, "commit", meets)
    assert imports.import_tree(spark, root, out, batch_bytes=1) == imports.Imported(1, False, 2)
    assert imports.Store(spark, out).manifest(1).count() == 2 and imports.Store(spark, out).observations().count() == 4


def test_a_file_of_some_megabytes_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n" + "0123456789,0123456789\n" * 1_000_000)
    rows = files.csv_rows(spark, f"file:{tmp_path}", ["a", "b"])
    assert rows.rdd.getNumPartitions() > 2 and rows.where("fault is null").count() == 1_000_000


def test_paths_below_roots_of_an_empty_authority_and_with_signs(spark, tmp_path):
    put(tmp_path / "in+(1)" / "b" / "c.csv", [line(_id="0003")])
    for root in (f"file://{tmp_path}/in+(1)", f"file:{tmp_path}/in+(1)", f"{tmp_path}/in+(1)/"):
        assert [r.path for r in files.listed(spark, root).collect()] == ["b/c.csv"]
        assert [r.path for r in files.inventory(spark, root).collect()] == ["b/c.csv"]


def test_without_observations_the_active_version_stays(spark, tmp_path):
    root, out = tree(tmp_path)
    imports.import_tree(spark, root, out)
    put(tmp_path / "in" / "a.csv", [line(latitude="x")])
    put(tmp_path / "in" / "b" / "c.csv", [])
    with pytest.raises(ValueError, match="No valid observations"):
        imports.import_tree(spark, root, out, rebuild=True)
    assert imports.Store(spark, out).active() == 1
    with pytest.raises(ValueError, match="No CSV files"):
        imports.import_tree(spark, root, out, glob="*.none")


def test_a_file_that_changes_during_import_is_refused(spark, tmp_path, monkeypatch):
    root, out = tree(tmp_path)
    real = files.ping_files

    def touched(*a):
        put(tmp_path / "in" / "a.csv", [line(_id="0001"), line(_id="0010")])
        return real(*a)

    monkeypatch.setattr(files, "ping_files", touched)
    with pytest.raises(ValueError, match="changed during import"):
        imports.import_tree(spark, root, out)
    assert imports.Store(spark, out).active() is None


def test_observation_keys(spark):
    def keys(**changes):
        raw = spark.createDataFrame([tuple([*line(**changes), "f"])], ", ".join(f"`{c}` string" for c in [*HEAD, "source_file"]))
        return imports.typed(raw).first().observation_key

    base = keys()
    assert keys(_id="other", received_at="1788242402000", driver_id="other", geohash_5="eycs8") == base
    assert keys(longitude="-0.0") == keys(longitude="0") != base and keys(agency_id="B") != base != keys(trip_id="")
    assert keys(latitude="38.70") == base


def test_sources_without_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert files.ping_files(spark, f"{tmp_path}/none").where(F.col("_id").isNotNull()).count() == 0


def test_places_are_whole_units_rounded_once(spark):
    from fleetspan.sources import adapter

    rows = [(d * 97 + i, 150 * d + i % 5, i % 6) for d in range(0, 600, 7) for i in range(6)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, k int").selectExpr("event_id", "user_id", "'x' AS event_type", "timestamp '2024-01-01' AS ts", "0.5D AS value", "concat('{\"k\": ', k, '}') AS props")
    got = {r.event_id: (r.lat, r.lon) for r in adapter.pings_of(e).collect()}
    assert got == {n: ((3_870_000 + k % 6 * 400 + n % 97) / 100_000, (-920_000 + u % 5 * 300 + u // 150 % 500 * 2000 + n % 89) / 100_000) for n, u, k in rows}
