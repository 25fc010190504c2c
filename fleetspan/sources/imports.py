"""The life of an import: files are read in batches that are each committed when done, so an interrupted import goes on where it stopped; a version is published by one rename."""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetspan.operators import ingest
from fleetspan.sources import files

#: Bytes of files that are committed together.
BATCH_BYTES = 256 << 30
#: Batches that are read at once, so that small ones together occupy the cluster.
BATCHES_AT_ONCE = 6
LOG = "version int, step long, fingerprint string, status string"
MANIFEST = "path string, sha256 string, bytes long, batch string, rows_read long, valid_rows long, observations long, rejected map<string,long>"


@dataclass(frozen=True)
class Imported:
    version: int
    unchanged: bool
    files_read: int


class Store:
    """A folder of versions: log (what became of each), manifest and batches of a version, its observations, and a pointer to the active one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.writing = threading.Lock()  # of the manifest: appends to one folder come one after the other

    def fs(self, path: str):
        """(Hadoop's file context, a path in it): driver-side calls on single small files."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        target = hadoop.Path(path)
        return hadoop.FileContext.getFileContext(target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def exists(self, path: str) -> bool:
        context, target = self.fs(path)
        return context.util().exists(target)

    def table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(path) if self.exists(path) else self.spark.createDataFrame([], schema)

    def log(self, version: int, fingerprint: str, status: str) -> None:
        step = (self.table("log", LOG).agg(F.max("step")).first()[0] or 0) + 1
        self.spark.createDataFrame([(version, step, fingerprint, status)], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def last(self):
        """The last row of the log, or None."""
        return next(iter(self.table("log", LOG).orderBy(F.desc("step")).head(1)), None)

    def active(self) -> int | None:
        return json.loads(self.spark.read.text(f"{self.path}/active.json").first()[0])["version"] if self.exists(f"{self.path}/active.json") else None

    def activate(self, version: int) -> None:
        """The pointer is written aside and renamed over the old one, so readers see one or the other."""
        context, target = self.fs(f"{self.path}/active.json")
        draft = f"{self.path}/active-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(json.dumps({"version": version}),)], "value string").coalesce(1).write.text(draft)
        part = next(f for f in self.spark.read.text(draft).inputFiles())
        gateway, hadoop = self.spark.sparkContext._gateway, self.spark.sparkContext._jvm.org.apache.hadoop
        rename = getattr(hadoop.fs, "Options$Rename")
        how = gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context.rename(hadoop.fs.Path(part), target, how)
        context.delete(hadoop.fs.Path(draft), True)

    def manifest(self, version: int) -> DataFrame:
        return self.table(f"manifest/version={version}", MANIFEST)

    def observations(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/observations/version={self.active() if version is None else version}")

    def provenance(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/sources/version={self.active() if version is None else version}")


#: What an observation keeps, besides its key.
KEPT = ["event_id", "agency_id", "vehicle_id", "driver_id", "trip_id", "stop_id", "created_us", "received_us", "operational_date", "lat", "lon", "geohash_5"]


def typed(raw: DataFrame) -> DataFrame:
    """Valid raw pings (reject_reason null) as observations with their key."""
    us = lambda c: F.trim(c).cast("long") * 1000
    place = lambda c: F.col(c).cast("double") + F.lit(0.0)  # noqa: E731  -0 becomes 0
    rows = raw.withColumns({"event_id": F.col("_id"), "created_us": us("created_at"), "received_us": us("received_at"), "operational_date": F.to_date("operational_date", "yyyyMMdd"), "lat": place("latitude"), "lon": place("longitude"), "geohash_5": F.trim("geohash_5")})
    return rows.withColumn("observation_key", ingest.observation_key(rows)).select("observation_key", *KEPT, "source_file")


def survivors(rows: DataFrame) -> DataFrame:
    """One row a key: the first of (receipt, event) gives what isn't part of the key."""
    first = F.min_by(F.struct(*KEPT), F.struct("received_us", "event_id", "geohash_5"))
    return rows.groupBy("observation_key").agg(first.alias("o")).select("observation_key", "o.*")


def batches_of(found: DataFrame, most: int) -> DataFrame:
    """Files of an inventory with a batch each, of `most` bytes or of one file; a row a file."""
    before = F.sum("bytes").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("batch", F.floor(F.coalesce(before, F.lit(0)) / most))


def commit(store: Store, root: str, version: int, entries: list, glob: str) -> None:
    """Reads some files of a tree into a folder named by their contents and then lists them in the manifest. What an earlier attempt left there is written over."""
    spark = store.spark
    batch = hashlib.sha256(",".join(sorted(e.sha256 for e in entries)).encode()).hexdigest()[:32]
    raw = ingest.reject_reason(files.ping_files(spark, root, [e.path for e in entries], glob))
    out = f"{store.path}/rows/version={version}/batch={batch}"
    valid = typed(raw.where("reject_reason is null")).select("*", F.lit(None).cast("string").alias("reject_reason"))
    rejected = raw.where("reject_reason is not null").select("source_file", "reject_reason")
    rows = valid.unionByName(rejected, allowMissingColumns=True)
    rows.write.mode("overwrite").parquet(out)
    now = {e.path: (e.bytes, e.modified) for e in files.listed(spark, root, glob, [e.path for e in entries]).collect()}  # as many as entries
    changed = [e.path for e in entries if now.get(e.path) != (e.bytes, e.modified)]
    if changed:
        raise ValueError(f"{changed[0]} changed during import; rebuild.")
    counted = spark.read.schema(rows.schema).parquet(out).groupBy("source_file", "reject_reason").agg(F.count("*").alias("n"), F.count_distinct("observation_key").alias("keys"))
    found: dict[str, dict] = {e.path: {} for e in entries}
    for r in counted.collect():  # a row a file and reason
        found[r.source_file][r.reject_reason] = r.n, r["keys"]
    report = []
    for e in entries:
        reasons = found[e.path]
        valid_rows, keys = reasons.pop(None, (0, 0))
        wrong = {k: n for k, (n, _) in reasons.items()}
        report.append((e.path, e.sha256, e.bytes, batch, valid_rows + sum(wrong.values()), valid_rows, keys, wrong))
    with store.writing:
        spark.createDataFrame(report, MANIFEST).coalesce(1).write.mode("append").parquet(f"{store.path}/manifest/version={version}")


def publish(store: Store, version: int) -> None:
    """Observations of all committed batches, where each came from, and their availability; then the version is the active one. Without observations the old one stays."""
    spark = store.spark
    paths = [f"{store.path}/rows/version={version}/batch={r[0]}" for r in store.manifest(version).select("batch").distinct().collect()]
    rows = spark.read.parquet(*paths).where("observation_key is not null")
    survivors(rows).write.mode("overwrite").parquet(f"{store.path}/observations/version={version}")
    made = store.observations(version)
    if not made.head(1):
        raise ValueError("No valid observations; the active version stays.")
    ingest.provenance(rows, ["observation_key", "event_id"], "source_file").write.mode("overwrite").parquet(f"{store.path}/sources/version={version}")
    ingest.availability(made, F.col("geohash_5")).write.mode("overwrite").parquet(f"{store.path}/availability/version={version}")
    store.activate(version)


def import_tree(spark: SparkSession, root: str, out: str, rebuild: bool = False, batch_bytes: int = BATCH_BYTES, glob: str = "*.csv") -> Imported:
    """Imports a tree of ping files into a Store at `out`.

    An unchanged tree whose version is active is left alone; files of an unfinished version that its manifest lists are skipped; a changed tree is refused unless it is
    rebuilt as a new version, and the active one stays until that is complete. Invalid rows are counted by reason, not kept.
    """
    store = Store(spark, out)
    found = files.inventory(spark, root, glob).persist()
    try:
        if not found.head(1):
            raise ValueError("No CSV files found under the source root.")
        mark, last = files.fingerprint(found.select("path", "bytes", "sha256")).first().fingerprint, store.last()
        if last and last.fingerprint == mark and last.status == "ready" and not rebuild:
            return Imported(store.active(), True, 0)
        if last and last.fingerprint != mark and not rebuild:
            raise ValueError("The source inventory has changed; rebuild to make a new version.")
        resumed = last and last.fingerprint == mark and last.status == "loading" and not rebuild
        version = last.version if resumed else (last.version if last else 0) + 1
        if not resumed:
            store.log(version, mark, "loading")
        todo = batches_of(files.unread(found, store.manifest(version)), batch_bytes)
        batches: dict[int, list] = {}
        for e in todo.orderBy("batch", "path").collect():
            batches.setdefault(e.batch, []).append(e)
        with ThreadPoolExecutor(BATCHES_AT_ONCE) as pool:
            jobs = [pool.submit(commit, store, root, version, entries, glob) for entries in batches.values()]
            try:
                for job in jobs:
                    job.result()
            except BaseException:
                pool.shutdown(cancel_futures=True)  # those that are being read are still committed
                raise
        publish(store, version)
        store.log(version, mark, "ready")
        return Imported(version, False, sum(map(len, batches.values())))
    finally:
        found.unpersist()


def progress(store: Store, root: str, glob: str = "*.csv") -> DataFrame:
    """One row of the last version: its number and status, files done of all, valid rows and observations of its files so far."""
    last = store.last()
    done = store.manifest(last.version).agg(F.count("*").alias("files_done"), F.coalesce(F.sum("valid_rows"), F.lit(0)).alias("valid_rows"), F.coalesce(F.sum("observations"), F.lit(0)).alias("observations"))
    every = files.listed(store.spark, root, glob).agg(F.count("*").alias("files"))
    return done.crossJoin(every).select(F.lit(last.version).alias("version"), F.lit(last.status).alias("status"), "files_done", "files", "valid_rows", "observations")  # one row each


def package_fingerprint(inventory: DataFrame) -> Column:
    """A hash of the names and contents of a package's files, as an aggregate over its inventory."""
    return F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("path", "sha256")))).cast("binary"), 256)


def new_packages(inventory: DataFrame, known: DataFrame) -> DataFrame:
    """source_name and checksum of packages (folders that hold a feed_info.txt) whose contents are not among those known under that name."""
    entries = inventory.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("source_name"), F.regexp_extract("path", "([^/]*)$", 1).alias("path"), "sha256")
    packages = entries.groupBy("source_name").agg(package_fingerprint(entries).alias("checksum"), F.bool_or(F.col("path") == "feed_info.txt").alias("has_feed")).where("has_feed").drop("has_feed")
    return packages.join(known.select("source_name", "checksum"), ["source_name", "checksum"], "left_anti")
