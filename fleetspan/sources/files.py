"""Files as sources: ping CSV trees, timetable packages and jam reports, with their inventory, manifest and sinks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetspan.operators.ingest import PING_COLUMNS
from fleetspan.sources import named_csv

# Columns of a jam report file.
JAM_COLUMNS = "zona geohash6 data Hora Minuto localizacao_dicofre rua cidade nivel_de_intensidade velocidade velocidade_kmh atraso comprimento latitude longitude geowkt geo".split()


def csv_rows(spark: SparkSession, root: str, columns: list[str] | None, glob: str = "*.csv", files: list[str] | None = None, required: list[str] | None = None, whole: bool = False) -> DataFrame:
    """Rows of all CSV files below root, or of those named, by the names in each file's header: columns as strings (None: all, as a map `data`), source_file, at and fault. See named_csv.NamedCsv."""
    named_csv.register(spark)
    reader = spark.read.format("named_csv").option("path", root.rstrip("/")).option("glob", glob)
    given = {"columns": columns, "files": files, "required": required}
    for name, value in given.items():
        if value is not None:
            reader = reader.option(name, json.dumps(value))
    return (reader.option("splitBytes", "0") if whole else reader).load()


def ping_files(spark: SparkSession, root: str, files: list[str] | None = None, glob: str = "*.csv") -> DataFrame:
    return csv_rows(spark, root, PING_COLUMNS, glob, files)


def jam_files(spark: SparkSession, root: str, files: list[str] | None = None, glob: str = "*.csv") -> DataFrame:
    return csv_rows(spark, root, JAM_COLUMNS, glob, files)


def _below(root: str):
    tail = root.rstrip("/").split(":")[-1] + "/"
    return F.substring_index("path", "/" + tail.lstrip("/") if tail.startswith("///") else tail, -1).alias("path")  # paths of files have no or another authority where the root's is empty


def listed(spark: SparkSession, root: str, glob: str = "*.csv", files: list[str] | None = None) -> DataFrame:
    """path (below root), bytes and time of change of each file, or of those named; nothing is read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root if files is None else [f"{root.rstrip('/')}/{x}" for x in files])
    return f.select(_below(root), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def inventory(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """path (below root), bytes, sha256 and time of change of each file. A file is hashed whole by one task, so files have to be below 2 GB."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return f.select(_below(root), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def fingerprint(files: DataFrame) -> DataFrame:
    """One row: a hash of the whole inventory."""
    return files.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("path", "bytes", "sha256")))).cast("binary"), 256).alias("fingerprint"), F.count("*").alias("files"))


def unread(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of an inventory that the manifest lacks. Raises ValueError if a file of the manifest has other contents now."""
    changed = files.join(manifest.select("path", F.col("sha256").alias("known")), "path").where("sha256 <> known").orderBy("path").head(1)
    if changed:
        raise ValueError(f"{changed[0].path} has changed since it was read; rebuild.")
    return files.join(manifest.select("path"), "path", "left_anti")


def published(spark: SparkSession, rows: DataFrame, out: str, version: str) -> DataFrame:
    """Writes a version of a table, then the pointer that makes it the active one; refuses an empty one. Returns the active version's rows."""
    rows.write.mode("overwrite").parquet(f"{out}/version={version}")
    if not spark.read.parquet(f"{out}/version={version}").head(1):
        raise ValueError("No rows; the active version stays.")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{out}/_active")
    return active(spark, out)


def active(spark: SparkSession, out: str) -> DataFrame:
    """The rows of the active version."""
    version = spark.read.parquet(f"{out}/_active").first()[0]
    return spark.read.parquet(f"{out}/version={version}")


def progress(done: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files read of all, and observations that they gave. done: path, inserted."""
    return done.agg(F.count("*").alias("files_done"), F.coalesce(F.sum("inserted"), F.lit(0)).alias("observations")).crossJoin(F.broadcast(files.agg(F.count("*").alias("files"))))  # one row each


def package_records(spark: SparkSession, root: str, package: str, tables: list[str] | None = None) -> DataFrame:
    """package_id, table_name, row_number (from 1, in file order), data and ragged (whether a row has too many or too few fields) of every row of a package's tables, nothing lost.

    A table is a file <table>.txt, or a folder of that name with its parts in order. Headers lacking a required column end the read.
    """
    rows = csv_rows(spark, root, None, "*", whole=True).withColumn("table_name", F.regexp_extract("source_file", r"^([^/]*)\.txt(/|$)", 1))
    rows = rows.where(F.col("table_name").isin(tables) if tables else F.col("table_name") != "")
    ends = rows.groupBy("table_name", "source_file").agg(F.max("at").alias("n"))  # a row a file
    starts = ends.select("table_name", "source_file", F.coalesce(F.sum("n").over(Window.partitionBy("table_name").orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    met = rows.join(F.broadcast(starts), ["table_name", "source_file"])
    return met.select(F.lit(package).alias("package_id"), "table_name", (F.col("start") + F.col("at")).alias("row_number"), "data", F.col("fault").isNotNull().alias("ragged"))


def exported(passages: DataFrame, path: str) -> None:
    """All passages with all their columns as gzipped CSV, a folder a day."""
    passages.write.partitionBy("day").option("header", True).option("compression", "gzip").mode("overwrite").csv(path)


def work_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or where that is unset one in the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    return path.rstrip("/") if path else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/fleetspan-work"


def shared(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet in work_dir() and read back: a cut in the lineage that outlives executors."""
    path = f"{work_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(df: DataFrame) -> None:
    """Deletes the folder of a table of shared() that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
