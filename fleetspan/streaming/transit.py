"""Structured Streaming forms of ingest dedup, hourly snapshots, and first and last pings at stops, all in append mode: state is dropped behind the watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspan.sources.files import work_dir

IDENTITY = ["agency_id", "vehicle_id", "trip_id", "stop_id", "created_us"]


def read_events(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """A table's file as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def with_end(p: DataFrame, years: int = 100) -> DataFrame:
    """A stream of pings and, beside it, one ping of no vehicle far ahead, which moves the watermark past all others, so that windows still open at the end come out too."""
    spark = p.sparkSession
    path = f"{work_dir(spark)}/stream-end-{uuid.uuid4().hex}"
    far = 4_102_444_800_000_000 + years * 31_557_600_000_000
    spark.range(1).select(F.lit(far).alias("created_us")).write.parquet(path)
    end = spark.readStream.schema("created_us long").parquet(path)
    return p.unionByName(end, allowMissingColumns=True)


def timed(p: DataFrame, late: str) -> DataFrame:
    return p.withColumn("at", F.timestamp_micros("created_us")).withWatermark("at", late)


def deduplicated(p: DataFrame, late: str = "7 days") -> DataFrame:
    """The first of each observation; keys are forgotten once the watermark has passed them."""
    return timed(p, late).dropDuplicatesWithinWatermark(IDENTITY)


def snapshots(p: DataFrame, every: str = "1 hour", late: str = "7 days") -> DataFrame:
    """The latest ping of each vehicle in each window."""
    w = F.window("at", every)
    return timed(p, late).groupBy(w, "agency_id", "vehicle_id").agg(F.max("created_us").alias("created_us"), F.count("*").alias("pings")).select(F.unix_micros("window.start").alias("start_us"), "agency_id", "vehicle_id", "created_us", "pings")


def stop_spans(p: DataFrame, late: str = "7 days") -> DataFrame:
    """First and last ping of each calendar day, trip, vehicle and stop. Without a plan, so without the rule for a trip's last stop."""
    w = F.window("at", "1 day")
    return timed(p, late).groupBy(w, "trip_id", "vehicle_id", "stop_id").agg(F.min("created_us").alias("t_first"), F.max("created_us").alias("t_pass")).select("trip_id", "vehicle_id", "stop_id", "t_first", "t_pass")


def drained(stream: DataFrame) -> DataFrame:
    """Runs a stream over all that is there and returns its result, through a Parquet sink in the shared folder."""
    spark = stream.sparkSession
    path = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint")
    writer.format("parquet").option("path", f"{path}/out").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
