"""What the text operators share: the shared folder, bounded Arrow batches and joins that stand a hot key."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker unpacks at once, and rows of an Arrow batch that it gives back.
BATCH_ROWS = 512
#: Short rows of an Arrow batch that is given back as columns.
MANY_ROWS = 8192
#: A key is hot if it has more than one in HOT_SHARE of all rows; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 2048
#: A key of no more rows is never worth a broadcast.
HOT_ROWS = 256

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset a folder of the warehouse, which they share too."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    return path.rstrip("/") if path else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/fleetspan-work"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: a cut in the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes tables of saved() that nothing reads any more."""
    for df in frames:
        for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, file)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session is gone; the cluster owns the folder
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_case(c: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def map_rows(df: DataFrame, schema: str, rows: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """rows() over each partition's rows as tuples; strings come as UTF-8 bytes. Spark bounds the bytes of a batch that comes in, BATCH_ROWS the rows that are unpacked at once."""
    out = spark_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed(rows(r for b in sliced(batches) for r in unpacked(b)), out)

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, schema: str, batches: Callable[[Iterator[tuple]], Iterator[list]]) -> DataFrame:
    """map_rows() for many rows: batches() yields lists of columns (Arrow arrays in the schema's order), which are cast to the schema's types and given on in slices of MANY_ROWS rows."""
    out = spark_schema(df.sparkSession, schema)

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in batches(r for b in sliced(given) for r in unpacked(b)):
            b = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)
            for at in range(0, b.num_rows, MANY_ROWS):
                yield b.slice(at, MANY_ROWS)

    return df.mapInArrow(run, schema)


def strings(values: list[bytes]) -> pa.Array:
    """UTF-8 bytes as strings; bytes that aren't UTF-8 become U+FFFD."""
    try:
        return pa.array(values, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([v.decode("utf-8", "replace") for v in values], pa.string())


def keep_rows(df: DataFrame, keep: Callable[[Iterator[bytes | None]], Iterator[bool]]) -> DataFrame:
    """Rows of df whose text keep() accepts, all columns as they are; keep() gets the texts of a partition and yields a verdict for each in turn."""
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield b.filter(pa.array(keep(iter(b.column(at).cast(pa.large_binary()).to_pylist())), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, BATCH_ROWS):
            yield b.slice(at, BATCH_ROWS)


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple]:
    cols = []
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            c = c.cast(pa.large_binary())
        cols.append(c.to_pylist())
    return zip(*cols, strict=True)


def packed(rows: Iterator[tuple], schema: pa.Schema, most: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most `most` rows."""
    kept: list[tuple] = []
    for r in rows:
        kept.append(r)
        if len(kept) == most:
            yield _batch(kept, schema)
            kept = []
    if kept:
        yield _batch(kept, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def spark_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def fresh(name: str, taken: list[str]) -> str:
    """name, with as many underscores before it as make it differ from all column names taken."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


#: Bits of a filter of keys, so that it takes no more than some 16 MB, however many keys there are.
FILTER_BITS = 1 << 24


def split_by(df: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of df whose key may be in keys (all that are, and some more), and rows whose key certainly isn't or is null; no row of df is moved.

    keys, with one column, become a bitmap of FILTER_BITS bits by hash, a table of at most FILTER_BITS / 64 rows that is broadcast. With more keys than bits most rows
    may be in: then the filter saves little, but stays right.
    """
    name = f"bits_{uuid.uuid4().hex}"
    bit = F.pmod(F.xxhash64(F.col(keys.columns[0])), F.lit(FILTER_BITS))
    one = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    words = keys.select(bit.alias("bit")).select((F.col("bit") / 64).cast("long").alias(f"{name}_word"), one.alias("mask")).groupBy(f"{name}_word").agg(F.bit_or("mask").alias(f"{name}_mask"))
    words = saved(words, "key-filter")
    mine = F.pmod(F.xxhash64(F.col(column)), F.lit(FILTER_BITS))
    met = df.join(F.broadcast(words), (mine / 64).cast("long") == F.col(f"{name}_word"), "left")
    may = F.col(column).isNotNull() & F.coalesce(F.getbit(F.col(f"{name}_mask"), F.pmod(mine, F.lit(64)).cast("int")) == 1, F.lit(False))
    own = [F.col(f"`{c}`") for c in df.columns]
    return met.where(may).select(*own), met.where(~may).select(*own)


def even(total: int, most: int) -> bool:
    """Whether no key is hot, or beyond HOT_ROWS, among total rows of which one key has most."""
    return most <= max(total / HOT_SHARE, HOT_ROWS)


def hot_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, how: str = "inner", most: int | None = None) -> DataFrame:
    """left joined with right, which has one row a key and in `weight` the number of left's rows with that key.

    Keys with more than total / HOT_SHARE rows are at most HOT_SHARE, so those are broadcast and left's rows with them stay
    where they are. All other keys are shuffled, and none of those fills a task. how: inner or left. most, the largest weight if it is known: where no key is
    hot or beyond HOT_ROWS the join is a plain one, which takes a third of the plan, of its scans and of the driver's broadcasts.
    """
    least = total / HOT_SHARE
    if most is not None and even(total, most):
        return left.join(right, on, how)
    hot = right.where(F.col(weight) > least)
    hot_keys = F.broadcast(hot.select(*on))
    there = left.join(F.broadcast(hot), on, "inner")
    rest = left.join(hot_keys, on, "left_anti").join(right.where(F.col(weight) <= least), on, how)
    return there.unionByName(rest)
