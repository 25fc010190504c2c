"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fleetspan.llm.common import discard, fresh, hot_join, map_rows, saved, shared_dir, sliced, table
from fleetspan.llm.words import length, signed

#: Shorter keys are never dropped.
LEAST_CHARS = 10
#: Batches of documents, by doc_id, that one call feeds to the runs.
BATCHES = 4
#: Runs of one level that are merged into one of the next.
FANOUT = 3
KEY = ["h1", "h2"]


def line_key(line: bytes) -> bytes:
    """The line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased; bytes.strip() takes just these six."""
    return line.strip().lower()


def key_hash(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return signed(h >> 64), signed(h & (1 << 64) - 1)


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or length(key) >= least)


def line_keys(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """doc_id, h1, h2: the 128-bit hashes of each document row's distinct keys of at least `least` code points."""

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        for doc, text in it:
            for key in {k for k in map(line_key, (text or b"").split(b"\n")) if long_enough(k, least)}:
                yield doc, *key_hash(key)

    return map_rows(docs.select("doc_id", "text").where("doc_id is not null"), "doc_id long, h1 long, h2 long", rows)


class LineRuns:
    """Sorted runs of (key, first document), bucketed by key so that a batch meets them by merge join without moving them.

    A run of level k+1 is made of FANOUT runs of level k. Runs are tables in the shared folder; a lost executor loses none.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def names(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        placed = run.select(*KEY, "first_doc").repartition(self.buckets, *KEY)
        placed.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{shared_dir(self.spark)}/{name}").saveAsTable(name)
        return name

    def add(self, entries: DataFrame) -> None:
        """A new run of level 0, and merges of levels that are full."""
        self.levels[0].append(self._write(entries))
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                # read as plain files: a union of bucketed scans would be taken as partitioned by key
                files = self.spark.read.parquet(*[f"{shared_dir(self.spark)}/{name}" for name in level])
                merged = files.groupBy(*KEY).agg(F.min("first_doc").alias("first_doc"))
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(merged))
                self._drop(level)
                self.levels[k] = []

    def _drop(self, names: list[str]) -> None:
        for name in names:
            run = self.spark.table(name)
            discard(run)
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        self._drop(self.names())

    def meet(self, keys: DataFrame) -> DataFrame:
        """A batch's (key, first_doc, n, several) with the document that a run has for the key as known, else null. A key is in one run at most."""
        met, known = keys.repartition(self.buckets, *KEY), [F.lit(None).cast("long")]
        for i, name in enumerate(self.names()):
            known.append(F.col(f"run_{i}"))
            met = met.join(self.spark.table(name).select(*KEY, F.col("first_doc").alias(f"run_{i}")), KEY, "left")
        return met.select(*KEY, "first_doc", "n", "several", F.coalesce(*known).alias("known"))


def dropped_keys(docs: DataFrame, least: int = LEAST_CHARS, batches: int = BATCHES) -> DataFrame:
    """doc_id, keys: per document the hashes of the lines that it loses, as 'h1 and h2' structs."""
    spark = docs.sparkSession
    lines = saved(line_keys(docs, least), "line-keys")
    bounds = sorted(set(lines.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01))) if lines.head(1) else []
    parts, held, runs = [], [], LineRuns(spark)
    try:
        for low, high in zip([None, *bounds], [*bounds, None], strict=True):
            batch = lines
            if low is not None:
                batch = batch.where(F.col("doc_id") > low)
            if high is not None:
                batch = batch.where(F.col("doc_id") <= high)
            keys = batch.groupBy(*KEY).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"), (F.min("doc_id") < F.max("doc_id")).alias("several"))
            met = saved(runs.meet(keys), "line-batch")
            if high is not None:
                runs.add(met.where("known is null"))
            parts.append(met.where("known is not null or several").select(*KEY, F.coalesce("known", "first_doc").alias("first_doc"), "n"))
            held.append(met)
        # a key's first document is the same in all batches that repeat it
        repeated = saved(reduce(DataFrame.unionByName, parts).groupBy(*KEY).agg(F.min("first_doc").alias("first_doc"), F.sum("n").alias("n")), "line-repeated")
        discard(*held)
        total, most = repeated.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        gone = hot_join(lines, repeated, KEY, "n", total, most=most).where("first_doc < doc_id").select("doc_id", *KEY)
        gone = saved(gone.groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("keys")), "line-dropped")
    finally:
        runs.close()
    discard(lines, repeated)
    return gone


def dedup_lines(docs: DataFrame, least: int = LEAST_CHARS, batches: int = BATCHES) -> DataFrame:
    """All columns of docs with text rewritten, plus n_lines (before), n_dropped.

    A key is a line without ASCII white space at its ends, A-Z lower-cased. Keys of at least `least` code points lose their lines in all documents but the
    one with the smallest doc_id that holds them; lines of one document never displace each other, nor do repeated rows with one doc_id. Batches of
    ascending doc_id meet the runs of all earlier ones, so the smallest doc_id comes first. A null text counts as one empty line and stays null;
    a row with a null doc_id keeps all its lines and displaces none. Columns of docs named n_lines and n_dropped are replaced; all others stay as they are.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    doc, lost = fresh("doc", own), fresh("lost", own)
    gone = dropped_keys(docs, least, batches).select(F.col("doc_id").alias(doc), F.col("keys").alias(lost))
    joined = docs.select(*own).join(gone, F.col("doc_id") == F.col(doc), "left").drop(doc)
    at = own.index("text")
    schema = StructType([*docs.select(*own).schema.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            given = b.column(at)
            texts, counts, dropped = given.cast(pa.large_binary()).to_pylist(), [], []
            for i, keys in enumerate(b.column(len(own)).to_pylist()):
                lines = kept = (texts[i] or b"").split(b"\n")
                if keys:
                    out = {(k["h1"], k["h2"]) for k in keys}
                    kept = [x for x in lines if not (long_enough(k := line_key(x), least) and key_hash(k) in out)]
                    texts[i] = b"\n".join(kept)
                counts.append(len(lines))
                dropped.append(len(lines) - len(kept))
            columns = b.columns[: len(own)]
            columns[at] = pa.array(texts, pa.large_binary()).view(pa.large_string()) if pa.types.is_large_string(given.type) else pa.array(texts, pa.binary()).view(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], names=[*own, "n_lines", "n_dropped"])

    return joined.mapInArrow(rows, schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
