"""Importance resampling towards a target distribution: hashed n-gram weights with Gumbel noise, and the best scores without sorting all rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fleetspan.llm.common import map_rows, saved, sliced, table
from fleetspan.llm.words import alnum_words, signed

#: Buckets that features are hashed to; counts and gains are arrays of this size.
BUCKETS = 10_000
#: Documents of fewer words aren't drawn.
LEAST_WORDS = 20
#: Percent of the documents with enough words that are drawn.
PERCENT = 25
SEED = "7"
#: Of the quantile sketch: its rank error is one in so many.
ACCURACY = 10_000
#: Features of a task that are counted at once.
COUNTED = 1 << 20
#: High scores first, then small ids; a text's digest and a row's place in the saved table tell rows of one id apart.
ORDER = [F.desc, F.asc_nulls_last, F.asc, F.asc]
KEYS = ["score", "doc_id", "digest", "place"]


def bucketed(words: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all runs of one and two words. The checksum of a pair goes on from that of its first word."""
    ones = list(map(crc32, words))
    pairs = list(map(crc32, words[1:], map(crc32, repeat(b" "), ones)))
    return np.array(ones + pairs, np.int64) % buckets


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket. Each task adds up an array, so no more rows are moved than it has buckets; the driver gets one array."""

    def counted(it: Iterator[tuple]) -> Iterator[tuple]:
        total, held, n = np.zeros(buckets, np.int64), [], 0
        for (text,) in it:
            held.append(bucketed(alnum_words(text), buckets))
            n += len(held[-1])
            if n >= COUNTED:
                total += np.bincount(np.concatenate(held), minlength=buckets)
                held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=buckets)
        for b in np.flatnonzero(total):
            yield int(b), int(total[b])

    out = np.zeros(buckets, np.int64)
    for b, n in map_rows(texts.select("text"), "bucket int, n long", counted).groupBy("bucket").agg(F.sum("n")).collect():
        out[b] = n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier a feature of each bucket is in the target, both smoothed by one a bucket."""
    s, t, buckets = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + buckets) / ((a + 1) * (t + buckets)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: str = SEED) -> int:
    """Thousandths of a Gumbel variate that hangs on the id alone."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, kept: list[str], seed: str = SEED) -> DataFrame:
    """row (a struct of the columns kept), doc_id, digest, n_words, n_features, weight and score of each document row."""
    rows = docs.select(F.struct(*kept).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    longs = ["digest", "n_words", "n_features", "weight", "score"]
    schema = StructType([*rows.schema.fields[:2], *[StructField(c, LongType()) for c in longs]])
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out = []
            for doc_id, text in zip(b.column(1).to_pylist(), b.column(2).cast(pa.large_binary()).to_pylist(), strict=True):
                words = alnum_words(text)
                at = bucketed(words, buckets)
                weight = int(gains[at].sum()) // len(at) if len(at) else 0
                out.append((signed(xxhash.xxh64_intdigest(text or b"")), len(words), len(at), weight, weight + noise(doc_id, seed)))
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * len(longs)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=schema.names)

    return rows.mapInArrow(run, schema)


def numbered(rows: DataFrame, tag: str) -> DataFrame:
    """rows with their rank from 1 in the order of KEYS: ranges are sorted each by a task, and what stands before a range is added up from the ranges' counts."""
    order = [way(c) for way, c in zip(ORDER, KEYS, strict=True)]
    spark = rows.sparkSession
    placed = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("nth", F.monotonically_increasing_id()), tag)
    part = F.shiftright("nth", 33)
    before, total = [], 0
    for p, n in sorted(placed.groupBy(part.alias("part")).agg(F.count("*")).collect()):  # a row a partition
        before.append((p, total))
        total += n
    met = placed.withColumn("part", part).join(F.broadcast(spark.createDataFrame(before, "part long, before long")), "part")
    return met.withColumn("rank", F.col("before") + F.col("nth").bitwiseAND((1 << 33) - 1) + 1).drop("part", "before", "nth")


def bracket(rows: DataFrame, k: int, n: int) -> tuple[Column, int]:
    """A condition on score that holds for the k-th highest of n rows, and how many rows score above it.

    A quantile sketch proposes the bounds; exact counts outside confirm them, or the bracket is widened until they do.
    """
    margin = 2 / ACCURACY
    while True:
        low, high = 1 - k / n - margin, 1 - k / n + margin
        at = rows.agg(F.percentile_approx("score", F.array(F.lit(max(low, 0.0)), F.lit(min(high, 1.0))), ACCURACY)).first()[0]
        over = F.col("score") > at[1] if high < 1 else F.lit(False)
        under = F.col("score") < at[0] if low > 0 else F.lit(False)
        above, below = rows.agg(F.count_if(over), F.count_if(under)).first()
        if above < k <= n - below:
            return ~over & ~under, above
        margin *= 8


def cutoff(rows: DataFrame, k: int, n: int) -> dict[str, int]:
    """KEYS of the k-th of n rows: only the rows of the bracket are sorted."""
    inside, above = bracket(rows, k, n)
    return numbered(rows.where(inside).select(*KEYS), "resample-bracket").where(F.col("rank") == k - above).first().asDict()


def not_after(cut: dict[str, int]) -> Column:
    """Whether a row stands at the cutoff or before it in the order of KEYS."""
    met = F.lit(True)
    for way, c in reversed(list(zip(ORDER, KEYS, strict=True))):
        if cut[c] is None:
            met = F.col(c).isNotNull() | met
        else:
            ahead = F.col(c) > cut[c] if way is F.desc else F.col(c) < cut[c]
            met = F.coalesce(ahead | ((F.col(c) == cut[c]) & met), F.lit(False))
    return met


def resampled(docs: DataFrame, target: DataFrame, kept: list[str] | None = None, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """row (a struct of docs' columns, or of those kept), n_features, weight, score and rank of every document row; rank is null where it isn't drawn.

    Words are alphanumeric, features runs of one and two of them. A document's weight is the mean of its buckets' gains by which target differs from docs;
    with noise by doc_id added, the highest percent of documents with least_words words are drawn, ties to the smaller doc_id, then by text. A null text has no words, weight 0 and
    is never drawn; a null doc_id has the noise of an empty one and comes last of a tie; repeated rows are each drawn or not, in any order among themselves; an empty
    target gives weights that prefer what docs hold little of; no docs give no rows. Other columns are only read if kept.
    """
    gains = gains_of(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    rows = saved(scored(docs, gains, kept or docs.columns, seed).withColumn("place", F.monotonically_increasing_id()), "resample-scores")
    enough = F.col("n_words") >= least_words
    n = rows.where(enough).count()
    k = percent * n // 100
    out = ["row", "n_features", "weight", "score"]
    if not k:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    drawn = enough & not_after(cutoff(rows.where(enough).select(*KEYS), k, n))
    ranks = numbered(rows.where(drawn), "resample-drawn").select(*out, "rank")
    return ranks.unionByName(rows.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), kept=["doc_id"])
    return rows.select("row.doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RUNS = "list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))"
#: The checksum is worked out byte by byte from its polynomial; the rest is the definition of the operator.
ORACLE = f"""
WITH RECURSIVE steps AS (
  SELECT b, b AS c, 0 AS i FROM range(256) t(b)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM steps WHERE i < 8
), crc AS (
  SELECT list(c ORDER BY b) AS tab FROM steps WHERE i = 8
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, words, {_RUNS} AS runs FROM (SELECT doc_id, {_WORDS} AS words FROM documents)
), target AS (
  SELECT unnest({_RUNS}) AS f FROM (SELECT {_WORDS} AS words FROM benchmark)
), source AS (
  SELECT r, unnest(runs) AS f FROM docs
), names AS (
  SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM source UNION SELECT f FROM target)
), buckets AS (
  SELECT f, xor(4294967295, list_reduce(
      list_concat([4294967295::BIGINT], list_transform(range(0, len(x) // 2), lambda i: (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1)),
      lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]))) % 10000 AS b
  FROM names, crc
), s AS (
  SELECT b, count(*) AS n FROM source JOIN buckets USING (f) GROUP BY b
), t AS (
  SELECT b, count(*) AS n FROM target JOIN buckets USING (f) GROUP BY b
), gains AS (
  SELECT b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000) / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (b)
), weights AS (
  SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM source JOIN buckets USING (f) JOIN gains USING (b) GROUP BY r
), scores AS (
  SELECT r, doc_id, len(words) AS n_words, len(runs) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (r)
), ranks AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 25 * count(*) // 100 FROM ranks) THEN rank END AS rank
FROM scores LEFT JOIN ranks USING (r)
"""
