"""Quality classifier by compression: zstandard dictionaries of good and of bad text compete for each document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetspan.llm.common import keep_rows, map_rows, saved, table
from fleetspan.llm.logistic import Logistic

#: Bytes that are compressed at once; a whole text is cut into such pieces, so every part of it meets the dictionaries.
PIECE = 256
#: Bytes of a dictionary. Labelled rows of each label that dictionaries and calibration are made of at most, and bytes of their texts, which are taken whole.
DICTIONARY, SAMPLE, SAMPLE_BYTES = 65_536, 3000, 1 << 22
LEVEL = 3
#: A document with a lower score is rejected.
LEAST_SCORE = 0.7
#: Rows whose crc32(doc_id as text) mod FOLDS is HELD_OUT are never learned from.
FOLDS, HELD_OUT = 4, 2


def fold(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


class Sizes:
    """Compressed bytes of a text with the bad and with the good dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard as z

        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.each = [z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d), **options) if d else z.ZstdCompressor(**options) for d in (bad, good)]

    def difference(self, text: bytes) -> float:
        """By how much the good dictionary makes the text smaller than the bad one does, over the text's length."""
        parts = pieces(text)
        bad, good = (sum(len(c.compress(p)) for p in parts) for c in self.each)
        return (bad - good) / max(len(text), 1)

    def features(self, text: bytes | None) -> list[float]:
        """What is calibrated: the normalised difference, which says more in longer texts; so its slope follows the log length. Where there is no difference both are zero, whatever the length."""
        text = text or b""
        diff = self.difference(text)
        return [diff, diff * float(np.log1p(len(text)))]


class Model:
    """Dictionaries and calibration. With labels of one kind only, every score is (n1 + 1) / (n + 1)."""

    def __init__(self, good: bytes = b"", bad: bytes = b"", calibration: Logistic | None = None, constant: float = 1.0):
        self.good, self.bad, self.calibration, self.constant = good, bad, calibration, constant

    def scorer(self):
        if self.calibration is None:
            return lambda _: self.constant
        sizes = Sizes(self.good, self.bad)
        return lambda text: float(self.calibration.score(np.array([sizes.features(text)]))[0])


def dictionary(parts: list[bytes]) -> bytes:
    """Trained on the pieces; where those are too few to train on, the pieces themselves."""
    import zstandard as z

    try:
        return z.train_dictionary(DICTIONARY, parts).as_bytes()
    except z.ZstdError:
        return b"".join(parts)[-DICTIONARY:]


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Learns from at most `most` labelled rows of either label outside the held-out fold, those of the smallest hashes whose texts have most_bytes in all; half make dictionaries, half calibrate."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = {r[0]: r[1] for r in rows.groupBy("quality").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return Model(constant=(n1 + 1) / (n0 + n1 + 1))
    order = [F.xxhash64(F.lit("quality"), F.col("doc_id")), F.col("doc_id")]
    sample = rows.where("quality = 0").orderBy(*order).limit(most).unionByName(rows.where("quality = 1").orderBy(*order).limit(most))
    sample = docs.select("doc_id", "text").join(F.broadcast(sample.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), F.col("doc_id")), F.lit(2)).cast("int"))), "doc_id")
    sample = sample.groupBy("doc_id", "quality", "half").agg(F.min("text").alias("text"))  # of rows that share an id one, so that the bound is one of rows
    before = Window.partitionBy("quality", "half").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)  # 2 * most rows at most
    sample = saved(sample.withColumn("bytes", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0))).where(F.col("bytes") < most_bytes), "quality-sample")

    got = sample.where("half = 0").select("quality", F.col("text").cast("binary")).toArrow()  # most_bytes of either label, and a text beyond
    taken = list(zip(got["quality"].to_pylist(), got["text"].to_pylist(), strict=True))
    parts = {q: sorted(p for label, text in taken if label == q for p in pieces(text or b"")) for q in (0, 1)}
    good, bad = dictionary(parts[1]), dictionary(parts[0])
    sizes_of = lambda: Sizes(good, bad)

    def measure(it: Iterator[tuple]) -> Iterator[tuple]:
        sizes = sizes_of()
        for quality, text in it:
            yield quality, sizes.features(text)

    got = sorted(tuple((r[0], tuple(r[1]))) for r in map_rows(sample.where("half = 1").select("quality", "text"), "quality int, x array<double>", measure).collect())
    y = np.array([r[0] for r in got], float)
    if not 0 < y.sum() < len(y):
        return Model(constant=(n1 + 1) / (n0 + n1 + 1))
    weight = np.where(y == 1, n1 / y.sum(), n0 / (len(y) - y.sum()))  # as often as among all labelled rows
    return Model(good, bad, Logistic(np.array([r[1] for r in got]), y, weight * len(y) / weight.sum()))


def scored(docs: DataFrame, labels: DataFrame, model_docs: DataFrame | None = None) -> DataFrame:
    """One row per document row: doc_id, text, held_out, score, predicted.

    A null text is empty; empty texts get the score of no difference. A null doc_id isn't held out and never learned from; labels other than 0 and 1 are skipped, of
    repeated labels the smallest counts. Only doc_id and text are read of documents; an empty table gives no rows.
    """
    model = fit(model_docs if model_docs is not None else docs, labels)

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        score = model.scorer()
        for doc, text in it:
            s = score(text)
            yield doc, None if text is None else text.decode("utf-8", "replace"), s, int(s >= LEAST_SCORE)

    out = map_rows(docs.select("doc_id", "text"), "doc_id long, text string, score double, predicted int", rows)
    return out.select("doc_id", "text", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """Rows whose text scores at least LEAST_SCORE, with all their columns."""

    def keep(texts: Iterator[bytes | None]) -> Iterator[bool]:
        score = scorer_of(model)
        return (score(t) >= LEAST_SCORE for t in texts)

    return keep_rows(docs, keep)


_scorers: dict[Model, object] = {}


def scorer_of(model: Model):
    """The model's scorer, made once per worker and task."""
    if model not in _scorers:
        _scorers.clear()
        _scorers[model] = model.scorer()
    return _scorers[model]


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text")
