"""Mixing sources to target weights by soft membership, in DataFrame functions only."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspan.llm.common import saved, table
from fleetspan.llm.quality_rules import let, words_of

#: Domains, as documents.lang names them, and their share of the mix's tokens.
TARGETS = {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}
#: Labelled rows that the classifier is fitted on at most: those of the smallest hash of doc_id.
SAMPLE = 20_000
#: Buckets that words are hashed to; together with the domains they bound what reaches the driver.
BUCKETS = 4096
#: Evidence of a text is damped to that of about so many distinct words, so that long texts keep soft posteriors.
DAMP = 12.0
#: Tokens asked for, as a multiple of what gives the domain with the most tokens for its target a mean rate of 1; scarcer domains are repeated more.
GROWTH = 1.15
#: Steps end when no gap is above TOLERANCE of all tokens, or when PATIENCE steps didn't lower the largest gap by a hundredth.
PATIENCE, TOLERANCE = 25, 1e-4


def buckets_of(words: Column) -> Column:
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))


def classifier(docs: DataFrame, labels: DataFrame, names: list[str], most: int = SAMPLE) -> dict[str, list[float]]:
    """Naive Bayes over presence of word buckets: for each domain its log prior, then the log weight of each bucket.

    It learns domains from rows that labels marks as of good quality; a row's domain is its lang.
    """
    sample = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    seen = docs.select("doc_id", F.col("lang").alias("domain"), "text").where(F.col("domain").isin(names))
    seen = seen.join(F.broadcast(sample), "doc_id").select("domain", buckets_of(words_of(F.coalesce("text", F.lit("")))).alias("b"))
    seen = seen.select("domain", F.explode(F.concat(F.array(F.lit(-1)), "b")).alias("b"))
    counts = {(r[0], r[1]): r[2] for r in seen.groupBy("domain", "b").count().collect()}  # at most len(names) * (BUCKETS + 1) rows
    n = {d: counts.get((d, -1), 0) for d in names}
    every = sum(n.values())
    return {d: [math.log((n[d] + 1) / (every + len(names))), *(math.log((counts.get((d, b), 0) + 0.5) / (n[d] + 1)) for b in range(BUCKETS))] for d in names}


def constant(values: list[float]) -> Column:
    """An array literal; the optimizer folds it."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def memberships(docs: DataFrame, weights: dict[str, list[float]], kept: list[str] | None = None) -> DataFrame:
    """row, a struct of the columns kept (doc_id unless given), chance, n_tokens and p_<domain>, the posteriors, which sum to 1. A text without words gets the prior."""
    names = list(weights)
    first = weights[names[0]]

    def evidence(d: str, b: Column) -> Column:
        odds = [x - y for x, y in zip(weights[d], first, strict=True)]
        table_ = constant(odds[1:])
        total = F.aggregate(b, F.lit(0.0), lambda acc, i: acc + F.get(table_, i))
        return F.lit(odds[0]) + total * F.lit(DAMP) / (F.lit(DAMP) + F.size(b))

    scored = let(words_of(F.coalesce("text", F.lit(""))), lambda w: F.struct(F.size(w).cast("long").alias("n_tokens"), let(buckets_of(w), lambda b: F.array(*[evidence(d, b) for d in names])).alias("z")))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))  # rows without an id are told apart by their text
    chance = F.pmod(F.xxhash64(F.lit("mixing"), F.col("doc_id"), key), F.lit(1 << 20)) / float(1 << 20)
    rows = docs.select(F.struct(*(kept or ["doc_id"])).alias("row"), chance.alias("chance"), scored.alias("s")).select("row", "chance", "s.n_tokens", "s.z")
    top = F.array_max("z")
    rows = rows.withColumn("e", F.transform("z", lambda x: F.exp(x - top)))
    total = F.aggregate("e", F.lit(0.0), lambda acc, x: acc + x)
    return rows.select("row", "chance", "n_tokens", *[(F.get("e", F.lit(i)) / total).alias(f"p_{d}") for i, d in enumerate(names)])


def fit_rates(members: DataFrame, targets: dict[str, float], growth: float = GROWTH) -> tuple[list[list[float]], dict[str, float], dict[str, float]]:
    """Gradients whose projected steps from rate 1 give each document's rate; domain totals reached; totals asked for.

    Least squares over rates >= 0 of the gaps between each domain's sum of rate * tokens * posterior and its target, with gaps whitened by the inverse
    of the documents' second moments, so that a step of length 1 is safe and few are needed. A document's rate depends on its posteriors and the gradients
    only, so a step is one aggregation of as many numbers as there are domains.
    """
    names = list(targets)
    p = [F.col(f"p_{d}") for d in names]
    n = F.col("n_tokens").cast("double")
    one = members.agg(*[F.coalesce(F.sum(n * x), F.lit(0.0)) for x in [*p, *(x * y for x in p for y in p)]]).first()
    got, moments = np.array(one[: len(p)]), np.array(one[len(p) :]).reshape(len(p), len(p))
    share = np.array([targets[d] for d in names]) / sum(targets.values())
    want = share * growth * max((g / s for g, s in zip(got, share, strict=True) if s > 0), default=0.0)
    whiten = np.linalg.pinv(moments, rcond=1e-9, hermitian=True)
    gradients: list[list[float]] = []
    allowed = TOLERANCE * max(want.sum(), 1.0)
    gap = mark = abs(got - want).max()
    waited = 0
    while gap > allowed and waited < PATIENCE:
        step = [float(x) for x in whiten @ (got - want)]
        if max(map(abs, step)) < 1e-9:  # what is left of the gaps isn't in reach of any rates
            break
        gradients.append(step)
        got = np.array(members.agg(*[F.sum(rate(names, gradients) * n * x) for x in p]).first())
        gap = abs(got - want).max()
        waited = 0 if gap < 0.99 * mark else waited + 1
        mark = gap if waited == 0 else mark
    if gap > allowed:
        missed = ", ".join(f"{d} {g:.0f} of {w:.0f}" for d, g, w in zip(names, got, want, strict=True))
        warnings.warn(f"the mix misses its targets after {len(gradients)} steps; tokens by domain: {missed}", stacklevel=2)
    return gradients, dict(zip(names, map(float, got), strict=True)), dict(zip(names, map(float, want), strict=True))


def rate(names: list[str], gradients: list[list[float]]) -> Column:
    """All projected steps on a row."""
    if not gradients:
        return F.lit(1.0)
    flat, n = constant([x for g in gradients for x in g]), len(names)
    step = lambda i: sum((F.col(f"p_{d}") * F.get(flat, i * n + j) for j, d in enumerate(names)), F.lit(0.0))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(gradients) - 1)), F.lit(1.0), lambda r, i: F.greatest(F.lit(0.0), r - step(i)))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, model_docs: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate and n_copies of each document row; see mixed_rows()."""
    names = list(targets or TARGETS)
    return mixed_rows(docs, labels, targets, model_docs, ["doc_id"]).select("row.doc_id", "n_tokens", *[f"p_{d}" for d in names], "rate", "n_copies")


def mixed_rows(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, model_docs: DataFrame | None = None, kept: list[str] | None = None) -> DataFrame:
    """row, a struct of the columns kept, n_tokens, p_<domain>, rate and n_copies of each document row.

    The classifier learns from labelled rows of model_docs (docs unless given). n_copies is the rate rounded down, or up for a share of documents equal to its fraction, by
    hash of doc_id, or of the text where that is null; so expected totals stay. A null text has no tokens and prior posteriors; a null doc_id is a row like others and is never labelled;
    repeated labels of a doc_id count once; without any labels or tokens posteriors are the targets' prior and rates stay 1. Other columns are not read.
    """
    targets = targets or TARGETS
    names = list(targets)
    weights = classifier(model_docs if model_docs is not None else docs, labels, names)
    members = saved(memberships(docs, weights, kept), "mixing-members")
    apart = len({tuple(w) for w in weights.values()}) > 1
    gradients = fit_rates(members, targets)[0] if apart else []
    r = rate(names, gradients)
    return members.withColumn("rate", r).withColumn("n_copies", F.floor(F.col("rate") + F.col("chance")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
