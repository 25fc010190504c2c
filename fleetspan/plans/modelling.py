"""Queries of model training and evaluation, and of the streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspan.operators import boosting, features, models, passages
from fleetspan.plans.base import MODEL, NAMED, context_of, judged_of
from fleetspan.plans.book import Book, plain
from fleetspan.plans.oracle import FRAGMENTS, sql
from fleetspan.sources import adapter, files
from fleetspan.streaming import transit

BOOK = Book()

FRAGMENTS |= {
    "named": NAMED,
    "scored": "SELECT day, line, label::INT AS y, round(1 / (1 + exp(-greatest(-50, least(50, -3.0 + -0.9 * (log_ratio - -0.2) / 0.6 + -0.3 * trend / 0.5 + 0.4 * (coalesce(delay_gap_min, 0.1) - 0.1) / 2.0 + 0.2 * (coalesce(line_irreg30, 0.5) - 0.5) / 0.3)))), 4) AS p FROM named WHERE valid AND NOT bunched AND ratio >= 0.5 AND label IS NOT NULL",
}
LEVELS = [0.002, 0.01, 0.02, 0.05, 0.1]


def training(spark, sf):
    return models.training_set(features.named(context_of(spark, sf).where("hw is not null and sched_hw <> 0")))


def scored(spark, sf):
    return training(spark, sf).withColumn("p", F.round(features.linear_score(MODEL, -3.0), 4))


@BOOK.add("m06_training_set", sql("SELECT day::VARCHAR AS day, count(*) AS n, sum(y)::DOUBLE AS positives FROM scored GROUP BY 1"))
def _(spark, sf):
    return plain(training(spark, sf).groupBy("day").agg(F.count("*").alias("n"), F.sum("y").alias("positives")))


@BOOK.add("m07_alert_table", sql(f"SELECT level, count(*) FILTER (p >= level) AS alerts, count(*) FILTER (p >= level AND y = 1) AS hits, round(count(*) FILTER (p >= level AND y = 1) / nullif(count(*) FILTER (p >= level), 0), 6) AS precision, round(count(*) FILTER (p >= level AND y = 1) / nullif(count(*) FILTER (y = 1), 0), 6) AS recall, round(100 * count(*) FILTER (p >= level) / count(*), 6) AS per_100 FROM scored, (SELECT unnest({LEVELS})::DOUBLE AS level) GROUP BY 1"))
def _(spark, sf):
    return plain(models.alert_table(scored(spark, sf), LEVELS))


@BOOK.add("m08_alert_budget", sql("SELECT 1.0::DOUBLE AS per_100, round(quantile_cont(p, 0.99), 5) AS threshold FROM scored UNION ALL SELECT 2.0, round(quantile_cont(p, 0.98), 5) FROM scored"))
def _(spark, sf):
    return plain(models.alert_budget(scored(spark, sf), [1.0, 2.0]), 5)


@BOOK.add("m09_average_precision", sql("SELECT round(sum(pos * cp / cn) / nullif(sum(pos), 0), 6) AS ap, sum(n)::BIGINT AS n, sum(pos)::BIGINT AS positives FROM (SELECT *, sum(n) OVER (ORDER BY p DESC) AS cn, sum(pos) OVER (ORDER BY p DESC) AS cp FROM (SELECT p, count(*) AS n, count(*) FILTER (y = 1) AS pos FROM scored GROUP BY 1))"))
def _(spark, sf):
    return plain(models.average_precision(scored(spark, sf)))


@BOOK.add("m09_roc_auc", sql("SELECT round(sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0), 6) AS auc, sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives FROM (SELECT *, sum(neg) OVER (ORDER BY p) - neg AS below FROM (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg FROM scored GROUP BY 1))"))
def _(spark, sf):
    return plain(models.roc_auc(scored(spark, sf)))


@BOOK.add("m11_screening", sql("SELECT (log_gap >= 1)::INT + (log_gap >= 2)::INT + (log_gap >= 3)::INT + (log_gap >= 4)::INT AS bin, count(*) AS n, round(avg(label::INT), 6) AS rate FROM named WHERE valid AND NOT bunched AND ratio >= 0.5 AND label IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    return plain(models.screening(training(spark, sf), "log_gap", [1, 2, 3, 4]))


@BOOK.add("w29_target_encoding", sql("SELECT line, stop_id, day::VARCHAR AS day, round(ln(r / (1 - r)), 6) AS logit FROM (SELECT *, least(1 - 1e-6, greatest(1e-6, (os + 200 * base) / (n_other + 200))) AS r FROM (SELECT line, stop_id, day, sum(n) OVER w - n AS n_other, sum(s) OVER w - s AS os FROM (SELECT line, stop_id, day, count(*) AS n, sum(bunched::INT) AS s FROM feat WHERE valid GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY line, stop_id)), (SELECT avg(bunched::INT) AS base FROM feat WHERE valid))"))
def _(spark, sf):
    return plain(models.target_encoding(judged_of(spark, sf).where("valid"), ["line", "stop_id"], F.col("bunched")))


@BOOK.add("m05_train_logistic")
def _(spark, sf):
    rows = files.shared(training(spark, sf).select("day", "y", *models.FEATURES), "training")  # read by each of the stages that are fitted
    train, test = models.split(rows)
    return models.average_precision(models.probabilities(models.train_logistic(train), test))


#: Trees among which a count is chosen, and the step at which counts are compared; models whose count isn't chosen have one step.
TREES, STEP = 300, 25


def learned(spark, sf):
    """Training rows with their features and a label for each horizon, written once, and their days in order."""
    p = passages.labelled(context_of(spark, sf).drop("label", "progress", "ratio_prev3"))
    p = p.withColumns({f"y{k}": F.max("bunched").over(passages.trip_window().rowsBetween(1, k)).cast("int") for k in HORIZONS})
    rows = models.training_set(features.named(p.where("hw is not null and sched_hw <> 0")))
    rows = files.shared(rows.select(F.col("day").cast("string").alias("day"), "y", *[f"y{k}" for k in HORIZONS], *[F.col(c).cast("double").alias(c) for c in models.FEATURES]), "training")
    return rows, sorted(r[0] for r in rows.select("day").distinct().collect())


def test_days_of(rows):
    return {str(r[0]) for r in models.test_days(rows.withColumn("day", F.to_date("day"))).collect()}


HORIZONS = (3, 5, 10)


@BOOK.add("m05_train_trees")
def _(spark, sf):
    """Count of trees chosen by days left out, then average precision on the test days of the member that has learned from all others, at that count."""
    rows, days = learned(spark, sf)
    test = test_days_of(rows)
    train = [d for d in days if d not in test]
    count, curve, booster = boosting.choose_count(rows, models.FEATURES, train, "y", TREES, STEP)
    final = booster.stages.where((F.col("trees") == count) & (F.col("member") == len(train)))
    return final.agg(*[F.first(c).alias(c) for c in ("ap", "n", "positives")]).select("*", F.lit(count).alias("trees"), F.lit(max(curve)).alias("cross_ap"))


@BOOK.add("m10_learning_curve")
def _(spark, sf):
    """Average precision on the test days of models of the first 1, 2, ... training days, all grown from the same histograms."""
    rows, days = learned(spark, sf)
    test = test_days_of(rows)
    train = [d for d in days if d not in test]
    members = [boosting.Member(str(i + 1), frozenset(train[: i + 1]), "y") for i in range(len(train))]
    out = boosting.Booster(rows, models.FEATURES, members).fit(STEP).judged().where(F.col("day").isin(*test))
    return models.average_precision(out, ["member"]).select((F.col("member") + 1).alias("days"), "ap", "n", "positives")


@BOOK.add("m12_horizons")
def _(spark, sf):
    """Average precision of each horizon's models on the day that each has not seen; all horizons and days are grown together."""
    rows, days = learned(spark, sf)
    members = [boosting.Member(f"y{k}", frozenset(days) - {d}, f"y{k}") for k in HORIZONS for d in days]
    out = models.average_precision(boosting.Booster(rows, models.FEATURES, members).fit(STEP).judged(), ["member"])
    names = F.array(*[F.struct(F.lit(int(m.label[1:])).alias("stops_ahead"), F.lit(min(set(days) - m.days)).alias("day")) for m in members])
    return out.select(F.get(names, F.col("member")).alias("m"), "ap", "n", "positives").select("m.*", "ap", "n", "positives")


def stream(spark, sf):
    """Pings of the events stream: the batch derivation on a streaming source."""
    return adapter.pings_of(transit.read_events(spark, sf))


@BOOK.add("stream_dedup", sql("SELECT DISTINCT agency_id, vehicle_id, trip_id, stop_id, created_us FROM pings"))
def _(spark, sf):
    return transit.drained(transit.deduplicated(stream(spark, sf)).select(*transit.IDENTITY))


@BOOK.add("stream_snapshots", sql("SELECT min(created_us // 3600000000 * 3600000000) AS start_us, agency_id, vehicle_id, max(created_us) AS created_us, count(*) AS pings FROM pings GROUP BY created_us // 3600000000, agency_id, vehicle_id"))
def _(spark, sf):
    return transit.drained(transit.snapshots(transit.with_end(stream(spark, sf)))).where("vehicle_id is not null")


@BOOK.add("stream_stop_spans", sql("SELECT trip_id, vehicle_id, stop_id, min(created_us) AS t_first, max(created_us) AS t_pass FROM pings GROUP BY created_us // 86400000000, 1, 2, 3"))
def _(spark, sf):
    return transit.drained(transit.stop_spans(transit.with_end(stream(spark, sf)))).where("vehicle_id is not null")
