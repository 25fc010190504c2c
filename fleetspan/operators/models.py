"""Early-warning models: training sets, Spark ML training, alert tables, ranking measures and target encoding."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspan.functions.stats import percentiles
from fleetspan.operators.features import scoreable

#: Inputs of the same-line model, in its order.
FEATURES = [
    "log_ratio", "trend", "delay_min", "lead_delay_min", "sched_hw_min", "progress", "peak_am", "peak_pm", "weekend", "delay_gap_min", "prev_trip_delay_min",
    "hour_sin", "hour_cos", "leader_log_ratio", "line_irreg30", "line_n30", "leader_changed", "close1", "close3", "close5", "delay_change3", "lead_close3",
]


def training_set(p: DataFrame, mode: str = "line") -> DataFrame:
    """Scoreable passages with a label, which becomes 0 or 1."""
    return p.where(scoreable(mode) & F.col("label").isNotNull()).withColumn("y", F.col("label").cast("double"))


def test_days(p: DataFrame) -> DataFrame:
    """The last working day and the last weekend day."""
    return p.select("day").distinct().groupBy((F.weekday("day") >= 5).alias("weekend")).agg(F.max("day").alias("day")).select("day")


def split(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    days = F.broadcast(test_days(p))  # two rows
    return p.join(days, "day", "left_anti"), p.join(days, "day", "left_semi")


def _prepared(rows: DataFrame) -> list:
    """Stages that put a feature's mean in place of missing values (0 where none is there)."""
    means = numeric(rows).agg(*[F.coalesce(F.avg(F.nullif(F.col(c), F.lit(float("nan")))), F.lit(0.0)).alias(c) for c in FEATURES]).first()
    full = ", ".join(f"coalesce(nullif({c}, double('NaN')), {means[c]!r}D) AS {c}_full" for c in FEATURES)
    return [SQLTransformer(statement=f"SELECT *, {full} FROM __THIS__"), VectorAssembler(inputCols=[f"{c}_full" for c in FEATURES], outputCol="raw")]


def numeric(p: DataFrame) -> DataFrame:
    return p.withColumns({c: F.col(c).cast("double") for c in FEATURES})


def train_logistic(rows: DataFrame) -> PipelineModel:
    """Logistic regression on standardised features; missing values count as the mean."""
    return Pipeline(stages=[*_prepared(rows), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol="y", maxIter=30, regParam=1e-3)]).fit(numeric(rows))


def probabilities(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(numeric(rows)).withColumn("p", F.get(vector_to_array("probability"), F.lit(1)))


def alert_table(scored: DataFrame, levels: list[float]) -> DataFrame:
    """Per alert level: alerts, those that come true, precision, recall, alerts per 100. One aggregation counts all levels."""
    one = scored.agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("pos"), *[F.count_if(F.col("p") >= x).alias(f"a{i}") for i, x in enumerate(levels)], *[F.count_if((F.col("p") >= x) & (F.col("y") == 1)).alias(f"t{i}") for i, x in enumerate(levels)])
    rows = one.select("n", "pos", F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(f"a{i}").alias("alerts"), F.col(f"t{i}").alias("hits")) for i, x in enumerate(levels)])).alias("x")).select("n", "pos", "x.*")
    return rows.select("level", "alerts", "hits", (F.col("hits") / F.nullif("alerts", F.lit(0))).alias("precision"), (F.col("hits") / F.nullif("pos", F.lit(0))).alias("recall"), (100 * F.col("alerts") / F.col("n")).alias("per_100"))


def alert_budget(scored: DataFrame, per_100: list[float]) -> DataFrame:
    """The threshold that gives so many alerts per 100 passages."""
    q = percentiles(scored, [], "p", {f"q{i}": 1 - b / 100 for i, b in enumerate(per_100)})
    return q.select(F.explode(F.array(*[F.struct(F.lit(b).alias("per_100"), F.col(f"q{i}").alias("threshold")) for i, b in enumerate(per_100)])).alias("x")).select("x.*")


def roc_auc(scored: DataFrame) -> DataFrame:
    """One row: the chance that a positive scores above a negative, equal scores counting half. Scores are dealt to ranges as in average_precision()."""
    r = _ranged(scored)
    below = F.col("all_neg") - F.col("cn") + F.col("cp")  # negatives scored lower, from running sums over descending scores
    won = F.sum(F.col("pos") * (below + (F.col("n") - F.col("pos")) / 2))
    g = r.withColumn("all_neg", F.lit(0)).agg(F.sum("pos").alias("positives"), F.sum(F.col("n") - F.col("pos")).alias("negatives"), won.alias("w"))
    pairs = F.col("positives") * F.col("negatives")
    return g.select(((F.col("w") + pairs) / F.nullif(pairs, F.lit(0))).alias("auc"), "positives", "negatives")


def _ranged(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, p, n, pos, and over descending scores of each key running sums cn and cp of n and pos. Scores are dealt to ranges, so running sums need no single task."""
    keys = keys or []
    g = scored.groupBy(*keys, "p").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("pos"))
    g = g.repartitionByRange(*keys, F.desc("p")).withColumn("part", F.spark_partition_id())
    parts = g.groupBy(*keys, "part").agg(F.sum("n").alias("pn"), F.sum("pos").alias("pp"))
    order = Window.partitionBy(*keys).orderBy("part")  # as many rows as partitions
    parts = parts.select(*keys, "part", (F.sum("pn").over(order) - F.col("pn")).alias("n0"), (F.sum("pp").over(order) - F.col("pp")).alias("p0"))
    w = Window.partitionBy(*keys, "part").orderBy(F.desc("p"))
    return g.join(F.broadcast(parts), [*keys, "part"]).withColumns({"cn": F.col("n0") + F.sum("n").over(w), "cp": F.col("p0") + F.sum("pos").over(w)})


def average_precision(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row, or one a key: average precision with equal scores taken together."""
    ap = F.sum(F.col("pos") * F.col("cp") / F.col("cn")) / F.nullif(F.sum("pos"), F.lit(0))
    return _ranged(scored, keys).groupBy(*keys or []).agg(ap.alias("ap"), F.sum("n").alias("n"), F.sum("pos").alias("positives"))


def target_encoding(p: DataFrame, keys: list[str], y: Column, prior: float = 200) -> DataFrame:
    """Per key and day the logit of the label's smoothed rate over all other days."""
    d = p.groupBy(*keys, "day").agg(F.count("*").alias("n"), F.sum(y.cast("double")).alias("s"))
    w = Window.partitionBy(*keys)
    base = p.agg(F.avg(y.cast("double")).alias("base"))
    d = d.withColumns({"on": F.sum("n").over(w) - F.col("n"), "os": F.sum("s").over(w) - F.col("s")}).crossJoin(F.broadcast(base))  # one row
    rate = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), (F.col("os") + prior * F.col("base")) / (F.col("on") + prior)))
    return d.select(*keys, "day", F.log(rate / (1 - rate)).alias("logit"))


def screening(p: DataFrame, feature: str, bins: list[float]) -> DataFrame:
    """Rate of the label by bins of a feature."""
    b = F.lit(0)
    for x in bins:
        b = b + (F.col(feature) >= x).cast("int")
    return p.where(F.col(feature).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("y").alias("rate"))
