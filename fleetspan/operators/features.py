"""Context features of passages, and scores of stored linear models."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspan.functions import clock
from fleetspan.operators.passages import GROUP, TIES, trip_window

#: Microseconds of the line's recent past, and the clamp of ratios before a logarithm.
RECENT_US, CLAMP = 1_800_000_000, (0.05, 3.0)

#: Trees that a batch of rows walks together.
TREES_AT_ONCE = 64


def log_ratio(ratio: Column) -> Column:
    # greatest() and least() skip nulls, so those are kept apart
    return F.when(ratio.isNotNull(), F.log(F.least(F.lit(CLAMP[1]), F.greatest(F.lit(CLAMP[0]), ratio))))


def trip_history(p: DataFrame) -> DataFrame:
    """Gap changes a stop over 1, 3 and 5 stops, whether the leader changed, and the delay's change over 3 stops in minutes."""
    w = trip_window()
    close = {f"close{k}": (F.col("hw") - F.lag("hw", k).over(w)) / k for k in (1, 3, 5)}
    changed = F.when(F.row_number().over(w) > 1, (~F.col("leader_trip").eqNullSafe(F.lag("leader_trip").over(w))).cast("int"))
    return p.withColumns(close | {"leader_changed": changed, "delay_change3": (F.col("delay") - F.lag("delay", 3).over(w)) / 60})


def leader_state(p: DataFrame, mode: str = "line") -> DataFrame:
    """The leader's own ratio and gap trend at the same stop; needs trip_history()."""
    w = Window.partitionBy(*GROUP[mode]).orderBy(*TIES)
    return p.withColumns({"lead_ratio": F.lag("ratio").over(w), "lead_close3": F.lag("close3").over(w)})


def irregularity(p: DataFrame) -> DataFrame:
    """Mean size and count of the line's log ratios over the half hour strictly before each passage."""
    w = Window.partitionBy("day", "line", "direction_id").orderBy("t").rangeBetween(-RECENT_US, -1)
    dev = F.abs(log_ratio(F.col("ratio")))
    return p.withColumns({"line_irreg30": F.avg(dev).over(w), "line_n30": F.count(dev).over(w)})


def named(p: DataFrame) -> DataFrame:
    """The named feature values of a passage; missing ones stay null where the model knows how to fill them."""
    local = clock.local(F.col("t"))
    hour, raw = F.hour(local), F.try_divide("hw", "sched_hw")
    ratio = F.when(raw.isNotNull(), F.greatest(F.lit(0.0), raw))
    change = ratio - F.col("ratio_prev3")
    trend = F.when(change.isNotNull(), F.least(F.lit(3.0), F.greatest(F.lit(-3.0), change)))
    angle = (hour + F.minute(local) / 60) * (2 * math.pi / 24)
    return p.withColumns({
        "log_ratio": log_ratio(ratio),
        "trend": F.coalesce(trend, F.lit(0.0)),
        "delay_min": F.col("delay") / 60,
        "lead_delay_min": F.col("lead_delay") / 60,
        "sched_hw_min": F.col("sched_hw") / 60,
        "leader_log_ratio": log_ratio(F.col("lead_ratio")) if "lead_ratio" in p.columns else F.lit(None).cast("double"),
        "delay_gap_min": (F.col("lead_delay") - F.col("delay")) / 60,
        "prev_trip_delay_min": F.coalesce(F.col("prev_trip_delay") / 60, F.lit(0.0)),
        "peak_am": hour.between(7, 9).cast("int"),
        "peak_pm": hour.between(17, 19).cast("int"),
        "weekend": (F.weekday(local) >= 5).cast("int"),
        "log_gap": F.when(F.col("hw").isNotNull(), F.log(F.greatest(F.col("hw"), F.lit(5.0)) / 60)),
        "hour_sin": F.sin(angle),
        "hour_cos": F.cos(angle),
    })


def scoreable(mode: str = "line") -> Column:
    """Valid, not bunched yet, and far enough apart or staying together long enough to judge."""
    far = F.col("shared_next") >= 0.6 if mode == "corridor" else F.col("ratio") >= 0.5
    return F.coalesce(F.col("valid") & ~F.col("bunched") & far, F.lit(False))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.lit(50.0), F.greatest(F.lit(-50.0), z))))


def linear_score(model: dict[str, tuple[float, float, float]], intercept: float) -> Column:
    """Probability by a stored linear model: feature -> (coefficient, mean, deviation); a missing value counts as the mean."""
    z = F.lit(intercept)
    for name, (coef, mean, std) in model.items():
        z = z + F.lit(coef) * (F.coalesce(F.col(name).cast("double"), F.lit(mean)) - mean) / std
    return sigmoid(z)


def tree_score(trees: list[dict], names: list[str], baseline: float) -> Column:
    """Probability by stored trees: parallel lists f (number of the feature, -1 for a leaf), t (at most: left), m (missing goes left), l and r (children), v (a leaf's value).

    Trees are laid end to end in arrays that each worker gets once; a batch of rows walks all of them together, a level at a time, so a plan doesn't grow with the trees.
    """
    starts = np.cumsum([0, *[len(t["f"]) for t in trees]])
    join = lambda k, kind: np.concatenate([np.array(t[k], kind) for t in trees] or [np.zeros(0, kind)])
    shift = np.repeat(starts[:-1], np.diff(starts))
    f, t, m, v = join("f", np.int32), join("t", float), join("m", np.int8), join("v", float)
    left, right = join("l", np.int64) + shift, join("r", np.int64) + shift
    roots = starts[:-1]

    @F.pandas_udf("double")
    def chance(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns], 1)
        z = np.full(len(x), baseline)
        for begin in range(0, len(roots), TREES_AT_ONCE):
            at = np.broadcast_to(roots[begin : begin + TREES_AT_ONCE], (len(x), len(roots[begin : begin + TREES_AT_ONCE]))).copy()
            while (inner := f[at] >= 0).any():
                value = np.take_along_axis(x, np.maximum(f[at], 0), 1)
                at = np.where(inner, np.where(np.where(np.isnan(value), m[at] == 1, value <= t[at]), left[at], right[at]), at)
            z += v[at].sum(1)
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -50, 50))))

    return chance(*[F.col(c).cast("double") for c in names])


def scored(p: DataFrame, chance: Column, mode: str = "line") -> DataFrame:
    """All passages with prob: the model's chance where they can be judged, else null."""
    return p.withColumn("prob", F.when(scoreable(mode), chance))


def window_summary(p: DataFrame, keys: list[str], level: float) -> DataFrame:
    """Per key of scored(): trips, passages, bunched and scored ones, alerts from `level` on and those that came true."""
    alert = F.col("prob") >= level
    return p.groupBy(*keys).agg(F.countDistinct("day", "trip_id", "vehicle_id").alias("trips"), F.count("*").alias("passages"), F.count_if("bunched").alias("bunched"), F.count("prob").alias("scored"), F.count_if(alert).alias("alerts"), F.count_if(alert & F.col("label")).alias("came_true"))
