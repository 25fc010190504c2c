"""Exact percentiles of few, large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and, for each name, the value at that share of the group's sorted values, interpolated between ranks; nulls don't count.

    Values are dealt to ranges by key and value, so that a group is sorted by many tasks: counts of ranges (a row a range and key) tell which ranges hold the
    ranks that are asked for, and only those are numbered.
    """
    v = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    ranged = v.repartitionByRange(*keys, "v").withColumn("part", F.spark_partition_id())
    n = ranged.groupBy(*keys, "part").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*keys)
    n = n.withColumns({"before": F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("n").over(group)})
    place = {name: F.lit(q) * (F.col("total") - 1) for name, q in shares.items()}
    holds = F.lit(False)
    for p in place.values():
        for rank in (F.floor(p), F.ceil(p)):
            holds = holds | ((rank >= F.col("before")) & (rank < F.col("before") + F.col("n")))
    r = ranged.join(F.broadcast(n.where(holds)), [*keys, "part"])
    r = r.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy(*keys, "part").orderBy("v")) - 1)
    at = lambda rank: F.max(F.when(F.col("rank") == rank, F.col("v")))
    out = r.groupBy(*keys).agg(*[c for name, p in place.items() for c in (at(F.floor(p)).alias(f"{name}_low"), at(F.ceil(p)).alias(f"{name}_high"))], F.max("total").alias("total"))
    return out.select(*keys, *[(F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (p - F.floor(p))).alias(name) for name, p in place.items()])
