"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, mixing; each stage takes all that the one before kept.

Counted as part of the llm subpackage. All stages keep rows with nulls unless their operator's docstring says otherwise, take any extra columns along and
give no rows for an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspan.llm import decontaminate, line_dedup, minhash, mixing, quality_model
from fleetspan.llm.common import saved, split_by, table

#: Shares of the mix's tokens by language.
TARGETS = mixing.TARGETS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts, null and empty texts by the score of an empty text. It learns from labelled documents of its input outside the held-out fold."""
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    return quality_model.accepted(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a smaller doc_id holds too."""
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id; of rows with one doc_id and text one stays. Rows with a null doc_id stay.

    Where rows of one doc_id have several texts, each text is a document of its own, under a number that follows the order of doc_id.
    """
    rows = docs.where("doc_id is not null").select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    if rows.groupBy("id").agg(F.min("h").alias("least"), F.max("h").alias("most")).where("least <> most").head(1):
        numbered = rows.select("id", "h").distinct().orderBy("id", "h").select("id", "h", F.monotonically_increasing_id().alias("number"))
        rows = saved(rows.join(saved(numbered, "near-numbers"), ["id", "h"]).select("row", F.col("number").alias("id")), "near-rows")
    verdicts = saved(minhash.near_duplicates(rows.select(F.col("id").alias("doc_id"), "row.text")).select(F.col("doc_id").alias("id"), "kept"), "near-verdicts")
    doubtful = verdicts.groupBy("id").agg(F.count("*").alias("n"), F.min("kept").alias("kept")).where("n > 1 or not kept").select("id")
    may_go, stay = split_by(rows, "id", doubtful)  # only rows that may go, or be one of several, are moved
    left = may_go.join(verdicts.where("kept").select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    return left.select("row.*").unionByName(stay.select("row.*")).unionByName(docs.where("doc_id is null"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their rate and n_copies in the mix, each row its own; those with no copies go."""
    own = [c for c in docs.columns if c not in ("n_tokens", "rate", "n_copies")]
    rows = mixing.mixed_rows(docs, table(spark, sf_dir, "labels"), TARGETS, kept=own)
    return rows.where("n_copies > 0").select(*[f"row.`{c}`" for c in own], "n_tokens", "rate", "n_copies")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_dedup", near_dedup),
    ("decontaminate", clean),
    ("mixing", mix),
]

#: SQL can't express the classifier; the stages are tested each against its operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each result but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = saved(docs, f"pipeline-{name}")
    return docs
