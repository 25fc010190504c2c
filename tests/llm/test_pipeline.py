"""The pipeline's stages, each against its operator on the stage's own input; and the queries' SQL."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetspan.llm import decontaminate, minhash, mixing, quality_model, queries
from fleetspan.llm.common import saved, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = saved(stage(spark, docs, SF), "test-stage")
        before, after = ({r.doc_id: r.text for r in d.collect()} for d in (docs, out))
        assert set(after) <= set(before) and (number == 4 or out.columns == columns)
        if name == "quality":
            assert set(after) == {r.doc_id for r in quality_model.scored(docs, table(spark, SF, "labels")).where("predicted = 1").collect()}
        elif name == "line_dedup":
            assert set(after) == set(before)
        elif name == "near_dedup":
            assert set(after) == {r.doc_id for r in minhash.near_duplicates(docs).where("kept").collect()}
        elif name == "decontaminate":
            assert set(after) == {r.doc_id for r in decontaminate.contamination(docs, table(spark, SF, "benchmark")).where("not contaminated").collect()}
        else:
            rated = mixing.mixed(docs, table(spark, SF, "labels")).collect()
            assert set(after) == {r.doc_id for r in rated if r.n_copies > 0} and out.columns == [*columns, "n_tokens", "rate", "n_copies"]
        docs = out


def test_stages_of_odd_rows(spark):
    rows = [(None, "no id but words enough to be a text of its own", None, None, None), (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, "a b c", None, "s", 5), (3, "a b c", None, "s", 5)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"_doc": F.lit(1), "rate": F.lit(2), "keys": F.lit(3)})
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() <= len(rows)
        assert stage(spark, odd.where("false"), SF).count() == 0


def test_rows_that_share_an_id_or_have_none(spark):
    first, second = (" ".join(f"{w}{i}" for i in range(40)) for w in "ab")
    rows = [(1, first), (5, first), (5, second), (5, second), (6, second), (None, first), (None, "one two three"), (None, "one two three"), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(1, first), (5, second), *((0, t) for i, t in rows if i is None)])
    # in the mix each row has tokens of its own
    got = corpus_pipeline.mix(spark, docs, SF).collect()
    assert len(got) == len(rows) and all(r.n_tokens == len(r.text.split()) for r in got)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(queries.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(str(r[c]) for c in cols) for r in got.collect()) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())
