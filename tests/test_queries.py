"""Every registered transit query against its DuckDB twin on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from fleetspan.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in ("events", "nation", "orders", "lineitem", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return repr(round(float(v), 4) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_twin(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert cols == sorted(want.columns)
    a = sorted(tuple(same(r[c]) for c in cols) for r in got.collect())
    at = [want.columns.index(c) for c in cols]
    b = sorted(tuple(same(r[i]) for i in at) for r in want.fetchall())
    assert a == b


def test_streams_and_models_without_twin_have_rows(spark):
    for name in ("x24_stop_paths", "j14_jam_match"):
        assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["m05_train_trees", "m05_train_logistic", "m10_learning_curve", "m12_horizons"])
def test_trained_models_judge_every_row_once(spark, name):
    """The trees themselves are compared with a plain booster in test_boosting.py."""
    from fleetspan.operators import models
    from fleetspan.plans import modelling

    rows = modelling.training(spark, SF)
    held_out = models.split(rows)[1].count()
    got = registry.QUERIES[name](spark, SF).collect()
    if name == "m12_horizons":
        assert sum(r.n for r in got if r.stops_ahead == 10) == rows.count() and len(got) == len({(r.stops_ahead, r.day) for r in got})
    else:
        assert {r.n for r in got} == {held_out}


def test_count_of_trees_is_chosen_among_all_that_the_library_tries(spark, monkeypatch):
    """25, 50, ... 300, as in the reference's training."""
    from fleetspan.operators import boosting

    tried, measured = [], boosting.Booster.measured
    monkeypatch.setattr(boosting.Booster, "measured", lambda self, counts: tried.append(counts) or measured(self, counts))
    got = registry.QUERIES["m05_train_trees"](spark, SF).first()
    assert tried == [list(range(25, 301, 25))] and got.trees in tried[0]


def test_logistic_training_works_out_its_rows_once(spark):
    """Fitting reads the training rows many times, so they are a table of their own."""
    assert not [f for f in registry.QUERIES["m05_train_logistic"](spark, SF).inputFiles() if f.endswith("events.parquet")]
