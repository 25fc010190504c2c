"""Boosted trees against a booster of one process, and stored trees against a walk of each row."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspan.operators import boosting, features, models

NAMES = ["a", "b", "c"]
HOW = {"rate": 0.3, "leaves": 6, "least_rows": 8, "ridge": 1.0}
DAYS = ["2024-01-01", "2024-01-02", "2024-01-03"]


def data(n=400, seed=1):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 3)) * 3) / 2
    y = (r.random(n) < 1 / (1 + np.exp(-(x[:, 0] - x[:, 1] * x[:, 2])))).astype(int)
    x[r.random((n, 3)) < 0.15] = np.nan
    return [(DAYS[i % 3], *[None if math.isnan(v) else float(v) for v in x[i]], int(y[i]), int(y[i]) if i % 5 else None) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "day string, a double, b double, c double, y int, y5 int")


def plain(rows, label, trees):
    """Raw scores of all rows by a booster that tries every split of every leaf on the rows themselves, best first."""
    x = np.array([[np.nan if v is None else v for v in r[1:4]] for r in rows], float)
    given = [r[label] for r in rows]
    learn = np.array([v is not None for v in given])
    y = np.array([v or 0 for v in given])
    p0 = y[learn].mean()
    raw = np.full(len(rows), math.log(p0 / (1 - p0)))
    worth = lambda g, h: g * g / (h + HOW["ridge"])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = np.rint((p - y) / boosting.UNIT) * boosting.UNIT, np.rint(p * (1 - p) / boosting.UNIT) * boosting.UNIT

        def best(rows_in):
            found = None
            mine = rows_in & learn
            for f in range(3):
                v = x[:, f]
                for t in sorted(set(v[mine & ~np.isnan(v)])):
                    for missing in (False, True) if np.isnan(v[mine]).any() else (False,):
                        left = np.where(np.isnan(v), missing, v <= t)
                        a, b = mine & left, mine & ~left
                        if min(a.sum(), b.sum()) < HOW["least_rows"]:
                            continue
                        gain = worth(g[a].sum(), h[a].sum()) + worth(g[b].sum(), h[b].sum()) - worth(g[mine].sum(), h[mine].sum())
                        if gain > (found[0] if found else 0) + 1e-9:
                            goes = missing if np.isnan(v[mine]).any() else a.sum() > b.sum()
                            found = (gain, np.where(np.isnan(v), goes, v <= t))
            return found

        leaves = [np.ones(len(rows), bool)]
        options = [best(leaves[0])]
        while len(leaves) < HOW["leaves"] and any(options):
            i = max(range(len(leaves)), key=lambda k: options[k][0] if options[k] else -1)
            _, left = options[i]
            parts = leaves[i] & left, leaves[i] & ~left
            leaves[i : i + 1], options[i : i + 1] = parts, [best(q) for q in parts]
        for q in leaves:
            m = q & learn
            raw[q] -= HOW["rate"] * g[m].sum() / (h[m].sum() + HOW["ridge"])
    return 1 / (1 + np.exp(-raw))


@pytest.mark.parametrize("partitions", [1, 5])
def test_trees_equal_a_plain_booster(spark, partitions):
    rows = data()
    df = table(spark, rows).repartition(partitions)
    b = boosting.Booster(df, NAMES, [boosting.Member("y", frozenset(DAYS), "y"), boosting.Member("y5", frozenset(DAYS), "y5")], **HOW).fit(3)
    for j, label in enumerate((4, 5)):
        model = b.model(j)
        got = table(spark, rows).coalesce(1).withColumn("p", features.tree_score(model["trees"], NAMES, model["baseline"]))
        assert np.allclose([r.p for r in got.collect()], plain(rows, label, 3), atol=1e-6)
        assert all(len([f for f in t["f"] if f < 0]) <= HOW["leaves"] for t in model["trees"])


def test_a_split_may_part_all_values_from_missing_ones(spark):
    rows = [(DAYS[i % 3], None if i % 3 else float(i), None, 1.0 if i % 2 else None, int(i % 3 > 0) if i % 11 else 0, None) for i in range(1200)]  # more values than bins
    model = boosting.Booster(table(spark, rows), NAMES, [boosting.Member("y", frozenset(DAYS), "y")], **HOW).fit(3).model(0)
    assert model["trees"][0]["f"][0] == 0 and model["trees"][0]["t"][0] == math.inf
    got = table(spark, rows).coalesce(1).withColumn("p", features.tree_score(model["trees"], NAMES, model["baseline"]))
    assert np.allclose([x.p for x in got.collect()], plain(rows, 4, 3), atol=1e-6)


def test_members_learn_only_from_their_days(spark, monkeypatch):
    monkeypatch.setattr(boosting, "SAVED_EVERY", 2)
    rows = data()
    members = [boosting.Member(d, frozenset(DAYS) - {d}, "y") for d in DAYS] + [boosting.Member("all", frozenset(DAYS), "y")]
    together = boosting.Booster(table(spark, rows).repartition(3), NAMES, members, **HOW).fit(3)
    for j in (0, 3):
        alone = boosting.Booster(table(spark, rows), NAMES, [members[j]], **HOW).fit(3)
        assert alone.model(0) == together.model(j)
    out = together.judged()
    assert {(r.member, r.day): r["count"] for r in out.groupBy("member", "day").count().collect()} == {(j, d): sum(r[0] == d for r in rows) for j, d in enumerate(DAYS)}
    score = features.tree_score(together.model(0)["trees"], NAMES, together.model(0)["baseline"])
    want = sorted(r.p for r in table(spark, rows).where(F.col("day") == DAYS[0]).select(score.alias("p")).collect())
    assert np.allclose(sorted(r.p for r in out.where("member = 0").collect()), want, atol=1e-9)


def test_count_of_trees_is_the_best_of_the_days_left_out(spark):
    count, curve, b = boosting.choose_count(table(spark, data()), NAMES, DAYS, "y", 4, 2, **HOW)
    assert count == 2 * (1 + int(np.argmax(curve))) and len(curve) == 2 and all(0.4 < a <= 1 for a in curve)
    one = models.average_precision(b.judged().where("member = 1")).first().ap
    assert abs({r.member: r.ap for r in models.average_precision(b.judged(), ["member"]).collect()}[1] - one) < 1e-12


def test_one_task_a_member_gives_the_trees_of_levels(spark, monkeypatch):
    monkeypatch.setattr(boosting, "SAVED_EVERY", 2)
    rows = data(600, 3)
    members = [boosting.Member(d, frozenset(DAYS) - {d}, "y") for d in DAYS] + [boosting.Member("y5", frozenset(DAYS[:2]), "y5", frozenset(DAYS[2:])), boosting.Member("none", frozenset(), "y")]
    found = []
    for most, part in ((1 << 22, 50), (0, 50)):  # histograms of several parts, and levels of all members
        monkeypatch.setattr(boosting, "TASK_ROWS", most)
        monkeypatch.setattr(boosting, "PART", part)
        b = boosting.Booster(table(spark, rows).repartition(3), NAMES, members, **HOW)
        measured = sorted(map(tuple, b.measured([1, 3]).collect()))
        found.append((b.trees, sorted(map(tuple, b.judged().collect())), measured))
    assert found[0] == found[1] and len(found[0][0][0]) == 3 and {(t, m) for t, m, *_ in found[0][2]} == {(t, m) for t in (1, 3) for m in range(5)}


def test_judged_after_earlier_trees_equals_shorter_models(spark):
    members = [boosting.Member(d, frozenset(DAYS) - {d}, "y") for d in DAYS]
    b = boosting.Booster(table(spark, data()), NAMES, members, **HOW).fit(4)
    for n in (1, 4):
        short = boosting.Booster(table(spark, data()), NAMES, members, **HOW).fit(n)
        assert sorted(map(tuple, b.judged(at=[1, 4]).where(F.col("trees") == n).drop("trees").collect())) == sorted(map(tuple, short.judged().collect()))
    with pytest.raises(ValueError):
        b.judged(at=[5])


def test_jobs_do_not_grow_with_trees(spark):
    jobs = []
    for trees in (1, 6):
        b = boosting.Booster(table(spark, data()), NAMES, [boosting.Member("y", frozenset(DAYS), "y")], **HOW)
        spark.sparkContext.setJobGroup(f"trees {trees}", "")
        b.fit(trees)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trees {trees}")))
        spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1] > 0 and len(b.trees[0]) == 6


def test_one_class_and_no_values(spark):
    rows = [(DAYS[0], None, 1.0, None, 1, None)] * 30
    b = boosting.Booster(table(spark, rows), NAMES, [boosting.Member("y", frozenset(DAYS), "y"), boosting.Member("none", frozenset(), "y5")], **HOW).fit(1)
    assert [t["f"] for t in b.trees[0]] == [[-1]] and b.baseline[1] == 0


def forest(n, depth, seed):
    r = np.random.default_rng(seed)
    trees = []
    for _ in range(n):
        inner = 2**depth - 1
        size = 2 * inner + 1
        trees.append({"f": [int(r.integers(3)) if i < inner else -1 for i in range(size)], "t": [float(r.normal()) for _ in range(size)], "m": [int(r.integers(2)) for _ in range(size)], "l": [2 * i + 1 if i < inner else 0 for i in range(size)], "r": [2 * i + 2 if i < inner else 0 for i in range(size)], "v": [float(r.normal()) / n for _ in range(size)]})
    return trees


@pytest.mark.parametrize("n,depth", [(0, 1), (5, 3), (300, 5)])
def test_stored_trees_equal_a_walk(spark, n, depth):
    trees, rows = forest(n, depth, 7), data(60)
    got = [r.p for r in table(spark, rows).coalesce(1).select(features.tree_score(trees, NAMES, 0.1).alias("p")).collect()]
    for r, p in zip(rows, got, strict=True):
        z = 0.1
        for t in trees:
            i = 0
            while t["f"][i] >= 0:
                v = r[1 + t["f"][i]]
                i = (t["l"] if (t["m"][i] if v is None else v <= t["t"][i]) else t["r"])[i]
            z += t["v"][i]
        assert abs(p - 1 / (1 + math.exp(-z))) < 1e-9
