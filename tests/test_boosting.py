"""Boosted trees against a plain numpy version that keeps all rows in memory, and what explains them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.operators import boosting, impacts

NAMES = ["a", "b", "c"]
SMALL = boosting.Settings(rounds=6, depth=3, step=0.3, bins=16)


def plain(x, y, cuts, s):
    """Margins after all rounds: every node looks at its own rows, every feature, cut (known against unknown, too) and side for
    unknown values."""
    first = math.log(y.mean())
    margin = np.full(len(y), first)

    def weight(g, h):
        shrunk = np.sign(g) * max(abs(g) - s.l1, 0)
        return s.step * min(max(-shrunk / (h + s.l2), -s.damp), s.damp)

    def score(g, h):
        return max(abs(g) - s.l1, 0) ** 2 / (h + s.l2)

    def grow(rows, depth, g, h, out):
        out[rows] = weight(g[rows].sum(), h[rows].sum())
        if depth == 0:
            return
        best = (1e-9, None)
        for f in range(x.shape[1]):
            for cut in (*cuts[f], np.inf):
                for left_too in (False, True):
                    known = ~np.isnan(x[rows, f])
                    left = np.where(known, x[rows, f] <= cut, left_too)
                    l, r = rows[left], rows[~left]
                    if min(h[l].sum(), h[r].sum()) < s.least:
                        continue
                    gain = score(g[l].sum(), h[l].sum()) + score(g[r].sum(), h[r].sum()) - score(g[rows].sum(), h[rows].sum())
                    if gain > best[0] + 1e-12:
                        best = (gain, (l, r))
        if best[1]:
            for part in best[1]:
                grow(part, depth - 1, g, h, out)

    for _ in range(s.rounds):
        rate = np.exp(margin)
        g = np.rint((rate - y) * boosting.UNIT) / boosting.UNIT
        h = np.rint(rate * math.exp(s.damp) * boosting.UNIT) / boosting.UNIT
        out = np.zeros(len(y))
        grow(np.arange(len(y)), s.depth, g, h, out)
        margin = margin + out
    return margin


def table(n=400, seed=3):
    r = np.random.default_rng(seed)
    x = np.column_stack([r.normal(size=n), r.integers(0, 9, n).astype(float), r.random(n)])
    x[r.random(n) < 0.15, 0] = np.nan
    x[r.random(n) < 0.1, 2] = np.nan
    y = r.poisson(np.exp(0.3 + 0.5 * np.nan_to_num(x[:, 0], nan=-1.0) - 0.1 * x[:, 1])).astype(float)
    return x, y


@pytest.fixture(scope="module")
def given(spark):
    x, y = table()
    rows = [(k, *[None if math.isnan(v) else float(v) for v in x[k]], float(y[k]), float(y[k] % 2)) for k in range(len(y))]
    return x, y, spark.createDataFrame(rows, "k long, a double, b double, c double, y double, z double").repartition(5)


@pytest.fixture(scope="module")
def forest(given):
    return boosting.fit(given[2], NAMES, ["y", "z"], SMALL)


def test_equals_the_plain_version(given, forest):
    x, y, rows = given
    got = {r.k: r.p for r in rows.select("k", boosting.rates(forest, "y").alias("p")).collect()}
    want = np.exp(plain(x, y, forest.cuts, SMALL))
    assert np.allclose([got[k] for k in range(len(y))], want, rtol=1e-9)
    other = np.exp(plain(x, y % 2, forest.cuts, SMALL))
    got = {r.k: r.p for r in rows.select("k", boosting.rates(forest, "z").alias("p")).collect()}
    assert np.allclose([got[k] for k in range(len(y))], other, rtol=1e-9)


def test_partitions_and_checkpoints_change_nothing(given, forest, monkeypatch):
    monkeypatch.setattr(boosting, "EVERY", 2)
    monkeypatch.setattr(boosting, "TASK_ROWS", 50)
    again = boosting.fit(given[2].repartition(4), NAMES, ["y", "z"], SMALL)
    assert again.to_json() == forest.to_json()


def test_contributions_add_up(given, forest):
    parts = F.aggregate(boosting.contributions(forest, "y"), F.lit(0.0), lambda a, b: a + b)
    for r in given[2].select(parts.alias("s"), boosting.rates(forest, "y").alias("p")).collect():
        assert abs(math.exp(r.s) - r.p) < 1e-9


def test_factors_rank_by_size(given, forest):
    found = boosting.factors(forest, given[2], ["k"], impacts.of_contribution, n=2).collect()
    by = {}
    for r in found:
        by.setdefault((r.k, r.target), []).append(r)
    assert all(sorted(r.rank for r in x) == list(range(1, len(x) + 1)) and len(x) <= 2 for x in by.values())
    for x in by.values():
        sizes = [abs(r.contribution) for r in sorted(x, key=lambda r: r.rank)]
        assert sizes == sorted(sizes, reverse=True)
    assert {t for _, t in by} == {"y", "z"}
    shares = boosting.importances(forest, "y")
    assert abs(sum(shares.values()) - 1) < 1e-9 and shares["a"] > shares["c"]


def test_saved_and_read(forest):
    assert boosting.Forest.from_json(forest.to_json()) == forest


def test_no_rows_constants_and_counts_below_zero(spark):
    schema = "a double, y double"
    none = boosting.fit(spark.createDataFrame([(1.0, None)], schema), ["a"], ["y"], SMALL)
    assert none.trees == {"y": []} and none.base["y"] == math.log(1e-6)
    same = boosting.fit(spark.createDataFrame([(1.0, 2.0)] * 50, schema), ["a"], ["y"], SMALL)
    assert all(t.feature == [-1] * 16 for t in same.trees["y"])
    rows = spark.createDataFrame([(None, 1.0)], schema)
    assert abs(rows.select(boosting.rates(same, "y")).first()[0] - 2.0) < 1e-3
    with pytest.raises(ValueError):
        boosting.fit(spark.createDataFrame([(1.0, -2.0)], schema), ["a"], ["y"], SMALL)


def test_impact_words(spark):
    rows = spark.createDataFrame([(0.5, 1.0, None), (-0.3, 1.0, 1.0), (0.0, 0.0, 0.0), (None, 1.0, 1.0)], "c double, r double, b double")
    got = [tuple(r) for r in rows.select(impacts.of_rate(F.col("c"), F.col("r"), F.col("b")), impacts.of_value(F.col("c"), F.col("b")), impacts.of_value(F.col("c"), F.col("b"), True), impacts.of_contribution(F.col("c")), impacts.of_importance(F.col("c"))).collect()]
    assert got[0] == ("high_positive", "neutral", "neutral", "high_positive", "high_positive")
    assert got[1] == ("medium_negative", "high_negative", "high_positive", "medium_negative", "high_positive")
    assert got[2] == ("low_positive", "neutral", "neutral", "low_positive", "low_positive")
    assert got[3] == (None,) * 5


def test_a_level_is_one_job_of_one_stage(spark, given):
    context = spark.sparkContext
    context.setJobGroup("levels", "levels of trees")
    try:
        boosting.fit(given[2], NAMES, ["y", "z"], SMALL)
    finally:
        context.setJobGroup("", "")
    jobs = [context.statusTracker().getJobInfo(k) for k in context.statusTracker().getJobIdsForGroup("levels")]
    levels = SMALL.rounds * SMALL.depth
    assert levels <= sum(len(j.stageIds) == 1 for j in jobs) and len(jobs) <= levels + 12


def test_transposed_walk_equals_a_plain_one():
    r = np.random.default_rng(2)
    bins = r.choice([0, 3, 7, boosting.UNKNOWN], size=(2, 50)).astype(np.uint8)
    tree = boosting.Tree([-1, 0, 1, -1, *[-1] * 4], [0, 3, 0, *[0] * 5], [False, True, False, *[False] * 5], [0.0] * 8, [0.0] * 8)
    for k, node in enumerate(boosting._nodes(tree, bins, 2)):
        a, b = (int(x) for x in bins[:, k])
        assert node == ((4 if b <= 0 else 5) if a <= 3 or a == boosting.UNKNOWN else 3)
