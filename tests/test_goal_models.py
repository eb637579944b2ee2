"""Goal models: the size they are trained at, their report against plain sums, and what explains them."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.operators import boosting, models

FEW = replace(models.TREES, rounds=4, step=0.3, bins=16)


@pytest.fixture(scope="module")
def features(spark):
    r = np.random.default_rng(5)
    rows = []
    for k in range(300):
        x = [None if r.random() < 0.1 else float(v) for v in r.random(len(models.WANTED)) * 3]
        rows.append((k, k // 2, int(r.poisson(0.5 + (x[0] or 0) / 2)), int(r.poisson(1.2)), *x))
    schema = "match_id long, day int, hg int, ag int, " + ", ".join(f"{c} double" for c in models.WANTED)
    return boosting.settled(spark.createDataFrame(rows, schema).withColumn("match_date", F.expr("timestamp '2020-01-01' + make_dt_interval(day)")).drop("day"))


def test_size_of_the_forest():
    assert (models.TREES.rounds, models.TREES.depth, models.TREES.step, models.TREES.l1, models.TREES.l2) == (200, 4, 0.05, 0.1, 1.0)


def test_report_against_plain_sums(features):
    got = {(r.model, r.scope): r for r in models.goal_model_report(features, FEW).collect()}
    assert set(got) == {(m, s) for m in ("poisson", "trees") for s in ("home", "away", "combined")}
    learn, held, names = models._parted(features)
    assert held.count() == 60 and learn.count() == 240 and held.agg(F.min("match_date")).first()[0] > learn.agg(F.max("match_date")).first()[0]
    rows = models.predict(models.train(learn, names, "trees", FEW), held, names).select("hg", "lambda_home").collect()
    errors = [r.lambda_home - r.hg for r in rows]
    report = got["trees", "home"]
    assert report.n == 60 and abs(report.mae - sum(map(abs, errors)) / 60) < 1e-6 and abs(report.bias - sum(errors) / 60) < 1e-6
    best = min(("poisson", "trees"), key=lambda m: got[m, "combined"].mae)
    assert {m for (m, _), r in got.items() if r.active} == {best}


def test_linear_factors_are_values_times_coefficients(features):
    learn, held, names = models._parted(features)
    fitted = models.train(learn, names)
    told = models.explain(fitted, held, names, n=len(names)).where("target = 'hg'").collect()
    assert len(told) == 60 * len(names)
    predicted = {r.match_id: r.lambda_home for r in models.predict(fitted, held, names).collect()}
    sums = {}
    for r in told:
        sums[r.match_id] = sums.get(r.match_id, fitted["hg"].stages[-1].intercept) + r.contribution
        assert abs(r.contribution - r.value * r.weight) < 1e-12
    assert all(abs(math.exp(sums[k]) - predicted[k]) < 1e-9 for k in predicted)


def test_tree_factors_add_up(features):
    learn, held, names = models._parted(features)
    forest = models.train(learn, names, "trees", FEW)
    constant = forest.base["ag"] + sum(t.value[1] for t in forest.trees["ag"])
    told = models.tree_factors(features, FEW, n=len(names)).where("target = 'ag'").collect()
    predicted = {r.match_id: r.lambda_away for r in models.predict(forest, held, names).collect()}
    sums = dict.fromkeys(predicted, constant)
    for r in told:
        sums[r.match_id] += r.contribution
        assert r.weight_impact.endswith("_positive") and r.impact.split("_")[1] == ("positive" if r.contribution >= 0 else "negative")
    assert all(abs(math.exp(sums[k]) - predicted[k]) < 1e-9 for k in predicted)
