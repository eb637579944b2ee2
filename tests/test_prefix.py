"""Prefix scans against plain sums."""

import random
import re

from pyspark.sql import functions as F

from pitchlake.operators import prefix


def rows_of(seed=2, n=300):
    rng = random.Random(seed)
    moments = [rng.randrange(-(1 << 50), 1 << 52) for _ in range(40)] + [5, 6, 1 << 36, (1 << 36) + 1, 1 << 46]
    return [(rng.choice(["hot", "hot", "hot", "b", None]), k, rng.choice(moments), rng.choice([None, 1, 2, 7]), rng.random() < 0.7) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, id long, at long, v long, done boolean").repartition(3)


def test_sums_before_each_moment(spark):
    rows = rows_of()
    got = prefix.with_sums_before(frame(spark, rows), ["k"], F.col("at"), {"total": F.col("v"), "rows": F.lit(1)}).collect()
    want = {(i, sum(o[3] or 0 for o in rows if o[0] == k and o[2] < at), sum(o[0] == k and o[2] < at for o in rows)) for k, i, at, *_ in rows}
    assert {(r.id, r.total, r["rows"]) for r in got} == want and len(got) == len(rows)
    every = prefix.with_sums_before(frame(spark, rows), [], F.col("at"), {"total": F.col("v")}).collect()
    assert {(r.id, r.total) for r in every} == {(i, sum(o[3] or 0 for o in rows if o[2] < at)) for _, i, at, *_ in rows}
    assert prefix.with_sums_before(frame(spark, []), ["k"], F.col("at"), {"total": F.col("v")}).collect() == []


def test_mean_of_the_last_done_rows(spark):
    rows = [r[:3] + (r[3] or 0,) + r[4:] for r in rows_of(seed=5)]
    for n in (1, 4, 500):
        got = prefix.mean_of_last(frame(spark, rows), ["k"], F.col("at"), ["id"], F.col("done"), {"mean": F.col("v")}, n).collect()
        assert len(got) == len(rows)
        for r in got:
            before = [o[3] for o in sorted(rows, key=lambda o: (o[2], o[1])) if o[0] == r.k and o[2] < r.at and o[4]][-n:]
            assert r.n_seen == len(before) and (r["mean"] is None) == (not before)
            assert not before or abs(r["mean"] - sum(before) / len(before)) < 1e-12


def test_no_window_sees_all_rows_of_a_key(spark):
    plan = prefix.with_sums_before(frame(spark, rows_of()), ["k"], F.col("at"), {"n": F.lit(1)})._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    parts = [re.search(r"\], \[([^\]]*)\], \[", w).group(1).count("#") for w in windows]
    assert sorted(parts) == [1, 2, 2]  # only the scan over ranges of 814 days goes by the key alone
