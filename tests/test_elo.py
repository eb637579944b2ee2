"""Elo as a sorted fold and as a stream, against a plain loop."""

import datetime
import random

from pitchlake.operators import rating
from pitchlake.streaming import elo

START = datetime.datetime(2020, 1, 1)


def matches(n=160, seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        home, away = rng.sample(range(6), 2)
        done = rng.random() < 0.8
        score = (rng.randrange(4), rng.randrange(4)) if done else (None, None)
        rows.append((rng.choice([1, 2, 2, 2, None]), k, START + datetime.timedelta(days=rng.randrange(30)), home, away, *score))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "competition_id long, match_id long, match_date timestamp_ntz, home_team_id long, away_team_id long, hg long, ag long")


def plain(rows):
    out, ratings = {}, {}
    for day in sorted({r[2] for r in rows}):
        now = sorted((r for r in rows if r[2] == day), key=lambda r: r[1])
        for c, k, _, h, a, *_ in now:
            out[k] = (ratings.get((c, h), 1500.0), ratings.get((c, a), 1500.0))
        for c, _, _, h, a, hg, ag in now:
            if hg is not None:
                rh, ra = ratings.get((c, h), 1500.0), ratings.get((c, a), 1500.0)
                change = 20 * ((1.0 if hg > ag else 0.5 if hg == ag else 0.0) - rating.expected(rh, ra))
                ratings[c, h], ratings[c, a] = rh + change, ra - change
    return out


def rounded(rows):
    return {r.match_id: (round(r.home_elo, 9), round(r.away_elo, 9)) for r in rows}


def test_fold_equals_a_plain_loop(spark):
    rows = matches()
    want = {k: (round(h, 9), round(a, 9)) for k, (h, a) in plain(rows).items()}
    assert rounded(rating.elo_ratings(frame(spark, rows).repartition(5)).collect()) == want
    assert rating.elo_ratings(frame(spark, [])).collect() == []


def test_stream_goes_on_from_its_state(spark, tmp_path):
    rows = matches(seed=4)
    order = sorted(rows, key=lambda r: (r[2], r[1]))
    middle = order[80][2]
    shared = [r for r in order if r[2] == middle]
    parts = [[r for r in order if r[2] < middle], shared[: len(shared) // 2], shared[len(shared) // 2 :] + [r for r in order if r[2] > middle]]
    late = (2, 999, START - datetime.timedelta(days=9), 0, 1, 3, 0)
    for part in (*parts, [late]):
        elo.rows_of(frame(spark, part)).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
        elo.run(spark, str(tmp_path / "landing"), str(tmp_path / "out"), str(tmp_path / "offsets")).awaitTermination()
    # A run without new files adds nothing.
    elo.run(spark, str(tmp_path / "landing"), str(tmp_path / "out"), str(tmp_path / "offsets")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == len(rows) + 1 and [r.match_id for r in got if r.late] == [999]
    assert rounded(r for r in got if not r.late) == {k: (round(h, 9), round(a, 9)) for k, (h, a) in plain(rows).items()}
