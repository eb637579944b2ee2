"""History, ratings, probabilities and grades against plain Python on random schedules with shared kickoffs."""

import math
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pitchlake.operators import evaluation, grading, history, models, players, poisson, rating, reports, resolve, sides, validate
from pitchlake.sources import commits
from pitchlake.streaming import live, rate

SCHEMA = "match_id long, competition_id long, season long, match_date timestamp_ntz, home_team_id long, away_team_id long, status string, hg long, ag long, hht long, aht long"


def schedule(seed, n=120, teams=5):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        h, a = rng.sample(range(teams), 2)
        done = rng.random() < 0.85
        goals = (rng.randrange(4), rng.randrange(4)) if done else (None, None)
        rows.append((k, k % 2, 2020, datetime(2020, 1, 1) + timedelta(days=rng.randrange(25)), h, a, "finished" if done else "scheduled", *goals, *([0, 0] if done else [None, None])))
    return rows


def reference(rows):
    """goals_for means of 3 and 10, the decayed mean, the number of matches before, and ratings: as the fold says it."""
    out, past, elo = {}, {}, {}
    ordered = sorted(rows, key=lambda r: (r[3], r[0]))
    for when in sorted({r[3] for r in rows}):
        group = [r for r in ordered if r[3] == when]
        for r in group:
            for venue, team in (("home", r[4]), ("away", r[5])):
                seen = past.get((r[1], team), [])
                last = seen[-10:]
                weights = [0.82**d for d in range(len(last) - 1, -1, -1)]
                out[r[0], venue] = (len(seen), sum(seen[-3:]) / len(seen[-3:]) if seen else None, sum(last) / len(last) if last else None, sum(v * w for v, w in zip(last, weights)) / sum(weights) if last else None, elo.get((r[1], team), 1500.0))
        for r in group:
            if r[7] is None:
                continue
            h, a = (r[1], r[4]), (r[1], r[5])
            past.setdefault(h, []).append(r[7])
            past.setdefault(a, []).append(r[8])
            rh, ra = elo.get(h, 1500.0), elo.get(a, 1500.0)
            change = 20 * ((1.0 if r[7] > r[8] else 0.5 if r[7] == r[8] else 0.0) - 1 / (1 + 10 ** ((ra - rh - 65) / 400)))
            elo[h], elo[a] = rh + change, ra - change
    return out


def close(a, b):
    return a is b is None or (a is not None and b is not None and math.isclose(a, b, abs_tol=1e-9))


@pytest.mark.parametrize("seed", [1, 2])
def test_history_and_ratings(spark, seed):
    rows = schedule(seed)
    random.Random(seed).shuffle(rows)
    m = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = reference(rows)
    s = sides.sides(m).withColumns({c: F.lit(None).cast("long") for c in ("shots", "shots_on_target", "corners", "cards", "fouls")})
    got = {(r.match_id, r.venue): r for r in history.side_features(s).collect()}
    ratings = {r.match_id: r for r in rating.elo_ratings(m).collect()}
    assert len(got) == 2 * len(rows)
    for key, (n, a3, a10, weighted, elo) in want.items():
        r = got[key]
        assert r.history_matches == n and close(r.goals_for_avg_3, a3) and close(r.goals_for_avg_10, a10) and close(r.goals_for_recency_weighted_10, weighted)
        assert close(ratings[key[0]][f"{key[1]}_elo"], elo)
        assert r.data_completeness == 0 and r.shots_avg_5 is None


def test_future_results_change_nothing(spark):
    rows = schedule(3)
    future = (999, 0, 2020, datetime(2021, 1, 1), 0, 1, "finished", 99, 99, 0, 0)
    one, two = (history.match_features(m, sides.sides(m).withColumns({c: F.lit(None).cast("long") for c in ("shots", "shots_on_target", "corners", "cards", "fouls")})) for m in (spark.createDataFrame(r, SCHEMA) for r in (rows, [*rows, future])))
    cols = ["match_id", "home_goals_for_avg_5", "league_home_goals_avg", "feature_quality_score"]
    assert {tuple(r) for r in one.select(*cols).collect()} == {tuple(r) for r in two.where("match_id < 999").select(*cols).collect()}
    assert history.leaks(two).count() == 0


def test_markets_are_coherent(spark):
    rates = spark.createDataFrame([(1, 1.4, 1.1), (2, 0.0, 0.0), (3, 5.0, 0.2)], "match_id long, lambda_home double, lambda_away double")
    for r in poisson.markets(rates).collect():
        assert math.isclose(r.home_win + r.draw + r.away_win, 1, abs_tol=1e-9)
        assert 1 >= r.over_0_5 >= r.over_1_5 >= r.over_2_5 >= r.over_3_5 >= r.over_4_5 >= 0
    raw = [[math.exp(-2.5) * 1.4**i * 1.1**j / math.factorial(i) / math.factorial(j) for j in range(9)] for i in range(9)]
    total = sum(map(sum, raw))
    one = poisson.markets(rates).where("match_id = 1").first()
    assert math.isclose(one.over_2_5, sum(raw[i][j] for i in range(9) for j in range(9) if i + j > 2) / total, abs_tol=1e-9)
    assert math.isclose(one.home_win, sum(raw[i][j] for i in range(9) for j in range(i)) / total, abs_tol=1e-9)
    top = poisson.top_scorelines(rates.where("match_id = 2"), 2).collect()
    assert (top[0].home_goals, top[0].away_goals, top[0].probability) == (0, 0, 1.0)


def test_grading_and_metrics(spark):
    rates = spark.createDataFrame([(1, 2.5, 0.5, None, None), (2, 0.4, 0.4, 3.0, 12.0)], "match_id long, lambda_home double, lambda_away double, x double, y double")
    p = grading.with_tails(poisson.markets(rates.withColumns({f"{v}_{m}_avg_10": F.col(c) / 2 for v in ("home", "away") for m, c in (("cards", "x"), ("corners", "y"))})))
    results = spark.createDataFrame([(1, 3, 0), (2, 1, 1)], "match_id long, hg long, ag long")
    stats = spark.createDataFrame([(2, 3, 1, 9)], "match_id long, yellow_cards long, red_cards long, corners long")
    rows = grading.outcomes(p, results, stats)
    by = {(r.match_id, r.event_type): r for r in rows.collect()}
    assert by[1, "match_result"].status == "correct" and (1, "cards_over_3_5") not in by and by[2, "cards_over_3_5"].actual == "true"
    assert grading.outcomes(p, results, stats, rows.select("match_id", "event_type")).count() == 0
    assert {r.match_id: r.status for r in grading.overall(rows).collect()}[2] == "incorrect"
    assert {r.scope for r in grading.model_stats(rows).collect()} == {"result", "parlay", "goals", "cards", "corners"}
    metrics = evaluation.count_metrics(rates.join(results, "match_id")).collect()
    assert {r.scope: r.n for r in metrics} == {"home": 2, "away": 2, "combined": 4}
    one = evaluation.result_metrics(poisson.markets(rates).join(results, "match_id")).first()
    assert one.n == 2 and 0 <= one.rps <= one.brier


def test_splits_keep_timestamps_whole(spark):
    m = spark.createDataFrame(schedule(4), SCHEMA)
    split = evaluation.chronological_split(m)
    assert split.groupBy("match_date").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    order = {"train": 0, "validation": 1, "test": 2}
    ends = {r.split: (r.a, r.b) for r in split.groupBy("split").agg(F.min("match_date").alias("a"), F.max("match_date").alias("b")).collect()}
    assert sorted(ends, key=lambda s: ends[s]) == sorted(ends, key=order.get)
    folds = evaluation.walk_forward(m, 10, 5, 5).collect()
    assert {(r.fold, r.split) for r in folds} >= {(0, "train"), (0, "test"), (1, "train")}


def test_resolution(spark):
    aliases = spark.createDataFrame([("man united", 1), ("manchester city", 2), ("real", 3), ("real", 4)], "key string, entity_id long")
    asked = spark.createDataFrame([("man united",), ("man unitedd",), ("real",), ("zzz",), ("manchester cty",)], "key string")
    got = {r.key: (r.resolution, r.entity_id) for r in resolve.resolve(asked, aliases, spark.createDataFrame([("zzz", 9)], "key string, entity_id long")).collect()}
    assert got["man united"] == ("resolved", 1) and got["man unitedd"] == ("fuzzy_approved", 1) and got["real"] == ("ambiguous", None) and got["zzz"] == ("decided", 9)


def test_empty_tables(spark):
    m = spark.createDataFrame([], SCHEMA)
    assert reports.standings(m).count() == 0 and reports.coverage(m).count() == 0 and rating.elo_ratings(m).count() == 0
    assert evaluation.chronological_split(m).count() == 0


def test_players(spark):
    m = spark.createDataFrame(schedule(5, 4), SCHEMA)
    absent = spark.createDataFrame([(7, r[4], None, None, True) for r in schedule(5, 4)] + [(8, 0, None, None, False)], "player_id long, team_id long, starts date, ends date, active boolean")
    assert {r.player_id for r in players.unavailable(m, absent).collect()} == {7}
    lineup = spark.createDataFrame([(1, 5, 1, True, None, 90), (1, 6, 1, False, 0.5, 90), (1, 7, 1, False, 0.9, 0)], "match_id long, player_id long, team_id long, confirmed boolean, start_probability double, expected_minutes int")
    form = spark.createDataFrame([(5, 900, 9, 0), (6, 900, 18, 1), (7, 900, 9, 9)], "player_id long, minutes long, goals long, cards long")
    got = players.chances(lineup, form).where("kind = 'scorer'").orderBy("rank").collect()
    assert [r.player_id for r in got] == [5, 6] and math.isclose(got[0].probability, 1 - math.exp(-0.9), abs_tol=1e-9)


def test_quarantine(spark):
    rows = spark.createDataFrame([(1, "L", "2020-21", datetime(2020, 1, 1), "A", "A", "finished", 1, None, 2, 0)], "id long, competition string, season string, match_date timestamp, home_team string, away_team string, status string, hg long, ag long, hht long, aht long")
    codes = {r.code for r in validate.quarantine(validate.checked(rows), "id").collect()}
    assert codes == {"same_team", "half_full_time_pair", "half_time_above_full_time"} and validate.good(validate.checked(rows)).count() == 0


def test_stream_keeps_one_state(spark, tmp_path):
    t = datetime(2024, 1, 1)
    for n, rows in enumerate([[(1, t, "live", 0, 0), (2, t, "scheduled", None, None)], [(1, t + timedelta(minutes=5), "finished", 1, 0), (1, t + timedelta(minutes=1), "live", 1, 0)], [(1, t + timedelta(minutes=9), "scheduled", None, None)]]):
        spark.createDataFrame(rows, live.SNAPSHOT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/landing")
        live.run(spark, f"{tmp_path}/landing", live.states(f"{tmp_path}/state", 4), f"{tmp_path}/offsets").awaitTermination()
        assert commits.commits(spark, live.states(f"{tmp_path}/state", 4))[-1] == n
        got = {r.match_id: (r.status, r.hg) for r in commits.read(spark, live.states(f"{tmp_path}/state", 4)).collect()}
    assert got == {1: ("finished", 1), 2: ("scheduled", None)}


def test_sliding_rate(spark):
    t = datetime(2024, 1, 1)
    events = spark.createDataFrame([(k, "c", t + timedelta(seconds=20 * k)) for k in range(6)], "id int, client string, ts timestamp")
    assert [r.n for r in rate.sliding(events, "client", limit=3).orderBy("id").collect()] == [1, 2, 3, 4, 4, 4]


def test_features_that_tell_the_result_are_refused(spark):
    rows = spark.createDataFrame([(1.0, 2.0)], "home_x double, target_home_goals double")
    assert models.feature_names(rows) == ["home_x"]
    with pytest.raises(ValueError):
        models.feature_names(rows, ["target_home_goals"])


def test_snapshots_of_one_time_have_an_order(spark):
    t = datetime(2024, 5, 1, 18)
    rows = [(1, t, "live", 1, 0), (1, t, "live", 0, 1), (1, t, "live", None, 5)]
    for given in (rows, rows[::-1]):
        got = live.newest(spark.createDataFrame(given, live.SNAPSHOT)).collect()
        assert [(r.hg, r.ag) for r in got] == [(1, 0)]


def test_unavailable_players_once_and_without_a_shuffle_of_pairs(spark):
    r = random.Random(3)
    day = lambda n: None if n is None else date(2024, 1, 1) + timedelta(days=n)
    games = [(k, r.randrange(400), *r.sample(range(4), 2)) for k in range(120)]
    absences = [(r.randrange(12), r.choice([0, 1, 2, 3, None]), r.choice([None, *[r.randrange(-50, 400)] * 6]), r.choice([None, *[r.randrange(450)] * 6]), r.random() < 0.8) for _ in range(60)]
    m = spark.createDataFrame([(k, day(n), h, a) for k, n, h, a in games], "match_id long, match_date date, home_team_id long, away_team_id long")
    found = players.unavailable(m, spark.createDataFrame([(p, t, day(a), day(b), x) for p, t, a, b, x in absences], "player_id long, team_id long, starts date, ends date, active boolean"))
    got = sorted((x.match_id, x.player_id) for x in found.collect())
    assert got == sorted({(k, p) for k, n, h, w in games for p, t, a, b, x in absences if x and t in (h, w) and (a is None or a <= n) and (b is None or n <= b)})
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Join" in plan and "Exchange" not in plan[: plan.index("Join")] and "Aggregate" not in plan[: plan.index("Join")]


def test_markets_are_plain_columns(spark):
    rates = [(0, 1.3, 0.9), (1, 0.0, 2.5), (2, 19.0, 0.2)]
    rows = poisson.markets(spark.createDataFrame(rates, "match_id long, lambda_home double, lambda_away double"))
    assert rows.columns == ["match_id", "lambda_home", "lambda_away", *rows.columns[3:]] and set(rows.columns[3:]) == set(poisson.MARKETS)
    assert "lambdafunction" not in rows._jdf.queryExecution().executedPlan().toString()
    for x in rows.collect():
        p, q = ([v / sum(raw) for v in raw] for raw in ([math.exp(-r) * r**k / math.factorial(k) for k in range(9)] for r in (x.lambda_home, x.lambda_away)))
        assert abs(x.home_win - sum(p[i] * q[j] for i in range(9) for j in range(i))) < 1e-9
        assert abs(x.over_2_5 - sum(p[i] * q[j] for i in range(9) for j in range(9) if i + j > 2)) < 1e-9


def test_lean_features_equal_the_full_ones(spark):
    m = spark.createDataFrame(schedule(11), SCHEMA)
    full = sides.sides(m).withColumns({c: F.lit(None).cast("long") for c in ("shots", "shots_on_target", "corners", "cards", "fouls")})
    names = [f"{v}_{c}" for v in ("home", "away") for c in history.RATED]
    lean = history.wide_features(m, sides.sides(m), history.RATED)
    assert not [c for c in lean.columns if "_avg_" in c and not c.startswith("league")] and "home_data_completeness" not in lean.columns
    assert {tuple(r) for r in lean.select("match_id", *names).collect()} == {tuple(r) for r in history.match_features(m, full).select("match_id", *names).collect()}


def test_team_windows_share_one_shuffle(spark):
    m = spark.createDataFrame(schedule(12), SCHEMA)
    plan = history.side_features(sides.sides(m), history.RATED, False)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1
