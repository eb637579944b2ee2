"""Queries over the match tables: reports, features, probabilities, grades and measures, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.operators import evaluation, grading, history, poisson, rating, reports
from pitchlake.operators import sides as side_rows
from pitchlake.sources import adapter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

BASE = f"{adapter.SQL},{side_rows.SQL}"
FORM = f"{BASE},{history.SQL}"
RATES = f"{FORM},{poisson.SQL}"
GRADES = f"{RATES},{grading.SQL}"
PAGE = ["match_id", "competition_id", "season", "day", "home_team_id", "away_team_id", "status", "hg", "ag"]


def query(sql: str | None = None, chain: str = BASE, recursive: bool = False):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH {'RECURSIVE ' * recursive}{chain}\n{sql}"
        return f

    return add


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return adapter.matches(spark, d)


def _full(spark: SparkSession, d: str) -> DataFrame:
    return side_rows.with_statistics(adapter.matches(spark, d), adapter.team_statistics(spark, d))


def _features(spark: SparkSession, d: str, only: tuple[str, ...] | None = history.CORE) -> DataFrame:
    full = _full(spark, d)
    return history.match_features(full, side_rows.sides(full), only)


def _wide(spark: SparkSession, d: str, only: tuple[str, ...]) -> DataFrame:
    """League priors and no other features than those named."""
    full = _full(spark, d)
    return history.wide_features(full, side_rows.sides(full), only)


def _goal_rates(spark: SparkSession, d: str) -> DataFrame:
    """_rates() without what only other events need."""
    matches = _matches(spark, d)
    return poisson.with_rates(history.wide_features(matches, side_rows.sides(matches), history.RATED))


def _rates(spark: SparkSession, d: str) -> DataFrame:
    return poisson.with_rates(_features(spark, d))


def _page(rows: DataFrame) -> DataFrame:
    return rows.withColumn("day", F.date_format("match_date", "yyyy-MM-dd")).select(*PAGE)


def _rounded(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return rows.select(*keys, *[F.round(F.col(c).cast("double"), 6).alias(c) for c in values])


def _round_sql(values) -> str:
    return ", ".join(f"round(CAST({v} AS DOUBLE), 6) AS {v}" for v in values)


@query("""SELECT competition_id, season, team_id, played, won, drawn, lost, CAST(gf AS BIGINT) AS gf, CAST(ga AS BIGINT) AS ga, CAST(points AS BIGINT) AS points, CAST(gf - ga AS BIGINT) AS gd, form,
  row_number() OVER (PARTITION BY competition_id, season ORDER BY points DESC, gf - ga DESC, gf DESC, team_id) AS position
FROM (SELECT competition_id, season, team_id, count(*) AS played, count(*) FILTER (WHERE points = 3) AS won, count(*) FILTER (WHERE points = 1) AS drawn, count(*) FILTER (WHERE points = 0) AS lost,
  sum(goals_for) AS gf, sum(goals_against) AS ga, sum(points) AS points, string_agg(CASE points WHEN 3 THEN 'W' WHEN 1 THEN 'D' ELSE 'L' END, '' ORDER BY match_date, match_id) AS all_form, right(all_form, 5) AS form
  FROM sides WHERE status = 'finished' GROUP BY ALL)""".replace(", right(all_form, 5) AS form", "").replace("gd, form,", "gd, right(all_form, 5) AS form,"))
def standings(spark, d):
    return reports.standings(_matches(spark, d))


@query("SELECT match_id, competition_id, season, strftime(match_date, '%Y-%m-%d') AS day, home_team_id, away_team_id, status, hg, ag FROM matches WHERE status = 'finished' AND competition_id = 2 AND match_date >= '1995-01-01' AND match_date < '1997-01-01' ORDER BY match_date DESC, match_id LIMIT 50 OFFSET 20")
def match_list_page(spark, d):
    return _page(reports.match_list(_matches(spark, d), "finished", 2, "1995-01-01", "1997-01-01", offset=20, limit=50))


@query("SELECT match_id, competition_id, season, strftime(match_date, '%Y-%m-%d') AS day, home_team_id, away_team_id, status, hg, ag FROM matches WHERE status = 'scheduled' AND match_date >= '1996-06-01'")
def upcoming_matches(spark, d):
    rows = _matches(spark, d)
    return _page(rows.where((F.col("status") == "scheduled") & (F.col("match_date") >= F.to_timestamp_ntz(F.lit("1996-06-01")))))


@query("SELECT team_id, nth, match_id, venue, opponent_id, goals_for, goals_against, CAST(points AS BIGINT) AS points FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY match_date DESC, match_id DESC, venue) AS nth FROM sides WHERE status = 'finished' AND match_date < '1997-01-01') WHERE nth <= 10")
def team_history(spark, d):
    return reports.team_results(_matches(spark, d), "1997-01-01", 10).select("team_id", "nth", "match_id", "venue", "opponent_id", "goals_for", "goals_against", "points")


@query("SELECT m.match_id, m.hg, m.ag, h.shots AS home_shots, a.shots AS away_shots, h.corners AS home_corners, a.corners AS away_corners, h.fouls AS home_fouls, a.fouls AS away_fouls FROM matches m LEFT JOIN stats h ON h.match_id = m.match_id AND h.venue = 'home' LEFT JOIN stats a ON a.match_id = m.match_id AND a.venue = 'away'")
def match_stats_join(spark, d):
    return _full(spark, d).select("match_id", "hg", "ag", "home_shots", "away_shots", "home_corners", "away_corners", "home_fouls", "away_fouls")


MEANS = [f"{m}_avg_{n}" for m in history.METRICS for n in (3, 5, 10)]
WEIGHTED = [f"{m}_recency_weighted_10" for m in history.DECAYED]


@query(f"SELECT match_id, venue, {_round_sql(MEANS)} FROM side_features", FORM)
def rolling_form(spark, d):
    return _rounded(history.side_features(side_rows.sides(_full(spark, d)), tuple(MEANS)), ["match_id", "venue"], MEANS)


@query(f"SELECT match_id, venue, {_round_sql(WEIGHTED)} FROM side_features", FORM)
def recency_weighted(spark, d):
    return _rounded(history.side_features(side_rows.sides(_full(spark, d)), tuple(WEIGHTED)), ["match_id", "venue"], WEIGHTED)


@query("""SELECT v.match_id, v.venue, round(avg(p.goals_for), 6) AS venue_goals_for_avg_5, round(avg(p.goals_against), 6) AS venue_goals_against_avg_5
FROM (SELECT *, count(*) FILTER (WHERE status = 'finished') OVER (PARTITION BY competition_id, team_id, venue ORDER BY match_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS nb FROM sides) v
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY competition_id, team_id, venue ORDER BY match_date, match_id) AS seq FROM sides WHERE status = 'finished') p
ON p.competition_id = v.competition_id AND p.team_id = v.team_id AND p.venue = v.venue AND p.seq BETWEEN v.nb - 4 AND v.nb GROUP BY v.match_id, v.venue""")
def venue_form(spark, d):
    rows = history.venue_history(side_rows.sides(_matches(spark, d)))
    return rows.select("match_id", "venue", *[F.round(history.mean_of_last(5, m), 6).alias(f"venue_{m}_avg_5") for m in ("goals_for", "goals_against")])


@query("SELECT match_id, venue, history_matches, round(days_rest, 6) AS days_rest, round(CAST(data_completeness AS DOUBLE), 6) AS data_completeness, strftime(history_max_date, '%Y-%m-%d') AS last_day FROM side_features", FORM)
def history_state(spark, d):
    rows = history.side_features(side_rows.sides(_full(spark, d)), ())
    return rows.select("match_id", "venue", "history_matches", F.round("days_rest", 6).alias("days_rest"), F.round("data_completeness", 6).alias("data_completeness"), F.date_format("history_max_date", "yyyy-MM-dd").alias("last_day"))


PRIORS = ["league_home_goals_avg", "league_away_goals_avg", "league_team_goals_avg"]


@query(f"SELECT match_id, league_prior_matches, {_round_sql(PRIORS)} FROM priors", FORM)
def league_priors(spark, d):
    return _rounded(history.league_priors(_matches(spark, d)), ["match_id", "league_prior_matches"], PRIORS)


@query("""SELECT m.match_id, count(p.hg) AS n_matches, round(avg(p.hg), 6) AS home_avg, round(avg(p.ag), 6) AS away_avg
FROM (SELECT *, count(*) FILTER (WHERE status = 'finished') OVER (PARTITION BY competition_id ORDER BY match_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS nb FROM matches) m
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY competition_id ORDER BY match_date, match_id) AS seq FROM matches WHERE status = 'finished') p
ON p.competition_id = m.competition_id AND p.seq BETWEEN m.nb - 199 AND m.nb GROUP BY m.match_id""")
def league_last_200(spark, d):
    return _rounded(reports.league_last(_matches(spark, d), 200), ["match_id", "n_matches"], ["home_avg", "away_avg"])


STRENGTHS = ["home_attack_strength", "away_attack_strength", "home_defence_weakness", "away_defence_weakness"]


@query(f"SELECT match_id, {_round_sql(STRENGTHS)}, round(least(1.0, 0.65 * least(least(home_history_matches, away_history_matches) / 10, 1.0) + 0.35 * CASE WHEN expected > 0 THEN known / expected ELSE 0.0 END), 6) AS feature_quality_score FROM features", FORM)
def strengths_quality(spark, d):
    rows = _features(spark, d).withColumn("q", F.round("feature_quality_score", 6))
    return _rounded(rows, ["match_id", "q"], STRENGTHS).withColumnRenamed("q", "feature_quality_score")


@query("SELECT match_id, round(home_elo, 6) AS home_elo, round(away_elo, 6) AS away_elo, round(home_elo - away_elo, 6) AS elo_difference, round(1 / (1 + power(10.0, (away_elo - (home_elo + 65)) / 400)), 6) AS home_elo_expected_result FROM elo", f"{BASE},{rating.SQL}", True)
def elo_ratings(spark, d):
    return _rounded(rating.elo_ratings(_matches(spark, d)), ["match_id"], ["home_elo", "away_elo", "elo_difference", "home_elo_expected_result"])


@query("SELECT match_id, false AS late, round(home_elo, 6) AS home_elo, round(away_elo, 6) AS away_elo, round(1 / (1 + power(10.0, (away_elo - (home_elo + 65)) / 400)), 6) AS home_elo_expected_result FROM elo", f"{BASE},{rating.SQL}", True)
def elo_stream(spark, d):
    from pitchlake.streaming import elo

    return _rounded(elo.caught_up(spark, _matches(spark, d)), ["match_id", "late"], ["home_elo", "away_elo", "home_elo_expected_result"])


@query("SELECT match_id FROM features WHERE home_history_max_date >= match_date OR away_history_max_date >= match_date", FORM)
def leakage_audit(spark, d):
    return history.leaks(_features(spark, d)).select("match_id")


@query(f"SELECT match_id, {_round_sql(['lambda_home', 'lambda_away'])} FROM lambdas", RATES)
def lambda_estimates(spark, d):
    return _rounded(_rates(spark, d), ["match_id"], ["lambda_home", "lambda_away"])


@query("SELECT m.match_id, CAST(home_goals AS BIGINT) AS home_goals, CAST(away_goals AS BIGINT) AS away_goals, round(p, 6) AS probability FROM matrix m JOIN matches USING (match_id) WHERE home_goals < 6 AND away_goals < 6", RATES)
def score_matrix(spark, d):
    rows = poisson.score_matrix(_rates(spark, d))
    return rows.select("match_id", F.col("home_goals").cast("long").alias("home_goals"), F.col("away_goals").cast("long").alias("away_goals"), F.round("probability", 6).alias("probability"))


@query(f"SELECT match_id, {_round_sql(poisson.MARKETS)} FROM markets", RATES)
def market_probs(spark, d):
    return _rounded(poisson.markets(_rates(spark, d)), ["match_id"], list(poisson.MARKETS))


@query("SELECT match_id, rank, CAST(home_goals AS BIGINT) AS home_goals, CAST(away_goals AS BIGINT) AS away_goals, round(p, 6) AS probability FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY round(p, 12) DESC, home_goals, away_goals) AS rank FROM matrix) WHERE rank <= 5", RATES)
def top_scorelines(spark, d):
    rows = poisson.top_scorelines(_rates(spark, d))
    return rows.select("match_id", F.col("rank").cast("long").alias("rank"), F.col("home_goals").cast("long").alias("home_goals"), F.col("away_goals").cast("long").alias("away_goals"), F.round("probability", 6).alias("probability"))


TAILS = [f"{k}_over_{grading.token(x)}" for k, lines in (("cards", (2.5, *grading.CARD_LINES)), ("corners", grading.CORNER_LINES)) for x in lines]


@query("SELECT match_id, " + ", ".join(f"round(sum(p) FILTER (WHERE kind = '{n.split('_')[0]}' AND line = {'.'.join(n.split('_')[2:])}), 6) AS {n}" for n in TAILS) + " FROM tails GROUP BY match_id", GRADES)
def event_tails(spark, d):
    return _rounded(grading.with_tails(_rates(spark, d)), ["match_id"], TAILS)


def _predictions(spark, d):
    return grading.with_tails(poisson.markets(_rates(spark, d)))


@query("SELECT match_id, event_type, round(probability, 6) AS probability, predicted, actual, status FROM outcomes", GRADES)
def outcome_grading(spark, d):
    rows = grading.outcomes(_predictions(spark, d), _matches(spark, d), adapter.team_statistics(spark, d))
    return rows.withColumn("probability", F.round("probability", 6))


@query("SELECT match_id, CASE WHEN bool_and(status = 'correct') THEN 'correct' ELSE 'incorrect' END AS status FROM outcomes GROUP BY match_id", GRADES)
def overall_grades(spark, d):
    return grading.overall(grading.outcomes(_predictions(spark, d), _matches(spark, d), adapter.team_statistics(spark, d)))


@query("""SELECT scope, count(*) FILTER (WHERE status = 'correct') AS correct, count(*) FILTER (WHERE status <> 'correct') AS incorrect, count(*) AS total,
  round(avg(power(probability - CAST(status = 'correct' AS INT), 2)) FILTER (WHERE scope = 'result'), 4) AS brier, round(100.0 * count(*) FILTER (WHERE status = 'correct') / count(*), 1) AS accuracy
FROM (SELECT *, CASE event_type WHEN 'match_result' THEN 'result' ELSE 'parlay' END AS scope FROM outcomes
  UNION ALL SELECT *, split_part(event_type, '_', 1) FROM outcomes WHERE event_type LIKE 'goals%' OR event_type LIKE 'cards%' OR event_type LIKE 'corners%') GROUP BY scope""", GRADES)
def model_stats(spark, d):
    return grading.model_stats(grading.outcomes(_predictions(spark, d), _matches(spark, d), adapter.team_statistics(spark, d)))


@query("""SELECT coalesce(side, 'combined') AS scope, count(*) AS n, round(avg(abs(p - a)), 6) AS mae, round(sqrt(avg((p - a) * (p - a))), 6) AS rmse,
  round(avg(CASE WHEN a = 0 THEN 2 * greatest(p, 1e-12) ELSE 2 * (a * ln(a / greatest(p, 1e-12)) - (a - greatest(p, 1e-12))) END), 6) AS deviance, round(avg(p - a), 6) AS bias
FROM (SELECT 'home' AS side, hg AS a, lambda_home AS p FROM lambdas WHERE hg IS NOT NULL UNION ALL SELECT 'away', ag, lambda_away FROM lambdas WHERE hg IS NOT NULL) GROUP BY GROUPING SETS ((side), ())""", RATES)
def count_metrics(spark, d):
    return _rounded(evaluation.count_metrics(_rates(spark, d)), ["scope", "n"], ["mae", "rmse", "deviance", "bias"])


@query("""SELECT count(*) AS n, round(avg(CASE greatest(home_win, draw, away_win) WHEN home_win THEN oh WHEN draw THEN od ELSE oa END), 6) AS accuracy, round(avg(-ln(greatest(oh * home_win + od * draw + oa * away_win, 1e-15))), 6) AS log_loss,
  round(avg(power(home_win - oh, 2) + power(draw - od, 2) + power(away_win - oa, 2)), 6) AS brier, round(avg((power(home_win - oh, 2) + power(home_win - oh + draw - od, 2)) / 2), 6) AS rps
FROM (SELECT p.*, CAST(hg > ag AS INT) AS oh, CAST(hg = ag AS INT) AS od, CAST(hg < ag AS INT) AS oa FROM markets p JOIN matches USING (match_id) WHERE hg IS NOT NULL)""", RATES)
def result_metrics(spark, d):
    rows = evaluation.result_metrics(poisson.markets(_rates(spark, d)))
    return _rounded(rows, ["n"], ["accuracy", "log_loss", "brier", "rps"])


@query("""SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(c - f)) / sum(n), 6) AS ece
FROM (SELECT count(*) AS n, avg(over_2_5) AS c, avg(CAST(hg + ag > 2.5 AS INT)) AS f FROM markets JOIN matches USING (match_id) WHERE hg IS NOT NULL GROUP BY least(floor(over_2_5 * 10), 9))""", RATES)
def calibration_error(spark, d):
    rows = poisson.markets(_goal_rates(spark, d).where("hg is not null"))
    return _rounded(evaluation.calibration_error(rows, "over_2_5", F.col("hg") + F.col("ag") > 2.5), ["n"], ["ece"])


@query("""SELECT match_id, CASE WHEN g < train_end THEN 'train' WHEN g < least(n - 1, train_end + greatest(1, floor(n * 0.15))) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, greatest(1, least(n - 2, floor(n * 0.7))) AS train_end FROM (SELECT match_id, dense_rank() OVER (ORDER BY match_date) - 1 AS g, (SELECT count(DISTINCT match_date) FROM matches WHERE status = 'finished') AS n FROM matches WHERE status = 'finished'))""")
def chrono_split(spark, d):
    return evaluation.chronological_split(side_rows.completed(_matches(spark, d))).select("match_id", "split")


@query("SELECT match_id, CASE WHEN g >= n - greatest(1, floor(n * 0.2)) THEN 'validation' ELSE 'train' END AS split FROM (SELECT match_id, dense_rank() OVER (ORDER BY match_date) - 1 AS g, (SELECT count(DISTINCT match_date) FROM matches WHERE status = 'finished') AS n FROM matches WHERE status = 'finished')")
def holdout_split(spark, d):
    return evaluation.holdout(side_rows.completed(_matches(spark, d))).select("match_id", "split")


@query("""SELECT fold, CASE WHEN g < e THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM
  (SELECT dense_rank() OVER (ORDER BY match_date) - 1 AS g FROM matches WHERE status = 'finished') d,
  (SELECT i.range AS fold, 600 + 200 * i.range AS e FROM range(1000) i WHERE 600 + 200 * i.range + 200 <= (SELECT count(DISTINCT match_date) FROM matches WHERE status = 'finished')) f
WHERE g < e + 200 GROUP BY ALL""")
def walk_forward(spark, d):
    return evaluation.walk_forward(side_rows.completed(_matches(spark, d)), 600, 200, 200)


@query("SELECT feature, median FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(median({c}) AS DOUBLE) AS median FROM stats" for c in ("shots", "corners", "fouls")) + ")")
def feature_medians(spark, d):
    return evaluation.medians(adapter.team_statistics(spark, d), ["shots", "corners", "fouls"])


@query("""SELECT m.competition_id, strftime(min(match_date), '%Y-%m-%d') AS first_date, strftime(max(match_date), '%Y-%m-%d') AS last_date, count(DISTINCT match_id) AS n_matches, count(*) FILTER (WHERE status = 'finished') AS n_finished,
  count(*) FILTER (WHERE status = 'scheduled') AS n_scheduled, count(hht) AS n_half_time, array_to_string(list_sort(list_distinct(list(season))), ',') AS seasons, any_value(n_teams) AS n_teams
FROM matches m JOIN (SELECT competition_id, count(DISTINCT team_id) AS n_teams FROM sides GROUP BY ALL) t ON t.competition_id = m.competition_id GROUP BY m.competition_id""")
def coverage_by_competition(spark, d):
    return reports.coverage(_matches(spark, d))


@query("""SELECT competition_id, bool_or(hg IS NOT NULL) AS has_results, bool_or(hht IS NOT NULL) AS has_half_times, bool_or(match_id IN (SELECT match_id FROM stats)) AS has_statistics,
  bool_or(match_id IN (SELECT match_id FROM stats WHERE red_cards > 0)) AS has_cards, bool_or(match_id IN (SELECT match_id FROM player_matches)) AS has_players, false AS has_referees, 'referees' AS missing, 'incomplete' AS state FROM matches GROUP BY competition_id""")
def data_categories(spark, d):
    return reports.data_categories(_matches(spark, d), adapter.team_statistics(spark, d), adapter.player_matches(spark, d))


@query("SELECT count(*) AS matches, count(*) FILTER (WHERE status = 'finished') AS finished, count(*) FILTER (WHERE status = 'scheduled') AS scheduled, count(DISTINCT competition_id) AS competitions, (SELECT count(DISTINCT team_id) FROM sides) AS teams FROM matches")
def import_metrics(spark, d):
    return reports.import_metrics(_matches(spark, d))


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part")
def table_counts(spark, d):
    return reports.counts({n: adapter.table(spark, d, n) for n in ("orders", "lineitem", "customer", "part")})


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%re%' ORDER BY p_name, p_partkey LIMIT 40")
def player_search(spark, d):
    names = adapter.table(spark, d, "part").select("p_partkey", "p_name")
    return names.where(F.col("p_name").ilike("%re%")).orderBy("p_name", "p_partkey").limit(40)
