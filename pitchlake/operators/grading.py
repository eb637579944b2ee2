"""Grading of predictions against results, and what the grades add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.operators.poisson import tail

GOAL_LINES = (0.5, 1.5, 2.5, 3.5, 4.5)
CARD_LINES = (3.5, 4.5, 5.5, 6.5)
CORNER_LINES = (6.5, 7.5, 8.5, 9.5, 10.5, 11.5, 12.5)


def token(line: float) -> str:
    return str(line).replace(".", "_")


def with_tails(rates: DataFrame) -> DataFrame:
    """rates with expected_cards and expected_corners (sums of both teams' means; null unless both are known) and the
    probabilities of more than each line."""
    rows = rates.withColumns({f"expected_{m}": F.col(f"home_{m}_avg_10") + F.col(f"away_{m}_avg_10") for m in ("cards", "corners")})
    rows = rows.withColumns({f"cards_over_{token(x)}": tail(F.col("expected_cards"), x) for x in (2.5, *CARD_LINES)})
    return rows.withColumns({f"corners_over_{token(x)}": tail(F.col("expected_corners"), x) for x in CORNER_LINES})


def actual_totals(statistics: DataFrame) -> DataFrame:
    """match_id, total_cards, total_corners of matches with statistics; unknown values count as 0."""
    cards = F.coalesce("yellow_cards", F.lit(0)) + F.coalesce("red_cards", F.lit(0))
    return statistics.groupBy("match_id").agg(F.sum(cards).alias("total_cards"), F.sum(F.coalesce("corners", F.lit(0))).alias("total_corners"))


def _line(event: str, probability: Column, actual: Column) -> Column:
    said = probability >= 0.5
    return F.struct(F.lit(event).alias("event_type"), probability.alias("probability"), said.cast("string").alias("predicted"), actual.cast("string").alias("actual"))


def outcomes(predictions: DataFrame, results: DataFrame, statistics: DataFrame, graded: DataFrame | None = None) -> DataFrame:
    """match_id, event_type, probability, predicted, actual, status: each prediction of a finished match held to its result.

    Events without a probability are left out, card and corner lines too where the match has no statistics. Events that
    `graded` (match_id, event_type) has are not graded anew.
    """
    rows = predictions.drop("hg", "ag").join(results.select("match_id", "hg", "ag").where("hg is not null and ag is not null"), "match_id")
    rows = rows.join(actual_totals(statistics), "match_id", "left")
    total = F.col("hg") + F.col("ag")
    result = F.when(F.col("hg") > F.col("ag"), "home_win").when(F.col("hg") < F.col("ag"), "away_win").otherwise("draw")
    best = F.greatest("home_win", "draw", "away_win")
    said = F.when(F.col("home_win") == best, "home_win").when(F.col("draw") == best, "draw").otherwise("away_win")
    events = [
        F.struct(F.lit("match_result").alias("event_type"), best.alias("probability"), said.alias("predicted"), result.alias("actual")),
        _line("over_2_5_goals", F.col("over_2_5"), total > 2),
        _line("both_teams_score", F.col("both_teams_score"), (F.col("hg") > 0) & (F.col("ag") > 0)),
        *[_line(f"goals_over_{token(x)}", F.col(f"over_{token(x)}"), total > x) for x in GOAL_LINES],
        *[_line(f"cards_over_{token(x)}", F.col(f"cards_over_{token(x)}"), F.col("total_cards") > x) for x in CARD_LINES],
        *[_line(f"corners_over_{token(x)}", F.col(f"corners_over_{token(x)}"), F.col("total_corners") > x) for x in CORNER_LINES],
    ]
    long = rows.select("match_id", F.inline(F.array(*events))).where("probability is not null and actual is not null")
    long = long.withColumn("status", F.when(F.col("predicted") == F.col("actual"), "correct").otherwise("incorrect"))
    return long if graded is None else long.join(graded, ["match_id", "event_type"], "left_anti")


def scorer_outcomes(chances: DataFrame, appearances: DataFrame, names: DataFrame, results: DataFrame, top: int = 3) -> DataFrame:
    """match_id, event_type top_3_scorer_any, probability (null), predicted, actual, status of matches with a result.

    chances: as players.chances gives them; names: player_id, name. Correct if a name among the `top` likeliest scorers
    is a name of someone who scored. Players without a name don't count; a match without predicted names is left out.
    """
    named = names.select("player_id", "name").where("name is not null and name <> ''")
    said = chances.where((F.col("kind") == "scorer") & (F.col("rank") <= top)).join(named, "player_id")
    said = said.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("_said"))  # `top` at most
    did = appearances.where("goals > 0").join(named, "player_id").groupBy("match_id").agg(F.array_sort(F.collect_set("name")).alias("_did"))
    done = results.where("hg is not null and ag is not null").select("match_id")
    rows = said.join(done, "match_id").join(did, "match_id", "left")
    hit = F.coalesce(F.arrays_overlap("_said.name", "_did"), F.lit(False))
    return rows.select(
        "match_id", F.lit("top_3_scorer_any").alias("event_type"), F.lit(None).cast("double").alias("probability"), F.array_join("_said.name", ",").alias("predicted"),
        F.coalesce(F.array_join("_did", ","), F.lit("")).alias("actual"), F.when(hit, "correct").otherwise("incorrect").alias("status"),
    )


def recent(outcomes: DataFrame, matches: DataFrame, n: int = 10) -> DataFrame:
    """match_id, match_date, home_team_id, away_team_id, score, status of the n latest matches whose result is graded."""
    graded = outcomes.where("event_type = 'match_result'").select("match_id", "status")
    rows = matches.drop("status").join(graded, "match_id").withColumn("score", F.concat_ws("-", "hg", "ag"))
    return rows.select("match_id", "match_date", "home_team_id", "away_team_id", "score", "status").orderBy(F.desc("match_date"), F.desc("match_id")).limit(n)


def overall(outcomes: DataFrame) -> DataFrame:
    """match_id, status: correct if every outcome is."""
    return outcomes.groupBy("match_id").agg(F.when(F.bool_and(F.col("status") == "correct"), "correct").otherwise("incorrect").alias("status"))


def latest(predictions: DataFrame, key: str = "match_id", at: str = "generated_at", tie: str = "prediction_id") -> DataFrame:
    """The latest prediction of each match."""
    order = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col(tie).desc())
    return predictions.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def model_stats(outcomes: DataFrame) -> DataFrame:
    """scope, correct, incorrect, total, accuracy (percent, one place), brier (of results, four places): result, parlay,
    scorer and each parlay category that occurs."""
    kind = F.col("event_type")
    scope = F.when(kind == "match_result", F.array(F.lit("result"))).when(kind == "top_3_scorer_any", F.array(F.lit("scorer")))
    scope = scope.otherwise(F.array(F.lit("parlay"), F.when(kind.startswith("goals"), "goals").when(kind.startswith("cards"), "cards").when(kind.startswith("corners"), "corners")))
    rows = outcomes.withColumn("scope", F.explode(scope)).where("scope is not null")
    right = F.col("status") == "correct"
    brier = F.avg(F.when(F.col("scope") == "result", F.pow(F.col("probability") - right.cast("double"), 2)))
    out = rows.groupBy("scope").agg(F.count_if(right).alias("correct"), F.count_if(~right).alias("incorrect"), F.count(F.lit(1)).alias("total"), brier.alias("brier"))
    return out.withColumn("accuracy", F.round(100 * F.col("correct") / F.col("total"), 1)).withColumn("brier", F.round("brier", 4))


SQL = """
totals AS (SELECT match_id, CAST(sum(yellow_cards + red_cards) AS BIGINT) AS total_cards, CAST(sum(corners) AS BIGINT) AS total_corners FROM stats GROUP BY match_id),
tail_rates AS (SELECT match_id, h_cards + a_cards AS expected_cards, h_corners + a_corners AS expected_corners FROM lambdas),
tails AS (
  SELECT match_id, kind, line, 1 - sum(exp(-rate) * power(rate, k.range) / factorial(CAST(k.range AS INT))) AS p
  FROM (SELECT match_id, 'cards' AS kind, expected_cards AS rate, unnest([2.5, 3.5, 4.5, 5.5, 6.5]) AS line FROM tail_rates
    UNION ALL SELECT match_id, 'corners', expected_corners, unnest([6.5, 7.5, 8.5, 9.5, 10.5, 11.5, 12.5]) FROM tail_rates) r, range(13) k
  WHERE k.range <= line GROUP BY match_id, kind, line),
outcomes0 AS (
  SELECT m.match_id, 'match_result' AS event_type, greatest(home_win, draw, away_win) AS probability,
    CASE greatest(home_win, draw, away_win) WHEN home_win THEN 'home_win' WHEN draw THEN 'draw' ELSE 'away_win' END AS predicted,
    CASE WHEN hg > ag THEN 'home_win' WHEN hg < ag THEN 'away_win' ELSE 'draw' END AS actual
  FROM markets p JOIN matches m ON m.match_id = p.match_id WHERE hg IS NOT NULL
  UNION ALL
  SELECT m.match_id, e.event_type, e.probability, CAST(e.probability >= 0.5 AS VARCHAR), CAST(e.actual AS VARCHAR)
  FROM markets p JOIN matches m ON m.match_id = p.match_id, LATERAL (VALUES ('over_2_5_goals', over_2_5, hg + ag > 2.5), ('both_teams_score', both_teams_score, hg > 0 AND ag > 0),
    ('goals_over_0_5', over_0_5, hg + ag > 0.5), ('goals_over_1_5', over_1_5, hg + ag > 1.5), ('goals_over_2_5', over_2_5, hg + ag > 2.5), ('goals_over_3_5', over_3_5, hg + ag > 3.5), ('goals_over_4_5', over_4_5, hg + ag > 4.5)) e(event_type, probability, actual)
  WHERE hg IS NOT NULL
  UNION ALL
  SELECT m.match_id, kind || '_over_' || replace(CAST(line AS VARCHAR), '.', '_'), p, CAST(p >= 0.5 AS VARCHAR), CAST(CASE kind WHEN 'cards' THEN total_cards ELSE total_corners END > line AS VARCHAR)
  FROM tails t JOIN matches m ON m.match_id = t.match_id JOIN totals x ON x.match_id = m.match_id WHERE hg IS NOT NULL AND p IS NOT NULL AND NOT (kind = 'cards' AND line = 2.5)),
outcomes AS (SELECT *, CASE WHEN predicted = actual THEN 'correct' ELSE 'incorrect' END AS status FROM outcomes0)"""
