"""Goal rates, score probabilities and the markets that follow from them."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_GOALS, DEFAULT_RATE, MAX_RATE = 8, 1.25, 20.0
GOAL_LINES = (1.5, 2.5, 3.5, 4.5)


def blended_rate(terms: list[tuple[float, Column]]) -> Column:
    """Weighted mean of the terms that are known, finite and not negative; DEFAULT_RATE if none is."""
    usable = [(w, F.when((c >= 0) & ~F.isnan(c) & (c < float("inf")), c)) for w, c in terms]
    total = reduce(lambda a, b: a + b, [F.coalesce(c * w, F.lit(0.0)) for w, c in usable])
    weight = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), w).otherwise(0.0) for w, c in usable])
    return F.when(weight > 0, total / weight).otherwise(DEFAULT_RATE)


def with_rates(features: DataFrame, strict_history: bool = False) -> DataFrame:
    """features with lambda_home and lambda_away. Rates above MAX_RATE are invalid: such rows go.

    strict_history: only matches both of whose teams have a history.
    """
    rows = features.withColumns({
        "lambda_home": blended_rate([(0.45, F.col("home_goals_for_recency_weighted_10")), (0.35, F.col("away_goals_against_recency_weighted_10")), (0.20, F.col("league_home_goals_avg"))]),
        "lambda_away": blended_rate([(0.45, F.col("away_goals_for_recency_weighted_10")), (0.35, F.col("home_goals_against_recency_weighted_10")), (0.20, F.col("league_away_goals_avg"))]),
    })
    if strict_history:
        rows = rows.where("home_history_matches > 0 and away_history_matches > 0")
    return rows.where(f"lambda_home <= {MAX_RATE} and lambda_away <= {MAX_RATE}")


def pmf(rate: Column, most: int = MAX_GOALS) -> Column:
    """Probabilities of 0 to `most`, as an array that adds up to 1."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.exp(-rate) * F.pow(rate, k) / F.factorial(k))
    return F.transform(raw, lambda p: p / F.aggregate(raw, F.lit(0.0), lambda a, x: a + x))


def tail(rate: Column, line: float) -> Column:
    """P(X > line)."""
    return 1 - F.aggregate(F.sequence(F.lit(0), F.lit(int(line))), F.lit(0.0), lambda a, k: a + F.exp(-rate) * F.pow(rate, k) / F.factorial(k))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def with_pmfs(rates: DataFrame) -> DataFrame:
    return rates.withColumns({"ph": pmf(F.col("lambda_home")), "pa": pmf(F.col("lambda_away"))})


def markets(rates: DataFrame) -> DataFrame:
    """match_id, rates and the probabilities of results, totals, both teams scoring, clean sheets and the first goal.

    Goals of the sides are independent, so each market is a sum of products of the sides' chances: no score is exploded. The
    chances are plain columns, made in steps that the next one uses several times: in arrays, a lambda that names one has it
    made anew for each of its elements.
    """
    goals = range(MAX_GOALS + 1)
    sides = {"h": F.col("lambda_home"), "a": F.col("lambda_away")}
    rows = rates.withColumns({f"_{s}{k}": F.exp(-rate) * F.pow(rate, F.lit(k)) / math.factorial(k) for s, rate in sides.items() for k in goals})
    rows = rows.withColumns({f"_{s}": reduce(lambda x, y: x + y, [F.col(f"_{s}{k}") for k in goals]) for s in sides})
    rows = rows.withColumns({f"_{s}{k}": F.col(f"_{s}{k}") / F.col(f"_{s}") for s in sides for k in goals})
    home, away = ([F.col(f"_{s}{k}") for k in goals] for s in sides)
    rows = rows.withColumns({f"_less{k}": reduce(lambda x, y: x + y, away[:k], F.lit(0.0)) for k in range(MAX_GOALS + 2)})
    added = lambda terms: reduce(lambda x, y: x + y, terms, F.lit(0.0))
    less = [F.col(f"_less{k}") for k in range(MAX_GOALS + 2)]  # P(away < k)
    none = home[0] * away[0]
    rows = rows.withColumns({"home_win": added(home[i] * less[i] for i in goals), "draw": added(home[i] * away[i] for i in goals), "_none": none})
    rows = rows.withColumn("away_win", 1 - F.col("home_win") - F.col("draw"))
    for line in GOAL_LINES:
        most = int(line) + 1
        rows = rows.withColumn(f"over_{str(line).replace('.', '_')}", 1 - added(home[i] * less[max(0, most - i)] for i in goals))
    share = F.when(F.col("lambda_home") + F.col("lambda_away") > 0, F.col("lambda_home") / (F.col("lambda_home") + F.col("lambda_away"))).otherwise(0.0)
    rows = rows.withColumns({
        "over_0_5": 1 - F.col("_none"),
        "both_teams_score": (1 - home[0]) * (1 - away[0]),
        "home_clean_sheet": away[0],
        "away_clean_sheet": home[0],
        "either_clean_sheet": home[0] + away[0] - F.col("_none"),
        "first_goal_home": (1 - F.col("_none")) * share,
        "no_goal": F.col("_none"),
    })
    rows = rows.drop("_none", *[f"_{s}" for s in sides], *[f"_{s}{k}" for s in sides for k in goals], *[f"_less{k}" for k in range(MAX_GOALS + 2)])
    return rows.withColumns({m: F.round(m, 12) for m in MARKETS})  # equal chances tie


MARKETS = ("home_win", "draw", "away_win", "over_0_5", "over_1_5", "over_2_5", "over_3_5", "over_4_5", "both_teams_score", "home_clean_sheet", "away_clean_sheet", "either_clean_sheet", "first_goal_home", "no_goal")


def score_matrix(rates: DataFrame, shown: int = 6) -> DataFrame:
    """One row per match and score: match_id, home_goals, away_goals, probability; the first `shown` goals of each side."""
    rows = with_pmfs(rates).select("match_id", F.posexplode(F.slice("ph", 1, shown)).alias("home_goals", "p"), "pa")
    rows = rows.select("match_id", "home_goals", "p", F.posexplode(F.slice("pa", 1, shown)).alias("away_goals", "q"))
    return rows.select("match_id", "home_goals", "away_goals", (F.col("p") * F.col("q")).alias("probability"))


def top_scorelines(rates: DataFrame, n: int = 5) -> DataFrame:
    """The n likeliest scores of each match: match_id, rank, home_goals, away_goals, probability."""
    goals = F.sequence(F.lit(0), F.lit(MAX_GOALS))
    cells = F.flatten(F.transform(goals, lambda i: F.transform(goals, lambda j: F.struct(F.round(-F.col("ph")[i] * F.col("pa")[j], 12).alias("p"), i.alias("h"), j.alias("a")))))
    rows = with_pmfs(rates).select("match_id", F.posexplode(F.slice(F.array_sort(cells), 1, n)).alias("rank", "c"))
    return rows.select("match_id", (F.col("rank") + 1).alias("rank"), F.col("c.h").alias("home_goals"), F.col("c.a").alias("away_goals"), (-F.col("c.p")).alias("probability"))


SQL = """
lambdas AS (
  SELECT match_id, competition_id, match_date, status, hg, ag, h_corners, a_corners, h_cards, a_cards,
    CASE WHEN hgf IS NULL AND aga IS NULL AND league_home_goals_avg IS NULL THEN 1.25 ELSE
      (coalesce(0.45 * hgf, 0) + coalesce(0.35 * aga, 0) + coalesce(0.2 * league_home_goals_avg, 0)) /
      (CASE WHEN hgf IS NULL THEN 0 ELSE 0.45 END + CASE WHEN aga IS NULL THEN 0 ELSE 0.35 END + CASE WHEN league_home_goals_avg IS NULL THEN 0 ELSE 0.2 END) END AS lambda_home,
    CASE WHEN agf IS NULL AND hga IS NULL AND league_away_goals_avg IS NULL THEN 1.25 ELSE
      (coalesce(0.45 * agf, 0) + coalesce(0.35 * hga, 0) + coalesce(0.2 * league_away_goals_avg, 0)) /
      (CASE WHEN agf IS NULL THEN 0 ELSE 0.45 END + CASE WHEN hga IS NULL THEN 0 ELSE 0.35 END + CASE WHEN league_away_goals_avg IS NULL THEN 0 ELSE 0.2 END) END AS lambda_away
  FROM features),
cells AS (
  SELECT match_id, h.range AS home_goals, a.range AS away_goals, lambda_home, lambda_away,
    exp(-lambda_home) * power(lambda_home, h.range) / factorial(CAST(h.range AS INT)) * exp(-lambda_away) * power(lambda_away, a.range) / factorial(CAST(a.range AS INT)) AS raw
  FROM lambdas, range(9) h, range(9) a),
matrix AS (SELECT *, raw / sum(raw) OVER (PARTITION BY match_id) AS p FROM cells),
markets0 AS (
  SELECT match_id, any_value(lambda_home) AS lambda_home, any_value(lambda_away) AS lambda_away,
    sum(p) FILTER (WHERE home_goals > away_goals) AS home_win, sum(p) FILTER (WHERE home_goals = away_goals) AS draw, sum(p) FILTER (WHERE home_goals < away_goals) AS away_win,
    sum(p) FILTER (WHERE home_goals + away_goals > 0) AS over_0_5, sum(p) FILTER (WHERE home_goals + away_goals > 1) AS over_1_5, sum(p) FILTER (WHERE home_goals + away_goals > 2) AS over_2_5,
    sum(p) FILTER (WHERE home_goals + away_goals > 3) AS over_3_5, sum(p) FILTER (WHERE home_goals + away_goals > 4) AS over_4_5,
    sum(p) FILTER (WHERE home_goals > 0 AND away_goals > 0) AS both_teams_score, sum(p) FILTER (WHERE away_goals = 0) AS home_clean_sheet, sum(p) FILTER (WHERE home_goals = 0) AS away_clean_sheet,
    sum(p) FILTER (WHERE home_goals = 0 OR away_goals = 0) AS either_clean_sheet,
    sum(p) FILTER (WHERE home_goals + away_goals > 0) * any_value(lambda_home) / nullif(any_value(lambda_home) + any_value(lambda_away), 0) AS first_goal_home,
    sum(p) FILTER (WHERE home_goals + away_goals = 0) AS no_goal
  FROM matrix GROUP BY match_id),
markets AS (SELECT match_id, lambda_home, lambda_away, """ + ", ".join(f"round({m}, 12) AS {m}" for m in MARKETS) + " FROM markets0)"
