"""From matches to what each of the two teams did in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATISTICS = ("shots", "shots_on_target", "corners", "yellow_cards", "red_cards", "fouls")


def completed(matches: DataFrame) -> DataFrame:
    """Finished matches with both scores."""
    return matches.where((F.col("status") == "finished") & F.col("hg").isNotNull() & F.col("ag").isNotNull())


def with_statistics(matches: DataFrame, statistics: DataFrame) -> DataFrame:
    """matches with home_ and away_ columns of the statistics; null where a side has none."""
    both = [F.max(F.when(F.col("venue") == v, F.col(c))).alias(f"{v}_{c}") for v in ("home", "away") for c in STATISTICS]
    return matches.join(statistics.groupBy("match_id").agg(*both), "match_id", "left")


def sides(matches: DataFrame) -> DataFrame:
    """Two rows per match, home and away, with the goals and, where matches has them, the statistics of each side."""
    known = [c for c in STATISTICS if f"home_{c}" in matches.columns]

    def side(venue: str, other: str, gf: str, ga: str):
        return F.struct(
            F.lit(venue).alias("venue"),
            F.col(f"{venue}_team_id").alias("team_id"),
            F.col(f"{other}_team_id").alias("opponent_id"),
            F.col(gf).alias("goals_for"),
            F.col(ga).alias("goals_against"),
            *[F.col(f"{venue}_{c}").alias(c) for c in known],
        )

    both = F.array(side("home", "away", "hg", "ag"), side("away", "home", "ag", "hg"))
    rows = matches.select("match_id", "competition_id", "season", "match_date", "status", F.inline(both))
    gf, ga = F.col("goals_for"), F.col("goals_against")
    rows = rows.withColumns({
        "points": F.when(gf > ga, 3).when(gf == ga, 1).when(gf < ga, 0).cast("long"),
        "clean_sheet": (ga == 0).cast("long"),
        "scored": (gf > 0).cast("long"),
        "over_2_5": (gf + ga > 2).cast("long"),
        "both_teams_scored": ((gf > 0) & (ga > 0)).cast("long"),
    })
    if "yellow_cards" in known:
        known_cards = F.col("yellow_cards").isNotNull() | F.col("red_cards").isNotNull()
        rows = rows.withColumn("cards", F.when(known_cards, F.coalesce("yellow_cards", F.lit(0)) + F.coalesce("red_cards", F.lit(0))))
    return rows


SQL = """
sides0 AS (
  SELECT m.match_id, competition_id, season, match_date, status, 'home' AS venue, home_team_id AS team_id, away_team_id AS opponent_id, hg AS goals_for, ag AS goals_against FROM matches m
  UNION ALL SELECT match_id, competition_id, season, match_date, status, 'away', away_team_id, home_team_id, ag, hg FROM matches m),
sides AS (
  SELECT s.*, shots, shots_on_target, corners, fouls, yellow_cards + red_cards AS cards,
    CASE WHEN goals_for > goals_against THEN 3 WHEN goals_for = goals_against THEN 1 WHEN goals_for < goals_against THEN 0 END AS points,
    CAST(goals_against = 0 AS INT) AS clean_sheet, CAST(goals_for > 0 AS INT) AS scored, CAST(goals_for + goals_against > 2 AS INT) AS over_2_5,
    CAST(goals_for > 0 AND goals_against > 0 AS INT) AS both_teams_scored
  FROM sides0 s LEFT JOIN stats t ON t.match_id = s.match_id AND t.venue = s.venue)"""
