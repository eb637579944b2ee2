"""Elo ratings as of each kickoff."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.operators.history import micros

K_FACTOR, HOME_ADVANTAGE, START = 20.0, 65.0, 1500.0


def expected(home: float, away: float, advantage: float = HOME_ADVANTAGE) -> float:
    return 1.0 / (1.0 + 10.0 ** ((away - (home + advantage)) / 400.0))


class Ratings:
    """The ratings of one competition. A team's entry is its rating before the kickoff of its last match, the rating since,
    and that kickoff, so that matches of one kickoff don't see each other. get and put reach the entries of teams."""

    def __init__(self, get: Callable, put: Callable):
        self.get, self.put = get, put

    def seen(self, team: int, at: int) -> float:
        before, since, when = self.get(team) or (START, START, None)
        return before if when == at else since

    def _change(self, team: int, at: int, points: float) -> None:
        before, since, when = self.get(team) or (START, START, None)
        self.put(team, (before if when == at else since, since + points, at))

    def play(self, at: int, home: int, away: int, hg, ag) -> tuple[float, float]:
        """Ratings of both sides before the kickoff `at`; a known score then changes them."""
        told = self.seen(home, at), self.seen(away, at)
        if hg is not None and ag is not None:
            now = [(self.get(t) or (START, START, None))[1] for t in (home, away)]
            points = K_FACTOR * ((1.0 if hg > ag else 0.5 if hg == ag else 0.0) - expected(*now))
            self._change(home, at, points)
            self._change(away, at, -points)
        return told


RATED = pa.schema([("match_id", pa.int64()), ("home_elo", pa.float64()), ("away_elo", pa.float64())])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rate rows that come by competition, kickoff and match; only the ratings of one competition are held."""
    nothing = object()
    now, ratings = nothing, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("competition_id", "match_id", "at", "home_team_id", "away_team_id", "hg", "ag")]
        told = []
        for competition, match, at, home, away, hg, ag in zip(*columns, strict=True):
            if now is nothing or competition != now:
                teams: dict[int, tuple] = {}
                now, ratings = competition, Ratings(teams.get, teams.__setitem__)
            told.append((match, *ratings.play(at, home, away, hg, ag)))
        if told:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*told, strict=True), RATED, strict=True)], schema=RATED)


def with_expectation(rated: DataFrame) -> DataFrame:
    """rated with elo_difference and home_elo_expected_result."""
    gap = F.col("home_elo") - F.col("away_elo")
    chance = 1 / (1 + F.pow(F.lit(10.0), (F.col("away_elo") - (F.col("home_elo") + HOME_ADVANTAGE)) / 400))
    return rated.withColumn("elo_difference", gap).withColumn("home_elo_expected_result", chance)


def elo_ratings(matches: DataFrame) -> DataFrame:
    """match_id, home_elo, away_elo, elo_difference, home_elo_expected_result.

    A fold over time within a competition. Rows are sorted by Spark and pass a task in order; the fold holds the ratings
    of a competition's teams and no matches, however many there are.
    """
    rows = matches.select("competition_id", "match_id", micros().alias("at"), F.col("home_team_id").cast("long"), F.col("away_team_id").cast("long"), F.col("hg").cast("long"), F.col("ag").cast("long"))
    ordered = rows.repartition("competition_id").sortWithinPartitions("competition_id", "at", "match_id")
    return with_expectation(ordered.mapInArrow(_fold, "match_id long, home_elo double, away_elo double"))


SQL = """
fold AS (
  SELECT competition_id, home_team_id % 20 + 1 AS h, away_team_id % 20 + 1 AS a, CASE WHEN hg > ag THEN 1.0 WHEN hg = ag THEN 0.5 ELSE 0.0 END AS s,
    row_number() OVER (PARTITION BY competition_id ORDER BY match_date, match_id) AS rn FROM matches WHERE status = 'finished'),
states AS (
  SELECT DISTINCT competition_id, CAST(0 AS BIGINT) AS rn, list_transform(range(20), lambda x: CAST(1500 AS DOUBLE)) AS r FROM matches
  UNION ALL
  SELECT competition_id, rn, list_transform(r, lambda v, i: CASE WHEN i = h THEN v + change WHEN i = a THEN v - change ELSE v END)
  FROM (SELECT s.competition_id, f.rn, s.r, f.h, f.a, 20.0 * (f.s - 1.0 / (1.0 + power(10.0, (s.r[f.a] - (s.r[f.h] + 65.0)) / 400.0))) AS change
    FROM states s JOIN fold f ON f.competition_id = s.competition_id AND f.rn = s.rn + 1)),
elo AS (
  SELECT m.match_id, s.r[home_team_id % 20 + 1] AS home_elo, s.r[away_team_id % 20 + 1] AS away_elo
  FROM (SELECT *, count(*) FILTER (WHERE status = 'finished') OVER (PARTITION BY competition_id ORDER BY match_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS nb FROM matches) m
  JOIN states s ON s.competition_id = m.competition_id AND s.rn = m.nb)"""
