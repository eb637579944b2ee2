"""How far a prediction's inputs can be trusted, and what stands in for missing ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.operators.history import micros

#: Weights of history, statistics, line-ups, referee and recency; what demo data keep of the sum.
WEIGHTS, DEMO = (0.45, 0.20, 0.15, 0.10, 0.10), 0.85


def with_quality(rows: DataFrame) -> DataFrame:
    """rows with quality in [0, 1] from history_matches and history_max_date of both sides, stats_coverage,
    lineup_coverage, referee_known and is_mock_data."""
    games = F.least((F.col("home_history_matches") + F.col("away_history_matches")) / 20, F.lit(1.0))
    newest = F.greatest("home_history_max_date", "away_history_max_date")
    age = (micros() - F.unix_micros(newest.cast("timestamp"))) / 86_400_000_000.0
    recent = F.when(newest.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - age / 365)))
    parts = (games, F.col("stats_coverage"), F.col("lineup_coverage"), F.col("referee_known").cast("double"), recent)
    total = sum((w * p for w, p in zip(WEIGHTS, parts, strict=True)), F.lit(0.0))
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
    return rows.withColumn("quality", bounded * F.when(F.col("is_mock_data"), DEMO).otherwise(1.0))


def label(column: str) -> Column:
    x = F.col(column)
    return F.when(x < 0.5, "very_low").when(x < 0.6, "low").when(x < 0.7, "medium").when(x < 0.8, "high").otherwise("very_high")


def league_fallback(sides: DataFrame, before: str | None, n: int = 40) -> DataFrame:
    """competition_id with the means of cards, corners and shots over its last n team rows before a date.

    Without a date all rows count, later ones too: that leaks and is only for comparison.
    """
    rows = sides.where("status = 'finished' and shots is not null")
    if before is not None:
        rows = rows.where(F.col("match_date") < F.to_timestamp_ntz(F.lit(before)))
    order = Window.partitionBy("competition_id").orderBy(F.desc("match_date"), F.desc("match_id"), "venue")
    last = rows.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= n)
    return last.groupBy("competition_id").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("cards", "corners", "shots")])
