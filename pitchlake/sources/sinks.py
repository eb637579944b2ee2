"""Writing tables: feature files, upserted tables, the ledger of runs, templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.operators.consolidate import upsert

# The headers of the import templates.
TEMPLATES = {
    "matches": "competition,season,match_date,home_team,away_team,home_goals,away_goals,home_yellow_cards,away_yellow_cards,home_red_cards,away_red_cards,home_corners,away_corners",
    "players": "player_name,team,position,active,penalty_taker,free_kick_taker",
    "player_matches": "match_id,player_name,team,started,minutes_played,goals,shots,shots_on_target,xg,yellow_cards,red_cards",
    "upcoming_matches": "competition,season,match_date,home_team,away_team,venue,referee",
}
LEDGER = "run_id string, source string, content_hash string, status string, records long, errors long, duration_seconds double, finished_at timestamp"


def write_features(rows: DataFrame, path: str) -> None:
    """By the path's suffix: csv (with header), json or jsonl, else Parquet. Fails where the path exists."""
    writer = rows.write
    if path.endswith(".csv"):
        writer.option("header", True).csv(path)
    elif path.endswith((".json", ".jsonl")):
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    return spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)


def next_version(spark: SparkSession, stored: str, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Upsert incoming into the table at `stored` as a new table at `version`: readers of the old one aren't disturbed."""
    upsert(spark.read.parquet(stored), incoming, keys).write.parquet(version)
    return spark.read.parquet(version)


def record_run(spark: SparkSession, ledger: str, run_id: str, source: str, content_hash: str, good: DataFrame, bad: DataFrame, seconds: float) -> DataFrame:
    """Append one row to the ledger: completed, partial (some rows are bad) or failed (all are)."""
    n, e = good.count(), bad.count()
    status = "completed" if not e else "partial" if n else "failed"
    row = spark.createDataFrame([(run_id, source, content_hash, status, n, e, seconds, None)], LEDGER).withColumn("finished_at", F.current_timestamp())
    row.write.mode("append").parquet(ledger)
    return row


def already_imported(ledger: DataFrame, content_hash: str) -> bool:
    return not ledger.where((F.col("content_hash") == content_hash) & (F.col("status") == "completed")).isEmpty()


def without_run(table: DataFrame, run_id: str, predictions: DataFrame | None = None) -> DataFrame:
    """table without the rows of an import; ValueError if predictions refer to one of them."""
    own = table.where(F.col("run_id") == run_id)
    if predictions is not None and not predictions.join(own.select("match_id"), "match_id", "left_semi").isEmpty():
        raise ValueError("predictions refer to this import")
    return table.where(~F.col("run_id").eqNullSafe(run_id))
