"""Event data in a folder tree of JSON files: competitions, matches, line-ups, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.functions.values import date

COMPETITIONS = "competition_id long, season_id long, competition_name string, season_name string"
MATCHES = (
    "match_id long, match_date string, kick_off string, competition struct<competition_id: long, competition_name: string>, season struct<season_id: long, season_name: string>, "
    "home_team struct<home_team_id: long, home_team_name: string, name: string>, away_team struct<away_team_id: long, away_team_name: string, name: string>, home_score long, away_score long"
)
LINEUPS = "team_id long, team_name string, lineup array<struct<player_id: long, player_name: string, jersey_number: int>>"
EVENTS = "id string, index long, period int, minute int, second int, type struct<id: long, name: string>, team struct<id: long, name: string>, player struct<id: long, name: string>"


def _read(spark: SparkSession, path: str, schema: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True).schema(schema)
    rows = reader.json(path).withColumn("_file", F.col("_metadata.file_path"))
    return rows if pattern is None else rows.where(F.col("_file").rlike(pattern))


def competitions(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, f"{root}/competitions.json", COMPETITIONS).drop("_file")


def matches(spark: SparkSession, root: str) -> DataFrame:
    """Normalised matches; ids of competition and season come from the record, else from the file's place."""
    rows = _read(spark, f"{root}/matches", MATCHES, r"/\d+/\d+\.json$")
    place = lambda k: F.regexp_extract("_file", r"/(\d+)/(\d+)\.json$", k).cast("long")
    finished = F.col("home_score").isNotNull() & F.col("away_score").isNotNull()
    return rows.where("match_id is not null").select(
        "match_id",
        F.coalesce("competition.competition_id", place(1)).alias("competition_id"),
        F.coalesce("season.season_id", place(2)).alias("season_id"),
        date(F.col("match_date")).alias("match_date"),
        "kick_off",
        F.col("home_team.home_team_id").alias("home_team_id"),
        F.coalesce("home_team.home_team_name", "home_team.name").alias("home_team"),
        F.col("away_team.away_team_id").alias("away_team_id"),
        F.coalesce("away_team.away_team_name", "away_team.name").alias("away_team"),
        F.col("home_score").alias("hg"),
        F.col("away_score").alias("ag"),
        F.when(finished, "finished").otherwise("scheduled").alias("status"),
    )


def _match_id():
    return F.regexp_extract("_file", r"/(\d+)\.json$", 1).cast("long").alias("match_id")


def lineups(spark: SparkSession, root: str) -> DataFrame:
    """One row per match, team and player."""
    rows = _read(spark, f"{root}/lineups", LINEUPS).where("team_id is not null")
    return rows.select(_match_id(), "team_id", "team_name", F.inline("lineup"))


def events(spark: SparkSession, root: str) -> DataFrame:
    rows = _read(spark, f"{root}/events", EVENTS).where("id is not null")
    return rows.select(_match_id(), "id", "index", "period", "minute", "second", F.col("type.name").alias("type"), F.col("team.id").alias("team_id"), F.col("player.id").alias("player_id"), F.col("player.name").alias("player_name"))


def manifest(matches: DataFrame, lineups: DataFrame, events: DataFrame) -> DataFrame:
    """By competition and season: matches, those with line-ups and with events, and whether all have both."""
    rows = matches.select("competition_id", "season_id", "match_id")
    for name, df in (("lineups", lineups), ("events", events)):
        rows = rows.join(df.select("match_id").distinct().withColumn(f"has_{name}", F.lit(1)), "match_id", "left")
    out = rows.groupBy("competition_id", "season_id").agg(F.count(F.lit(1)).alias("matches"), F.count("has_lineups").alias("with_lineups"), F.count("has_events").alias("with_events"))
    return out.withColumn("complete", (F.col("matches") == F.col("with_lineups")) & (F.col("matches") == F.col("with_events")))
