"""Match tables derived from the order tables that every query reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def team_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """One row per match and side that has statistics: shots, shots_on_target, corners, cards, fouls."""
    lines = table(spark, folder, "lineitem").where(F.col("l_returnflag").isin("A", "R"))
    side = F.when(F.col("l_returnflag") == "A", "home").otherwise("away")
    return lines.groupBy(F.col("l_orderkey").alias("match_id"), side.alias("venue")).agg(
        F.sum("l_quantity").cast("long").alias("shots"),
        F.sum(F.when(F.col("l_discount") <= 0.05, F.col("l_quantity"))).cast("long").alias("shots_on_target"),
        F.sum("l_linenumber").cast("long").alias("corners"),
        F.count_if(F.col("l_tax") >= 0.04).alias("yellow_cards"),
        F.count_if(F.col("l_tax") >= 0.08).alias("red_cards"),
        F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_linenumber"))).cast("long").alias("fouls"),
    )


def matches(spark: SparkSession, folder: str) -> DataFrame:
    """One row per match; scores are null until it is finished."""
    lines = table(spark, folder, "lineitem")
    home, away, first_half = F.col("l_returnflag") == "A", F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    goals = lines.groupBy("l_orderkey").agg(
        F.count_if(home).alias("hg"), F.count_if(away).alias("ag"), F.count_if(home & first_half).alias("hht"), F.count_if(away & first_half).alias("aht")
    )
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    rows = table(spark, folder, "orders").join(customers, F.col("c_custkey") == F.col("o_custkey")).join(nations, F.col("n_nationkey") == F.col("c_nationkey"))
    rows = rows.join(goals, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    finished = F.col("hg").isNotNull() & (F.col("o_orderstatus") != "P")
    base, slot = F.col("n_regionkey") * 20, F.col("o_custkey") % 20
    return rows.select(
        F.col("o_orderkey").alias("match_id"),
        F.col("n_regionkey").cast("long").alias("competition_id"),
        F.year("o_orderdate").cast("long").alias("season"),
        F.col("o_orderdate").alias("match_date"),
        (base + slot).cast("long").alias("home_team_id"),
        (base + (slot + 1 + F.col("o_orderkey") % 19) % 20).cast("long").alias("away_team_id"),
        F.when(finished, "finished").otherwise("scheduled").alias("status"),
        *[F.when(finished, F.col(c)).alias(c) for c in ("hg", "ag", "hht", "aht")],
    )


def player_matches(spark: SparkSession, folder: str) -> DataFrame:
    """One row per match and player: minutes, goals, cards. Dealt by match, so that matches are joined without another shuffle."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_tax").repartition("l_orderkey")
    return lines.groupBy(F.col("l_orderkey").alias("match_id"), F.col("l_partkey").alias("player_id")).agg(
        F.least(F.sum("l_quantity"), F.lit(90.0)).cast("long").alias("minutes"),
        F.count_if(F.col("l_returnflag").isin("A", "R")).alias("goals"),
        F.count_if(F.col("l_tax") >= 0.07).alias("cards"),
    )


SQL = """
li AS (
  SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS hg, count(*) FILTER (WHERE l_returnflag = 'R') AS ag,
    count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') AS hht, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') AS aht
  FROM lineitem GROUP BY l_orderkey),
stats AS (
  SELECT l_orderkey AS match_id, CASE l_returnflag WHEN 'A' THEN 'home' ELSE 'away' END AS venue, CAST(sum(l_quantity) AS BIGINT) AS shots,
    CAST(sum(l_quantity) FILTER (WHERE l_discount <= 0.05) AS BIGINT) AS shots_on_target, CAST(sum(l_linenumber) AS BIGINT) AS corners,
    count(*) FILTER (WHERE l_tax >= 0.04) AS yellow_cards, count(*) FILTER (WHERE l_tax >= 0.08) AS red_cards,
    CAST(sum(l_linenumber) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS fouls
  FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_orderkey, l_returnflag),
matches0 AS (
  SELECT o_orderkey AS match_id, CAST(n_regionkey AS BIGINT) AS competition_id, CAST(year(o_orderdate) AS BIGINT) AS season, o_orderdate AS match_date,
    CAST(n_regionkey * 20 + o_custkey % 20 AS BIGINT) AS home_team_id,
    CAST(n_regionkey * 20 + (o_custkey % 20 + 1 + o_orderkey % 19) % 20 AS BIGINT) AS away_team_id,
    CASE WHEN hg IS NULL OR o_orderstatus = 'P' THEN 'scheduled' ELSE 'finished' END AS status, hg AS hg0, ag AS ag0, hht AS hht0, aht AS aht0
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey LEFT JOIN li ON l_orderkey = o_orderkey),
matches AS (
  SELECT match_id, competition_id, season, match_date, home_team_id, away_team_id, status, CASE WHEN status = 'finished' THEN hg0 END AS hg,
    CASE WHEN status = 'finished' THEN ag0 END AS ag, CASE WHEN status = 'finished' THEN hht0 END AS hht, CASE WHEN status = 'finished' THEN aht0 END AS aht
  FROM matches0),
player_matches AS (
  SELECT l_orderkey AS match_id, l_partkey AS player_id, CAST(least(sum(l_quantity), 90.0) AS BIGINT) AS minutes,
    count(*) FILTER (WHERE l_returnflag IN ('A', 'R')) AS goals, count(*) FILTER (WHERE l_tax >= 0.07) AS cards
  FROM lineitem GROUP BY l_orderkey, l_partkey)"""
