"""Standings, coverage, listings and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.operators import prefix
from pitchlake.operators.history import micros
from pitchlake.operators.sides import completed, sides


def standings(matches: DataFrame) -> DataFrame:
    """Table of each competition and season: counts, goals, points, the last five results (newest last), position."""
    rows = sides(completed(matches))
    won, drawn, lost = (F.count_if(F.col("points") == p) for p in (3, 1, 0))
    letter = F.when(F.col("points") == 3, "W").when(F.col("points") == 1, "D").otherwise("L")
    games = F.sort_array(F.collect_list(F.struct(micros().alias("t"), "match_id", letter.alias("r"))))
    total = rows.groupBy("competition_id", "season", "team_id").agg(
        F.count(F.lit(1)).alias("played"), won.alias("won"), drawn.alias("drawn"), lost.alias("lost"), F.sum("goals_for").alias("gf"), F.sum("goals_against").alias("ga"), F.sum("points").alias("points"), games.alias("games")
    )
    last = F.slice("games", F.greatest(F.lit(1), F.size("games") - 4), 5)
    total = total.withColumn("gd", F.col("gf") - F.col("ga")).withColumn("form", F.array_join(F.transform(last, lambda g: g["r"]), "")).drop("games")
    order = Window.partitionBy("competition_id", "season").orderBy(F.desc("points"), F.desc("gd"), F.desc("gf"), "team_id")
    return total.withColumn("position", F.row_number().over(order).cast("long"))


def nested(matches: DataFrame, competitions: DataFrame, teams: DataFrame) -> DataFrame:
    """match_id and record: the match with its competition, season and teams as structs of id and name (null: unknown).

    competitions: competition_id, name. teams: team_id, name. Seasons are named by their year.
    """
    rows = matches.join(competitions.select("competition_id", F.col("name").alias("_c")), "competition_id", "left")
    for side in ("home", "away"):
        rows = rows.join(teams.select(F.col("team_id").alias(f"{side}_team_id"), F.col("name").alias(f"_{side}")), f"{side}_team_id", "left")
    part = lambda i, n, alias: F.struct(F.col(i).alias("id"), n.alias("name")).alias(alias)
    own = [F.date_format("match_date", "yyyy-MM-dd").alias("match_date"), "status", F.col("hg").alias("home_score"), F.col("ag").alias("away_score"), F.col("hht").alias("halftime_home_score"), F.col("aht").alias("halftime_away_score")]
    sides_ = [part("home_team_id", F.col("_home"), "home_team"), part("away_team_id", F.col("_away"), "away_team")]
    return rows.select("match_id", F.struct(F.col("match_id").alias("id"), part("competition_id", F.col("_c"), "competition"), part("season", F.col("season").cast("string"), "season"), *sides_, *own).alias("record"))


def match_list(matches: DataFrame, status: str | None = None, competition_id: int | None = None, since: str | None = None, until: str | None = None, newest_first: bool = True, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of matches by status, competition and dates (since <= date < until), in order of date and match_id."""
    if status is not None:
        matches = matches.where(F.col("status") == status)
    if competition_id is not None:
        matches = matches.where(F.col("competition_id") == competition_id)
    if since is not None:
        matches = matches.where(F.col("match_date") >= F.to_timestamp_ntz(F.lit(since)))
    if until is not None:
        matches = matches.where(F.col("match_date") < F.to_timestamp_ntz(F.lit(until)))
    date = F.col("match_date").desc() if newest_first else F.col("match_date").asc()
    return matches.orderBy(date, "match_id").offset(offset).limit(limit)


def team_results(matches: DataFrame, before: str, n: int) -> DataFrame:
    """The last n results of every team in any competition strictly before a date, newest first."""
    rows = sides(completed(matches)).where(F.col("match_date") < F.to_timestamp_ntz(F.lit(before)))
    order = Window.partitionBy("team_id").orderBy(F.desc("match_date"), F.desc("match_id"), "venue")
    return rows.withColumn("nth", F.row_number().over(order).cast("long")).where(F.col("nth") <= n)


def league_last(matches: DataFrame, n: int = 200) -> DataFrame:
    """Goal means of the competition's last n finished matches strictly before each match."""
    rows = matches.select("match_id", "competition_id", "match_date", "status", "hg", "ag")
    means = {"home_avg": F.col("hg"), "away_avg": F.col("ag")}
    found = prefix.mean_of_last(rows, ["competition_id"], micros(), ["match_id"], F.col("status") == "finished", means, n)
    return found.select("match_id", F.col("n_seen").alias("n_matches"), "home_avg", "away_avg")


def coverage(matches: DataFrame) -> DataFrame:
    """By competition: first and last date, matches in all and by status, distinct teams and the seasons in order."""
    teams = sides(matches).groupBy("competition_id").agg(F.count_distinct("team_id").alias("n_teams"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    rows = matches.groupBy("competition_id").agg(
        day(F.min("match_date")).alias("first_date"),
        day(F.max("match_date")).alias("last_date"),
        F.count_distinct("match_id").alias("n_matches"),
        F.count_if(F.col("status") == "finished").alias("n_finished"),
        F.count_if(F.col("status") == "scheduled").alias("n_scheduled"),
        F.count("hht").alias("n_half_time"),
        F.array_join(F.sort_array(F.collect_set("season")).cast("array<string>"), ",").alias("seasons"),
    )
    return rows.join(teams, "competition_id")


def data_categories(matches: DataFrame, statistics: DataFrame, players: DataFrame) -> DataFrame:
    """By competition: whether results, half times, statistics, cards and player rows exist, and the missing ones."""
    ids = lambda df: df.select("match_id").distinct()
    has = {
        "results": matches.where("hg is not null"),
        "half_times": matches.where("hht is not null"),
        "statistics": matches.join(ids(statistics), "match_id", "left_semi"),
        "cards": matches.join(ids(statistics.where("red_cards > 0")), "match_id", "left_semi"),
        "players": matches.join(ids(players), "match_id", "left_semi"),
        "referees": matches.where("false"),
    }
    rows = matches.select("competition_id").distinct()
    for name, found in has.items():
        some = found.select("competition_id", F.lit(True).alias(f"has_{name}")).distinct()
        rows = rows.join(some, "competition_id", "left").withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    missing = F.array_join(F.filter(F.array(*[F.when(~F.col(f"has_{n}"), n) for n in has]), lambda x: x.isNotNull()), ",")
    complete = F.when(missing == "", "complete").otherwise("incomplete")
    return rows.withColumn("missing", missing).withColumn("state", complete)


def import_metrics(matches: DataFrame) -> DataFrame:
    """One row: matches, finished, scheduled, distinct teams and competitions."""
    own = matches.agg(F.count(F.lit(1)).alias("matches"), F.count_if(F.col("status") == "finished").alias("finished"), F.count_if(F.col("status") == "scheduled").alias("scheduled"), F.count_distinct("competition_id").alias("competitions"))
    return own.crossJoin(sides(matches).agg(F.count_distinct("team_id").alias("teams")))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n: the row count of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def search(table: DataFrame, column: str, text: str, limit: int = 50) -> DataFrame:
    """Rows whose column has the text in any case, by name; at most `limit`."""
    escaped = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return table.where(F.col(column).ilike(f"%{escaped}%")).orderBy(column).limit(limit)


def is_any(column: Column) -> Column:
    """Whether any row of a group has it; false where all are null."""
    return F.coalesce(F.bool_or(column), F.lit(False))
