"""Row validation with quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


MOST_GOALS = 99
#: What a status may be, and the shape of a kickoff time.
STATUSES = ("scheduled", "live", "finished", "postponed", "cancelled", "abandoned", "awarded", "unknown")
KICKOFF = r"(?i)^([01]\d|2[0-3]):[0-5]\d(\s+(UTC|GMT)[+-]\d{1,2}(:[0-5]\d)?)?$"


def more_rules(columns: list[str]) -> dict[str, Column]:
    """Error code to condition, of those rules whose columns rows have: extra time, penalties, attendance, status."""
    e, f = F.col("het"), F.col("aet")
    found = {
        ("het", "aet"): ("half_extra_time_pair", e.isNull() != f.isNull()),
        ("het", "aet", "hg", "ag"): ("full_time_above_extra_time", (F.col("hg") > e) | (F.col("ag") > f)),
        ("hp", "ap"): ("half_penalty_pair", F.col("hp").isNull() != F.col("ap").isNull()),
        ("attendance",): ("negative_attendance", F.col("attendance") < 0),
        ("status",): ("unsupported_status", ~F.col("status").isin(*STATUSES)),
    }
    return dict(rule for needs, rule in found.items() if set(needs) <= set(columns))


def rules() -> dict[str, Column]:
    """Error code to condition over a parsed match."""
    a, b, c, d = (F.col(x) for x in ("hg", "ag", "hht", "aht"))
    return {
        "missing_competition": F.col("competition").isNull() | (F.trim("competition") == ""),
        "missing_home_team": F.col("home_team").isNull() | (F.trim("home_team") == ""),
        "missing_away_team": F.col("away_team").isNull() | (F.trim("away_team") == ""),
        "same_team": F.col("home_team") == F.col("away_team"),
        "missing_date": F.col("match_date").isNull(),
        "score_out_of_range": (F.least(a, b, c, d) < 0) | (F.greatest(a, b, c, d) > MOST_GOALS),
        "half_full_time_pair": a.isNull() != b.isNull(),
        "half_half_time_pair": c.isNull() != d.isNull(),
        "half_time_above_full_time": (c > a) | (d > b),
        "finished_without_score": (F.col("status") == "finished") & a.isNull(),
    }


def warnings() -> dict[str, Column]:
    return {"missing_season": F.col("season").isNull(), "many_goals": (F.col("hg") + F.col("ag")) > 15, "scheduled_with_score": (F.col("status") == "scheduled") & F.col("hg").isNotNull()}


def _found(checks: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in checks.items()]), lambda x: x.isNotNull())


def checked(rows: DataFrame) -> DataFrame:
    """rows with errors and warnings, arrays of codes."""
    more = {"odd_kickoff_time": ~F.col("kickoff_time").rlike(KICKOFF)} if "kickoff_time" in rows.columns else {}
    return rows.withColumns({"errors": _found(rules() | more_rules(rows.columns)), "warnings": _found(warnings() | more)})


def good(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("errors") == 0).drop("errors", "warnings")


def quarantine(rows: DataFrame, row_id: str) -> DataFrame:
    """row_id, severity, code: one row per finding of checked()."""
    all_ = F.concat(F.transform("errors", lambda x: F.struct(F.lit("error").alias("severity"), x.alias("code"))), F.transform("warnings", lambda x: F.struct(F.lit("warning").alias("severity"), x.alias("code"))))
    return rows.select(row_id, F.inline(all_))


def without_identity(rows: DataFrame, row_id: str) -> DataFrame:
    """row_id and lacks (competition, season) of rows that can't be told apart: no competition, or a season without a year."""
    lacks = {"competition": F.trim(F.coalesce("competition", F.lit(""))) == "", "season": ~F.coalesce(F.col("season").cast("string"), F.lit("")).rlike(r"(19|20)\d{2}")}
    return rows.select(row_id, _found(lacks).alias("lacks")).where(F.size("lacks") > 0)


def require_identity(rows: DataFrame, row_id: str, most: int = 10) -> DataFrame:
    """rows; ValueError with the first `most` rows of without_identity() if there are any."""
    bad = without_identity(rows, row_id).orderBy(row_id).limit(most).collect()
    if bad:
        raise ValueError("; ".join(f"{r[0]}: no {' and '.join(r.lacks)}" for r in bad))
    return rows


def missing_references(rows: DataFrame, row_id: str, known: dict[str, DataFrame]) -> DataFrame:
    """row_id and field: values of rows that no row of known[field] (a column of that name) has; a null refers to nothing."""
    found = None
    for field, table in known.items():
        lost = rows.where(F.col(field).isNotNull()).join(table.select(field).distinct(), field, "left_anti").select(row_id, F.lit(field).alias("field"))
        found = lost if found is None else found.unionByName(lost)
    return found


def out_of_range(rows: DataFrame, row_id: str, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """row_id, field and value of each number beyond its bounds; null is in bounds."""
    checks = []
    for field, (low, high) in bounds.items():
        off = F.lit(False) if low is None else F.col(field) < low
        off = off if high is None else off | (F.col(field) > high)
        checks.append(F.when(F.coalesce(off, F.lit(False)), F.struct(F.lit(field).alias("field"), F.col(field).cast("double").alias("value"))))
    return rows.select(row_id, F.inline(F.filter(F.array(*checks), lambda x: x.isNotNull())))


def unplannable(rows: DataFrame, seasons: DataFrame, now: str | Column, stored: DataFrame | None = None) -> DataFrame:
    """match_id and problem of matches that can't be planned: same_team, season_of_other_competition (of seasons:
    competition_id, season), kickoff_not_ahead (at or before now).

    With stored, rows are changes: a null leaves what is stored, and a kickoff is looked at only where it is changed.
    """
    fields = ["competition_id", "season", "match_date", "home_team_id", "away_team_id"]
    rows = rows.select("match_id", *fields, F.col("match_date").alias("_told"))
    if stored is not None:
        known = stored.select("match_id", *[F.col(c).alias(f"_{c}") for c in fields])
        rows = rows.join(known, "match_id").select("match_id", "_told", *[F.coalesce(c, f"_{c}").alias(c) for c in fields])
    pairs = seasons.select("competition_id", "season").distinct().withColumn("_of", F.lit(True))
    rows = rows.join(pairs, ["competition_id", "season"], "left")
    now = F.to_timestamp_ntz(F.lit(now)) if isinstance(now, str) else now
    checks = {"same_team": F.col("home_team_id") == F.col("away_team_id"), "season_of_other_competition": F.col("_of").isNull(), "kickoff_not_ahead": F.col("_told") <= now}
    return rows.select("match_id", F.explode(_found(checks)).alias("problem"))
