"""Results in CSV: any of three delimiters, three encodings, and the column names that results files use."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.functions import names, values
from pitchlake.sources.landing import text_of

# Columns of results files and what they are called here.
COLUMNS = {
    "Date": "date", "Time": "time", "HomeTeam": "home_team", "AwayTeam": "away_team", "Home": "home_team", "Away": "away_team", "FTHG": "hg", "FTAG": "ag", "HG": "hg", "AG": "ag", "HTHG": "hht", "HTAG": "aht",
    "Referee": "referee", "HS": "home_shots", "AS": "away_shots", "HST": "home_shots_on_target", "AST": "away_shots_on_target", "HF": "home_fouls", "AF": "away_fouls", "HC": "home_corners", "AC": "away_corners",
    "HY": "home_yellow_cards", "AY": "away_yellow_cards", "HR": "home_red_cards", "AR": "away_red_cards", "Season": "season", "League": "competition",
    "Div": "competition_code", "FTR": "result", "HTR": "half_time_result",
}
REQUIRED = ("date", "home_team", "away_team", "hg", "ag")
COUNTS = tuple(c for c in dict.fromkeys(COLUMNS.values()) if c in ("hg", "ag", "hht", "aht") or c.startswith(("home_", "away_")) and not c.endswith("_team"))
ODDS = ("B365H", "B365D", "B365A", "PSH", "PSD", "PSA", "MaxH", "MaxD", "MaxA", "AvgH", "AvgD", "AvgA")


def parse(text: str) -> list[dict[str, str]]:
    """Rows of a file as name to cell; names and cells trimmed, blank rows left out."""
    first = next((line for line in text.splitlines() if line.strip()), "")
    delimiter = max(",;\t", key=first.count)
    reader = csv.reader(io.StringIO(text), delimiter=delimiter)
    header = [h.strip() for h in next((r for r in reader if any(x.strip() for x in r)), [])]
    rows = ({h: c.strip() for h, c in zip(header, r, strict=False) if h} for r in reader)
    return [r for r in rows if any(r.values())]


def raw_rows(found: DataFrame) -> DataFrame:
    """path, member, row_number, cells (map) of files (path, member, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(p, m, n, list(row.items())) for p, m, c in zip(frame.path, frame.member, frame.content, strict=True) if c is not None for n, row in enumerate(parse(text_of(c)), 2)]
            yield pd.DataFrame(out, columns=["path", "member", "row_number", "cells"])

    kept = found.where("error is null") if "error" in found.columns else found
    rows = kept.select("path", "member", "content").mapInPandas(run, "path string, member string, row_number int, cells array<struct<key string, value string>>")
    return rows.withColumn("cells", F.map_from_entries("cells"))


def column_report(header: list[str]) -> dict[str, list[str]]:
    """Which known columns a file has, lacks, and which of the required ones are missing."""
    have = {COLUMNS[h] for h in header if h in COLUMNS}
    known = list(dict.fromkeys(COLUMNS.values()))
    return {"available": [c for c in known if c in have], "missing": [c for c in known if c not in have], "required_missing": [c for c in REQUIRED if c not in have], "odds": [h for h in header if h in ODDS]}


def normalised(rows: DataFrame, competition: str | None = None, season: str | None = None) -> DataFrame:
    """Typed matches of raw_rows(): dates, counts, cards, odds (map), status, invalid (fields with unreadable text).

    Absent and blank cells are null and never 0; accents stay. A file's own competition goes before the one given, its
    provider's code (Div) counts where there is neither. record_id is stable over competition, season, date and
    teams.
    """
    cell = lambda name: values.filled(*[F.col("cells")[h] for h, n in COLUMNS.items() if n == name])
    typed = {c: values.count(cell(c)) for c in COUNTS}
    at = values.kickoff(values.date(cell("date")).cast("timestamp"), cell("time"))["at"]
    bad = F.filter(F.array(*[F.when(cell(c).isNotNull() & t.isNull(), c) for c, t in typed.items()], F.when(cell("date").isNotNull() & at.isNull(), "date")), lambda x: x.isNotNull())
    odds = F.map_filter(F.transform_values("cells", lambda k, v: v.try_cast("double")), lambda k, v: k.isin(*ODDS) & (v > 1))
    out = rows.select(
        "path", "member", "row_number", F.coalesce(cell("competition"), F.lit(competition), cell("competition_code")).alias("competition"), cell("competition_code").alias("competition_code"), F.coalesce(cell("season"), F.lit(season)).alias("season"),
        at.alias("match_date"), cell("home_team").alias("home_team"), cell("away_team").alias("away_team"), cell("referee").alias("referee"),
        cell("result").alias("result"), cell("half_time_result").alias("half_time_result"),
        *[t.alias(c) for c, t in typed.items()], odds.alias("odds"), bad.alias("invalid"),
    )
    for side in ("home", "away"):
        y, r = F.col(f"{side}_yellow_cards"), F.col(f"{side}_red_cards")
        out = out.withColumn(f"{side}_cards", F.when(y.isNotNull() | r.isNotNull(), F.coalesce(y, F.lit(0)) + F.coalesce(r, F.lit(0))))
    status = F.when(F.col("hg").isNotNull() & F.col("ag").isNotNull(), "finished").otherwise("scheduled")
    key = names.identity(F.col("competition"), F.col("season"), F.col("match_date"), names.plain_name("home_team"), names.plain_name("away_team"))
    return out.withColumn("status", status).withColumn("record_id", key)
