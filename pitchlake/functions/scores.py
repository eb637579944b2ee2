"""Scores in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAIN, HALF = r"(?:^|\s)(\d{1,2})\s*[-–:]\s*(\d{1,2})(?=\s|$|\()", r"\(\s*(\d{1,2})\s*[-–:]\s*(\d{1,2})\s*\)"


def _pair(line: Column, pattern: str) -> tuple[Column, Column]:
    return tuple(F.regexp_extract(line, pattern, k).try_cast("long") for k in (1, 2))


def scoreline(line: Column) -> Column:
    """struct(home, away, half_home, half_away) of `A 2-1 (1-0) B` on one line; null where a part is missing."""
    (a, b), (c, d) = _pair(line, MAIN), _pair(line, HALF)
    return F.struct(a.alias("home"), b.alias("away"), c.alias("half_home"), d.alias("half_away"))


def canonical(ft: Column, et: Column) -> Column:
    """The score that counts: full time, else after extra time; penalties never."""
    return F.coalesce(ft, et)
