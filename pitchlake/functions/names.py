"""Normal forms of names and seasons."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Club suffixes that a team's name may leave out.
CLUB_WORDS = ("fc", "cf", "sc", "ac", "afc")
NO_LETTER = re.compile("[^a-z0-9]+")


def plain(value: str | None) -> str:
    """Without accents, in folded case, with runs of anything but a-z and digits as one space: ø and ł have no accent to
    lose and go."""
    marks = unicodedata.normalize("NFKD", value or "")
    text = "".join(c for c in marks if not unicodedata.combining(c)).casefold()
    return " ".join(NO_LETTER.sub(" ", text).split())


def plain_team(value: str | None) -> str:
    """plain() of a team's name without a trailing country code, with utd spelled out and one club word dropped."""
    text = unicodedata.normalize("NFKC", html.unescape(value or ""))
    words = plain(re.sub(r"\s*\([A-Z]{2,3}\)\s*$", "", text)).split()
    words = ["united" if w == "utd" else w for w in words]
    if len(words) > 1 and words[-1] in CLUB_WORDS:
        words = words[:-1]
    name = " ".join(words)
    return "manchester united" if name == "man united" else name


@pandas_udf(T.StringType())
def plain_name(names: pd.Series) -> pd.Series:
    return names.map(plain)


@pandas_udf(T.StringType())
def plain_team_name(names: pd.Series) -> pd.Series:
    return names.map(plain_team)


def renamed(name: Column, mapping: dict[str, str]) -> Column:
    """name as mapping has it, else as it is. mapping is a list of a source's spellings: it is part of the plan."""
    if not mapping:
        return name
    return F.coalesce(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[name], name)


def season_name(text: Column) -> Column:
    """YYYY-YY of 2019/20, 2019-2020, 2019-20 or 2019 (a season that starts then); null without a year."""
    start = F.regexp_extract(text, r"((?:19|20)\d{2})", 1)
    end = F.regexp_extract(text, r"(?:19|20)\d{2}\s*[/_–-]\s*(\d{4}|\d{2})(?!\d)", 1)
    year = F.try_to_number(start, F.lit("9999")).cast("int")
    last = F.when(end != "", F.right(end, F.lit(2))).otherwise(F.lpad(((year + 1) % 100).cast("string"), 2, "0"))
    return F.when(start != "", F.concat(start, F.lit("-"), last))


def token(text: Column) -> Column:
    """A name safe in paths: letters, digits, dot, dash and underscore; other runs become one underscore."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")


def identity(*parts: Column, length: int = 24) -> Column:
    """A stable id: the first digits of sha256 over the parts as a JSON list, a null part as an empty one."""
    return F.substring(F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 256), 1, length)


def content_hash(rows_of: dict[str, Column]) -> Column:
    """sha256 of named values as canonical JSON: names in order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[rows_of[n].alias(n) for n in sorted(rows_of)]), {"ignoreNullFields": "false"}), 256)
