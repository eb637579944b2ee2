"""Numbers, dates and statuses from text that may be anything."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date patterns of results files, and month names in English, Spanish and German.
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd/MM/yy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyy/MM/dd")
MONTHS = {
    1: "jan january ene enero januar jänner", 2: "feb february febrero februar", 3: "mar march marzo märz mär", 4: "apr april abr abril", 5: "may mayo mai", 6: "jun june junio juni",
    7: "jul july julio juli", 8: "aug august ago agosto", 9: "sep sept september septiembre", 10: "oct october octubre okt oktober", 11: "nov november noviembre", 12: "dec december dic diciembre dez dezember",
}


def filled(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns])


def count(text: Column) -> Column:
    """A whole number of 0 or more; anything else is null."""
    number = text.try_cast("double")
    return F.when((number >= 0) & (number == F.floor(number)), number.cast("long"))


def real(text: Column) -> Column:
    """A finite number of 0 or more; anything else is null."""
    number = text.try_cast("double")
    return F.when((number >= 0) & ~F.isnan(number) & (number < float("inf")), number)


def date(text: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The first format that fits, as a timestamp at midnight UTC."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in formats])


def kickoff(day: Column, time: Column) -> Column:
    """struct(at, time_known, zone_known): day with hh:mm and UTC±h[:mm], whose offset is taken off; 14 hours at most.

    Without a time it is midnight; without a zone the time counts as UTC; a zone beyond 14 hours makes it null.
    """
    hours = F.regexp_extract(time, r"^\s*(\d{1,2})[:.](\d{2})", 1).try_cast("int")
    minutes = F.regexp_extract(time, r"^\s*(\d{1,2})[:.](\d{2})", 2).try_cast("int")
    sign = F.when(F.regexp_extract(time, r"UTC\s*([+-])", 1) == "-", -1).otherwise(1)
    zone = F.regexp_extract(time, r"UTC\s*[+-]\s*(\d{1,2})", 1).try_cast("int")
    extra = F.coalesce(F.regexp_extract(time, r"UTC\s*[+-]\s*\d{1,2}:(\d{2})", 1).try_cast("int"), F.lit(0))
    offset = sign * (zone * 60 + extra)
    known = F.coalesce((hours < 24) & (minutes < 60), F.lit(False))
    shift = F.when(known, hours * 60 + minutes - F.coalesce(offset, F.lit(0))).otherwise(0)
    at = day + F.make_dt_interval(F.lit(0), F.lit(0), shift)
    valid = offset.isNull() | (F.abs(offset) <= 14 * 60)
    return F.struct(F.when(valid, at).alias("at"), known.alias("time_known"), (known & zone.isNotNull()).alias("zone_known"))


def status(text: Column, has_score: Column) -> Column:
    """Free text as one of finished, scheduled, live, postponed, cancelled, abandoned, awarded, unknown."""
    low = F.lower(F.coalesce(text, F.lit("")))
    rules = [("postpon|aplazad|verlegt", "postponed"), ("cancel|annul", "cancelled"), ("abandon|suspend|abgebrochen", "abandoned"), ("award|walkover|w/o", "awarded"), (r"\b(live|in[_ ]?play|half[_ -]?time)\b", "live"), ("finish|complete|full[_ -]?time|final|^ft$|^aet$|^played$", "finished"), ("sched|fixture|upcoming|not[_ ]started", "scheduled")]
    named = reduce(lambda rest, r: F.when(low.rlike(r[0]), r[1]).otherwise(rest), reversed(rules), F.when(has_score, "finished").when(low == "", "scheduled").otherwise("unknown"))
    return named


def season_date(day: Column, month: Column, season_start: Column) -> Column:
    """The date of a day and month in a season: months from July on lie in its first year. Null for no such date."""
    year = F.when(month >= 7, season_start).otherwise(season_start + 1)
    return F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0.0)).cast("date")
