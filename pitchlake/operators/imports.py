"""An import as one plan: parsed rows of any sources, checked, filtered by competition and season, counted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.functions import names
from pitchlake.operators import validate
from pitchlake.sources import landing, results_csv


def together(*parsed: DataFrame) -> DataFrame:
    """Rows of several parsers as one table; a column that a parser lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parsed)


def uploaded(found: DataFrame, most: int = landing.MAX_FILE) -> tuple[DataFrame, DataFrame]:
    """Uploaded files (path, content): their records (path, cells) by the reader of each payload's suffix, and path, error
    of the files that can't be read."""
    taken = landing.uploads(found, most)
    csv = results_csv.raw_rows(taken.where("suffix = '.csv'").withColumn("member", F.lit(None).cast("string")))
    rows = taken.where("suffix = '.json' and error is null").select("path", landing.json_records(F.col("content")).alias("rows"))
    refused = taken.where("error is not null").select("path", "error").unionByName(rows.where("rows is null").select("path", F.lit("not_json").alias("error")))
    return csv.select("path", "cells").unionByName(rows.select("path", F.explode("rows").alias("cells"))), refused


def about(rows: DataFrame, competition: str | None = None, season: str | None = None) -> DataFrame:
    """Rows whose competition or path has the plain form of `competition` in it, and whose season is `season`'s in any spelling."""
    if competition:
        token = names.plain(competition)
        places = [F.col(c) for c in ("competition", "path") if c in rows.columns]
        rows = rows.where(reduce(lambda a, b: a | b, [names.plain_name(p).contains(token) for p in places]))
    if season:
        rows = rows.where(names.season_name(F.col("season").cast("string")) == names.season_name(F.lit(season)))
    return rows


def in_order(value: Column, order: Column) -> Column:
    """An aggregate: the distinct values, each at its first place in the order."""
    seen = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    return F.array_distinct(F.transform(seen, lambda x: x["v"]))


def preview_quality(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Per competition: first and last date, matches in all, finished and scheduled ones, seasons, and which fields any row has."""
    present = [F.when(F.count(F.nullif(F.col(f).cast("string"), F.lit(""))) > 0, f) for f in sorted(fields)]
    return rows.groupBy(F.coalesce(F.nullif(F.col("competition").cast("string"), F.lit("")), F.lit("Unknown competition")).alias("competition")).agg(
        F.min("match_date").alias("first_match_date"), F.max("match_date").alias("last_match_date"), F.count(F.lit(1)).alias("total_matches"),
        F.count_if(F.lower("status") == "finished").alias("finished_matches"), F.count_if(F.lower("status") == "scheduled").alias("scheduled_matches"),
        F.array_sort(F.collect_set(F.col("season").cast("string"))).alias("seasons_available"), F.array_compact(F.array(*present)).alias("fields_available"),
    )


def imported(parsed: DataFrame, competition: str | None = None, season: str | None = None) -> DataFrame:
    """parsed rows about the competition and season with errors and warnings; good ones have no errors."""
    return validate.checked(about(parsed, competition, season))


def metrics(checked: DataFrame) -> DataFrame:
    """One row: matches, good and bad ones, those with warnings, competitions and seasons of the good ones."""
    good = F.size("errors") == 0
    return checked.agg(
        F.count(F.lit(1)).alias("matches"), F.count_if(good).alias("good"), F.count_if(~good).alias("bad"), F.count_if(F.size("warnings") > 0).alias("warned"),
        F.count_distinct(F.when(good, F.col("competition"))).alias("competitions"), F.count_distinct(F.when(good, F.col("season"))).alias("seasons"),
    )
