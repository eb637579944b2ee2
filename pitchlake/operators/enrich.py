"""Enriching stored entities from catalogs: fills, homonyms, provenance, bounded payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.operators import prefix
from pitchlake.operators.history import micros


def filled_from(stored: DataFrame, catalog: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """stored with null fields taken from catalog (one row a key), and kept: the fields in which a stored value stays
    although the catalog has another one."""
    new = catalog.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    rows = stored.join(new, key, "left")
    differs = F.filter(F.array(*[F.when(F.col(c) != F.col(f"_{c}"), c) for c in fields]), lambda x: x.isNotNull())
    rest = [c for c in stored.columns if c not in fields]
    return rows.select(*rest, *[F.coalesce(c, f"_{c}").alias(c) for c in fields], differs.alias("kept"))


def homonyms(asked: DataFrame, known: DataFrame) -> DataFrame:
    """asked (record_id, name, birth_date) with player_id and resolution against known (player_id, name, birth_date).

    One player of the name with that birth date, or none with another and one without a date: matched. Several: ambiguous.
    Only players of other birth dates, or none of the name: new. Players are counted by name and by date before the joins,
    so that no pairs of a frequent name are formed.
    """
    undated = F.col("birth_date").isNull()
    counts = [F.count(F.lit(1)).alias("n_all"), F.min("player_id").alias("id_all"), F.count_if(undated).alias("n_none"), F.min(F.when(undated, F.col("player_id"))).alias("id_none")]
    by_name = known.groupBy("name").agg(*counts)
    by_date = known.groupBy("name", "birth_date").agg(F.count(F.lit(1)).alias("n_same"), F.min("player_id").alias("id_same"))
    rows = asked.select("record_id", "name", "birth_date").join(by_name, "name", "left").join(by_date, ["name", "birth_date"], "left")
    blank = {f"{c}_blank": F.when(undated, F.col(f"{c}_all")).otherwise(F.col(f"{c}_none")) for c in ("n", "id")}
    per = rows.withColumns(blank)
    kind = F.when(F.col("n_same") == 1, "matched").when(F.col("n_same") > 1, "ambiguous").when(F.col("n_blank") == 1, "matched").when(F.col("n_blank") > 1, "ambiguous").otherwise("new")
    player = F.when(kind == "matched", F.coalesce("id_same", "id_blank"))
    return per.select("record_id", kind.alias("resolution"), player.alias("player_id"))


def provenance(fields: list[str], source: Column) -> Column:
    """A map of each field that isn't null to the source that it came from."""
    pairs = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("k"), source.alias("v"))) for c in fields])
    return F.map_from_entries(F.filter(pairs, lambda x: x.isNotNull()))


def with_defaults(metadata: Column, values: Column) -> Column:
    """metadata with the entries of values that are filled and that it lacks."""
    new = F.map_filter(values, lambda k, v: v.isNotNull() & (F.trim(v) != "") & ~F.map_contains_key(F.coalesce(metadata, F.create_map().cast("map<string,string>")), k))
    return F.map_concat(F.coalesce(metadata, F.create_map().cast("map<string,string>")), new)


def bounded(payload: Column, most: int = 65_536) -> Column:
    """JSON text, or where it is longer a stub with its hash and size."""
    stub = F.to_json(F.struct(F.sha2(payload, 256).alias("sha256"), F.octet_length(payload).alias("bytes")))
    return F.when(F.octet_length(payload) > most, stub).otherwise(payload)


def demo_in_history(matches: DataFrame) -> DataFrame:
    """match_id, history_contains_demo: whether a finished demo match of the competition came strictly before."""
    demo = F.when(F.col("is_demo") & (F.col("status") == "finished"), 1)
    found = prefix.with_sums_before(matches.select("match_id", "competition_id", "match_date", "is_demo", "status"), ["competition_id"], micros(), {"n": demo})
    return found.select("match_id", (F.col("n") > 0).alias("history_contains_demo"))
