"""Merging sources: idempotent inserts, identity by date band, fills, conflicts and the status order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIRS = {"full_time": ("hg", "ag"), "half_time": ("hht", "aht")}
BLOCKED = ("postponed", "cancelled", "abandoned")


def new_records(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of incoming whose keys stored lacks; of several with one key the first by (line) stays."""
    order = Window.partitionBy(*keys).orderBy("line")
    first = incoming.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")
    return first.join(stored.select(*keys), keys, "left_anti")


def matched(incoming: DataFrame, stored: DataFrame, days: int = 1) -> DataFrame:
    """incoming with stored_id: the stored match of the same competition, season and teams whose date is at most `days`
    away, the nearest one, then the least id.

    Stored matches of a moment are one, by their least id. They and incoming are put in order of time together, and a row sees
    the last stored moment up to its own and the first one after it, by a pass in each direction: no pairs are made.
    """
    keys = ["competition_id", "season", "home_team_id", "away_team_id"]
    moment = F.unix_micros(F.col("match_date").cast("timestamp"))
    own = stored.groupBy(*keys, moment.alias("_at")).agg(F.min("match_id").alias("_stored")).dropna(subset=[*keys, "_at"])
    both = incoming.withColumns({"_at": moment, "_asks": F.lit(True)}).unionByName(own.withColumn("_asks", F.lit(False)), allowMissingColumns=True)
    told = F.when(~F.col("_asks"), F.struct("_at", "_stored"))
    # Of one moment, stored ones come first in one direction and last in the other.
    by = Window.partitionBy(*keys)
    upto, after = (by.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow) for order in (("_at", "_asks"), (F.desc("_at"), F.desc("_asks"))))
    rows = both.withColumn("_told", told).withColumns({"_upto": F.last("_told", True).over(upto), "_after": F.last("_told", True).over(after)}).where("_asks")
    near = lambda c: F.struct(F.abs(F.col("_at") - F.col(f"{c}._at")).alias("g"), F.col(f"{c}._stored").alias("s"))
    found = [F.when(near(c)["g"] <= days * 86_400_000_000, near(c)) for c in ("_upto", "_after")]
    return rows.select(*[F.col(c) for c in incoming.columns], F.least(*found)["s"].alias("stored_id"))


def _pair(incoming: tuple[Column, Column], stored: tuple[Column, Column]) -> Column:
    differs = (stored[0].isNotNull() & (incoming[0] != stored[0])) | (stored[1].isNotNull() & (incoming[1] != stored[1]))
    whole = incoming[0].isNotNull() & incoming[1].isNotNull()
    return F.when(whole & F.coalesce(differs, F.lit(False)), "conflict").when(whole, "fill").when(incoming[0].isNotNull() | incoming[1].isNotNull(), "half").otherwise("none")


def next_status(stored: Column, incoming: Column) -> Column:
    """What a status becomes; `conflict` where the two can't follow each other."""
    return (
        F.when(incoming.isNull() | (incoming == "unknown") | (incoming == stored), stored)
        .when(stored.isNull() | stored.isin("unknown", "scheduled", "live"), incoming)
        .when(stored.isin(*BLOCKED) & (incoming == "finished"), incoming)
        .when(incoming == "scheduled", stored)
        .otherwise("conflict")
    )


def merged(stored: DataFrame, incoming: DataFrame, scalars: tuple[str, ...] = ("venue",)) -> DataFrame:
    """match_id, the merged columns, conflicts (field, group, existing, incoming) and half_pairs, by match_id.

    A pair of scores moves as one: two stored and different values make two conflicts, stored ones stay; an empty pair is
    filled; half a pair is an error and changes nothing. Scalars are filled if null, else conflict. incoming has one row a
    match.
    """
    return stored.alias("s").join(incoming.alias("i"), "match_id").select("match_id", *_merge(scalars))


def compared(records: DataFrame, stored: DataFrame, scalars: tuple[str, ...] = ("venue",)) -> DataFrame:
    """records (stored_id, ...) with n_conflicts, the number of conflicts that merged() finds between each and the stored match
    it is about; null where it is about none."""
    both = records.alias("i").join(stored.alias("s"), F.col("i.stored_id") == F.col("s.match_id"), "left")
    *_, conflicts, _ = _merge(scalars)
    return both.select("i.*", F.when(F.col("s.match_id").isNotNull(), F.size(conflicts)).alias("n_conflicts"))


def _merge(scalars: tuple[str, ...]) -> list[Column]:
    """The columns of merged() over pairs of a stored match (s) and an incoming one (i)."""
    s, i = (lambda c: F.col(f"s.{c}")), (lambda c: F.col(f"i.{c}"))
    out, found, halves = [], [], []

    def conflict(field: str, group: str, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(field).alias("field"), F.lit(group).alias("group"), s(field).cast("string").alias("existing"), i(field).cast("string").alias("incoming")))

    for group, (a, b) in PAIRS.items():
        kind = _pair((i(a), i(b)), (s(a), s(b)))
        for c in (a, b):
            out.append(F.when(kind == "fill", F.coalesce(s(c), i(c))).otherwise(s(c)).alias(c))
            found.append(conflict(c, group, (kind == "conflict") & ~s(c).eqNullSafe(i(c))))
        halves.append(F.when(kind == "half", group))
    for c in scalars:
        out.append(F.coalesce(s(c), i(c)).alias(c))
        found.append(conflict(c, c, s(c).isNotNull() & i(c).isNotNull() & (s(c) != i(c))))
    status = next_status(s("status"), i("status"))
    out.append(F.when(status == "conflict", s("status")).otherwise(status).alias("status"))
    found.append(conflict("status", "status", status == "conflict"))
    keep = lambda *c: F.filter(F.array(*c), lambda x: x.isNotNull())
    return [*out, keep(*found).alias("conflicts"), keep(*halves).alias("half_pairs")]


def outcomes(records: DataFrame, seen: DataFrame) -> DataFrame:
    """record_id and the outcome of importing records (record_id, stored_id, is_resolved, n_conflicts): known records
    (seen: record_id, in_conflict) stay a duplicate or a conflict; new ones can't be told apart from others
    (resolution_conflict), contradict the match they are about (conflict), are about a known one (matched_duplicate) or bring
    a new one (persisted)."""
    known = seen.select("record_id", F.col("in_conflict").alias("_known")).groupBy("record_id").agg(F.bool_or("_known").alias("_known"))
    kind = (
        F.when(F.col("_known"), "conflict").when(~F.col("_known"), "duplicate").when(~F.col("is_resolved"), "resolution_conflict")
        .when(F.col("n_conflicts") > 0, "conflict").when(F.col("stored_id").isNotNull(), "matched_duplicate").otherwise("persisted")
    )
    return records.join(known, "record_id", "left").select("record_id", kind.alias("outcome"))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """stored with incoming's rows: known ones of its values overwrite, unknown ones leave what is there; new keys come in."""
    values = [c for c in stored.columns if c not in keys]
    new = incoming.select(*keys, *[F.col(c).alias(f"_{c}") for c in values])
    rows = stored.join(new, keys, "full_outer")
    return rows.select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in values])


def invariants(rows: DataFrame) -> DataFrame:
    """match_id, problem: half pairs, half-time above full-time scores, those above extra time's where rows have it (het, aet),
    statuses that scores contradict."""
    a, b, c, d = (F.col(x) for x in ("hg", "ag", "hht", "aht"))
    checks = {
        "half_full_time_pair": a.isNull() != b.isNull(),
        "half_half_time_pair": c.isNull() != d.isNull(),
        "half_time_above_full_time": (c > a) | (d > b),
        "finished_without_score": (F.col("status") == "finished") & (a.isNull() | b.isNull()),
        "scheduled_with_score": (F.col("status") == "scheduled") & (a.isNotNull() | b.isNotNull()),
    }
    if {"het", "aet"} <= set(rows.columns):
        checks |= {"half_extra_time_pair": F.col("het").isNull() != F.col("aet").isNull(), "full_time_above_extra_time": (a > F.col("het")) | (b > F.col("aet"))}
    found = F.filter(F.array(*[F.when(F.coalesce(x, F.lit(False)), n) for n, x in checks.items()]), lambda x: x.isNotNull())
    return rows.select("match_id", F.explode(found).alias("problem"))
