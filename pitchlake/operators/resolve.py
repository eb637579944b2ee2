"""Names to entities: by exact key, by saved decisions, by likeness with a margin."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

AUTO, MARGIN, REVIEW = 0.94, 0.04, 0.70
STRICT_AUTO, STRICT_MARGIN = 0.97, 0.06


@pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks in both, 0 to 1."""
    return pd.Series([SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def exact(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """names (key) with entity_id and resolution: resolved, ambiguous (several ids) or unmatched. aliases: key, entity_id."""
    ids = aliases.where("key is not null and key <> ''").groupBy("key").agg(F.count_distinct("entity_id").alias("n_ids"), F.min("entity_id").alias("entity_id"))
    rows = names.join(ids, "key", "left")
    kind = F.when(F.col("n_ids") == 1, "resolved").when(F.col("n_ids") > 1, "ambiguous").otherwise("unmatched")
    return rows.withColumn("resolution", kind).withColumn("entity_id", F.when(F.col("n_ids") == 1, F.col("entity_id"))).drop("n_ids")


def _numbered_letters(keys: DataFrame) -> DataFrame:
    """key, token of distinct keys: each letter with its number among equal ones, so that shared tokens count repeated letters."""
    letters = keys.select("key", F.explode(F.split("key", "")).alias("letter")).groupBy("key", "letter").agg(F.count(F.lit(1)).alias("n"))
    numbered = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda k: F.concat("letter", k.cast("string")))
    return letters.select("key", F.explode(numbered).alias("token"))


def _index(keys: DataFrame, order: DataFrame, review: float) -> DataFrame:
    """key, _tokens (rarest first), and a row for each of the first tokens, one of which a key shares with all that are
    like it: _token and its place _at, from 0."""
    rows = _numbered_letters(keys).join(order, "token")
    rows = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("_tokens"))
    rows = rows.select("key", F.col("_tokens.token").alias("_tokens"))
    n = F.size("_tokens")
    least = F.ceil(review / (2 - review) * n - 1e-6)  # of tokens shared, with the shortest key that can reach review
    first = F.slice("_tokens", F.lit(1), (n - least + 1).cast("int"))
    return rows.select("*", F.posexplode(first).alias("_at", "_token"))


def candidate_pairs(names: DataFrame, others: DataFrame, review: float = REVIEW) -> DataFrame:
    """key, other: the pairs of keys of names and others that share enough letters to reach review; no pair is lost.

    Matching blocks have no more letters than both keys share, so a pair needs review / 2 of both lengths in common. Keys
    are indexed by their rarest numbered letters: of two that share t of their tokens, each in one order, the first shared
    one is at least t - 1 places from either end. Pairs meet at that token only, so none comes twice.
    """
    left, right = (k.select("key").where("key is not null and key <> ''").distinct() for k in (names, others))
    order = _numbered_letters(left).unionByName(_numbered_letters(right)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    asked = _index(left, order, review)
    known = _index(right, order, review).select(F.col("key").alias("other"), F.col("_tokens").alias("_others"), F.col("_at").alias("_there"), "_token")
    a, b = F.size("_tokens"), F.size("_others")
    need = F.lit(review / 2) * (a + b) - 1e-6
    met = asked.join(known, "_token").where((a - F.col("_at") >= need) & (b - F.col("_there") >= need))
    shared = F.array_intersect("_tokens", "_others")
    return met.where((F.size(shared) >= need) & (F.get(shared, 0) == F.col("_token"))).select("key", "other")


def fuzzy(names: DataFrame, candidates: DataFrame, auto: float = AUTO, margin: float = MARGIN, review: float = REVIEW, keep: int = 5) -> DataFrame:
    """key, resolution, entity_id, best, second, candidates: each distinct key against all candidates that can reach review.

    Only candidate_pairs() are compared, each pair of keys once. best and second are null below review. best = 1: exact; best >= auto and margin over the second entity: fuzzy_approved; best >= review:
    manual_review; else unmatched. The `keep` best entities are listed.
    """
    left = names.select("key").where("key is not null").distinct()
    right = candidates.select(F.col("key").alias("other"), "entity_id").where("key is not null").distinct()
    likely = candidate_pairs(left, candidates, review).withColumn("score", likeness("key", "other"))
    scored = likely.join(right, "other").groupBy("key", "entity_id").agg(F.max("score").alias("score")).where(F.col("score") >= review)
    order = Window.partitionBy("key").orderBy(F.desc("score"), "entity_id")
    top = scored.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= keep)
    best = top.groupBy("key").agg(
        F.max("score").alias("best"), F.max(F.when(F.col("nth") == 2, F.col("score"))).alias("second"), F.max(F.when(F.col("nth") == 1, F.col("entity_id"))).alias("entity_id"), F.sort_array(F.collect_list(F.struct("nth", "entity_id", "score"))).alias("candidates")
    )
    rows = left.select("key").join(best, "key", "left")
    clear = F.col("best") - F.coalesce("second", F.lit(0.0)) >= margin
    tie = F.col("best") == F.col("second")
    kind = F.when((F.col("best") == 1) & ~F.coalesce(tie, F.lit(False)), "exact").when((F.col("best") >= auto) & clear, "fuzzy_approved").when(F.col("best") >= review, "manual_review").otherwise("unmatched")
    sure = F.col("resolution").isin("exact", "fuzzy_approved")
    return rows.withColumn("resolution", kind).withColumn("entity_id", F.when(sure, F.col("entity_id")))


def resolve(names: DataFrame, aliases: DataFrame, decided: DataFrame, **levels) -> DataFrame:
    """key, entity_id, resolution: saved decisions (key, entity_id) win, then exact keys, then likeness."""
    rows = exact(names.select("key").distinct(), aliases)
    open_ = rows.where("resolution = 'unmatched'").select("key")
    close = fuzzy(open_, aliases, **levels).select("key", F.col("entity_id").alias("_id"), F.col("resolution").alias("_kind"))
    rows = rows.join(close, "key", "left").withColumn("entity_id", F.coalesce("entity_id", "_id")).withColumn("resolution", F.coalesce("_kind", "resolution")).drop("_id", "_kind")
    saved = decided.select("key", F.col("entity_id").alias("_saved"))
    rows = rows.join(saved, "key", "left").withColumn("resolution", F.when(F.col("_saved").isNotNull(), "decided").otherwise(F.col("resolution")))
    return rows.withColumn("entity_id", F.coalesce("_saved", "entity_id")).drop("_saved")


def review_queue(resolved: DataFrame) -> DataFrame:
    """Keys that a person must decide."""
    return resolved.where(F.col("resolution").isin("manual_review", "ambiguous"))


def with_decisions(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """queue (key, candidates) with status: resolved if the decision (key, candidate_id) names a candidate, rejected if it
    names another entity, pending without one."""
    rows = queue.join(decisions, "key", "left")
    known = F.exists("candidates", lambda c: c["entity_id"] == F.col("candidate_id"))
    return rows.withColumn("status", F.when(F.col("candidate_id").isNull(), "pending").when(known, "resolved").otherwise("rejected"))
