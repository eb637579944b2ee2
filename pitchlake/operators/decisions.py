"""What people decide about stored matches: results, conflicts of fields, events and cards entered by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.operators.consolidate import PAIRS, invariants

SCORES = ("hg", "ag", "hht", "aht")
CHOICES = ("existing", "incoming")


def registered(matches: DataFrame, results: DataFrame) -> DataFrame:
    """match_id, answer, hg, ag, hht, aht, status of each result (one a match): what became of it, and the match after it.

    A match that isn't finished takes the result (registered). A finished one keeps its own: the same score again is
    repeated, another is refused. unknown: there is no such match.
    """
    values = (*SCORES, "status")
    own = matches.select("match_id", *[F.col(c).alias(f"_{c}") for c in values], F.lit(True).alias("_stored"))
    rows = results.select("match_id", *values).join(own, "match_id", "left")
    done = F.coalesce(F.col("_status") == "finished", F.lit(False))
    same = F.col("hg").eqNullSafe(F.col("_hg")) & F.col("ag").eqNullSafe(F.col("_ag"))
    answer = F.when(F.col("_stored").isNull(), "unknown").when(~done, "registered").when(same, "repeated").otherwise("refused")
    rows = rows.withColumn("answer", answer)
    after = [F.when(F.col("answer") == "registered", F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in values]
    return rows.select("match_id", "answer", *after)


def to_grade(answers: DataFrame) -> DataFrame:
    """Matches whose predictions a result lets be graded: those finished by it, and finished ones told again."""
    return answers.where((F.col("status") == "finished") & F.col("answer").isin("registered", "repeated"))


def pending(merged: DataFrame) -> DataFrame:
    """match_id, field, group, existing, incoming: a row for each conflict of merged matches."""
    return merged.select("match_id", F.inline("conflicts"))


def _page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    if offset < 0 or not 1 <= limit <= 200:
        raise ValueError("offset from 0, limit from 1 to 200")
    return rows.orderBy(*order).offset(offset).limit(limit)


def pending_page(conflicts: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of pending conflicts by match and field; ValueError for pages out of range."""
    return _page(conflicts, ["match_id", "field"], offset, limit)


def settled(stored: DataFrame, conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """stored's matches that decisions (match_id, field, choice) are about, with answer; a decision is taken whole or not.

    conflicts: pending(). Answers, the first that holds: not_pending, invalid_choice (neither existing nor incoming),
    missing (a conflict of the match has no choice), unexpected (a choice without conflict), split_pair (one half of a pair of
    scores taken), invalid_state (what would be left breaks invariants), resolved. Only resolved ones change values.
    """
    fields = [c for c in (*SCORES, "status", "venue") if c in stored.columns]
    told = decisions.select("match_id", "field", "choice", F.lit(True).alias("_told"))
    both = conflicts.withColumn("_open", F.lit(True)).join(told, ["match_id", "field"], "full_outer")
    is_open, is_told = F.col("_open").isNotNull(), F.col("_told").isNotNull()
    count = lambda when: F.count_if(F.coalesce(when, F.lit(False)))
    taken = F.col("choice") == "incoming"
    split = [F.count_distinct(F.when(is_open & (F.col("group") == g), F.col("choice"))) > 1 for g in PAIRS]
    found = both.groupBy("match_id").agg(
        count(is_told).alias("_n"), count(is_open).alias("_n_open"), count(is_told & ~F.coalesce(F.col("choice").isin(*CHOICES), F.lit(False))).alias("_n_bad"),
        count(is_open & ~is_told).alias("_n_missing"), count(is_told & ~is_open).alias("_n_more"), F.greatest(*split).alias("_split"),
        *[F.max(F.when(is_open & taken & (F.col("field") == c), F.struct(F.col("incoming").alias("v")))).alias(f"_{c}") for c in fields],
    ).where("_n > 0")
    kinds = dict(stored.dtypes)
    rows = stored.join(found, "match_id")
    after = rows.select("match_id", *[F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.v").cast(kinds[c])).otherwise(F.col(c)).alias(c) for c in fields])
    broken = invariants(after).select("match_id", F.lit(True).alias("_broken")).distinct()
    checks = {"not_pending": F.col("_n_open") == 0, "invalid_choice": F.col("_n_bad") > 0, "missing": F.col("_n_missing") > 0, "unexpected": F.col("_n_more") > 0, "split_pair": F.col("_split"), "invalid_state": F.col("_broken").isNotNull()}
    answer: Column = F.coalesce(*[F.when(when, name) for name, when in checks.items()], F.lit("resolved"))
    rows = rows.join(broken, "match_id", "left").withColumn("answer", answer)
    new = {c: F.when((F.col("answer") == "resolved") & F.col(f"_{c}").isNotNull(), F.col(f"_{c}.v").cast(kinds[c])).otherwise(F.col(c)) for c in fields}
    return rows.withColumns(new).select(*stored.columns, "answer")


def _named(value: Column) -> Column:
    return F.nullif(F.lower(F.trim(value)), F.lit(""))


def with_entities(items: DataFrame, teams: DataFrame, players: DataFrame) -> DataFrame:
    """items (event_type, team, player_name, ...) with team_id, player_id and error: rows to append have none.

    Names are compared without case and outer blanks; of several entities of one name the least id counts; unknown and
    null names give no id and are no error. A blank event_type is one.
    """

    def ids(entities: DataFrame, key: str, id_: str) -> DataFrame:
        return entities.select(_named(F.col("name")).alias(key), id_).where(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_).alias(id_))

    rows = items.withColumns({"_team": _named(F.col("team")), "_player": _named(F.col("player_name"))})
    rows = rows.join(ids(teams, "_team", "team_id"), "_team", "left").join(ids(players, "_player", "player_id"), "_player", "left").drop("_team", "_player")
    return rows.withColumn("error", F.when(_named(F.col("event_type")).isNull(), "missing_event_type"))


def with_cards(stored: DataFrame, cards: DataFrame) -> DataFrame:
    """match_id, player_id, yellow_cards, red_cards: stored counters plus one for each card (yellow, red: booleans); null
    counters start from 0 once a card comes, and players without a row get one."""
    more = cards.groupBy("match_id", "player_id").agg(F.count_if("yellow").alias("_yellow"), F.count_if("red").alias("_red"))
    rows = stored.select("match_id", "player_id", "yellow_cards", "red_cards", F.lit(True).alias("_stored")).join(more, ["match_id", "player_id"], "full_outer")

    def total(old: str, new: str) -> Column:
        added = F.coalesce(old, F.lit(0)) + F.col(new)
        return F.when((F.coalesce(new, F.lit(0)) > 0) | F.col("_stored").isNull(), added).otherwise(F.col(old)).alias(old)

    return rows.select("match_id", "player_id", total("yellow_cards", "_yellow"), total("red_cards", "_red"))
