"""Point-in-time history: what was known of a team strictly before a kickoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.operators import prefix

METRICS = ("goals_for", "goals_against", "shots", "shots_on_target", "corners", "cards", "fouls", "points", "clean_sheet", "scored", "over_2_5", "both_teams_scored")
DECAYED = ("goals_for", "goals_against", "shots_on_target", "corners", "cards", "points")
COMPLETENESS = ("shots", "shots_on_target", "corners", "cards", "fouls")
DECAY = 0.82


def micros(date: str = "match_date") -> Column:
    return F.unix_micros(F.col(date).cast("timestamp"))


def _two_axes(rows: DataFrame, keys: list[str], told: dict[str, Column]) -> DataFrame:
    """rows with n_before, and once more each finished one as what it tells later ones: _asks, _at and the columns of told.

    Rows of one kickoff don't see each other. A finished row has number seq among its keys; a row that n_before of them
    precede stands right behind the n_before-th. Both lie on one axis (2 * seq, 2 * n_before + 1), so a range frame of
    width 2n finds the last n: one shuffle on the keys, frames of n rows, no join.
    """
    done = F.when(F.col("status") == "finished", 1).otherwise(0)
    by = Window.partitionBy(*keys)
    before = by.orderBy(micros()).rangeBetween(Window.unboundedPreceding, -1)
    upto = by.orderBy(micros(), "match_id", F.col("venue").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("n_before", F.coalesce(F.sum(done).over(before), F.lit(0))).withColumn("_seq", F.sum(done).over(upto))
    kinds = rows.select(*[c.alias(n) for n, c in told.items()]).schema
    own = F.struct((F.col("n_before") * 2 + 1).alias("_at"), F.lit(True).alias("_asks"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in kinds])
    seen = F.struct((F.col("_seq") * 2).alias("_at"), F.lit(False).alias("_asks"), *[c.alias(n) for n, c in told.items()])
    return rows.select("*", F.inline(F.when(done == 1, F.array(own, seen)).otherwise(F.array(own)))).drop("_seq")


def last(keys: list[str], n: int) -> Window:
    """The frame of the last n on _two_axes()."""
    return Window.partitionBy(*keys).orderBy("_at").rangeBetween(-2 * n, -1)


def last_before(rows: DataFrame, keys: list[str], n: int, values: list[str]) -> DataFrame:
    """rows with n_before and history, the last n finished rows of the same keys before each row's kickoff, oldest first."""
    doubled = _two_axes(rows, keys, {"_seen": F.struct("match_date", *values)})
    return doubled.withColumn("history", F.collect_list("_seen").over(last(keys, n))).where("_asks").drop("_at", "_asks", "_seen")


def mean_of_last(n: int, metric: str, history: str = "history") -> Column:
    """Mean of the known values among the last n; null if none is known."""
    last = f"slice({history}, greatest(1, size({history}) - {n} + 1), {n})"
    step = f"(a, x) -> if(x.{metric} is null, a, named_struct('s', a.s + x.{metric}, 'n', a.n + 1))"
    return F.expr(f"aggregate({last}, named_struct('s', 0D, 'n', 0), {step}, a -> a.s / nullif(a.n, 0))")


def decayed_mean(metric: str, history: str = "history", decay: float = DECAY) -> Column:
    """Mean weighted by decay ** distance from the newest; unknown values keep their place and weigh nothing."""
    # From the oldest on, all weights so far shrink by one step with each match.
    step = f"(a, x) -> named_struct('s', a.s * {decay}D + coalesce(x.{metric}, 0), 'w', a.w * {decay}D + if(x.{metric} is null, 0, 1))"
    return F.expr(f"aggregate({history}, named_struct('s', 0D, 'w', 0D), {step}, a -> a.s / nullif(a.w, 0D))")


def venue_history(sides: DataFrame) -> DataFrame:
    """sides with the last five matches of the team at the same venue."""
    return last_before(sides, ["competition_id", "team_id", "venue"], 5, ["goals_for", "goals_against"])


def league_priors(matches: DataFrame) -> DataFrame:
    """matches with the competition's number of finished matches and goal means strictly before each kickoff."""
    known = F.when(F.col("hg").isNotNull(), 1)
    rows = prefix.with_sums_before(matches, ["competition_id"], micros(), {"league_prior_matches": known, "_home": F.col("hg"), "_away": F.col("ag")})
    some = F.col("league_prior_matches") > 0
    return rows.withColumns({
        "league_home_goals_avg": F.when(some, F.col("_home") / F.col("league_prior_matches")),
        "league_away_goals_avg": F.when(some, F.col("_away") / F.col("league_prior_matches")),
        "league_team_goals_avg": F.when(some, (F.col("_home") + F.col("_away")) / (2 * F.col("league_prior_matches"))),
    }).drop("_home", "_away")


def _decayed_lags(metric: str) -> Column:
    """decayed_mean() of a metric whose values n places back are columns (_<metric>_n)."""
    places = [F.col(f"_{metric}_{k}") for k in reversed(range(10))]
    total = weight = F.lit(0.0)
    for x in places:
        total, weight = total * DECAY + F.coalesce(x, F.lit(0)), weight * DECAY + F.when(x.isNull(), 0).otherwise(1)
    return total / F.nullif(weight, F.lit(0.0))


def side_features(sides: DataFrame, only: tuple[str, ...] | None = None, complete: bool = True) -> DataFrame:
    """Per match and side: history_matches, days_rest, known share, means of the last 3, 5 and 10, decayed means.

    only: the names of the means wanted, all by default; complete: whether data_completeness is. What isn't asked for isn't
    planned or read. A mean is null without a known value. Means come from running sums, decayed means from the last ten
    values; both are made once per finished row. All windows are within one shuffle by team.
    """
    wanted = lambda name: only is None or name in only
    keys = ["competition_id", "team_id"]
    decayed = [m for m in DECAYED if wanted(f"{m}_recency_weighted_10")]
    averaged = [(m, n) for m in METRICS for n in (3, 5, 10) if wanted(f"{m}_avg_{n}")]
    summed = list(dict.fromkeys([*(COMPLETENESS if complete else ()), *[m for m, _ in averaged]]))
    places = sorted({n for _, n in averaged} | ({10} if complete else set()))
    told_of = ["match_id", "competition_id", "match_date", "venue", "team_id"]
    rows = sides.select(*told_of, (F.col("status") == "finished").alias("_done"), *dict.fromkeys([*summed, *decayed])).repartition(*keys)
    # Finished rows: running sums, and those of n rows before, give the sums of the last n.
    order = Window.partitionBy(*keys, "_done").orderBy(micros(), "match_id", F.col("venue").desc())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Sums and counts of all metrics are one array each: expressions stay short enough to be compiled.
    lists = {"_s": F.array(*[F.coalesce(F.sum(m).over(upto), F.lit(0)).cast("double") for m in summed]), "_n": F.array(*[F.count(m).over(upto).cast("double") for m in summed])} if summed else {}
    rows = rows.withColumns({"_seq": F.row_number().over(order), **lists, **{f"_{m}_{k}": F.lag(m, k).over(order) if k else F.col(m) for m in decayed for k in range(10)}})
    rows = rows.select(*told_of, "_done", "_seq", *lists, *[_decayed_lags(m).alias(f"_decayed_{m}") for m in decayed])
    zeros = F.array_repeat(F.lit(0.0), len(summed))
    rows = rows.withColumns({f"{k}{n}": F.coalesce(F.lag(k, n).over(order), zeros) for k in lists for n in places})
    rows = rows.withColumns({f"{k}{n}": F.zip_with(k, f"{k}{n}", lambda now, then: now - then) for k in lists for n in places})
    means = {n: F.zip_with(f"_s{n}", f"_n{n}", lambda total, count: F.when(count > 0, total / count)) for n in {n for _, n in averaged}}
    known = [sum(F.get("_n10", summed.index(m)) for m in COMPLETENESS).alias("known")] if complete else []
    told = F.struct(F.col("_seq").alias("seq"), F.col("match_date").alias("day"), *known, *[c.alias(f"avg_{n}") for n, c in means.items()], *[F.col(f"_decayed_{m}").alias(m) for m in decayed])
    # Each row sees the last of the finished rows before its kickoff; the greatest seq is the last.
    before = Window.partitionBy(*keys).orderBy(micros()).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.select(*told_of, F.when(F.col("_done"), told).alias("_told")).withColumn("_seen", F.max("_told").over(before))
    seen = F.col("_seen")
    games = F.least(seen["seq"], F.lit(10))
    rest = (micros() - F.unix_micros(seen["day"].cast("timestamp"))) / 86_400_000_000.0
    share = [F.coalesce(seen["known"] / (games * len(COMPLETENESS)), F.lit(0.0)).alias("data_completeness")] if complete else []
    return rows.select(
        *told_of, F.coalesce(seen["seq"], F.lit(0)).cast("long").alias("history_matches"), rest.alias("days_rest"), seen["day"].alias("history_max_date"), *share,
        *[F.get(seen[f"avg_{n}"], summed.index(m)).alias(f"{m}_avg_{n}") for m, n in averaged], *[seen[m].alias(f"{m}_recency_weighted_10") for m in decayed],
    )


def wide_features(matches: DataFrame, sides: DataFrame, only: tuple[str, ...] | None = None, complete: bool = False) -> DataFrame:
    """One row per match: league priors, and side_features() as home_ and away_ columns."""
    features = side_features(sides, only, complete)
    names = [c for c in features.columns if c not in ("match_id", "competition_id", "match_date", "venue", "team_id")]
    pick = [F.max(F.when(F.col("venue") == v, F.col(c))).alias(f"{v}_{c}") for v in ("home", "away") for c in names]
    return league_priors(matches).join(features.groupBy("match_id").agg(*pick), "match_id")


#: The means that goal rates are made of.
RATED = ("goals_for_recency_weighted_10", "goals_against_recency_weighted_10")
#: The means that strengths, rates and tails are made of.
CORE = ("goals_for_avg_5", "goals_against_avg_5", "goals_for_recency_weighted_10", "goals_against_recency_weighted_10", "cards_avg_10", "corners_avg_10")


def match_features(matches: DataFrame, sides: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """One row per match: home_ and away_ features, league priors, strengths, weaknesses and the feature quality.

    only: as in side_features(), CORE at least.
    """
    wide = wide_features(matches, sides, None if only is None else tuple({*CORE, *only}), True)
    base = F.when(F.col("league_team_goals_avg") > 0, F.col("league_team_goals_avg"))
    for v in ("home", "away"):
        wide = wide.withColumn(f"{v}_attack_strength", F.col(f"{v}_goals_for_avg_5") / base)
        wide = wide.withColumn(f"{v}_defence_weakness", F.col(f"{v}_goals_against_avg_5") / base)
    games = {v: F.least(F.col(f"{v}_history_matches"), F.lit(10)) for v in ("home", "away")}
    known = sum((F.col(f"{v}_data_completeness") * games[v] * 5).cast("int") for v in games)  # cuts, as the known share is a float
    expected = (games["home"] + games["away"]) * 5
    volume = F.least(F.least("home_history_matches", "away_history_matches") / 10, F.lit(1.0))
    share = F.when(expected > 0, known / expected).otherwise(0.0)
    return wide.withColumn("feature_quality_score", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.65 * volume + 0.35 * share)), 6))


def leaks(features: DataFrame) -> DataFrame:
    """Rows of match_features() whose history reaches their own kickoff; there must be none."""
    return features.where((F.col("home_history_max_date") >= F.col("match_date")) | (F.col("away_history_max_date") >= F.col("match_date")))


SQL = """
before AS (
  SELECT *, count(*) FILTER (WHERE status = 'finished') OVER (PARTITION BY competition_id, team_id ORDER BY match_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS nb FROM sides),
perf AS (
  SELECT *, row_number() OVER (PARTITION BY competition_id, team_id ORDER BY match_date, match_id, venue DESC) AS seq FROM sides WHERE status = 'finished'),
hist AS (
  SELECT b.match_id, b.venue, b.nb, b.match_date, b.nb - p.seq AS d, p.match_date AS seen_date, p.goals_for, p.goals_against, p.shots, p.shots_on_target, p.corners, p.cards, p.fouls, p.points, p.clean_sheet, p.scored, p.over_2_5, p.both_teams_scored
  FROM before b LEFT JOIN perf p ON p.competition_id = b.competition_id AND p.team_id = b.team_id AND p.seq BETWEEN b.nb - 9 AND b.nb),
side_features AS (
  SELECT match_id, venue, any_value(nb) AS history_matches, max(seen_date) AS history_max_date,
    CASE WHEN any_value(nb) > 0 THEN (epoch_us(any_value(match_date)) - epoch_us(max(seen_date))) / 86400000000.0 END AS days_rest,
    CASE WHEN count(d) > 0 THEN (count(shots) + count(shots_on_target) + count(corners) + count(cards) + count(fouls)) / (count(d) * 5) ELSE 0.0 END AS data_completeness,
""" + ",\n".join(f"    avg({m}) FILTER (WHERE d < {n}) AS {m}_avg_{n}" for m in METRICS for n in (3, 5, 10)) + ",\n" + ",\n".join(
    f"    sum({m} * power({DECAY}, d)) / sum(power({DECAY}, d)) FILTER (WHERE {m} IS NOT NULL) AS {m}_recency_weighted_10" for m in DECAYED
) + """
  FROM hist GROUP BY match_id, venue),
priors AS (
  SELECT *, league_home / nullif(league_prior_matches, 0) AS league_home_goals_avg, league_away / nullif(league_prior_matches, 0) AS league_away_goals_avg,
    (league_home + league_away) / nullif(2 * league_prior_matches, 0) AS league_team_goals_avg
  FROM (SELECT *, count(hg) OVER w AS league_prior_matches, CAST(sum(hg) OVER w AS DOUBLE) AS league_home, CAST(sum(ag) OVER w AS DOUBLE) AS league_away FROM matches
    WINDOW w AS (PARTITION BY competition_id ORDER BY match_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING))),
features AS (
  SELECT p.*, h.history_matches AS home_history_matches, a.history_matches AS away_history_matches, h.history_max_date AS home_history_max_date, a.history_max_date AS away_history_max_date,
    h.goals_for_recency_weighted_10 AS hgf, h.goals_against_recency_weighted_10 AS hga, a.goals_for_recency_weighted_10 AS agf, a.goals_against_recency_weighted_10 AS aga,
    h.goals_for_avg_5 / nullif(league_team_goals_avg, 0) AS home_attack_strength, a.goals_for_avg_5 / nullif(league_team_goals_avg, 0) AS away_attack_strength,
    h.goals_against_avg_5 / nullif(league_team_goals_avg, 0) AS home_defence_weakness, a.goals_against_avg_5 / nullif(league_team_goals_avg, 0) AS away_defence_weakness,
    h.corners_avg_10 AS h_corners, a.corners_avg_10 AS a_corners, h.cards_avg_10 AS h_cards, a.cards_avg_10 AS a_cards,
    trunc(h.data_completeness * least(h.history_matches, 10) * 5) + trunc(a.data_completeness * least(a.history_matches, 10) * 5) AS known,
    (least(h.history_matches, 10) + least(a.history_matches, 10)) * 5 AS expected
  FROM priors p JOIN side_features h ON h.match_id = p.match_id AND h.venue = 'home' JOIN side_features a ON a.match_id = p.match_id AND a.venue = 'away')"""
