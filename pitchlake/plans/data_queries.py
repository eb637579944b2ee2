"""Queries over several sources: consolidation, resolution, validation, players, rates; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.functions import names, values
from pitchlake.functions import scores
from pitchlake.operators import consolidate, enrich, evaluation, grading, impacts, imports, players, poisson, quality, resolve, validate
from pitchlake.operators import sides as side_rows
from pitchlake.plans import match_queries as base
from pitchlake.sources import adapter, results_csv, results_json
from pitchlake.streaming import rate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, chain: str | None = base.BASE):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH {chain}\n{sql}" if chain else sql
        return f

    return add


def _second_source(spark, d):
    """What another source says of the matches: shifted dates, some other scores, statuses and missing values."""
    m = adapter.matches(spark, d)
    k = F.col("match_id")
    shift = F.make_dt_interval((k % 4 - 1).cast("int"))
    return m.withColumns({
        "match_date": F.col("match_date") + shift,
        "hg": F.when(k % 7 == 0, F.col("hg") + 1).when(k % 11 == 0, F.lit(None)).otherwise(F.col("hg")),
        "hht": F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("hht")),
        "aht": F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("aht")),
        "status": F.when(k % 13 == 0, "postponed").when(k % 17 == 0, "scheduled").otherwise(F.col("status")),
        "venue": F.concat(F.lit("ground "), (k % 3).cast("string")),
        "record_id": k * 2 + 1,
    })


def _stored(spark, d):
    m = adapter.matches(spark, d)
    k = F.col("match_id")
    return m.withColumns({"hht": F.when(k % 3 == 0, F.lit(None)).otherwise(F.col("hht")), "aht": F.when(k % 3 == 0, F.lit(None)).otherwise(F.col("aht")), "venue": F.when(k % 2 == 0, F.concat(F.lit("ground "), (k % 5).cast("string")))})


SECOND = base.BASE + """,
second AS (
  SELECT match_id, competition_id, season, match_date + to_days(CAST(match_id % 4 - 1 AS INT)) AS match_date, home_team_id, away_team_id, CASE WHEN match_id % 7 = 0 THEN hg + 1 WHEN match_id % 11 = 0 THEN NULL ELSE hg END AS hg, ag,
    CASE WHEN match_id % 5 <> 0 THEN hht END AS hht, CASE WHEN match_id % 5 <> 0 THEN aht END AS aht,
    CASE WHEN match_id % 13 = 0 THEN 'postponed' WHEN match_id % 17 = 0 THEN 'scheduled' ELSE status END AS status, 'ground ' || match_id % 3 AS venue, match_id * 2 + 1 AS record_id FROM matches),
stored AS (
  SELECT * REPLACE (CASE WHEN match_id % 3 <> 0 THEN hht END AS hht, CASE WHEN match_id % 3 <> 0 THEN aht END AS aht), CASE WHEN match_id % 2 = 0 THEN 'ground ' || match_id % 5 END AS venue FROM matches)"""


@query("""SELECT record_id, match_id, line FROM (SELECT match_id AS record_id, match_id, l_linenumber AS line, row_number() OVER (PARTITION BY match_id ORDER BY l_linenumber) AS r
FROM (SELECT l_orderkey AS match_id, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey UNION ALL SELECT o_orderkey, 100 FROM orders)) WHERE r = 1 AND record_id % 3 <> 0""", None)
def import_dedup(spark, d):
    lines = adapter.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("match_id")).agg(F.min("l_linenumber").cast("int").alias("line"))
    both = lines.unionByName(adapter.table(spark, d, "orders").select(F.col("o_orderkey").alias("match_id"), F.lit(100).alias("line")))
    incoming = both.select(F.col("match_id").alias("record_id"), "match_id", "line")
    stored = adapter.table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("record_id"))
    return consolidate.new_records(incoming, stored, ["record_id"]).select("record_id", "match_id", "line")


@query("""SELECT i.record_id, s.stored_id FROM second i LEFT JOIN (
  SELECT i.record_id, arg_min(s.match_id, (abs(epoch_us(s.match_date) - epoch_us(i.match_date)), s.match_id)) AS stored_id FROM second i JOIN matches s ON s.competition_id = i.competition_id AND s.season = i.season AND s.home_team_id = i.home_team_id
    AND s.away_team_id = i.away_team_id AND abs(epoch_us(s.match_date) - epoch_us(i.match_date)) <= 86400000000 GROUP BY i.record_id) s ON s.record_id = i.record_id""", SECOND)
def band_match(spark, d):
    return consolidate.matched(_second_source(spark, d), adapter.matches(spark, d)).select("record_id", "stored_id")


STATUS_SQL = "CASE WHEN i.status = s.status THEN s.status WHEN s.status IN ('unknown', 'scheduled', 'live') THEN i.status WHEN i.status = 'scheduled' THEN s.status ELSE 'conflict' END"


@query(f"""SELECT match_id, hg, ag, hht, aht, venue, CASE WHEN ns = 'conflict' THEN old_status ELSE ns END AS status, CAST(c_ft + c_ht + c_venue + CAST(ns = 'conflict' AS INT) AS BIGINT) AS n_conflicts, half AS half_pairs FROM (
SELECT s.match_id, s.status AS old_status, {STATUS_SQL} AS ns,
  CASE WHEN i.hg IS NOT NULL AND i.ag IS NOT NULL AND s.hg IS NULL AND s.ag IS NULL THEN i.hg ELSE s.hg END AS hg, CASE WHEN i.hg IS NOT NULL AND i.ag IS NOT NULL AND s.hg IS NULL AND s.ag IS NULL THEN i.ag ELSE s.ag END AS ag,
  CASE WHEN s.hht IS NULL AND i.hht IS NOT NULL THEN i.hht ELSE s.hht END AS hht, CASE WHEN s.aht IS NULL AND i.aht IS NOT NULL THEN i.aht ELSE s.aht END AS aht, coalesce(s.venue, i.venue) AS venue,
  CAST(coalesce(i.hg <> s.hg, false) AS INT) AS c_ft, 0 AS c_ht, CAST(coalesce(i.venue <> s.venue, false) AS INT) AS c_venue, CASE WHEN i.hg IS NULL AND i.ag IS NOT NULL THEN 'full_time' ELSE '' END AS half
FROM stored s JOIN second i ON i.match_id = s.match_id)""", SECOND)
def match_conflicts(spark, d):
    rows = consolidate.merged(_stored(spark, d), _second_source(spark, d).drop("match_date"))
    return rows.select("match_id", "hg", "ag", "hht", "aht", "venue", "status", F.size("conflicts").cast("long").alias("n_conflicts"), F.array_join("half_pairs", ",").alias("half_pairs"))


@query("SELECT coalesce(s.match_id, i.match_id) AS match_id, coalesce(i.hg, s.hg) AS hg, coalesce(i.hht, s.hht) AS hht, coalesce(i.venue, s.venue) AS venue FROM stored s FULL JOIN (SELECT * REPLACE (CASE WHEN match_id % 3 = 0 THEN -match_id - 1 ELSE match_id END AS match_id) FROM second) i ON i.match_id = s.match_id", SECOND)
def upsert_known(spark, d):
    keep = ["match_id", "hg", "hht", "venue"]
    told = _second_source(spark, d).withColumn("match_id", F.expr("if(match_id % 3 = 0, -match_id - 1, match_id)"))
    return consolidate.upsert(_stored(spark, d).select(*keep), told.select(*keep), ["match_id"])


@query("""SELECT match_id, unnest(list_filter([CASE WHEN (hg IS NULL) <> (ag IS NULL) THEN 'half_full_time_pair' END, CASE WHEN (hht IS NULL) <> (aht IS NULL) THEN 'half_half_time_pair' END, CASE WHEN hht > hg OR aht > ag THEN 'half_time_above_full_time' END,
  CASE WHEN status = 'finished' AND (hg IS NULL OR ag IS NULL) THEN 'finished_without_score' END, CASE WHEN status = 'scheduled' AND (hg IS NOT NULL OR ag IS NOT NULL) THEN 'scheduled_with_score' END], lambda x: x IS NOT NULL)) AS problem FROM second""", SECOND)
def state_problems(spark, d):
    return consolidate.invariants(_second_source(spark, d))


@query("""SELECT match_id, severity, code FROM (SELECT match_id, unnest([CASE WHEN home_team_id % 20 = 7 THEN {'severity': 'error', 'code': 'missing_home_team'} END, CASE WHEN hg IS NULL AND ag IS NOT NULL THEN {'severity': 'error', 'code': 'half_full_time_pair'} END,
  CASE WHEN hht > hg OR aht > ag THEN {'severity': 'error', 'code': 'half_time_above_full_time'} END, CASE WHEN status = 'finished' AND hg IS NULL THEN {'severity': 'error', 'code': 'finished_without_score'} END,
  CASE WHEN hg + ag > 15 THEN {'severity': 'warning', 'code': 'many_goals'} END, CASE WHEN status = 'scheduled' AND hg IS NOT NULL THEN {'severity': 'warning', 'code': 'scheduled_with_score'} END], recursive := true) FROM second)""".replace(", recursive := true", "").replace("SELECT match_id, severity, code FROM (SELECT match_id, unnest(", "SELECT match_id, f.severity AS severity, f.code AS code FROM (SELECT match_id, unnest(").replace(") FROM second)", ") AS f FROM second) WHERE f IS NOT NULL"), SECOND)
def quarantine_rows(spark, d):
    rows = _second_source(spark, d)
    team = lambda c: F.concat(F.lit("Team "), F.col(c).cast("string"))
    home = F.when(F.col("home_team_id") % 20 == 7, "  ").otherwise(team("home_team_id"))
    parsed = rows.withColumns({"competition": F.col("competition_id").cast("string"), "home_team": home, "away_team": team("away_team_id")})
    return validate.quarantine(validate.checked(parsed), "match_id")


def _absences(spark, d):
    part = adapter.table(spark, d, "part")
    start = F.date_add(F.lit("1994-01-01").cast("date"), F.col("p_size") * 30)
    return part.select(F.col("p_partkey").alias("player_id"), (F.col("p_partkey") % 100).alias("team_id"), start.alias("starts"), F.when(F.col("p_size") % 5 != 0, F.date_add(start, 60)).alias("ends"), (F.col("p_size") % 7 != 0).alias("active"))


@query("""SELECT DISTINCT match_id, p_partkey AS player_id FROM sides JOIN part ON p_partkey % 100 = team_id AND p_size % 7 <> 0
WHERE CAST(match_date AS DATE) >= DATE '1994-01-01' + p_size * 30 AND (p_size % 5 = 0 OR CAST(match_date AS DATE) <= DATE '1994-01-01' + p_size * 30 + 60)""")
def availability_at_kickoff(spark, d):
    return players.unavailable(adapter.matches(spark, d), _absences(spark, d))


def _lineups(spark, d):
    lines = adapter.table(spark, d, "lineitem")
    team = F.when(F.col("l_linenumber") % 2 == 1, F.col("home_team_id")).otherwise(F.col("away_team_id"))
    rows = lines.join(adapter.matches(spark, d).select(F.col("match_id").alias("l_orderkey"), "home_team_id", "away_team_id"), "l_orderkey")
    shown = F.col("l_shipdate") - F.make_dt_interval(F.lit(60))
    return rows.groupBy(F.col("l_orderkey").alias("match_id"), F.col("l_partkey").alias("player_id")).agg(F.min(team).alias("team_id"), F.min(shown).alias("known_at"), F.bool_or(F.col("l_linestatus") == "F").alias("confirmed"), F.max(F.col("l_discount") * 10).alias("start_probability"), F.lit(75).alias("expected_minutes"))


LINEUPS = base.BASE + """,
lineups AS (
  SELECT l_orderkey AS match_id, l_partkey AS player_id, min(CASE WHEN l_linenumber % 2 = 1 THEN home_team_id ELSE away_team_id END) AS team_id, min(l_shipdate - to_days(60)) AS known_at, bool_or(l_linestatus = 'F') AS confirmed,
    max(l_discount * 10) AS start_probability FROM lineitem JOIN matches ON match_id = l_orderkey GROUP BY ALL)"""


@query("SELECT l.match_id, round(least(count(*) / 22, 1.0) * least(count(DISTINCT team_id) / 2, 1.0), 6) AS coverage, bool_and(confirmed) AS confirmed FROM lineups l JOIN matches m ON m.match_id = l.match_id WHERE known_at <= match_date GROUP BY l.match_id", LINEUPS)
def lineup_coverage(spark, d):
    known = players.known_lineups(_lineups(spark, d), adapter.matches(spark, d))
    return players.lineup_coverage(known).withColumn("coverage", F.round("coverage", 6))


FORMS = LINEUPS + """,
form AS (
  SELECT player_id, count(*) AS games, CAST(sum(minutes) AS BIGINT) AS minutes, CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(cards) AS BIGINT) AS cards
  FROM (SELECT p.*, row_number() OVER (PARTITION BY player_id ORDER BY match_date DESC, p.match_id DESC) AS r FROM player_matches p JOIN matches m ON m.match_id = p.match_id WHERE status = 'finished') WHERE r <= 10 GROUP BY player_id)"""


def _form(spark, d):
    done = side_rows.completed(adapter.matches(spark, d)).select("match_id", "match_date")
    return players.player_form(adapter.player_matches(spark, d).join(done, "match_id"))


@query("SELECT * FROM form", FORMS)
def player_form(spark, d):
    return _form(spark, d)


@query("""SELECT match_id, kind, rank, player_id, probability FROM (SELECT *, row_number() OVER (PARTITION BY match_id, kind ORDER BY probability DESC, player_id) AS rank FROM (
  SELECT l.match_id, kind, l.player_id, round((1 - exp(-(n / minutes * 75))) * CASE WHEN confirmed THEN 1.0 ELSE start_probability END, 9) AS probability
  FROM lineups l JOIN (SELECT player_id, minutes, 'scorer' AS kind, goals AS n FROM form UNION ALL SELECT player_id, minutes, 'card', cards FROM form) f ON f.player_id = l.player_id WHERE minutes > 0)) WHERE rank <= 10""", FORMS)
def player_probs(spark, d):
    return players.chances(_lineups(spark, d), _form(spark, d))


NOISY = "CASE c_custkey % 4 WHEN 0 THEN upper(c_name) WHEN 1 THEN replace(c_name, 'a', 'á') WHEN 2 THEN ' ' || c_name || 'ø FC' ELSE replace(c_name, '#', ' ł ') END"


def _noisy(spark, d):
    return adapter.table(spark, d, "customer").select("c_custkey", F.expr(NOISY).alias("name"))


@query(f"SELECT c_custkey, trim(regexp_replace(lower(strip_accents({NOISY})), '[^a-z0-9]+', ' ', 'g')) AS plain, regexp_replace(trim(regexp_replace(lower(strip_accents({NOISY})), '[^a-z0-9]+', ' ', 'g')), ' fc$', '') AS team FROM customer", None)
def normalize_names(spark, d):
    return _noisy(spark, d).select("c_custkey", names.plain_name("name").alias("plain"), names.plain_team_name("name").alias("team"))


def _parsed(spark, d):
    """Matches as a parser gives them: names of competitions and teams, seasons in words."""
    region = adapter.table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("competition_id"), F.col("r_name").alias("competition"))
    team = lambda c: F.concat(F.lit("Team "), F.col(c).cast("string"))
    rows = adapter.matches(spark, d).join(region, "competition_id")
    label = F.concat(F.col("season").cast("string"), F.lit("/"), F.substring((F.col("season") + 1).cast("string"), 3, 2))
    return rows.withColumns({"season": label, "home_team": F.when(F.col("home_team_id") % 20 == 7, F.lit(None)).otherwise(team("home_team_id")), "away_team": team("away_team_id")})


PARSED = base.BASE + """,
parsed AS (SELECT m.*, r_name AS competition, m.season || '/' || right(CAST(m.season + 1 AS VARCHAR), 2) AS label, m.home_team_id % 20 = 7 OR coalesce(hht > hg OR aht > ag, false) AS bad FROM matches m JOIN region ON r_regionkey = competition_id)"""


@query("SELECT count(*) AS matches, count(*) FILTER (WHERE NOT bad) AS good, count(*) FILTER (WHERE bad) AS bad, count(*) FILTER (WHERE hg + ag > 15) AS warned, count(DISTINCT competition) FILTER (WHERE NOT bad) AS competitions, count(DISTINCT label) FILTER (WHERE NOT bad) AS seasons FROM parsed WHERE competition = 'ASIA' AND label = '1995/96'", PARSED)
def import_composition(spark, d):
    return imports.metrics(imports.imported(_parsed(spark, d), "ÁSIA", "1995-1996"))


@query("""SELECT competition, CAST(min(match_date) AS TIMESTAMP) AS first_match_date, CAST(max(match_date) AS TIMESTAMP) AS last_match_date, count(*) AS total_matches, count(*) FILTER (WHERE status = 'finished') AS finished_matches, count(*) FILTER (WHERE status = 'scheduled') AS scheduled_matches,
  string_agg(DISTINCT label, ',' ORDER BY label) AS seasons_available, concat_ws(',', CASE WHEN count(ag) > 0 THEN 'ag' END, CASE WHEN count(hg) > 0 THEN 'hg' END, CASE WHEN count(hht) > 0 THEN 'hht' END) AS fields_available FROM parsed GROUP BY competition""", PARSED)
def preview_quality(spark, d):
    rows = imports.preview_quality(_parsed(spark, d), ["hg", "ag", "hht"])
    listed = {c: F.array_join(c, ",") for c in ("seasons_available", "fields_available")}
    return rows.withColumns(listed | {c: F.col(c).cast("timestamp_ntz") for c in ("first_match_date", "last_match_date")})


@query("SELECT home_team_id, string_agg(season, ',' ORDER BY first DESC) AS seasons FROM (SELECT home_team_id, season, max(match_id) AS first FROM matches GROUP BY ALL) GROUP BY home_team_id")
def seasons_in_order(spark, d):
    return adapter.matches(spark, d).groupBy("home_team_id").agg(F.array_join(F.transform(imports.in_order(F.col("season"), -F.col("match_id")), lambda s: s.cast("string")), ",").alias("seasons"))


@query("SELECT match_id, CASE WHEN home_team_id % 20 = 7 THEN 'competition' END AS lacks_competition, CASE WHEN match_id % 3 = 0 THEN 'season' END AS lacks_season FROM matches WHERE home_team_id % 20 = 7 OR match_id % 3 = 0")
def rows_without_identity(spark, d):
    rows = adapter.matches(spark, d).select("match_id", F.when(F.col("home_team_id") % 20 != 7, "Liga").alias("competition"), F.when(F.col("match_id") % 3 == 0, "autumn").otherwise(F.col("season").cast("string")).alias("season"))
    lacks = validate.without_identity(rows, "match_id")
    return lacks.select("match_id", *[F.when(F.array_contains("lacks", c), c).alias(f"lacks_{c}") for c in ("competition", "season")])


@query("SELECT match_id, 'away_team_id' AS field FROM matches WHERE away_team_id % 20 = 3 UNION ALL SELECT match_id, 'season' FROM matches WHERE season = 1992")
def missing_references(spark, d):
    rows = adapter.matches(spark, d)
    teams = rows.select("away_team_id").where("away_team_id % 20 <> 3")
    return validate.missing_references(rows, "match_id", {"away_team_id": teams, "season": rows.select("season").where("season > 1992")})


@query("SELECT match_id, 'hg' AS field, CAST(hg AS DOUBLE) AS value FROM matches WHERE hg > 4 UNION ALL SELECT match_id, 'ag', CAST(ag AS DOUBLE) FROM matches WHERE ag < 1")
def range_checks(spark, d):
    return validate.out_of_range(adapter.matches(spark, d), "match_id", {"hg": (None, 4), "ag": (1, 99)})


SEASON = "CASE match_id % 4 WHEN 0 THEN season || '/' || right(CAST(season + 1 AS VARCHAR(10)), 2) WHEN 1 THEN season || '-' || (season + 1) WHEN 2 THEN 'Season ' || season ELSE 'none' END"


@query(f"SELECT match_id, CASE WHEN match_id % 4 < 3 THEN season || '-' || right(CAST(season + 1 AS VARCHAR), 2) END AS season FROM (SELECT match_id, season, {SEASON} AS label FROM matches)")
def normalize_seasons(spark, d):
    label = F.expr(SEASON.replace("VARCHAR(10)", "STRING"))
    return adapter.matches(spark, d).select("match_id", names.season_name(label).alias("season"))


@query(f"""SELECT c_custkey, key, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS resolution, CASE WHEN n = 1 THEN id END AS entity_id FROM
  (SELECT c_custkey, trim(regexp_replace(lower(strip_accents({NOISY})), '[^a-z0-9]+', ' ', 'g')) AS key FROM customer) LEFT JOIN
  (SELECT trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS key, count(DISTINCT c_custkey % 700) AS n, min(c_custkey % 700) AS id FROM customer GROUP BY 1) USING (key)""", None)
def exact_resolution(spark, d):
    names_ = _noisy(spark, d).select("c_custkey", names.plain_name("name").alias("key"))
    aliases = adapter.table(spark, d, "customer").select(names.plain_name("c_name").alias("key"), (F.col("c_custkey") % 700).alias("entity_id"))
    return resolve.exact(names_, aliases).select("c_custkey", "key", "resolution", "entity_id")


LCP = "list_transform(range(1, length(y) + 1), lambda j: {'k': len(list_filter(range(1, least(length(x) - i, length(y) - j) + 2), lambda k: x[i:i + k - 1] = y[j:j + k - 1])), 'i': -i, 'j': -j})"


@query(f"""SELECT key, CASE WHEN best = 1 AND second IS DISTINCT FROM 1 THEN 'exact' WHEN best >= {resolve.AUTO} AND best - coalesce(second, 0.0) >= {resolve.MARGIN} THEN 'fuzzy_approved'
  WHEN best >= {resolve.REVIEW} THEN 'manual_review' ELSE 'unmatched' END AS resolution, CASE WHEN resolution IN ('exact', 'fuzzy_approved') THEN first_id END AS entity_id, round(best, 6) AS best, round(second, 6) AS second
FROM (SELECT key, max(score) FILTER (WHERE nth = 1) AS best, max(score) FILTER (WHERE nth = 2) AS second, max(entity_id) FILTER (WHERE nth = 1) AS first_id
  FROM (SELECT key, entity_id, score, row_number() OVER (PARTITION BY key ORDER BY score DESC, entity_id) AS nth FROM scored
    UNION ALL SELECT key, NULL, NULL, NULL FROM asked) GROUP BY key)""", f"""RECURSIVE names AS (SELECT p_name AS name, min(p_partkey) AS entity_id FROM part GROUP BY p_name),
asked AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN left(p_name, length(p_name) - 1) ELSE replace(p_name, 'e', 'a') END AS key FROM part),
blocks AS (
  SELECT key, name, key AS x, name AS y, CAST(0 AS BIGINT) AS matched FROM asked CROSS JOIN names
  UNION ALL
  SELECT key, name, CASE side WHEN 0 THEN left(x, -m.i - 1) ELSE x[-m.i + m.k:] END, CASE side WHEN 0 THEN left(y, -m.j - 1) ELSE y[-m.j + m.k:] END, CASE side WHEN 0 THEN m.k ELSE 0 END
  FROM (SELECT *, unnest([0, 1]) AS side FROM (SELECT *, list_max(flatten(list_transform(range(1, length(x) + 1), lambda i: {LCP}))) AS m FROM blocks WHERE x <> '' AND y <> '') WHERE m.k > 0)),
scored AS (SELECT key, entity_id, 2.0 * sum(matched) / (length(key) + length(name)) AS score FROM blocks JOIN names USING (name) GROUP BY key, name, entity_id HAVING score >= {resolve.REVIEW})""")
def fuzzy_resolution(spark, d):
    part = adapter.table(spark, d, "part").select("p_partkey", "p_name")
    known = part.groupBy("p_name").agg(F.min("p_partkey").alias("entity_id")).select(F.col("p_name").alias("key"), "entity_id")
    asked = part.select(F.expr("CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN substring(p_name, 1, length(p_name) - 1) ELSE replace(p_name, 'e', 'a') END").alias("key"))
    return resolve.fuzzy(asked, known).select("key", "resolution", "entity_id", F.round("best", 6).alias("best"), F.round("second", 6).alias("second"))


@query("""SELECT match_id, hg, ag, hht, aht FROM matches WHERE hg IS NOT NULL""")
def parse_scorelines(spark, d):
    m = adapter.matches(spark, d).where("hg is not null")
    line = F.concat(F.lit("Team A "), "hg", F.lit("-"), "ag", F.lit(" ("), "hht", F.lit("-"), "aht", F.lit(") Team B"))
    parsed = m.select("match_id", scores.scoreline(line).alias("s"))
    return parsed.select("match_id", *[F.col(f"s.{a}").alias(b) for a, b in (("home", "hg"), ("away", "ag"), ("half_home", "hht"), ("half_away", "aht"))])


def _versions(spark, d):
    o = adapter.table(spark, d, "events")
    return o.select(F.col("event_id").alias("prediction_id"), (F.col("user_id") % 500).alias("match_id"), F.col("ts").alias("generated_at"), F.round("value", 4).alias("p"))


VERSIONS = "versions AS (SELECT event_id AS prediction_id, user_id % 500 AS match_id, ts AS generated_at, round(value, 4) AS p FROM events)"


@query("SELECT prediction_id, match_id, p FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY generated_at DESC, prediction_id DESC) AS r FROM versions) WHERE r = 1", VERSIONS)
def latest_prediction(spark, d):
    return grading.latest(_versions(spark, d)).select("prediction_id", "match_id", "p")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_id IN (SELECT arg_max(prediction_id, (generated_at, prediction_id)) FROM versions GROUP BY match_id) GROUP BY event_type", VERSIONS)
def semi_latest(spark, d):
    last = grading.latest(_versions(spark, d)).select(F.col("prediction_id").alias("event_id"))
    return adapter.table(spark, d, "events").join(last, "event_id", "left_semi").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, user_id, n, n > 3 AS limited FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS n FROM events)", None)
def sliding_rate(spark, d):
    return rate.sliding(adapter.table(spark, d, "events"), "user_id", seconds=3600, limit=3).select("event_id", "user_id", "n", "limited")


@query("""SELECT match_id, strftime(match_date - to_minutes(CAST(60 * (match_id % 7 - 3) - CASE WHEN match_id % 5 = 0 THEN 0 ELSE 15 * 60 + 30 END AS INT)), '%Y-%m-%d %H:%M') AS at FROM matches WHERE match_id % 5 <> 0
UNION ALL SELECT match_id, strftime(match_date, '%Y-%m-%d %H:%M') FROM matches WHERE match_id % 5 = 0""")
def kickoff_times(spark, d):
    m = adapter.matches(spark, d)
    zone = F.col("match_id") % 7 - 3
    label = F.concat(F.lit("15:30 UTC"), F.when(zone < 0, "-").otherwise("+"), F.abs(zone).cast("string"))
    at = values.kickoff(F.col("match_date"), F.when(F.col("match_id") % 5 != 0, label))
    return m.select("match_id", F.date_format(at["at"], "yyyy-MM-dd HH:mm").alias("at"))


@query("""SELECT p.match_id, round(quality, 6) AS quality, CASE WHEN quality < 0.5 THEN 'very_low' WHEN quality < 0.6 THEN 'low' WHEN quality < 0.7 THEN 'medium' WHEN quality < 0.8 THEN 'high' ELSE 'very_high' END AS label FROM (
SELECT f.match_id, least(1.0, 0.45 * least((home_history_matches + away_history_matches) / 20, 1.0) + 0.20 * CASE WHEN s.match_id IS NULL THEN 0.0 ELSE 1.0 END + 0.10 +
  0.10 * CASE WHEN greatest(home_history_max_date, away_history_max_date) IS NULL THEN 0.0 ELSE greatest(0.0, 1 - (epoch_us(match_date) - epoch_us(greatest(home_history_max_date, away_history_max_date))) / 86400000000.0 / 365) END) AS quality
FROM features f LEFT JOIN (SELECT DISTINCT match_id FROM stats) s ON s.match_id = f.match_id) p""", base.FORM)
def prediction_quality(spark, d):
    rows = base._features(spark, d)
    some = adapter.team_statistics(spark, d).select("match_id").distinct().withColumn("stats_coverage", F.lit(1.0))
    rows = rows.join(some, "match_id", "left").withColumns({"stats_coverage": F.coalesce("stats_coverage", F.lit(0.0)), "lineup_coverage": F.lit(0.0), "referee_known": F.lit(True), "is_mock_data": F.lit(False)})
    scored = quality.with_quality(rows)
    return scored.select("match_id", F.round("quality", 6).alias("quality"), quality.label("quality").alias("label"))


@query("""SELECT competition_id, round(avg(cards), 6) AS cards, round(avg(corners), 6) AS corners, round(avg(shots), 6) AS shots FROM (
  SELECT *, row_number() OVER (PARTITION BY competition_id ORDER BY match_date DESC, match_id DESC, venue) AS r FROM sides WHERE status = 'finished' AND shots IS NOT NULL AND match_date < '1998-01-01') WHERE r <= 40 GROUP BY competition_id""")
def league_fallback(spark, d):
    rows = side_rows.sides(base._full(spark, d))
    return quality.league_fallback(rows, before="1998-01-01")


GOAL_FEATURES = tuple(f"{m}_avg_{n}" for m in ("goals_for", "goals_against", "shots") for n in (5, 10))


def _told(rows):
    return rows.withColumns({c: F.round(c, 6) for c, t in rows.dtypes if t == "double"})


@query()
def glm_goals(spark, d):
    from pitchlake.operators import models

    return models.goal_model_report(base._wide(spark, d, GOAL_FEATURES))


@query()
def linear_factors(spark, d):
    from pitchlake.operators import models

    return _told(models.linear_factors(base._wide(spark, d, GOAL_FEATURES)))


@query()
def tree_factors(spark, d):
    from pitchlake.operators import models

    return _told(models.tree_factors(base._wide(spark, d, GOAL_FEATURES)))


IMPACT_SQL = """CASE WHEN {x} >= {high} THEN 'high' WHEN {x} >= {medium} THEN 'medium' ELSE 'low' END || CASE WHEN {up} THEN '_positive' ELSE '_negative' END"""


def _impact_sql(x, high, medium, up):
    return f"CASE WHEN {x} IS NOT NULL THEN {IMPACT_SQL.format(x=x, high=high, medium=medium, up=up)} END"


@query(f"""SELECT match_id, {_impact_sql('abs(c) / greatest(r, 1e-12)', 0.35, 0.2, 'b IS NULL OR c >= 0')} AS rate_impact,
  CASE WHEN f IS NOT NULL THEN coalesce({_impact_sql('abs((f - b) / nullif(b, 0))', 0.35, 0.15, '(f - b) / nullif(b, 0) >= 0')}, 'neutral') END AS attack_impact,
  CASE WHEN a IS NOT NULL THEN coalesce({_impact_sql('abs((a - b) / nullif(b, 0))', 0.35, 0.15, '-((a - b) / nullif(b, 0)) >= 0')}, 'neutral') END AS defence_impact
FROM (SELECT f.match_id, round(h.goals_for_avg_5, 6) AS f, round(h.goals_against_avg_5, 6) AS a, round(league_home_goals_avg, 6) AS b, round(lambda_home, 6) AS r, round(lambda_home, 6) - round(league_home_goals_avg, 6) AS c
  FROM lambdas l JOIN features f ON f.match_id = l.match_id JOIN side_features h ON h.match_id = l.match_id AND h.venue = 'home')""", base.RATES)
def factor_impacts(spark, d):
    rows = base._rates(spark, d)
    value = {k: F.round(F.col(c).cast("double"), 6) for k, c in {"f": "home_goals_for_avg_5", "a": "home_goals_against_avg_5", "b": "league_home_goals_avg", "r": "lambda_home"}.items()}
    return rows.select(
        "match_id",
        impacts.of_rate(value["r"] - value["b"], value["r"], value["b"]).alias("rate_impact"),
        impacts.of_value(value["f"], value["b"]).alias("attack_impact"),
        impacts.of_value(value["a"], value["b"], inverse=True).alias("defence_impact"),
    )


@query("SELECT match_id, round(1 - exp(-0.45 * (lambda_home + lambda_away)), 6) AS first_half_goal, round(0.45 * lambda_home, 6) AS first_half_home, round(0.45 * lambda_away, 6) AS first_half_away FROM lambdas", base.RATES)
def first_half(spark, d):
    rows = base._rates(spark, d)
    share = {v: 0.45 * F.col(f"lambda_{v}") for v in ("home", "away")}
    return rows.select("match_id", F.round(1 - F.exp(-(share["home"] + share["away"])), 6).alias("first_half_goal"), *[F.round(share[v], 6).alias(f"first_half_{v}") for v in share])


@query("""SELECT match_id, coalesce(bool_or(match_id % 97 = 0 AND status = 'finished') OVER (PARTITION BY competition_id ORDER BY match_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), false) AS history_contains_demo FROM matches""")
def demo_in_history(spark, d):
    return enrich.demo_in_history(adapter.matches(spark, d).withColumn("is_demo", F.col("match_id") % 97 == 0))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END, n_name) AS segment, coalesce(CASE WHEN c_custkey % 5 <> 0 THEN n_name END, n_name) AS country,
  CASE WHEN c_custkey % 3 <> 0 AND c_mktsegment <> n_name THEN 'segment' ELSE '' END AS kept FROM customer JOIN nation ON n_nationkey = c_nationkey""", None)
def catalog_fill(spark, d):
    both = adapter.table(spark, d, "customer").join(adapter.table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    k = F.col("c_custkey")
    stored = both.select("c_custkey", F.when(k % 3 != 0, F.col("c_mktsegment")).alias("segment"), F.when(k % 5 != 0, F.col("n_name")).alias("country"))
    catalog = both.select("c_custkey", F.col("n_name").alias("segment"), F.col("n_name").alias("country"))
    return enrich.filled_from(stored, catalog, "c_custkey", ["segment", "country"]).withColumn("kept", F.array_join("kept", ","))


@query("""SELECT record_id, CASE WHEN n_same = 1 THEN 'matched' WHEN n_same > 1 THEN 'ambiguous' WHEN n_blank = 1 THEN 'matched' WHEN n_blank > 1 THEN 'ambiguous' ELSE 'new' END AS resolution,
  CASE WHEN n_same = 1 THEN id_same WHEN n_same = 0 AND n_blank = 1 THEN id_blank END AS player_id FROM (
  SELECT a.p_partkey AS record_id, count(*) FILTER (WHERE a.b = k.b) AS n_same, count(*) FILTER (WHERE k.p_partkey IS NOT NULL AND (k.b IS NULL OR a.b IS NULL)) AS n_blank, min(k.p_partkey) FILTER (WHERE a.b = k.b) AS id_same,
    min(k.p_partkey) FILTER (WHERE k.p_partkey IS NOT NULL AND (k.b IS NULL OR a.b IS NULL)) AS id_blank
  FROM (SELECT p_partkey, p_brand || p_type AS name, CASE WHEN p_size % 7 <> 0 THEN p_size END AS b FROM part WHERE p_partkey % 2 = 0) a
  LEFT JOIN (SELECT p_partkey, p_brand || p_type AS name, CASE WHEN p_size % 5 <> 0 THEN p_size END AS b FROM part WHERE p_partkey % 2 = 1) k ON a.name = k.name GROUP BY a.p_partkey)""", None)
def homonym_players(spark, d):
    part = adapter.table(spark, d, "part").withColumn("name", F.concat("p_brand", "p_type"))
    asked = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("record_id"), "name", F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("birth_date"))
    known = part.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("player_id"), "name", F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("birth_date"))
    return enrich.homonyms(asked, known)


@query("SELECT match_id, array_to_string(list_filter([CASE WHEN ag IS NOT NULL THEN 'ag' END, CASE WHEN hg IS NOT NULL THEN 'hg' END, CASE WHEN hht IS NOT NULL THEN 'hht' END], lambda x: x IS NOT NULL), ',') AS known FROM second", SECOND)
def field_provenance(spark, d):
    rows = _second_source(spark, d)
    told = enrich.provenance(["ag", "hg", "hht"], F.lit("second"))
    return rows.select("match_id", F.array_join(F.array_sort(F.map_keys(told)), ",").alias("known"))


@query("SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM events GROUP BY ALL", None)
def request_windows(spark, d):
    rows = rate.tumbling(adapter.table(spark, d, "events"), "user_id", seconds=3600)
    return rows.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("SELECT CAST(least(floor(home_win * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(home_win), 6) AS confidence, round(avg(CAST(hg > ag AS INT)), 6) AS frequency FROM markets JOIN matches USING (match_id) WHERE hg IS NOT NULL GROUP BY 1", base.RATES)
def calibration_bins(spark, d):
    rows = poisson.markets(base._goal_rates(spark, d).where("hg is not null"))
    out = evaluation.calibration(rows, "home_win", F.col("hg") > F.col("ag"))
    return out.select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("frequency", 6).alias("frequency"))


@query("SELECT match_id, event_type, status FROM outcomes WHERE match_id % 2 = 1 OR event_type <> 'match_result'", base.GRADES)
def grading_retry(spark, d):
    graded = adapter.matches(spark, d).where("match_id % 2 = 0").select("match_id", F.lit("match_result").alias("event_type"))
    rows = grading.outcomes(base._predictions(spark, d), adapter.matches(spark, d), adapter.team_statistics(spark, d), graded)
    return rows.select("match_id", "event_type", "status")


@query("""SELECT match_id, unnest(list_filter([CASE WHEN home = away_team_id THEN 'same_team' END, CASE WHEN s.season IS NULL THEN 'season_of_other_competition' END, CASE WHEN told <= '1997-01-01' THEN 'kickoff_not_ahead' END], lambda x: x IS NOT NULL)) AS problem FROM (
  SELECT match_id, competition_id, away_team_id, CASE WHEN match_id % 7 = 0 THEN away_team_id ELSE home_team_id END AS home, CASE WHEN match_id % 5 = 0 THEN season + 90 ELSE season END AS season, CASE WHEN match_id % 3 = 0 THEN match_date + to_days(30) END AS told FROM matches) c
LEFT JOIN (SELECT DISTINCT competition_id, season FROM matches) s ON s.competition_id = c.competition_id AND s.season = c.season""")
def unplannable_changes(spark, d):
    stored, k = adapter.matches(spark, d), F.col("match_id")
    changes = stored.select(
        "match_id",
        F.lit(None).cast(stored.schema["competition_id"].dataType).alias("competition_id"),
        F.when(k % 5 == 0, F.col("season") + 90).alias("season"),
        F.when(k % 3 == 0, F.col("match_date") + F.make_dt_interval(F.lit(30))).alias("match_date"),
        F.when(k % 7 == 0, F.col("away_team_id")).alias("home_team_id"),
        F.lit(None).cast(stored.schema["away_team_id"].dataType).alias("away_team_id"),
    )
    return validate.unplannable(changes, stored, "1997-01-01", stored)


@query("""SELECT match_id, problem FROM (SELECT match_id, unnest([CASE WHEN hg > het OR ag > aet THEN 'full_time_above_extra_time' END, CASE WHEN (het IS NULL) <> (aet IS NULL) THEN 'half_extra_time_pair' END]) AS problem
FROM (SELECT match_id, hg, ag, hg + match_id % 4 - 1 AS het, CASE WHEN match_id % 9 <> 0 THEN ag END AS aet FROM matches)) WHERE problem IS NOT NULL""")
def extra_time_problems(spark, d):
    k = F.col("match_id")
    rows = adapter.matches(spark, d).withColumns({"het": F.col("hg") + k % 4 - 1, "aet": F.when(k % 9 != 0, F.col("ag"))})
    return consolidate.invariants(rows).where(F.col("problem").contains("extra_time"))


@query("""SELECT match_id, competition_id || '-' || season || '-' || month(match_date) || '-' || match_id // 1000 AS path, strftime(match_date, '%Y-%m-%d') AS day, 'team ' || home_team_id AS home_team, 'team ' || away_team_id AS away_team, CASE WHEN hg IS NULL THEN 'scheduled' ELSE 'finished' END AS status,
  hg, ag, CASE WHEN match_id % 4 < 3 AND ag IS NOT NULL THEN hht END AS hht, CASE WHEN match_id % 4 < 3 AND ag IS NOT NULL THEN aht END AS aht, CASE WHEN match_id % 4 = 1 THEN hg + 1 END AS hagg, CASE WHEN match_id % 4 = 1 THEN ag END AS aagg FROM matches""")
def json_documents(spark, d):
    """Matches as JSON documents by competition, season and month, of a thousand ids at most, in four shapes of scores, read
    by the JSON reader."""
    m = adapter.matches(spark, d)
    k = F.col("match_id") % 4
    pair = lambda a, b: F.when(F.col("hg").isNotNull(), F.array(a, b))
    score = F.when(k == 0, F.to_json(F.struct(pair("hg", "ag").alias("ft"), pair("hht", "aht").alias("ht")))).when(
        k == 1, F.to_json(F.struct(pair("hg", "ag").alias("regular"), pair("hht", "aht").alias("halftime"), pair(F.col("hg") + 1, "ag").alias("aggregate")))
    ).when(k == 3, F.to_json(F.array("hg", "ag")))
    own = [F.when((k == 2) & F.col("hg").isNotNull(), F.col(c)).alias(n) for n, c in (("score1", "hg"), ("score2", "ag"), ("ht_home", "hht"), ("ht_away", "aht"))]
    one = F.to_json(F.struct(
        F.col("match_id").cast("string").alias("round"), F.date_format("match_date", "yyyy-MM-dd").alias("date"), F.concat(F.lit("team "), "home_team_id").alias("team1"), F.concat(F.lit("team "), "away_team_id").alias("away"),
        *own,
    ))
    text = F.when(score.isNotNull() & F.col("hg").isNotNull(), F.concat(F.substring(one, F.lit(1), F.length(one) - 1), F.lit(',"score":'), score, F.lit("}"))).otherwise(one)
    path = F.concat_ws("-", "competition_id", "season", F.month("match_date"), F.floor(F.col("match_id") / 1000))
    documents = m.groupBy(path.alias("path")).agg(F.concat(F.lit('{"name":"Cup","matches":['), F.array_join(F.collect_list(text), ","), F.lit("]}")).cast("binary").alias("content"))
    read = results_json.matches(documents)
    return read.select(F.col("round").cast("long").alias("match_id"), "path", F.date_format("match_date", "yyyy-MM-dd").alias("day"), "home_team", "away_team", "status", "hg", "ag", "hht", "aht", "hagg", "aagg")


@query("""SELECT match_id, competition_id || '-' || season || '-' || month(match_date) || '-' || match_id // 1000 || '.csv' AS path, 'Málaga ' || home_team_id AS home_team, 'Gijón ' || away_team_id AS away_team, strftime(match_date, '%Y-%m-%d') AS day, CAST(season AS VARCHAR) AS season, 'league ' || competition_id AS competition,
  CASE WHEN match_id % 13 <> 0 THEN hg END AS hg, ag, hht, aht, CASE WHEN match_id % 5 <> 0 THEN match_id % 6 END AS home_yellow_cards, CASE WHEN match_id % 5 <> 0 THEN match_id % 6 + CASE WHEN match_id % 7 = 0 THEN 1 ELSE 0 END WHEN match_id % 7 = 0 THEN 1 END AS home_cards,
  CASE WHEN hg IS NULL OR ag IS NULL OR match_id % 13 = 0 THEN 'scheduled' ELSE 'finished' END AS status, CASE WHEN match_id % 13 = 0 THEN 'hg' ELSE '' END AS invalid, round(CASE WHEN match_id % 3 <> 0 THEN 1 + (match_id % 40 + 1) / 10.0 END, 6) AS b365h FROM matches""")
def csv_documents(spark, d):
    """Matches as CSV documents by competition, season and month, of a thousand ids at most, with three delimiters, two date
    formats and three encodings, unreadable goals and blank cells, read by the CSV reader."""
    m = adapter.matches(spark, d)
    k, kind = F.col("match_id"), F.col("competition_id") % 3
    cut = F.when(kind == 0, ",").when(kind == 1, ";").otherwise("\t")
    day = F.when(kind == 0, F.date_format("match_date", "dd/MM/yyyy")).otherwise(F.date_format("match_date", "yyyy-MM-dd"))
    cells = {
        "Date": day, "HomeTeam": F.concat(F.lit("Málaga "), "home_team_id"), "AwayTeam": F.concat(F.lit("Gijón "), "away_team_id"), "Referee": k, "Season": F.col("season"), "League": F.concat(F.lit("league "), "competition_id"),
        "FTHG": F.when(k % 13 == 0, "x").otherwise(F.col("hg").cast("string")), "FTAG": F.col("ag"), "HTHG": F.col("hht"), "HTAG": F.col("aht"),
        "HY": F.when(k % 5 != 0, k % 6), "HR": F.when(k % 7 == 0, 1), "B365H": F.when(k % 3 != 0, F.round(1 + (k % 40 + 1) / 10, 1).cast("string")).otherwise("0.5"),
    }
    line = F.array_join(F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in cells.values()]), "|")
    path = F.concat(F.concat_ws("-", "competition_id", "season", F.month("match_date"), F.floor(k / 1000)), F.lit(".csv"))
    text = F.concat(F.lit("|".join(cells) + "\n"), F.array_join(F.collect_list("line"), "\n"))
    documents = m.select(path.alias("path"), kind.alias("kind"), cut.alias("cut"), line.alias("line")).groupBy("path", "kind", "cut").agg(text.alias("text"))
    text = F.replace("text", F.lit("|"), F.col("cut"))
    content = F.when(F.col("kind") == 0, F.encode(F.concat(F.lit("\ufeff"), text), "UTF-8")).when(F.col("kind") == 1, F.encode(text, "iso-8859-1")).otherwise(F.encode(text, "UTF-8"))
    read = results_csv.normalised(results_csv.raw_rows(documents.select("path", F.lit(None).cast("string").alias("member"), content.alias("content"))))
    return read.select(
        F.col("referee").cast("long").alias("match_id"), "path", "home_team", "away_team", F.date_format("match_date", "yyyy-MM-dd").alias("day"), "season", "competition", "hg", "ag", "hht", "aht",
        "home_yellow_cards", "home_cards", "status", F.array_join("invalid", ",").alias("invalid"), F.round(F.col("odds")["B365H"], 6).alias("b365h"),
    )
