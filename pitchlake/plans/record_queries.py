"""Queries about results, conflicts, events and counters that people enter, scorers and further models; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchlake.operators import consolidate, decisions, grading, players, resolve
from pitchlake.plans import data_queries as data
from pitchlake.plans import match_queries as base
from pitchlake.plans.data_queries import _form, _lineups, _second_source, _stored
from pitchlake.sources import adapter

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, chain: str | None = base.BASE):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH {chain}\n{sql}" if chain else sql
        return f

    return add


REGISTERED = data.SECOND + """,
known AS (SELECT match_id, CASE WHEN match_id % 3 = 0 AND status = 'finished' THEN 'scheduled' ELSE status END AS status, CASE WHEN match_id % 3 <> 0 THEN hg END AS hg, CASE WHEN match_id % 3 <> 0 THEN ag END AS ag FROM matches),
told AS (SELECT CASE WHEN match_id % 19 = 0 THEN -match_id - 1 ELSE match_id END AS match_id, hg, ag FROM second WHERE hg IS NOT NULL),
answers AS (SELECT t.match_id, CASE WHEN k.match_id IS NULL THEN 'unknown' WHEN k.status <> 'finished' THEN 'registered' WHEN k.hg IS NOT DISTINCT FROM t.hg AND k.ag IS NOT DISTINCT FROM t.ag THEN 'repeated' ELSE 'refused' END AS answer, t.hg AS new_hg, k.hg AS old_hg FROM told t LEFT JOIN known k ON k.match_id = t.match_id)"""


def _answers(spark, d):
    k = F.col("match_id")
    open_ = k % 3 == 0
    known = adapter.matches(spark, d)
    known = known.withColumns({"status": F.when(open_ & (F.col("status") == "finished"), "scheduled").otherwise(F.col("status")), **{c: F.when(~open_, F.col(c)).alias(c) for c in decisions.SCORES}})
    told = _second_source(spark, d).where("hg is not null").withColumns({"status": F.lit("finished"), "match_id": F.when(k % 19 == 0, -k - 1).otherwise(k)})
    return decisions.registered(known, told)


@query("SELECT match_id, answer, CASE WHEN answer = 'registered' THEN new_hg ELSE old_hg END AS hg FROM answers", REGISTERED)
def register_results(spark, d):
    return _answers(spark, d).select("match_id", "answer", "hg")


@query("SELECT answer, count(*) AS n FROM answers WHERE answer IN ('registered', 'repeated') GROUP BY answer", REGISTERED)
def results_to_grade(spark, d):
    return decisions.to_grade(_answers(spark, d)).groupBy("answer").agg(F.count(F.lit(1)).alias("n"))


PENDING = data.SECOND + f""",
pending AS (
  SELECT s.match_id, 'hg' AS field, CAST(s.hg AS VARCHAR) AS existing, CAST(i.hg AS VARCHAR) AS incoming FROM stored s JOIN second i ON i.match_id = s.match_id WHERE i.ag IS NOT NULL AND s.hg <> i.hg
  UNION ALL SELECT s.match_id, 'venue', s.venue, i.venue FROM stored s JOIN second i ON i.match_id = s.match_id WHERE s.venue <> i.venue
  UNION ALL SELECT s.match_id, 'status', s.status, i.status FROM stored s JOIN second i ON i.match_id = s.match_id WHERE {data.STATUS_SQL} = 'conflict')"""


def _pending(spark, d):
    return decisions.pending(consolidate.merged(_stored(spark, d), _second_source(spark, d).drop("match_date")))


@query("SELECT * FROM pending", PENDING)
def pending_conflicts(spark, d):
    return _pending(spark, d).select("match_id", "field", "existing", "incoming")


@query("SELECT * FROM pending ORDER BY match_id, field LIMIT 100 OFFSET 100", PENDING)
def pending_conflicts_page(spark, d):
    return decisions.pending_page(_pending(spark, d), 100, 100).select("match_id", "field", "existing", "incoming")


CHOICE = "CASE WHEN field = 'hg' AND match_id % 2 = 0 THEN 'incoming' WHEN field = 'venue' AND match_id % 3 = 0 THEN 'incoming' WHEN field = 'status' AND match_id % 4 = 0 THEN 'incoming' WHEN match_id % 29 = 0 THEN 'both' ELSE 'existing' END"


@query(f"""SELECT match_id, answer, CASE WHEN answer = 'resolved' AND new_hg IS NOT NULL THEN CAST(new_hg AS BIGINT) ELSE hg END AS hg, CASE WHEN answer = 'resolved' AND new_venue IS NOT NULL THEN new_venue ELSE venue END AS venue,
  CASE WHEN answer = 'resolved' AND new_status IS NOT NULL THEN new_status ELSE status END AS status FROM stored JOIN (
  SELECT match_id, CASE WHEN NOT bool_or(is_open) THEN 'not_pending' WHEN bool_or(choice = 'both') THEN 'invalid_choice' WHEN bool_or(is_open AND choice IS NULL) THEN 'missing' WHEN bool_or(NOT is_open) THEN 'unexpected' ELSE 'resolved' END AS answer,
    max(incoming) FILTER (WHERE field = 'hg' AND choice = 'incoming') AS new_hg, max(incoming) FILTER (WHERE field = 'venue' AND choice = 'incoming') AS new_venue, max(incoming) FILTER (WHERE field = 'status' AND choice = 'incoming') AS new_status
  FROM (SELECT match_id, field, p.existing IS NOT NULL OR p.incoming IS NOT NULL AS is_open, incoming, choice FROM pending p FULL JOIN (
    SELECT match_id, field, {CHOICE} AS choice FROM pending WHERE NOT (field = 'venue' AND match_id % 5 = 0) UNION ALL SELECT match_id, 'aht', 'existing' FROM stored WHERE match_id % 23 = 0) c USING (match_id, field))
  GROUP BY match_id HAVING count(choice) > 0) USING (match_id)""", PENDING)
def field_decisions(spark, d):
    conflicts = _pending(spark, d)
    chosen = conflicts.where("not (field = 'venue' and match_id % 5 = 0)").select("match_id", "field", F.expr(CHOICE).alias("choice"))
    more = _stored(spark, d).where("match_id % 23 = 0").select("match_id", F.lit("aht").alias("field"), F.lit("existing").alias("choice"))
    return decisions.settled(_stored(spark, d), conflicts, chosen.unionByName(more)).select("match_id", "answer", "hg", "venue", "status")


@query("""SELECT key, n_candidates, CASE WHEN length(key) % 3 = 0 THEN 'resolved' WHEN length(key) % 3 = 1 THEN 'rejected' ELSE 'pending' END AS status
FROM (SELECT p_brand || p_type AS key, count(DISTINCT p_size) AS n_candidates FROM part GROUP BY 1)""", None)
def entity_decisions(spark, d):
    sizes = adapter.table(spark, d, "part").select(F.concat("p_brand", "p_type").alias("key"), F.col("p_size").alias("entity_id")).distinct()
    queue = sizes.groupBy("key").agg(F.collect_list(F.struct("entity_id")).alias("candidates"), F.min("entity_id").alias("least"))
    chosen = queue.withColumn("candidate_id", F.expr("case length(key) % 3 when 0 then least when 1 then -1 end")).where("candidate_id is not null").select("key", "candidate_id")
    rows = resolve.with_decisions(queue.drop("least"), chosen)
    return rows.select("key", F.size("candidates").cast("long").alias("n_candidates"), "status")


@query("""SELECT event_id, s_suppkey AS team_id, c_custkey AS player_id, CASE WHEN event_id % 9 = 0 THEN 'missing_event_type' END AS error FROM events
LEFT JOIN supplier ON event_id % 4 <> 0 AND s_suppkey = user_id % 150 LEFT JOIN customer ON event_id % 5 <> 0 AND c_custkey = user_id""", None)
def event_append(spark, d):
    number = lambda c: F.lpad(c.cast("string"), 9, "0")
    items = adapter.table(spark, d, "events").select(
        "event_id", F.when(F.col("event_id") % 9 == 0, " ").otherwise(F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("  SUPPLIER#"), number(F.col("user_id") % 150))).alias("team"),
        F.when(F.col("event_id") % 5 == 0, " ").otherwise(F.concat(F.lit("customer#"), number(F.col("user_id")), F.lit(" "))).alias("player_name"),
    )
    teams = adapter.table(spark, d, "supplier").select(F.col("s_suppkey").alias("team_id"), F.col("s_name").alias("name"))
    people = adapter.table(spark, d, "customer").select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("name"))
    return decisions.with_entities(items, teams, people).select("event_id", "team_id", "player_id", "error")


@query("""SELECT match_id, player_id, CASE WHEN old IS NULL OR y > 0 THEN coalesce(cards, 0) + coalesce(y, 0) ELSE cards END AS yellow_cards, CASE WHEN r > 0 THEN coalesce(r, 0) WHEN old IS NULL THEN 0 END AS red_cards FROM
  (SELECT match_id, player_id, CASE WHEN player_id % 2 = 0 THEN cards END AS cards, true AS old FROM player_matches) s FULL JOIN
  (SELECT CASE WHEN l_orderkey % 3 = 0 THEN -l_orderkey - 1 ELSE l_orderkey END AS match_id, l_partkey AS player_id, count(*) FILTER (WHERE l_tax >= 0.05) AS y, count(*) FILTER (WHERE l_discount >= 0.09) AS r FROM lineitem WHERE l_tax >= 0.05 OR l_discount >= 0.09 GROUP BY ALL) m USING (match_id, player_id)""")
def card_counters(spark, d):
    held = adapter.player_matches(spark, d).select("match_id", "player_id", F.when(F.col("player_id") % 2 == 0, F.col("cards")).alias("yellow_cards"), F.lit(None).cast("long").alias("red_cards"))
    shown = adapter.table(spark, d, "lineitem").select(F.expr("if(l_orderkey % 3 = 0, -l_orderkey - 1, l_orderkey)").alias("match_id"), F.col("l_partkey").alias("player_id"), (F.col("l_tax") >= 0.05).alias("yellow"), (F.col("l_discount") >= 0.09).alias("red"))
    return decisions.with_cards(held, shown.where("yellow or red"))


SCORERS = data.FORMS + """,
names AS (SELECT p_partkey AS player_id, p_brand || ' ' || p_name AS name FROM part),
chances AS (SELECT match_id, player_id, row_number() OVER (PARTITION BY match_id ORDER BY probability DESC, player_id) AS rank FROM (
  SELECT l.match_id, l.player_id, round((1 - exp(-(goals / minutes * 75))) * CASE WHEN confirmed THEN 1.0 ELSE start_probability END, 9) AS probability FROM lineups l JOIN form f ON f.player_id = l.player_id WHERE minutes > 0)),
scorers AS (SELECT match_id, predicted, coalesce(actual, '') AS actual, CASE WHEN list_has_any(said, coalesce(did, [])) THEN 'correct' ELSE 'incorrect' END AS status
  FROM (SELECT match_id, list(name ORDER BY rank) AS said, string_agg(name, ',' ORDER BY rank) AS predicted FROM chances JOIN names USING (player_id) WHERE rank <= 3 GROUP BY match_id)
  JOIN (SELECT match_id FROM matches WHERE hg IS NOT NULL) USING (match_id)
  LEFT JOIN (SELECT match_id, list(DISTINCT name) AS did, string_agg(DISTINCT name, ',' ORDER BY name) AS actual FROM player_matches JOIN names USING (player_id) WHERE goals > 0 GROUP BY match_id) USING (match_id))"""


def _scorers(spark, d):
    names = adapter.table(spark, d, "part").select(F.col("p_partkey").alias("player_id"), F.concat_ws(" ", "p_brand", "p_name").alias("name"))
    return grading.scorer_outcomes(players.chances(_lineups(spark, d), _form(spark, d)), adapter.player_matches(spark, d), names, adapter.matches(spark, d))


@query("SELECT match_id, 'top_3_scorer_any' AS event_type, predicted, actual, status FROM scorers", SCORERS)
def scorer_grading(spark, d):
    return _scorers(spark, d).drop("probability")


@query("SELECT 'scorer' AS scope, count(*) FILTER (WHERE status = 'correct') AS correct, count(*) FILTER (WHERE status <> 'correct') AS incorrect, count(*) AS total, round(100.0 * count(*) FILTER (WHERE status = 'correct') / count(*), 1) AS accuracy FROM scorers", SCORERS)
def scorer_stats(spark, d):
    return grading.model_stats(_scorers(spark, d)).drop("brier")


@query("SELECT m.match_id, strftime(match_date, '%Y-%m-%d') AS day, home_team_id, away_team_id, hg || '-' || ag AS score, o.status AS status FROM matches m JOIN outcomes o ON o.match_id = m.match_id AND event_type = 'match_result' ORDER BY match_date DESC, m.match_id DESC LIMIT 10", base.GRADES)
def recent_grades(spark, d):
    matches = adapter.matches(spark, d)
    rows = grading.recent(grading.outcomes(base._predictions(spark, d), matches, adapter.team_statistics(spark, d)), matches)
    return rows.select("match_id", F.date_format("match_date", "yyyy-MM-dd").alias("day"), "home_team_id", "away_team_id", "score", "status")


@query()
def cards_model(spark, d):
    from pitchlake.operators import models

    features = base._wide(spark, d, ("cards_avg_5", "cards_avg_10"))
    return models.cards_report(features, grading.actual_totals(adapter.team_statistics(spark, d)))


def _appearances(spark, d):
    done = adapter.matches(spark, d).where("status = 'finished'").select("match_id", "match_date")
    return adapter.player_matches(spark, d).join(done, "match_id")


@query()
def scorer_model(spark, d):
    from pitchlake.operators import models

    return models.scorer_report(_appearances(spark, d))


@query("""SELECT p.match_id, player_id, CAST(goals > 0 AS DOUBLE) AS scored, CAST(count(*) OVER w AS DOUBLE) AS games, round(avg(goals) OVER w, 6) AS goals_avg, round(avg(minutes) OVER w, 6) AS minutes_avg, round(avg(cards) OVER w, 6) AS cards_avg
FROM player_matches p JOIN matches m ON m.match_id = p.match_id WHERE status = 'finished' WINDOW w AS (PARTITION BY player_id ORDER BY match_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)""")
def scorer_features(spark, d):
    from pitchlake.operators import models

    rows = models.scorer_rows(_appearances(spark, d))
    return rows.select("match_id", "player_id", "scored", "games", *[F.round(c, 6).alias(c) for c in ("goals_avg", "minutes_avg", "cards_avg")])
