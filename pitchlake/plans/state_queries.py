"""Queries about tables that change by commits, streams into them, imports that are undone, and names of several catalogs."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from pitchlake.functions import names, scores
from pitchlake.operators import aliases, consolidate, enrich, imports, reports
from pitchlake.plans import data_queries as data
from pitchlake.plans import match_queries as base
from pitchlake.sources import adapter, commits, shared
from pitchlake.sources.commits import Once
from pitchlake.streaming import live

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, chain: str | None = base.BASE):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = f"WITH {chain}\n{sql}" if chain else sql
        return f

    return add


def _landing_sql(k: int) -> str:
    return f"""b{k} AS (SELECT match_id, seen_at, status, hg, ag FROM snapshots WHERE landing = {k}
  QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY seen_at DESC NULLS LAST, status DESC NULLS LAST, hg DESC NULLS LAST, ag DESC NULLS LAST) = 1)"""


def _step_sql(name: str, state: str, batch: str) -> str:
    return f"""{name} AS (SELECT match_id, CASE WHEN newer THEN coalesce(b_seen, s_seen) ELSE s_seen END AS seen_at, CASE WHEN newer THEN step ELSE s_status END AS status,
  CASE WHEN newer THEN coalesce(b_hg, s_hg) ELSE s_hg END AS hg, CASE WHEN newer THEN coalesce(b_ag, s_ag) ELSE s_ag END AS ag FROM (
  SELECT *, b_seen IS NOT NULL AND (s_seen IS NULL OR b_seen >= s_seen) AND step <> 'conflict' AS newer FROM (
  SELECT coalesce(s.match_id, b.match_id) AS match_id, s.seen_at AS s_seen, b.seen_at AS b_seen, s.status AS s_status, s.hg AS s_hg, b.hg AS b_hg, s.ag AS s_ag, b.ag AS b_ag,
    CASE WHEN b.status IS NULL OR b.status = s.status THEN s.status WHEN s.status IS NULL OR s.status IN ('scheduled', 'live') THEN b.status WHEN b.status = 'scheduled' THEN s.status ELSE 'conflict' END AS step
  FROM {state} s FULL JOIN {batch} b ON s.match_id = b.match_id)))"""


REPLAY = ",\n".join([
    """snapshots AS (SELECT user_id AS match_id, ts AS seen_at, CASE event_type WHEN 'purchase' THEN 'finished' WHEN 'click' THEN 'live' ELSE 'scheduled' END AS status, event_id % 4 AS hg, event_id % 3 AS ag, event_id % 7 % 3 AS landing FROM events)""",
    *[_landing_sql(k) for k in range(3)], _step_sql("s1", "b0", "b1"), _step_sql("s2", "s1", "b2"),
])


@query("SELECT match_id, epoch_us(seen_at) AS seen_us, status, hg, ag FROM s2", REPLAY)
def stream_upsert(spark, d):
    """Snapshots that land in three parts, late ones among them: one state per match, by commits to the parts touched."""
    rows = live.replayed(spark, adapter.table(spark, d, "events"))
    return rows.select("match_id", F.unix_micros("seen_at").alias("seen_us"), "status", "hg", "ag")


@query("""SELECT match_id, venue, CASE WHEN match_id % 3 = 0 THEN shots + 5 ELSE shots END AS shots, corners, CASE WHEN match_id % 3 = 0 THEN 'b' ELSE 'a' END AS data_source FROM stats""")
def box_scores(spark, d):
    """Pages of box scores from two sources that overlap, the last of them told again with other values: each match's
    statistics once, from the source that came first."""
    own = shared.written(adapter.team_statistics(spark, d).select("match_id", "venue", "shots", "corners"), "told")
    first = own.where("match_id % 3 = 0").withColumns({"shots": F.col("shots") + 5, "data_source": F.lit("b")})
    second = own.withColumn("data_source", F.lit("a"))
    again = own.withColumns({"shots": F.col("shots") + 1, "data_source": F.lit("b")})
    top = shared.folder(spark, "boxes")
    table = live.boxes(f"{top}/table")
    for pages in (first, second, again):
        pages.write.mode("append").parquet(f"{top}/landing")
        live.statistics(spark, f"{top}/landing", table, f"{top}/offsets", pages=64).awaitTermination()
    return commits.read(spark, table)


@query("""SELECT match_id, CASE WHEN match_id % 4 = 0 THEN 'r0' ELSE 'r3' END AS run_id, CASE WHEN match_id % 4 = 0 THEN hg + 1 ELSE hg END AS hg, CASE WHEN match_id % 4 = 0 THEN 0 ELSE coalesce(n, 0) END AS n_statistics
FROM matches LEFT JOIN (SELECT match_id, count(*) AS n FROM stats GROUP BY match_id) USING (match_id) WHERE match_id % 4 = 0 OR match_id % 5 = 0""")
def import_lifecycle(spark, d):
    """Three imports, of which one is deleted with its statistics and one read again with fewer rows and other scores; every
    step is asked for twice and done once."""
    k = F.col("match_id")
    rows = shared.written(adapter.matches(spark, d).select("match_id", "hg"), "told")
    boxes = shared.written(adapter.team_statistics(spark, d).select("match_id", "venue", "shots"), "told")
    top = shared.folder(spark, "imports")
    stored = rows.schema.add("run_id", "string")
    matches, children = commits.Table(f"{top}/matches", stored), commits.Table(f"{top}/statistics", boxes.schema)
    told = lambda which, run: rows.where(which).withColumn("run_id", F.lit(run))
    for _ in range(2):
        commits.insert(spark, matches, told(k % 2 == 0, "r0"), ["match_id"], Once("imports", 0), "r0")
        commits.insert(spark, matches, told(F.lit(True), "r1"), ["match_id"], Once("imports", 1), "r1")
        commits.insert(spark, children, boxes, ["match_id"], Once("imports", 1), "r1")
        commits.delete_run(spark, matches, [children], "r1", Once("imports", 2))
        again = rows.where(k % 4 == 0).withColumn("hg", F.col("hg") + 1)
        commits.reprocess(spark, matches, [children], "r0", again, Once("imports", 3))
        commits.insert(spark, matches, told(k % 5 == 0, "r3"), ["match_id"], Once("imports", 4), "r3")
        new = commits.read(spark, matches).where("run_id = 'r3'").select("match_id")
        commits.insert(spark, children, boxes.join(new, "match_id"), ["match_id"], Once("imports", 4), "r3")
    counts = commits.read(spark, children).groupBy("match_id").agg(F.count(F.lit(1)).alias("n"))
    return commits.read(spark, matches).join(counts, "match_id", "left").select("match_id", "run_id", "hg", F.coalesce("n", F.lit(0)).alias("n_statistics"))


CATALOGS = """RECURSIVE uses AS (
  SELECT p_partkey AS record_id, 'r' || p_partkey % 3 AS repository, 'club ' || p_partkey AS key FROM part
  UNION ALL SELECT p_partkey, 'r' || p_partkey % 3, 'club ' || (p_partkey + 1) FROM part WHERE p_partkey % 6 <> 5
  UNION ALL SELECT p_partkey, 'r' || p_partkey % 3, 'club of ' || p_partkey // 12 FROM part WHERE p_partkey % 24 IN (1, 8)),
edges AS (SELECT DISTINCT a.key AS x, b.key AS y FROM uses a JOIN uses b ON a.record_id = b.record_id),
reach AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y),
groups AS (SELECT x AS key, min(y) AS component FROM reach GROUP BY x),
known AS (SELECT 'club ' || p_partkey AS key, p_partkey AS entity_id FROM part WHERE p_partkey % 12 = 0 OR p_partkey % 15 = 3),
decisions AS (SELECT 'r' || p_partkey % 3 AS repository, 'club ' || p_partkey AS key, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey + 1000000 END AS entity_id FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 11 = 3),
dec AS (SELECT component, count(DISTINCT entity_id) AS n, min(entity_id) AS id FROM decisions JOIN groups USING (key) WHERE entity_id IS NOT NULL GROUP BY component),
sto AS (SELECT component, count(DISTINCT entity_id) AS n, min(entity_id) AS id FROM known JOIN groups USING (key) GROUP BY component)"""


@query("""SELECT repository, key, component, resolution, CASE resolution WHEN 'decided' THEN own WHEN 'by_decision' THEN dec_id WHEN 'matched' THEN sto_id END AS entity_id FROM (
SELECT u.repository, u.key, g.component, d.entity_id AS own, dec.id AS dec_id, sto.id AS sto_id, CASE WHEN d.key IS NOT NULL THEN CASE WHEN d.entity_id IS NOT NULL THEN 'decided' ELSE 'rejected' END
  WHEN dec.n = 1 THEN 'by_decision' WHEN dec.n > 1 THEN 'contradiction' WHEN sto.n = 1 THEN 'matched' WHEN sto.n > 1 THEN 'ambiguous' ELSE 'new' END AS resolution
FROM (SELECT DISTINCT repository, key FROM uses) u JOIN groups g ON g.key = u.key LEFT JOIN decisions d ON d.repository = u.repository AND d.key = u.key LEFT JOIN dec ON dec.component = g.component LEFT JOIN sto ON sto.component = g.component)""", CATALOGS)
def alias_closure(spark, d):
    """Clubs of three catalogs whose aliases chain, with decisions that contradict each other in some chains."""
    k = F.col("p_partkey")
    part = adapter.table(spark, d, "part").select("p_partkey")
    repository = F.concat(F.lit("r"), (k % 3).cast("string"))
    club = lambda x: F.concat(F.lit("Club "), x.cast("string"))
    listed = [club(k), F.when(k % 6 != 5, club(k + 1)), F.when((k % 24).isin(1, 8), F.concat(F.lit("Club of "), F.floor(k / 12).cast("string")))]
    one = part.select(k.alias("record_id"), repository.alias("repository"), F.explode(F.array_compact(F.array(*listed))).alias("name"))
    records = one.groupBy("record_id", "repository").agg(F.collect_list(names.plain_name(F.col("name"))).alias("keys"))
    key = F.lower(club(k)).alias("key")
    known = part.where((k % 12 == 0) | (k % 15 == 3)).select(key, k.alias("entity_id"))
    decisions = part.where((k % 7 == 0) | (k % 11 == 3)).select(repository.alias("repository"), key, F.when(k % 5 != 0, k + 1_000_000).alias("entity_id"))
    return aliases.resolved(records, known, decisions)


DIFFERS = "coalesce(i.{a} IS NOT NULL AND i.{b} IS NOT NULL AND ((s.{a} IS NOT NULL AND i.{a} <> s.{a}) OR (s.{b} IS NOT NULL AND i.{b} <> s.{b})), false)"


@query(f"""SELECT record_id, CASE WHEN record_id % 20 = 1 THEN 'conflict' WHEN record_id % 10 = 1 THEN 'duplicate' WHEN home_team_id % 20 = 7 THEN 'resolution_conflict' WHEN differs THEN 'conflict' WHEN stored_id IS NOT NULL THEN 'matched_duplicate' ELSE 'persisted' END AS outcome FROM (
SELECT i.record_id, i.home_team_id, s.match_id AS stored_id, s.match_id IS NOT NULL AND ({DIFFERS.format(a="hg", b="ag")} OR {DIFFERS.format(a="hht", b="aht")} OR coalesce(i.venue <> s.venue, false) OR {data.STATUS_SQL} = 'conflict') AS differs
FROM second i LEFT JOIN (SELECT i.record_id, arg_min(s.match_id, (abs(epoch_us(s.match_date) - epoch_us(i.match_date)), s.match_id)) AS stored_id FROM second i JOIN matches s ON s.competition_id = i.competition_id AND s.season = i.season AND s.home_team_id = i.home_team_id
  AND s.away_team_id = i.away_team_id AND abs(epoch_us(s.match_date) - epoch_us(i.match_date)) <= 86400000000 GROUP BY i.record_id) b ON b.record_id = i.record_id LEFT JOIN stored s ON s.match_id = b.stored_id)""", data.SECOND)
def record_outcomes(spark, d):
    second = data._second_source(spark, d)
    told = consolidate.matched(second, adapter.matches(spark, d))
    rows = consolidate.compared(told, data._stored(spark, d)).withColumn("is_resolved", F.col("home_team_id") % 20 != 7)
    seen = second.where("record_id % 10 = 1").select("record_id", (F.col("record_id") % 20 == 1).alias("in_conflict"))
    return consolidate.outcomes(rows, seen)


@query("""SELECT match_id, '{"id":' || match_id || ',"competition":{"id":' || competition_id || ',"name":' || CASE WHEN competition_id = 3 THEN 'null' ELSE '"' || r_name || '"' END || '},"season":{"id":' || season || ',"name":"' || season || '"},"home_team":{"id":' || home_team_id || ',"name":"Team ' || home_team_id || '"},"away_team":{"id":' || away_team_id
  || ',"name":"Team ' || away_team_id || '"},"match_date":"' || strftime(match_date, '%Y-%m-%d') || '","status":"' || status || '","home_score":' || coalesce(CAST(hg AS VARCHAR), 'null') || ',"away_score":' || coalesce(CAST(ag AS VARCHAR), 'null') || ',"halftime_home_score":' || coalesce(CAST(hht AS VARCHAR), 'null')
  || ',"halftime_away_score":' || coalesce(CAST(aht AS VARCHAR), 'null') || '}' AS record FROM matches JOIN region ON r_regionkey = competition_id""")
def match_records(spark, d):
    m = adapter.matches(spark, d)
    region = adapter.table(spark, d, "region").where("r_regionkey <> 3").select(F.col("r_regionkey").cast("long").alias("competition_id"), F.col("r_name").alias("name"))
    ids = m.select(F.explode(F.array("home_team_id", "away_team_id")).alias("team_id")).distinct()
    rows = reports.nested(m, region, ids.withColumn("name", F.concat(F.lit("Team "), "team_id")))
    return rows.select("match_id", F.to_json("record", {"ignoreNullFields": "false"}).alias("record"))


SPELLINGS = {"NATION_0": "Nation Zero", "NATION_1": "1st nation", "NATION_12": "NATION_1", "nation_2": "no such spelling"}


@query("SELECT c_custkey, CASE n_name " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SPELLINGS.items()) + " ELSE n_name END AS team FROM customer JOIN nation ON n_nationkey = c_nationkey", None)
def mapped_names(spark, d):
    both = adapter.table(spark, d, "customer").join(adapter.table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return both.select("c_custkey", names.renamed(F.col("n_name"), SPELLINGS).alias("team"))


@query("""SELECT doc_id, md5(CASE WHEN strlen(text) > 4096 THEN '{"sha256":"' || sha256(text) || '","bytes":' || strlen(text) || '}' ELSE text END) AS payload_md5,
  CASE WHEN doc_id % 3 = 0 THEN 'lang=xx' || CASE WHEN trim(source) <> '' THEN ',source=' || source ELSE '' END ELSE array_to_string(list_filter([CASE WHEN trim(lang) <> '' THEN 'lang=' || lang END, CASE WHEN trim(source) <> '' THEN 'source=' || source END], lambda x: x IS NOT NULL), ',') END AS metadata FROM documents""", None)
def bounded_payloads(spark, d):
    """Payloads of more than 4,096 bytes as a stub of their hash and size, and metadata that lack entries filled."""
    docs = adapter.table(spark, d, "documents")
    stored = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("lang"), F.lit("xx")))
    filled = enrich.with_defaults(stored, F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")))
    told = F.array_join(F.array_sort(F.transform(F.map_entries(filled), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return docs.select("doc_id", F.md5(enrich.bounded(F.col("text"), 4096)).alias("payload_md5"), told.alias("metadata"))


@query("SELECT match_id, CASE WHEN match_id % 4 <> 0 THEN hg WHEN match_id % 3 <> 0 THEN hg + 1 END AS hg, CASE WHEN match_id % 4 <> 0 THEN ag WHEN match_id % 3 <> 0 THEN ag END AS ag FROM matches")
def canonical_scores(spark, d):
    """Full-time scores, else those after extra time."""
    k, rows = F.col("match_id"), adapter.matches(spark, d)
    ft = lambda c: F.when(k % 4 != 0, F.col(c))
    et = {"hg": F.when(k % 3 != 0, F.col("hg") + 1), "ag": F.when(k % 3 != 0, F.col("ag"))}
    return rows.select("match_id", *[scores.canonical(ft(c), F.when(k % 4 == 0, et[c])).alias(c) for c in et])


def _zipped(frames):
    """Files of kind zip, two (an archive of two payloads) and broken; others as they are."""
    for frame in frames:
        out = []
        for path, kind, text in frame.itertuples(index=False):
            content = text.encode()
            if kind in ("zip", "two"):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as archive:
                    for n in range(1 + (kind == "two")):
                        archive.writestr(f"in/data{n}.csv", text)
                    archive.writestr("in/readme.md", "notes")
                content = held.getvalue()
            out.append((path, content))
        yield pd.DataFrame(out, columns=["path", "content"])


UPLOADS = base.BASE + """,
files AS (SELECT *, competition_id || '-' || season || '-' || month(match_date) || '-' || match_id // 1000 AS name, (season * 12 + month(match_date)) % 7 AS kind FROM matches)"""


@query("""SELECT name || ['.csv', '.JSON', '.json', '.zip', '.zip', '.txt', '.json'][kind + 1] AS path, CASE kind WHEN 4 THEN 'not_one_payload' WHEN 5 THEN 'unsupported' WHEN 6 THEN 'not_json' END AS error, CASE WHEN kind < 4 THEN count(*) ELSE 0 END AS n_rows, CASE WHEN kind < 4 THEN CAST(sum(hg) AS BIGINT) END AS goals FROM files GROUP BY name, kind""", UPLOADS)
def upload_dispatch(spark, d):
    """Matches as uploads by competition, season and month, of a thousand ids at most: CSV, two shapes of JSON, archives of one
    and of two payloads, a suffix that isn't taken and broken JSON, each read by its payload's reader or refused."""
    m = adapter.matches(spark, d)
    name = F.concat_ws("-", "competition_id", "season", F.month("match_date"), F.floor(F.col("match_id") / 1000))
    kind = (F.col("season") * 12 + F.month("match_date")) % 7
    suffixes, kinds = [".csv", ".JSON", ".json", ".zip", ".zip", ".txt", ".json"], ["csv", "list", "records", "zip", "two", "text", "broken"]
    at = lambda values: F.array(*[F.lit(v) for v in values])[F.col("kind")]
    rows = m.select(name.alias("name"), kind.cast("int").alias("kind"), F.concat_ws(",", "match_id", F.coalesce(F.col("hg").cast("string"), F.lit(""))).alias("line"), F.to_json(F.struct("match_id", "hg")).alias("object"))
    files = rows.groupBy("name", "kind").agg(F.array_join(F.collect_list("line"), "\n").alias("lines"), F.array_join(F.collect_list("object"), ",").alias("objects"))
    listed = F.concat(F.lit("["), F.col("objects"), F.lit("]"))
    text = F.when(F.col("kind") == 1, listed).when(F.col("kind") == 2, F.concat(F.lit('{"records":'), listed, F.lit("}"))).when(F.col("kind") == 6, F.concat(F.lit("["), F.col("objects"))).otherwise(F.concat(F.lit("match_id,hg\n"), F.col("lines")))
    found = files.select(F.concat("name", at(suffixes)).alias("path"), at(kinds).alias("kind"), text.alias("text")).mapInPandas(_zipped, "path string, content binary")
    records, refused = imports.uploaded(found)
    goals = records.select("path", F.nullif(F.col("cells")["hg"], F.lit("")).cast("long").alias("hg")).groupBy("path").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("hg").alias("goals"))
    read = goals.select("path", F.lit(None).cast("string").alias("error"), "n_rows", "goals")
    return read.unionByName(refused.select("path", "error", F.lit(0).cast("long").alias("n_rows"), F.lit(None).cast("long").alias("goals")))
