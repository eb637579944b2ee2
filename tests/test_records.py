"""Results, conflicts, counters and models that are entered, decided or saved: cases at the edges."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pitchlake.operators import consolidate, decisions, grading, models, registry

MATCH = "match_id long, hg long, ag long, hht long, aht long, status string, venue string"


def test_a_result_is_registered_once(spark):
    matches = spark.createDataFrame([(1, None, None, None, None, "scheduled", None), (2, 2, 1, 1, 0, "finished", None), (3, None, None, None, None, "finished", None)], MATCH)
    results = spark.createDataFrame([(1, 3, 0, 1, 0, "finished"), (2, 2, 1, None, None, "finished"), (3, 0, 0, None, None, "finished"), (9, 1, 1, None, None, "finished")], "match_id long, hg long, ag long, hht long, aht long, status string")
    out = decisions.registered(matches, results)
    got = {r.match_id: (r.answer, r.hg, r.hht) for r in out.collect()}
    assert got == {1: ("registered", 3, 1), 2: ("repeated", 2, 1), 3: ("refused", None, None), 9: ("unknown", None, None)}
    assert sorted(r.match_id for r in decisions.to_grade(out).collect()) == [1, 2]
    other = results.where("match_id = 2").selectExpr("match_id", "5L as hg", "ag", "hht", "aht", "status")
    assert [(r.answer, r.hg) for r in decisions.registered(matches, other).collect()] == [("refused", 2)]


def test_decisions_are_taken_whole(spark):
    stored = spark.createDataFrame([(k, 1, 0, 1, 0, "finished", "old") for k in range(1, 9)], MATCH)
    pair = lambda k: [(k, "hg", "full_time", "1", "0"), (k, "ag", "full_time", "0", "2")]
    venue = lambda k: [(k, "venue", "venue", "old", "new")]
    conflicts = spark.createDataFrame([*pair(1), *venue(1), *pair(2), *venue(3), *venue(4), *pair(5), *venue(6), *venue(8)], "match_id long, field string, group string, existing string, incoming string")
    told = [(1, "hg", "existing"), (1, "ag", "existing"), (1, "venue", "incoming"), (2, "hg", "incoming"), (2, "ag", "existing"), (3, "venue", "maybe"), (4, "venue", "incoming"), (4, "hht", "existing")]
    told += [(5, "hg", "incoming"), (5, "ag", "incoming"), (6, "venue", None), (7, "venue", "incoming")]
    out = decisions.settled(stored, conflicts, spark.createDataFrame(told, "match_id long, field string, choice string"))
    got = {r.match_id: (r.answer, r.hg, r.ag, r.venue) for r in out.collect()}
    assert got == {
        1: ("resolved", 1, 0, "new"), 2: ("split_pair", 1, 0, "old"), 3: ("invalid_choice", 1, 0, "old"), 4: ("unexpected", 1, 0, "old"),
        5: ("invalid_state", 1, 0, "old"), 6: ("invalid_choice", 1, 0, "old"), 7: ("not_pending", 1, 0, "old"),
    }
    with pytest.raises(ValueError):
        decisions.pending_page(conflicts, -1)


def test_counters_and_names(spark):
    stored = spark.createDataFrame([(1, 1, None, 2), (1, 2, 1, 0)], "match_id long, player_id long, yellow_cards long, red_cards long")
    cards = spark.createDataFrame([(1, 1, True, False), (1, 1, True, True), (1, 3, False, True)], "match_id long, player_id long, yellow boolean, red boolean")
    assert sorted(map(tuple, decisions.with_cards(stored, cards).collect())) == [(1, 1, 2, 3), (1, 2, 1, 0), (1, 3, 0, 1)]
    people = spark.createDataFrame([(7, "Ana"), (4, "ANA "), (5, None)], "player_id long, name string")
    teams = spark.createDataFrame([(1, "Reds")], "team_id long, name string")
    items = spark.createDataFrame([(1, "goal", " reds", "ana"), (2, " ", None, ""), (3, None, "x", None)], "line long, event_type string, team string, player_name string")
    got = {r.line: (r.team_id, r.player_id, r.error) for r in decisions.with_entities(items, teams, people).collect()}
    assert got == {1: (1, 4, None), 2: (None, None, "missing_event_type"), 3: (None, None, "missing_event_type")}


def test_top_three_scorers(spark):
    chances = spark.createDataFrame([(1, "scorer", k, k, 0.1) for k in range(1, 5)] + [(2, "scorer", 1, 9, 0.1), (3, "scorer", 1, 1, 0.1), (4, "card", 1, 1, 0.1)], "match_id long, kind string, rank long, player_id long, probability double")
    names = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, "D"), (5, "B"), (9, None)], "player_id long, name string")
    did = spark.createDataFrame([(1, 4, 1), (1, 5, 2), (3, 1, 0)], "match_id long, player_id long, goals long")
    results = spark.createDataFrame([(k, 1, 1) for k in range(1, 5)], "match_id long, hg long, ag long")
    got = {r.match_id: (r.predicted, r.actual, r.status) for r in grading.scorer_outcomes(chances, did, names, results).collect()}
    assert got == {1: ("A,B,C", "B,D", "correct"), 3: ("A", "", "incorrect")}


def test_registry_saves_once_and_loads_what_is_active(spark, tmp_path):
    root, listed = str(tmp_path / "models"), str(tmp_path / "registry")
    rows = spark.createDataFrame([(float(k), float(k % 5), k % 4, k % 3) for k in range(60)], "a double, b double, hg long, ag long")
    fitted = models.train(rows, ["a", "b"])
    hashed = registry.data_hash(rows)
    assert hashed == registry.data_hash(rows.orderBy("b")) != registry.data_hash(rows.where("a > 0"))
    path = registry.save(fitted, spark, listed, root, "goals", "1", ["a", "b"], {"mae": 1.0}, hashed)
    assert registry.load_active(spark, listed, root, "goals")[2] == "no active version"
    with pytest.raises(Exception, match="(?i)exist"):
        registry.save(fitted, spark, listed, root, "goals", "1", ["a", "b"], {"mae": 0.5}, hashed)
    registry.record(spark, listed, "goals", "1", "active", path, ["a", "b"], {"mae": 1.0}, hashed)
    loaded, features, why = registry.load_active(spark, listed, root, "goals")
    assert why is None and features == ["a", "b"]
    want = {r.a: r.lambda_home for r in models.predict(fitted, rows, features).collect()}
    assert want == {r.a: r.lambda_home for r in models.predict(loaded, rows, features).collect()}
    registry.record(spark, listed, "goals", "2", "active", f"{root}/goals/2", ["a"], {}, hashed)
    assert "can't be loaded" in registry.load_active(spark, listed, root, "goals")[2]
    registry.record(spark, listed, "goals", "2", "active", "/elsewhere", ["a"], {}, hashed)
    assert "outside" in registry.load_active(spark, listed, root, "goals")[2]
    registry.record(spark, listed, "goals", "2", "retired", f"{root}/goals/2", ["a"], {}, hashed)
    registry.record(spark, listed, "goals", "1", "active", path, ["b", "a"], {}, hashed)
    assert "aren't those" in registry.load_active(spark, listed, root, "goals")[2]


def test_scorer_model_beats_the_share(spark):
    days = spark.range(0, 40 * 30).selectExpr("id % 40 as match_id", "timestamp_ntz'2024-01-01 15:00:00' + make_dt_interval(cast(id % 40 as int)) as match_date", "id div 40 as player_id", "90L as minutes", "if(id div 40 < 10, 1L, 0L) as goals", "0L as cards")
    report = models.scorer_report(days).first()
    assert report.n == 8 * 30 and report.brier < report.base_brier / 4


def test_homonyms(spark):
    from pitchlake.operators import enrich

    known = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, "a", None), (4, "b", 5), (5, "b", 5), (6, "c", 7), (7, "d", None), (8, "d", None), (9, None, 5)], "player_id long, name string, birth_date int")
    asked = [(1, "a", 5), (2, "a", 9), (3, "a", None), (4, "b", 5), (5, "b", 6), (6, "c", None), (7, "d", 1), (8, "e", 1), (9, None, 5)]
    got = {r.record_id: (r.resolution, r.player_id) for r in enrich.homonyms(spark.createDataFrame(asked, "record_id long, name string, birth_date int"), known).collect()}
    assert got == {1: ("matched", 1), 2: ("matched", 3), 3: ("ambiguous", None), 4: ("ambiguous", None), 5: ("new", None), 6: ("matched", 6), 7: ("ambiguous", None), 8: ("new", None), 9: ("new", None)}


def test_date_bands_against_all_pairs(spark):
    r = random.Random(6)
    at = lambda: datetime(2024, 1, 1) + timedelta(hours=12 * r.randrange(30))
    key = lambda: (r.choice([1, 2, None]), 2024, r.randrange(2), 7)
    stored, told = [(k, *key(), r.choice([None, *[at()] * 9])) for k in range(80)], [(k, *key(), r.choice([None, *[at()] * 9])) for k in range(80)]
    schema = "{} long, competition_id long, season long, home_team_id long, away_team_id long, match_date timestamp_ntz"
    for days in (1, 3):
        found = consolidate.matched(spark.createDataFrame(told, schema.format("record_id")), spark.createDataFrame(stored, schema.format("match_id")), days)
        want = {}
        for k, *own, day in told:
            gaps = [(abs(other - day), n) for n, *its, other in stored if None not in (*own, day, other) and own == its and abs(other - day) <= timedelta(days=days)]
            want[k] = min(gaps)[1] if gaps else None
        assert {x.record_id: x.stored_id for x in found.collect()} == want and any(want.values())
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_compared_counts_what_merged_finds(spark):
    schema = "match_id long, hg int, ag int, hht int, aht int, venue string, status string"
    stored = spark.createDataFrame([(1, 1, 0, None, None, "a", "finished"), (2, None, None, 0, 0, None, "live")], schema)
    told = spark.createDataFrame([(1, 2, 1, 0, 0, "b", "postponed"), (2, 1, 1, 0, 0, "c", "finished"), (3, 1, 1, 0, 0, "c", "finished")], schema)
    got = {x.match_id: x.n_conflicts for x in consolidate.compared(told.withColumn("stored_id", F.when(F.col("match_id") < 3, F.col("match_id"))), stored).collect()}
    assert got == {x.match_id: len(x.conflicts) for x in consolidate.merged(stored, told).collect()} | {3: None} and got[1] == 4


def test_a_fit_reads_rows_that_are_written_once(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression

    made = []
    monkeypatch.setattr(models, "written", lambda rows, name, f=models.written: made.append(f(rows, name)) or made[-1])
    rows = spark.createDataFrame([(datetime(2024, 1, 1) + timedelta(days=k), float(k % 2), float(k % 5)) for k in range(40)], "match_date timestamp_ntz, scored double, a double")
    held = models._held(rows, LogisticRegression(labelCol="scored"), ["a"])
    assert held.count() == 8 and len(made) == 1 and held.agg(F.min("match_date")).first()[0] == datetime(2024, 2, 2)
    assert "FileScan parquet" in held._jdf.queryExecution().executedPlan().toString() and "Scan ExistingRDD" not in held._jdf.queryExecution().executedPlan().toString()
