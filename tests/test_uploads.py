"""Uploads by their payload, outcomes of records, nested records: cases at the edges."""

import io
import zipfile

from pyspark.sql import functions as F

from pitchlake.functions import names
from pitchlake.operators import consolidate, enrich, imports, reports
from pitchlake.sources import landing


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", ".").replace("_up_", "../"), text)
    return out.getvalue()


def test_uploads(spark):
    csv, mark = b"id,hg\n1,2\n3,\n", "﻿".encode()
    files = {
        "a.CSV": csv, "b.json": mark + b'[{"id": 4, "x": {"y": 1}}, {}]', "c.json": b'{"matches": [{"id": 5}]}', "d.json": b'{"id": 6}', "e.json": b"[1, 2]", "f.json": b"{", "g.json": b"[]", "h.json": b'{"records": 3}',
        "i.zip": archive(a__csv="id\n7\n", b__txt="no"), "j.zip": archive(a__csv="id\n7\n", b__json="[]"), "k.zip": archive(b__txt="no"), "l.zip": b"PK", "m.zip": archive(_up_a__csv="id\n8\n"), "n.txt": csv, "o.csv": b"x" * 301, "p.csv": None, "q.zip": archive(a__csv="id\n" + "0" * 400), "r": csv,
    }
    found = spark.createDataFrame(list(files.items()), "path string, content binary")
    records, refused = imports.uploaded(found, 300)
    got = sorted(((r.path, r.cells.get("id")) for r in records.collect()), key=repr)
    assert got == [("a.CSV", "1"), ("a.CSV", "3"), ("b.json", "4"), ("b.json", None), ("c.json", "5"), ("d.json", "6"), ("i.zip", "7")]
    assert {r.path: r.error for r in refused.collect()} == {
        "e.json": "not_json", "f.json": "not_json", "h.json": "not_json", "j.zip": "not_one_payload", "k.zip": "not_one_payload", "l.zip": "not_an_archive", "m.zip": "unsafe_member", "n.txt": "unsupported", "o.csv": "too_large",
        "q.zip": "too_large", "r": "unsupported",
    }
    assert landing.uploads(found.limit(0)).count() == 0


def test_outcomes(spark):
    rows = spark.createDataFrame([(1, None, True, None), (2, 9, True, 0), (3, 9, True, 2), (4, None, False, None), (5, 9, True, 2), (6, None, True, None)], "record_id long, stored_id long, is_resolved boolean, n_conflicts int")
    seen = spark.createDataFrame([(5, False), (6, True), (6, False)], "record_id long, in_conflict boolean")
    assert {r.record_id: r.outcome for r in consolidate.outcomes(rows, seen).collect()} == {1: "persisted", 2: "matched_duplicate", 3: "conflict", 4: "resolution_conflict", 5: "duplicate", 6: "conflict"}


def test_nested_record_of_unknown_names(spark):
    m = spark.createDataFrame([(1, 2, 2020, 3, None, "scheduled", None, 1, None, None)], "match_id long, competition_id long, season long, home_team_id long, away_team_id long, status string, hg long, ag long, hht long, aht long").withColumn("match_date", F.lit(None).cast("timestamp"))
    named = spark.createDataFrame([(3, "A")], "team_id long, name string")
    r = reports.nested(m, spark.createDataFrame([], "competition_id long, name string"), named).first().record
    assert (r.competition.id, r.competition.name, r.home_team.name, r.away_team.id, r.away_team.name, r.match_date, r.away_score) == (2, None, "A", None, None, None, 1)


def test_names_maps_and_payloads(spark):
    rows = spark.createDataFrame([("a", {"x": "1"}), ("b", None), (None, {})], "n string, m map<string,string>")
    assert [r[0] for r in rows.select(names.renamed(F.col("n"), {"a": "z"})).collect()] == ["z", "b", None]
    assert [r[0] for r in rows.select(names.renamed(F.col("n"), {})).collect()] == ["a", "b", None]
    filled = enrich.with_defaults(F.col("m"), F.create_map(F.lit("x"), F.lit("9"), F.lit("y"), F.lit(" "), F.lit("z"), F.col("n")))
    assert [r[0] for r in rows.select(filled).collect()] == [{"x": "1", "z": "a"}, {"x": "9", "z": "b"}, {"x": "9"}]
    text = spark.createDataFrame([("é" * 3,), ("ab",), (None,)], "p string")
    assert [r[0] and len(r[0]) > 6 for r in text.select(enrich.bounded(F.col("p"), 5)).collect()] == [True, False, None]
