"""Sources and sinks on small files written here."""

import io
import json
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from pitchlake.functions import names
from pitchlake.operators import imports, validate
from pitchlake.sources import catalogs, event_tree, landing, results_csv, results_json, schedule_text, sinks


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


CSV = "Date,HomeTeam,AwayTeam,FTHG,FTAG,HS,HY,HR,B365H\n13/08/2021,Málaga,Gijón,2,0,,1,,2.5\n14/08/2021,A,B,x,1,7,,,\n,,,,,,,,\n"


def test_csv_keeps_nulls_and_accents(spark, tmp_path):
    write(tmp_path / "a.csv", "﻿" + CSV)
    write(tmp_path / "b.csv", CSV.replace(",", ";").encode("cp1252"))
    rows = results_csv.normalised(results_csv.raw_rows(landing.members(landing.files(spark, str(tmp_path)))), "Liga", "2021-22").collect()
    assert len(rows) == 4
    for r in rows:
        if r.home_team == "Málaga":
            assert (r.hg, r.ag, r.home_shots, r.home_cards, r.away_cards, r.status, r.invalid) == (2, 0, None, 1, None, "finished", [])
            assert r.match_date.isoformat() == "2021-08-13T00:00:00" and r.odds == {"B365H": 2.5}
        else:
            assert (r.hg, r.ag, r.home_shots, r.status, r.invalid) == (None, 1, 7, "scheduled", ["hg"])
    assert len({r.record_id for r in rows}) == 2
    assert results_csv.column_report(["Date", "HomeTeam", "FTHG", "B365H"])["required_missing"] == ["away_team", "ag"]


def test_archives_stay_inside(spark, tmp_path):
    for name, members in {"good": {"x/r.csv": CSV, "__MACOSX/r.csv": "?"}, "escape": {"../r.csv": CSV}, "bomb": {"r.csv": "a" * 4_000_000}}.items():
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for n, t in members.items():
                z.writestr(n, t)
        write(tmp_path / f"{name}.zip", data.getvalue())
    write(tmp_path / "broken.zip", b"no archive")
    write(tmp_path / ".git" / "c.csv", CSV)
    rows = landing.members(landing.files(spark, str(tmp_path))).collect()
    by = {r.path.rsplit("/", 1)[1]: (r.member, r.error) for r in rows}
    assert by == {"good.zip": ("x/r.csv", None), "escape.zip": (None, "unsafe_member"), "bomb.zip": (None, "too_large"), "broken.zip": (None, "not_an_archive")}


def test_json_shapes(spark, tmp_path):
    one = {"date": "2022-12-18", "time": "18:00 UTC+3", "team1": "Argentina", "team2": {"name": "France"}, "score": {"ft": [2, 2], "ht": [2, 0], "et": [3, 3], "p": [4, 2]}}
    two = {"date": "2023-01-01", "home": "A", "away": "B"}
    shapes = {"map": {"name": "Cup", "rounds": {"Final": [one]}}, "list": {"rounds": [{"name": "R1", "matches": [one, two]}]}, "bare": [one, two], "single": one, "games": {"games": [two]}, "broken": None}
    for name, value in shapes.items():
        write(tmp_path / f"{name}.json", json.dumps(value) if value else "{")
    rows = results_json.matches(landing.files(spark, str(tmp_path))).collect()
    assert len(rows) == 7
    for r in rows:
        if r.home_team == "Argentina":
            assert (r.away_team, r.hg, r.ag, r.hht, r.het, r.hp, r.status, r.kickoff_time_known) == ("France", 2, 2, 2, 3, 4, "finished", True)
            assert r.match_date.isoformat() == "2022-12-18T15:00:00"
        else:
            assert (r.hg, r.status, r.kickoff_time_known) == (None, "scheduled", False)
    assert {r["round"] for r in rows} == {"Final", "R1", None}


@pytest.mark.parametrize(
    ("match", "goals"),
    [
        ({"score": {"regulation": "1-0", "aet": [2, 0], "shootout": {"home": 4, "away": 3}, "agg": "5—4"}}, [1, 0, None, None, 2, 0, 4, 3, 5, 4]),
        ({"score1": 2, "score2": "1", "halftime_home_goals": 1, "halftime_away_goals": 0, "pen_home": 3, "pen_away": 1}, [2, 1, 1, 0, None, None, 3, 1, None, None]),
        ({"score": {"ht": [0, 0]}, "home_goals": 0, "away_goals": 0, "agg_home": 1, "agg_away": 2}, [0, 0, 0, 0, None, None, None, None, 1, 2]),
        ({"score": "2:2", "et_home": -1, "et_away": True}, [2, 2] + [None] * 8),
        ({}, [None] * 10),
    ],
)
def test_score_names(match, goals):
    assert results_json.scores(match) == goals


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("A 2-1 (1-0) B", {"ft": (2, 1), "ht": (1, 0)}),
        ("A 3-4 pen (1-1, 1-1, 0-1) B", {"pen": (3, 4), "et": (1, 1), "ft": (1, 1), "ht": (0, 1)}),
        ("A 3-4 pen. (1-1, 0-1) B", {"pen": (3, 4), "ft": (1, 1), "ht": (0, 1)}),
        ("A 3-4 pen 2-2 aet B", {"pen": (3, 4), "et": (2, 2)}),
        ("A 2-1 aet/gg B", {"et": (2, 1)}),
        ("A 2-1 aet (1-1, 0-0) B", {"et": (2, 1), "ft": (1, 1), "ht": (0, 0)}),
    ],
)
def test_score_lines(line, expected):
    _, _, (match,) = schedule_text.parse("= Cup 2020/21\nSat Aug 22\n  " + line)
    assert match.scores == expected and (match.home, match.away) == ("A", "B") and match.day == date(2020, 8, 22)


def test_schedule_state(spark, tmp_path):
    write(tmp_path / "s.txt", "= League 2021/22\n\n» Matchday 3\n[Sat Dec/18]\n  15:00  A  v  B\n  C - D [postponed]\n[Sun Jan/2]\n  E 1-0 F @ Park, Town att. 1,234\n     (0-0)\n")
    rows = schedule_text.matches(landing.files(spark, str(tmp_path))).orderBy("line").collect()
    assert [(r.home_team, r.day, r.time, r.status) for r in rows] == [("A", date(2021, 12, 18), "15:00", "scheduled"), ("C", date(2021, 12, 18), "15:00", "postponed"), ("E", date(2022, 1, 2), None, "finished")]
    last = rows[-1]
    assert (last.competition, last.matchday, last.hg, last.ag, last.hht, last.venue, last.attendance) == ("League", 3, 1, 0, 0, "Park, Town", 1234)


def test_team_schedule():
    _, _, rows = schedule_text.parse("= Ligue 1 2020/21 | Paris\n▪1\nSat Aug 22\n(h) Lens 1-0 (0-0)\n(a) Nice 2-2\n")
    assert [(m.home, m.away, m.round) for m in rows] == [("Paris", "Lens", "1"), ("Nice", "Paris", "1")]


def test_rendered_lines_come_back():
    lines = [schedule_text.rendered(f"Team {h}", f"Side {a}", (h % 5, a % 4), (0, 0)) for h in range(6) for a in range(6)]
    _, _, rows = schedule_text.parse("= L 2020/21\nSat Aug 22\n" + "\n".join(lines))
    assert [(m.home, m.away, m.scores["ft"], m.scores["ht"]) for m in rows] == [(f"Team {h}", f"Side {a}", (h % 5, a % 4), (0, 0)) for h in range(6) for a in range(6)]


def test_catalogs(spark, tmp_path):
    write(tmp_path / "leagues" / "eng.txt", "= England\nen.1  Premier League | EPL\n  | Premiership\n")
    write(tmp_path / "clubs" / "eng.txt", "= England\nArsenal FC | Arsenal, 1886, @ Emirates Stadium, London\n")
    write(tmp_path / "players" / "fr.txt", "= France\nKylian Mbappé | Mbappé, FW, 1.78 m, b. 20 Dec 1998 @ Paris\nX Y, 178\n")
    write(tmp_path / "clubs" / "eng.props.txt", "= none\n")
    files = landing.files(spark, str(tmp_path)).withColumn("kind", landing.kind("path"))
    by = {r.name: r for r in catalogs.records(files).collect()}
    assert by["Premier League"].aliases == ["EPL", "Premiership"] and by["Premier League"].division == 1 and by["Premier League"].country == "England"
    assert (by["Arsenal FC"].founded_year, by["Arsenal FC"].stadium, by["Arsenal FC"].city) == (1886, "Emirates Stadium", "London")
    p = by["Kylian Mbappé"]
    assert (p.position, p.height_m, p.birth_date, p.birthplace) == ("FW", 1.78, date(1998, 12, 20), "Paris")
    assert by["X Y"].height_m == 1.78 and len(by) == 4


def test_event_tree(spark, tmp_path):
    write(tmp_path / "competitions.json", json.dumps([{"competition_id": 1, "competition_name": "L", "season_id": 2, "season_name": "S"}]))
    match = {"match_id": 7, "match_date": "2020-01-01", "home_team": {"home_team_id": 1, "home_team_name": "A"}, "away_team": {"away_team_id": 2, "name": "B"}, "home_score": 1, "away_score": 0}
    write(tmp_path / "matches" / "1" / "2.json", json.dumps([match, {**match, "match_id": 8, "home_score": None}]))
    write(tmp_path / "lineups" / "7.json", json.dumps([{"team_id": 1, "team_name": "A", "lineup": [{"player_id": 5, "player_name": "P"}]}]))
    write(tmp_path / "events" / "7.json", json.dumps([{"id": "e", "index": 1, "type": {"id": 1, "name": "Shot"}, "team": {"id": 1}}]))
    root = str(tmp_path)
    m, li, ev = event_tree.matches(spark, root), event_tree.lineups(spark, root), event_tree.events(spark, root)
    assert [(r.match_id, r.competition_id, r.away_team, r.status) for r in m.orderBy("match_id").collect()] == [(7, 1, "B", "finished"), (8, 1, "B", "scheduled")]
    assert li.first().player_id == 5 and ev.first().type == "Shot" and ev.first().match_id == 7
    assert event_tree.manifest(m, li, ev).first()[2:] == (2, 1, 1, False)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, None, 2.5)], "id long, s string, x double")
    for suffix in ("csv", "json", "parquet"):
        sinks.write_features(rows, f"{tmp_path}/f.{suffix}")
        assert {tuple(r) for r in sinks.read_features(spark, f"{tmp_path}/f.{suffix}").select("id", "s", "x").collect()} == {(1, "a", None), (2, None, 2.5)}
    new = spark.createDataFrame([(2, "b", None), (3, "c", 1.0)], rows.schema)
    out = sinks.next_version(spark, f"{tmp_path}/f.parquet", new, ["id"], f"{tmp_path}/v2")
    assert {tuple(r) for r in out.collect()} == {(1, "a", None), (2, "b", 2.5), (3, "c", 1.0)}
    sinks.record_run(spark, f"{tmp_path}/ledger", "r1", "csv", "h", rows, rows.limit(0), 1.0)
    ledger = spark.read.parquet(f"{tmp_path}/ledger")
    assert sinks.already_imported(ledger, "h") and not sinks.already_imported(ledger, "other")
    table = spark.createDataFrame([(1, "r1"), (2, "r2")], "match_id long, run_id string")
    assert sinks.without_run(table, "r1").first().match_id == 2
    with pytest.raises(ValueError):
        sinks.without_run(table, "r1", table)
    assert sinks.TEMPLATES == {
        "matches": "competition,season,match_date,home_team,away_team,home_goals,away_goals,home_yellow_cards,away_yellow_cards,home_red_cards,away_red_cards,home_corners,away_corners",
        "players": "player_name,team,position,active,penalty_taker,free_kick_taker",
        "player_matches": "match_id,player_name,team,started,minutes_played,goals,shots,shots_on_target,xg,yellow_cards,red_cards",
        "upcoming_matches": "competition,season,match_date,home_team,away_team,venue,referee",
    }


def test_provider_codes_and_results(spark, tmp_path):
    write(tmp_path / "a.csv", "Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,HTHG,HTAG,HTR\nE0,13/08/2021,Brentford,Arsenal,2,0,H,1,0,H\n")
    raw = results_csv.raw_rows(landing.members(landing.files(spark, str(tmp_path))))
    row = results_csv.normalised(raw).first()
    assert (row.competition, row.competition_code, row.result, row.half_time_result, row.hg, row.hht) == ("E0", "E0", "H", "H", 2, 1)
    assert results_csv.normalised(raw, "Premier League").first().competition == "Premier League"
    assert "result" in results_csv.column_report(["Div", "FTR"])["available"]


def test_names_and_ids(spark):
    assert [names.plain(x) for x in ("Bodø/Glimt", "Łódź", "Đurđevac", "São Paulo", None)] == ["bod glimt", "odz", "ur evac", "sao paulo", ""]
    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x"), ("", "x")], "p string, q string").select(names.identity(F.col("p"), F.col("q")).alias("i"), names.content_hash({"q": F.col("q"), "p": F.col("p")}).alias("h")).collect()
    assert rows[0].i != rows[1].i and rows[2].i == rows[3].i and len({r.h for r in rows}) == 4


def test_import_checks(spark):
    rows = spark.createDataFrame([(1, "Liga", "2020/21", 3, 1), (2, " ", "autumn", None, 120), (3, None, "2020", 4, 5)], "id long, competition string, season string, het int, attendance int")
    assert {(r.id, tuple(r.lacks)) for r in validate.without_identity(rows, "id").collect()} == {(2, ("competition", "season")), (3, ("competition",))}
    with pytest.raises(ValueError, match="2: no competition and season"):
        validate.require_identity(rows, "id")
    assert validate.require_identity(rows.where("id = 1"), "id").count() == 1
    assert [tuple(r) for r in validate.out_of_range(rows, "id", {"attendance": (2, 99), "het": (None, 3)}).orderBy("id", "field").collect()] == [(1, "attendance", 1.0), (2, "attendance", 120.0), (3, "het", 4.0)]
    assert [tuple(r) for r in validate.missing_references(rows, "id", {"het": rows.where("id = 1")}).collect()] == [(3, "het")]
    assert {r.id for r in imports.about(rows, "LÍGA", "2020-2021").collect()} == {1}
    both = imports.together(rows.select("id"), rows.select("id", "season"))
    assert both.count() == 6 and both.where("season is null").count() == 3
