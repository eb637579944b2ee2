"""Tables that change by commits: parts that stay, repeated requests, attempts that die, imports that are undone, paged streams."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.sources import commits
from pitchlake.sources.commits import Once
from pitchlake.streaming import live

ROWS = T.StructType().add("match_id", "long").add("a", "long").add("b", "string").add("run_id", "string")


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def held(spark, table, at=None):
    return sorted((tuple(r) for r in commits.read(spark, table, at).collect()), key=repr)


def test_upserts_touch_their_parts_only(spark, tmp_path):
    table, rng, model, past = commits.Table(str(tmp_path / "t"), ROWS, parts=5), random.Random(3), {}, []
    assert held(spark, table) == [] and commits.commits(spark, table) == [] and commits.history(spark, table).count() == 0
    for n in range(5):
        told = {k: (k, rng.choice([None, n]), rng.choice([None, f"v{n}"]), None) for k in rng.sample(range(30), 4)}
        before = commits._head(spark, table)[1]
        assert commits.put(spark, table, frame(spark, list(told.values())), ["match_id"], Once("w", n))
        assert not commits.put(spark, table, frame(spark, [(99, 9, "x", None)]), ["match_id"], Once("w", n))
        for k, row in told.items():
            old = model.get(k, (k, None, None, None))
            model[k] = tuple(x if x is not None else y for x, y in zip(row, old, strict=True))
        after = commits._head(spark, table)[1]
        parts = {r[0] for r in frame(spark, list(told.values())).select(table.place()).collect()}
        assert {p for p in after if before.get(p) != after[p]} == parts
        past.append(sorted(model.values(), key=repr))
        assert held(spark, table) == past[-1]
    assert [held(spark, table, n) for n in range(5)] == past
    assert commits.vacuum(spark, table, keep=2) > 0 and commits.vacuum(spark, table, keep=2) == 0
    assert [held(spark, table, n) for n in (3, 4)] == past[3:]
    with pytest.raises(ValueError):
        commits.read(spark, table, 1)


def test_attempt_that_dies_does_not_count(spark, tmp_path):
    table = commits.Table(str(tmp_path / "t"), ROWS, parts=3)
    commits.put(spark, table, frame(spark, [(1, 1, "x", None), (2, 2, "y", None)]), ["match_id"], Once("w", 0))
    before = held(spark, table)
    frame(spark, [(1, 7, "z", None)]).select("*", table.place()).write.partitionBy("_part").parquet(f"{table.folder}/data/commit=1")
    os.makedirs(f"{table.folder}/log/commit=1/_temporary")
    assert held(spark, table) == before
    with pytest.raises(ValueError, match="aren't touched"):
        commits.commit(spark, table, frame(spark, [(1, 1, "x", None)]), lambda rows: frame(spark, [(k, 0, "", None) for k in range(20)]), Once("w", 1), "wrong")
    assert held(spark, table) == before
    assert commits.put(spark, table, frame(spark, [(2, 3, None, None)]), ["match_id"], Once("w", 1))
    assert held(spark, table) == [(1, 1, "x", None), (2, 3, "y", None)]


def test_part_without_rows_goes(spark, tmp_path):
    table = commits.Table(str(tmp_path / "t"), ROWS, parts=2)
    commits.insert(spark, table, frame(spark, [(k, 0, "", None) for k in range(8)]), ["match_id"], Once("w", 0))
    commits.commit(spark, table, commits.read(spark, table), lambda rows: rows.where("match_id < 0"), Once("w", 1), "clear")
    assert held(spark, table) == [] and commits.insert(spark, table, frame(spark, []), ["match_id"], Once("w", 2))
    assert held(spark, table) == []


def test_imports_are_undone_with_what_hangs_on_them(spark, tmp_path, monkeypatch):
    matches, box = commits.Table(str(tmp_path / "m"), ROWS, parts=4), live.boxes(str(tmp_path / "b"), 4)
    commits.insert(spark, matches, frame(spark, [(k, k, "", "r1") for k in range(6)]), ["match_id"], Once("i", 0), "r1")
    commits.insert(spark, matches, frame(spark, [(k, 50, "", "r2") for k in range(4, 9)]), ["match_id"], Once("i", 1), "r2")
    commits.insert(spark, box, spark.createDataFrame([(k, v, 1, 1, "a") for k in range(9) for v in ("home", "away")], live.BOX), ["match_id"], Once("i", 0))
    assert {(r[0], r[3]) for r in held(spark, matches)} == {(k, "r1" if k < 6 else "r2") for k in range(9)}
    predictions = spark.createDataFrame([(7,)], "match_id long")
    with pytest.raises(ValueError, match="predictions"):
        commits.delete_run(spark, matches, [box], "r2", Once("i", 2), predictions)
    real = commits.commit

    def dies(spark, table, *args, **more):
        if table is matches:
            raise OSError("lost")
        return real(spark, table, *args, **more)

    monkeypatch.setattr(commits, "commit", dies)
    with pytest.raises(OSError):
        commits.delete_run(spark, matches, [box], "r1", Once("i", 2), predictions)
    monkeypatch.setattr(commits, "commit", real)
    assert commits.delete_run(spark, matches, [box], "r1", Once("i", 2), predictions) and not commits.delete_run(spark, matches, [box], "r1", Once("i", 2))
    assert {r[0] for r in held(spark, matches)} == {6, 7, 8} and {r[0] for r in held(spark, box)} == {6, 7, 8}
    commits.insert(spark, matches, frame(spark, [(7, 1, "", "r3"), (20, 1, "", "r3")]), ["match_id"], Once("i", 3), "r3")
    again = frame(spark, [(7, 70, "", None), (8, 80, "", None), (20, 5, "", None)]).drop("run_id")
    assert commits.reprocess(spark, matches, [box], "r2", again, Once("i", 4))
    assert {(r[0], r[1], r[3]) for r in held(spark, matches)} == {(7, 70, "r2"), (8, 80, "r2"), (20, 1, "r3")} and held(spark, box) == []
    assert [(r.action, r.run) for r in commits.history(spark, matches).orderBy("number").collect()] == [("insert", "r1"), ("insert", "r2"), ("delete", "r1"), ("insert", "r3"), ("reprocess", "r2")]


def test_paged_import_goes_on_and_takes_statistics_once(spark, tmp_path):
    rng = random.Random(5)
    pages = [[(rng.randrange(25), v, rng.randrange(20), n, rng.choice("ab")) for _ in range(6) for v in ("home", "away")] for n in range(6)]

    def land(folder, some):
        for page in some:
            spark.createDataFrame(page, live.BOX).coalesce(1).write.mode("append").parquet(str(folder))

    def follow(name, landing):
        table = live.boxes(str(tmp_path / name), 3)
        live.statistics(spark, str(landing), table, str(tmp_path / f"{name}-offsets"), pages=1).awaitTermination()
        return table

    land(tmp_path / "one", pages)
    whole = follow("whole", tmp_path / "one")
    for k in range(0, 6, 2):
        land(tmp_path / "two", pages[k : k + 2])
        parts = follow("parts", tmp_path / "two")
    want = held(spark, parts)
    assert len(commits.commits(spark, parts)) == 6 and {r[0] for r in want} == {r[0] for p in pages for r in p}
    assert {(r[0], r[1]) for r in want} == {(r[0], r[1]) for r in held(spark, whole)} and len({(r[0], r[1]) for r in want}) == len(want)
    assert all(len({r[4] for r in want if r[0] == k}) == 1 and len({r[3] for r in want if r[0] == k}) == 1 for k, *_ in want)
    os.remove(tmp_path / "parts-offsets" / "commits" / "5")  # the batch was committed, the stream died before it noted that
    crc = tmp_path / "parts-offsets" / "commits" / ".5.crc"
    if crc.exists():
        os.remove(crc)
    follow("parts", tmp_path / "two")
    assert held(spark, parts) == want and len(commits.commits(spark, parts)) == 6


def test_rows_of_one_source(spark):
    rows = [(1, "home", 3, 1, "b"), (1, "home", 2, 9, "a"), (1, "home", 4, 0, "a"), (1, "away", 1, 1, "b"), (2, None, None, 1, None)]
    got = {tuple(r) for r in live.one_source(spark.createDataFrame(rows, live.BOX)).collect()}
    assert got == {(1, "home", 4, 0, "a"), (2, None, None, 1, None)}
    assert live.one_source(spark.createDataFrame([], live.BOX)).where(F.lit(True)).count() == 0
