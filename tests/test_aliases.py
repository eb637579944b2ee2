"""Alias closure against union-find over all links."""

import random

import pytest

from pitchlake.operators import aliases

RECORDS, KNOWN, DECISIONS = "record_id long, repository string, keys array<string>", "key string, entity_id long", "repository string, key string, entity_id long"


def plain(records, known, decisions):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for _, _, keys in records:
        keys = [k for k in keys or [] if k]
        for k in keys:
            a, b = sorted((find(keys[0]), find(k)))
            root[b] = a
    chosen = {(r, k): e for r, k, e in decisions}
    out = set()
    for repository, key in {(r, k) for _, r, keys in records for k in keys or [] if k}:
        group = find(key)
        mine = {e for _, k, e in decisions if k in root and find(k) == group and e is not None}
        has = {e for k, e in known if k in root and find(k) == group and e is not None}
        if (repository, key) in chosen:
            entity = chosen[repository, key]
            kind = "decided" if entity is not None else "rejected"
        elif mine:
            kind, entity = ("by_decision", min(mine)) if len(mine) == 1 else ("contradiction", None)
        elif has:
            kind, entity = ("matched", min(has)) if len(has) == 1 else ("ambiguous", None)
        else:
            kind, entity = "new", None
        out.add((repository, key, group, kind, entity))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_equals_union_find(spark, seed):
    rng = random.Random(seed)
    name = lambda: f"n{rng.randrange(60)}"
    records = [(n, rng.choice(["a", "b", None]), [name() for _ in range(rng.choice([1, 1, 2]))] + rng.choice([[], [None], [""]])) for n in range(55)]
    known = [(name(), rng.randrange(4)) for _ in range(12)]
    decisions = [(*x, rng.choice([None, 7, 8])) for x in {(rng.choice(["a", "b"]), name()) for _ in range(10)}]
    got = aliases.resolved(spark.createDataFrame(records, RECORDS), spark.createDataFrame(known, KNOWN), spark.createDataFrame(decisions, DECISIONS))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain(records, known, decisions)


def test_long_chain_and_hub(spark):
    chain = [(k, "a", [f"c{k:03}", f"c{k + 1:03}"]) for k in range(40)]
    random.Random(4).shuffle(chain)
    hub = [(1000 + k, "b", ["hub", f"h{k}"]) for k in range(50)]
    links = spark.createDataFrame(chain + hub, RECORDS).selectExpr("record_id", "explode(keys) AS key")
    got = {r.key: r.component for r in aliases.components(links).collect()}
    assert {got[k] for k in got if k[0] == "c"} == {"c000"} and {got[k] for k in got if k[0] == "h"} == {"h0"} and len(got) == 41 + 51


def test_empty_tables(spark):
    none = [spark.createDataFrame([], s) for s in (RECORDS, KNOWN, DECISIONS)]
    assert aliases.resolved(*none).count() == 0
    one = spark.createDataFrame([(1, None, ["x"]), (2, "a", None), (3, "a", [])], RECORDS)
    assert [tuple(r) for r in aliases.resolved(one, *none[1:]).collect()] == [(None, "x", "x", "new", None)]


def test_no_table_of_names_passes_the_driver(spark):
    records = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "b", ["y", "z"])], RECORDS)
    found = aliases.resolved(records, spark.createDataFrame([("x", 1)], KNOWN), spark.createDataFrame([("b", "z", 2)], DECISIONS))
    assert found.count() == 4 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
