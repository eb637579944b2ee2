"""Resolution by likeness against every pair."""

import os
import random
from difflib import SequenceMatcher

import pytest

from pitchlake.operators import resolve
from pitchlake.plans import data_queries
from pitchlake.sources import adapter

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def brute(asked, known):
    out = {}
    for key in asked:
        ranked = sorted(((SequenceMatcher(None, key, name, autojunk=False).ratio(), -n) for name, n in known), reverse=True)
        top = [(s, -n) for s, n in ranked if s >= resolve.REVIEW]
        best, second = (round(top[k][0], 6) if len(top) > k else None for k in (0, 1))
        clear = len(top) > 0 and top[0][0] - (top[1][0] if len(top) > 1 else 0.0) >= resolve.MARGIN
        kind = "unmatched" if not top else "exact" if best == 1 else "fuzzy_approved" if top[0][0] >= resolve.AUTO and clear else "manual_review"
        out[key] = (kind, top[0][1] if kind in ("exact", "fuzzy_approved") else None, best, second)
    return out


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_query_agrees_with_all_pairs(spark):
    parts = sorted((r.p_partkey, r.p_name) for r in adapter.table(spark, FOLDER, "part").collect())
    first = {}
    for k, name in parts:
        first.setdefault(name, k)
    asked = {name if k % 3 == 0 else name[:-1] if k % 3 == 1 else name.replace("e", "a") for k, name in parts}
    got = {r.key: (r.resolution, r.entity_id, r.best, r.second) for r in data_queries.fuzzy_resolution(spark, FOLDER).collect()}
    assert got == brute(asked, list(first.items()))


def test_names_of_all_kinds_agree_with_all_pairs(spark):
    rng = random.Random(4)
    names = sorted({"".join(rng.choice("abné😀 ") for _ in range(rng.randrange(1, 14))) for _ in range(60)})
    known = [(name, k) for k, name in enumerate(names[::2])]
    asked = [*names[1::2], names[0], "x"]
    rows = resolve.fuzzy(spark.createDataFrame([(a,) for a in asked], "key string"), spark.createDataFrame(known, "key string, entity_id long")).collect()
    assert {r.key: (r.resolution, r.entity_id, r.best and round(r.best, 6), r.second and round(r.second, 6)) for r in rows} == brute(asked, known)


def name_rows(spark, n, seed=1):
    """Club-like names: two invented words and at times a suffix."""
    rng = random.Random(seed)
    syllables = [a + b for a in "bcdfghjklmnprstvwz" for b in ("a", "en", "io", "ur", "ost", "y")]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 4)))
    names = [f"{word()} {word()}{rng.choice(['', ' fc', ' united'])}" for _ in range(n)]
    return spark.createDataFrame([(k,) for k in names], "key string")


def test_candidates_lose_no_pair_and_are_few(spark):
    names, known = name_rows(spark, 120), name_rows(spark, 150, seed=2)
    pairs = {(r.key, r.other) for r in resolve.candidate_pairs(names, known).collect()}
    left, right = ({r.key for r in df.collect()} for df in (names, known))
    like = {(a, b) for a in left for b in right if SequenceMatcher(None, a, b, autojunk=False).ratio() >= resolve.REVIEW}
    assert like <= pairs and len(pairs) < 0.2 * len(left) * len(right)
    assert resolve.candidate_pairs(names, known).count() == len(pairs)
    strict = {(r.key, r.other) for r in resolve.candidate_pairs(names, known, review=0.94).collect()}
    assert {p for p in like if SequenceMatcher(None, *p, autojunk=False).ratio() >= 0.94} <= strict and len(strict) < 0.02 * len(pairs) + 5
