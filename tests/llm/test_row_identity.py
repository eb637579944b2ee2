"""Rows without a doc_id, and rows of one doc_id with other texts, are documents of their own."""

from collections import Counter

import pytest

from pitchlake.llm import jaccard_join, line_dedup
from tests.llm.fixtures import frame

LINE = "one two three four five six seven eight nine ten"
OTHER = "a clean line that no other row of this table has at all"


@pytest.mark.parametrize("shared", [None, 5])
def test_repeated_lines_are_cut_from_their_own_row_only(spark, shared):
    texts = [(1, f"first\n{LINE}"), (shared, f"{LINE}\nsecond"), (shared, f"{OTHER}\nthird"), (shared, None), (shared, "")]
    rows = [(d, t, "en", "a", 1) for d, t in texts]
    got = line_dedup.without_repeated_units(frame(spark, rows)).collect()
    kept = (1, f"first\n{LINE}") if shared else (1, "first\n")
    cut = "second" if shared else f"{LINE}\nsecond"  # a null doc_id ranks first
    assert Counter((r.doc_id, r.text) for r in got) == Counter([kept, (shared, cut), (shared, f"{OTHER}\nthird"), (shared, None), (shared, "")])


@pytest.mark.parametrize("shared", [None, 5])
def test_equal_lines_at_equal_places_of_one_id_are_two(spark, shared):
    rows = [(shared, f"{LINE}\n{end}", "en", "a", 1) for end in ("x", "y", "y")]
    left = Counter(r.text for r in line_dedup.without_repeated_units(frame(spark, rows)).collect())
    assert left in (Counter([f"{LINE}\nx", "y", "y"]), Counter(["x", f"{LINE}\ny", f"{LINE}\ny"]))


@pytest.mark.parametrize("shared", [None, 5])
def test_near_copies_go_by_row(spark, shared):
    base = " ".join(f"w{k}" for k in range(60))
    texts = [(1, base), (shared, f"{base} more"), (shared, "a text that is like no other one here"), (shared, None), (shared, f"z{base[2:]}")]
    rows = [(d, t, "en", "a", 1) for d, t in texts]
    kept = jaccard_join.one_of_each(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(1, base), (shared, "a text that is like no other one here"), (shared, None)])


def test_one_of_several_texts_of_one_id_stays(spark):
    base = " ".join(f"w{k}" for k in range(60))
    for shared in (None, 5):
        rows = [(shared, base, "en", "a", 1), (shared, f"{base} more", "en", "a", 1), (9, "quite another text of some more words", "en", "a", 1)]
        kept = [(r.doc_id, r.text) for r in jaccard_join.one_of_each(frame(spark, rows)).collect()]
        assert len(kept) == 2 and (9, rows[2][1]) in kept


def test_texts_of_one_id_keep_their_own_shingles(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(5, "a text that is like no other one here", "en", "a", 1), (5, base, "en", "a", 1), (7, f"{base} more", "en", "a", 1), (8, f"{base} more words", "en", "a", 1)]
    got = Counter(map(tuple, jaccard_join.jaccard_components(frame(spark, rows)).select("doc_id", "component_id").collect()))
    assert got == Counter([(5, 5), (5, 5), (7, 5), (8, 5)])
