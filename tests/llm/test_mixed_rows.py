"""The mix itself, row by row, where rows repeat."""

from collections import Counter

import pytest

from pitchlake.llm import mixing
from tests.llm.fixtures import documents, frame


def taken(rows):
    return Counter({k: n for k, n in rows.items() if n})


@pytest.mark.parametrize("rows", [[(1, "a b c", "en", "s", 1)] * 10, [(k // 4, f"w {k // 4} x y", "en", "s" if k % 3 else None, k) for k in range(50)], documents()])
def test_mixed_rows_are_those_of_mix(spark, rows):
    docs = frame(spark, rows).repartition(3)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r._text, r.source_key] += r.copies
    got = Counter((r.doc_id, r.h, r.k) for r in mixing.mixed_rows(docs).selectExpr("doc_id", "xxhash64(text) h", "concat(if(source is null, '1', '0'), coalesce(source, '')) k").collect())
    assert got == taken(want)
    if len(rows) == 10:
        assert sum(got.values()) == 15
    most = Counter(repr(tuple(r)) for r in mixing.mixed_rows(docs).collect())
    times = Counter(repr(tuple(r)) for r in docs.collect())
    assert all(n <= 2 * times[k] for k, n in most.items())
