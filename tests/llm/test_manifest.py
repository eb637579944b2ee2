"""The Merkle manifest against a plain tree in Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from pitchlake.llm import merkle_manifest as mm
from tests.llm.fixtures import documents, frame


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    doc_id, text, lang, source, n_chars = row
    n_chars = n_chars if n_chars is None else n_chars + more
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(nodes, at):
    """The root of nodes and the (other, is it left) of each level on the way from place at."""
    way = []
    while len(nodes) > 1:
        other = at ^ 1
        way.append((nodes[other], other < at) if other < len(nodes) else None)
        nodes = [h(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        at //= 2
    return nodes[0], way


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for g in langs}
    subroots = [climb([leaf_of(r) for r in ordered[g]], 0)[0] for g in langs]
    out = []
    for k, g in enumerate(langs):
        leaves = [leaf_of(r) for r in ordered[g]]
        root, over = climb(subroots, k)
        for at, r in enumerate(ordered[g]):
            way = climb(leaves, at)[1] + over
            node = leaf_of(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for step in way:
                node = h(node) if step is None else h(step[0], node) if step[1] else h(node, step[0])
            out.append((r[0], leaves[at], subroots[k], root, h(*[s[0] for s in way if s]), node, node == root))
    return out


def run(spark, rows, tmp_path):
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    return [tuple(r) for r in mm.op11_merkle(spark, str(tmp_path)).collect()]


@pytest.mark.parametrize("slot_bits,container_bits", [(12, 12), (2, 6), (1, 8)])
def test_manifest_equals_a_plain_tree(spark, tmp_path, monkeypatch, slot_bits, container_bits):
    monkeypatch.setattr(mm, "SLOT_BITS", slot_bits)
    rng = random.Random(slot_bits)
    rows = documents()
    rows += [(rng.randrange(-(1 << 62), 1 << 62), f"far {k}", rng.choice(["en", "", "zz", "é"]), None, k) for k in range(40)]
    rows += [(7, f"one of many texts of an id {k}", "en", "a", k) for k in range(40)] + [(9, "copy", "de", "b", 4)] * 37 + [(None, "no id", "fr", "a", 1)] * 3
    if slot_bits == 12:
        assert sorted(run(spark, rows, tmp_path), key=repr) == sorted(brute(rows), key=repr)
    else:  # the workers read the module's own bits, so small slot arrays are tested without Spark
        nodes = [h(str(k)) for k in range(37)]
        root, way = climb(nodes, 21)
        tree = mm.reduced(nodes, mm.levels_of(37))
        assert tree[-1] == [root] and mm.siblings(tree, 21) == [s[0] for s in way if s]
        assert mm.folded(nodes[21], 21, 37, mm.siblings(tree, 21)) == (root, len(mm.siblings(tree, 21)))


def test_blocks_above_one_slot_array(spark, tmp_path):
    rows = [(k * 3, str(k), "en" if k % 10 else None, "a", 1) for k in range(9000)]
    assert sorted(run(spark, rows, tmp_path), key=repr) == sorted(brute(rows), key=repr)


def test_empty_table_and_one_row(spark, tmp_path):
    assert run(spark, [], tmp_path / "none") == []
    one = [(5, None, None, None, None)]
    assert run(spark, one, tmp_path / "one") == brute(one)


@pytest.mark.parametrize("n", [1, 60, 300, 4096])
def test_ranks_of_bitmaps(n):
    rng = np.random.default_rng(n)
    lows = rng.choice(4096, n, replace=False)
    parts = [mm.packed(lows[: n // 2]), mm.packed(lows[n // 2 :])]
    whole = mm.merged(parts)
    assert whole == mm.packed(lows) and len(whole) <= 513
    asked = rng.integers(0, 4096, 200)
    assert mm.ranks(whole, asked).tolist() == [int((lows < a).sum()) for a in asked]
