"""The language model's passes over texts: no Python call per word, and words cut, numbered and counted as plain Python does."""

import random
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash

from pitchlake.llm import mixing_lm

ODD = [
    "",
    " \t\n\x0b\x0c\r ",
    "One two  ONE\ttwo\x0bÄrger ärger STRASSE straße",
    "a b   c\x1cd \x85 nul\x00 nul nul\x00\x00",
    "exactly8 exactly8s " + "x" * 63 + " " + "x" * 64 + " " + "x" * 65 + " " + "y" * 5000,
    None,
    "one",
]


def split(text):
    return [*(text or "").encode().lower().split(), b""]


def batch_of(texts, train, block):
    return pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string()), "_train": pa.array(train), "_block": pa.array(block, pa.int64())})


def calls(run):
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        out = run()
    finally:
        sys.setprofile(None)
    return n, out


def many(seed, texts=400, words=150):
    rng = random.Random(seed)
    return [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(words)) for _ in range(texts)]


def test_no_call_per_word():
    texts = many(3)
    batch = batch_of(texts, [k % 7 != 2 for k in range(len(texts))], [k // 200 for k in range(len(texts))])
    n, rows = calls(lambda: pa.Table.from_batches(list(mixing_lm._gathered(1)(iter([batch])))))
    more, _ = calls(lambda: mixing_lm._vocabulary(rows))
    assert n + more < 0.3 * sum(map(len, map(split, texts)))


def test_words_are_cut_and_numbered_as_written():
    texts = [*ODD, *many(4, 20), *ODD]
    words, lens = mixing_lm.cut([mixing_lm._encoded(t) for t in texts])
    want = [split(t) for t in texts]
    assert lens.tolist() == list(map(len, want)) and words.list() == [w for ws in want for w in ws]
    number = dict(zip(words.list(), words.numbers().tolist(), strict=True))
    assert len(set(number.values())) == len(number)
    again = mixing_lm.listed(list(number))  # in another place, the same number
    assert again.list() == list(number) and again.numbers().tolist() == list(number.values())
    assert mixing_lm.cut([])[0].list() == [] and len(mixing_lm.cut([])[0].numbers()) == 0


def test_units_are_counted_by_kind():
    texts = [*ODD, *many(5, 60), "b a a b", "b a", *ODD]
    train, block = [k % 3 > 0 for k in range(len(texts))], [k // 30 for k in range(len(texts))]
    total, held, by_word = Counter(), set(), Counter()
    for t, k in zip(texts, train, strict=True):
        n = Counter(split(t))
        kind = xxhash.xxh3_64_intdigest(min(w for w in n if n[w] == max(n.values())), 3) % mixing_lm.KINDS
        for w, c in n.items():
            total[w, kind] += c * k
            by_word[w] += c * k
            held |= {(w, kind)} if not k else set()
    rows = pa.Table.from_batches(list(mixing_lm._gathered(3)(iter([batch_of(texts, train, block)]))))
    got, n, v = {}, 0, 0
    for part in range(3):
        own = rows.filter(pa.array([p == part for p in rows.column("part").to_pylist()]))
        merged = mixing_lm._merged(own)
        words = merged.words.list()
        for w, kind, c, asked in zip(merged.word.tolist(), merged.kinds.tolist(), merged.total.tolist(), merged.asked.tolist(), strict=True):
            assert (words[w], kind) not in got
            got[words[w], kind] = (c, asked)
        told = mixing_lm._vocabulary(own)
        n, v = n + told.column("n")[0].as_py(), v + told.column("v")[0].as_py()
    assert got == {u: (c, u in held) for u, c in total.items()}
    assert n == sum(by_word.values()) and v == sum(c > 0 for c in by_word.values())


def test_passages_know_the_words_before():
    texts = [*ODD, "a", "a b", "a b c", "a b a b a b c a b a", "c a b a b", *many(6, 20), *ODD]
    often = [b"a", b"b"]
    words, lens = mixing_lm.cut([mixing_lm._encoded(t) for t in texts])
    keys = mixing_lm.passages_of(words.numbers(), lens, np.sort(mixing_lm.listed(often).numbers())).tolist()
    want = []
    for t in texts:
        ws = split(t)
        for k, w in enumerate(ws):
            back = [ws[k - j] if k >= j else None for j in (1, 2, 3, 4)]
            reach = 2
            while reach < 4 and all(b in often for b in back[:reach]):
                reach += 1
            want.append((*back[:reach], w))
    by_key, by_want = defaultdict(set), defaultdict(set)
    for a, b in zip(keys, want, strict=True):
        by_key[a].add(b)
        by_want[b].add(a)
    assert all(len(x) == 1 for x in (*by_key.values(), *by_want.values()))


def test_shared_beginnings_are_counted_as_word_by_word():
    words = sorted({w for t in [*many(7, 10), ODD[2], ODD[4]] for w in split(t)})
    rng = np.random.default_rng(8)
    kinds, once, counts = rng.integers(0, 3, len(words)), rng.integers(0, 2, len(words)), rng.integers(1, 9, len(words))
    length, code = mixing_lm.byte_code(np.bincount(mixing_lm.symbols(words)[0], minlength=256))
    together, apart = np.zeros((2, 2 * int(mixing_lm.BASES[-1])), np.float32)
    mixing_lm.add_words(together, words, kinds, once, counts, length, code)
    for k in range(len(words)):
        mixing_lm.add_words(apart, words[k : k + 1], kinds[k : k + 1], once[k : k + 1], counts[k : k + 1], length, code)
    assert np.array_equal(together, apart) and together.any()
