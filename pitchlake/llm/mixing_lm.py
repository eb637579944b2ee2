"""Language model scores by logistic context mixing over the bits of words, within and across their borders."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.llm.common import byte_batches, stash, table

#: Rows of the input that share a dictionary of words; characters of input for each part of the vocabulary.
BLOCK_ROWS, PART_CHARS = 4096, 8 << 20
#: Characters of input for each part of the passages, the words with those before them.
PASSAGE_CHARS = 16 << 20
#: A word is frequent that has a share of 1 in so many of all training tokens: there are no more of them.
FREQUENT = 2000
#: Slots, as powers of two, of the predictors by the last two bytes, three and four, the word so far, and that with the
#: kind of text.
SLOTS = (18, 20, 20, 21, 21)
#: Predictors that count tokens; those before them count a word once.
TOKENS = 2
#: Kinds of text, by a hash of the most frequent word.
KINDS = 64
BASES = np.cumsum([0, *(1 << b for b in SLOTS)])
GATES, BUCKETS, MINIBATCH, RATE = 24, 33, 1024, 0.1
#: Bytes that stand for the end of a word and the end of a text; no word has them.
WORD_END, TEXT_END = 0x20, 0x0A

_P = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64))


def byte_code(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and codes of a Huffman code of all 256 bytes: which questions spell a byte."""
    heap = [(float(w) + 1e-3, k, (k,)) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    length, code = np.zeros(256, np.int64), np.zeros(256, np.int64)
    serial = 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for bit, side in ((0, a[2]), (1, b[2])):
            for s in side:
                code[s] |= bit << length[s]
                length[s] += 1
        heapq.heappush(heap, (a[0] + b[0], serial, a[2] + b[2]))
        serial += 1
    return length, code  # the first question's answer is the highest of `length` bits


class Words(NamedTuple):
    """Words as places in one array of bytes, behind which eight more lie."""

    data: np.ndarray
    starts: np.ndarray
    lens: np.ndarray

    def take(self, which: np.ndarray) -> Words:
        return Words(self.data, self.starts[which], self.lens[which])

    def numbers(self) -> np.ndarray:
        """A hash of 64 bits of each word, eight bytes at once; xxh3 of the few that are long."""
        eights = np.ndarray(len(self.data) - 7, "<u8", self.data, 0, (1,))
        h = _mixed(self.lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ eights[self.starts] & _FIRST[np.minimum(self.lens, 8)])
        more, at = np.flatnonzero(self.lens > 8), 8
        while len(more) and at < LONG_WORD:
            h[more] = _mixed(h[more] ^ eights[self.starts[more] + at] & _FIRST[np.minimum(self.lens[more] - at, 8)])
            at += 8
            more = more[self.lens[more] > at]
        for k in more:
            h[k] = xxhash.xxh3_64_intdigest(self.data[self.starts[k] : self.starts[k] + self.lens[k]].tobytes())
        return h

    def ended(self) -> np.ndarray:
        """The bytes of all words, each followed by a line end."""
        sizes = self.lens + 1
        ends = np.cumsum(sizes)
        out = self.data[np.repeat(self.starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        out[ends - 1] = TEXT_END
        return out

    def list(self) -> list[bytes]:
        data = self.data.tobytes()
        return [data[a:b] for a, b in zip(self.starts.tolist(), (self.starts + self.lens).tolist(), strict=True)]

    def by_bytes(self) -> np.ndarray:
        """The order by the first eight bytes, in which words that begin alike lie together."""
        eights = np.ndarray(len(self.data) - 7, "<u8", self.data, 0, (1,))
        return np.argsort((eights[self.starts] & _FIRST[np.minimum(self.lens, 8)]).byteswap())


#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def read_words(ended: bytes) -> Words:
    """Of bytes in which each word is followed by a line end."""
    data = np.frombuffer(ended + bytes(8), np.uint8)
    ends = np.flatnonzero(data[:-8] == TEXT_END)
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
    return Words(data, starts, ends - starts)


def listed(words: Words | list[bytes]) -> Words:
    return words if isinstance(words, Words) else read_words(b"".join([w + b"\n" for w in words]))


def cut(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    """The words of texts in lower case (A-Z), each text's followed by the empty word that is its end, and their number in
    each text."""
    data = np.frombuffer((b"\n" + b"\n".join(texts) + b"\n").lower() + bytes(8), np.uint8)
    blank = _BLANK[data[:-8]]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    begin, end = edges[::2], edges[1::2]
    bounds = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    n = np.diff(np.searchsorted(begin, bounds), prepend=0)
    at = np.arange(len(begin)) + np.repeat(np.arange(len(texts)), n)
    starts, lens = np.zeros((2, len(begin) + len(texts)), np.int64)
    starts[at], lens[at] = begin, end - begin
    return Words(data, starts, lens), n + 1


def symbols(words: Words | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words with their ends, and the length of each; the empty word is the end of a text."""
    words = listed(words)
    sym, sizes = words.ended(), words.lens + 1
    sym[np.cumsum(sizes)[words.lens > 0] - 1] = WORD_END
    return sym.astype(np.int64), sizes


class Symbols(NamedTuple):
    """The bytes of words: the word of each, its place there, and what the predictors know before it."""

    owner: np.ndarray
    sym: np.ndarray
    place: np.ndarray
    contexts: list[np.ndarray]

    def take(self, which: np.ndarray) -> Symbols:
        return Symbols(self.owner[which], self.sym[which], self.place[which], [c[which] for c in self.contexts])


def spelled_out(words: Words | list[bytes], kinds: np.ndarray) -> Symbols:
    sym, lens = symbols(words)
    owner = np.repeat(np.arange(len(lens)), lens)
    first = np.cumsum(lens) - lens
    place = np.arange(len(sym)) - np.repeat(first, lens)
    u = sym.astype(np.uint64)
    back = [np.where(place >= k, np.concatenate([np.zeros(k, np.uint64), u[:-k]])[: len(u)], np.uint64(0)) for k in (1, 2, 3, 4)]
    runs = np.cumsum((u + np.uint64(1)) * _P[place % len(_P)])
    before = np.concatenate([[np.uint64(0)], runs[:-1]])[: len(u)]
    prefix = before - np.repeat(before[first], lens)
    contexts = [back[0] | back[1] << np.uint64(8)]
    for k in (2, 3):
        contexts.append(contexts[-1] | back[k] << np.uint64(8 * k))
    contexts = [c * np.uint64(0xD6E8FEB86659FD93) for c in contexts] + [prefix + place.astype(np.uint64)]
    contexts.append(contexts[-1] + ((kinds.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))[owner])
    return Symbols(owner, sym, place, contexts)


class Questions:
    """What is asked of each byte, one byte's questions after the other's."""

    def __init__(self, length: np.ndarray, code: np.ndarray):
        self.sizes = length
        self.first = np.cumsum(length) - length
        s = np.repeat(np.arange(256), length)
        asked = np.arange(len(s)) - self.first[s]  # questions before this one
        rest = length[s] - asked
        self.bit = (code[s] >> (rest - 1)) & 1
        self.node = ((np.int64(1) << asked) | (code[s] >> rest)).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)


class Decisions(NamedTuple):
    """Of each question its symbol's number, its answer and what tells its slot apart; `sizes` questions a symbol."""

    sizes: np.ndarray
    bit: np.ndarray
    node: np.ndarray

    def slots(self, j: int, context: np.ndarray) -> np.ndarray:
        """Of predictor j, from its contexts by symbol."""
        h = np.repeat(context, self.sizes)
        h ^= self.node
        h *= np.uint64(0x9E3779B97F4A7C15)
        h >>= np.uint64(64 - SLOTS[j])
        return h.view(np.int64) + BASES[j]


def decisions(sym: np.ndarray, questions: Questions) -> Decisions:
    sizes = questions.sizes[sym]
    ends = np.cumsum(sizes)
    at = np.repeat(questions.first[sym] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
    return Decisions(sizes, questions.bit[at], questions.node[at])


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x.clip(-20, 20)))


def _bucket(x: np.ndarray) -> np.ndarray:
    return np.rint((x.clip(-8, 8) + 8) * 2).astype(np.int64)


LEVELS = np.arange(BUCKETS) / 2 - 8.0


class Mixer:
    """Weights of predictors by gate, and by gate and bucket of the mix how often it met a 0 and a 1 there."""

    def __init__(self, gates: int, inputs: int, start: float = 0.3):
        self.weights = np.full((inputs, gates), start)
        self.refined = np.zeros((gates * BUCKETS, 2))

    def mixed(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        z = x[0] * self.weights[0].take(gate)
        for k in range(1, len(x)):
            z += x[k] * self.weights[k].take(gate)
        return z

    def learn(self, x: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, share: np.ndarray) -> None:
        """One step online: stretched chances x, answers bit, each as often as share says."""
        z = self.mixed(x, gate)
        gates = self.weights.shape[1]
        cells = (gate * BUCKETS + _bucket(z)) * 2 + bit
        self.refined += np.bincount(cells, share, self.refined.size).reshape(self.refined.shape)
        error = (bit - _squash(z)) * share
        total = np.maximum(np.bincount(gate, share, gates), 8.0)
        for k in range(len(x)):
            self.weights[k] += RATE * np.bincount(gate, error * x[k], gates) / total

    def chance(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        """Of a 1: mixed, then averaged with what the mix's own record says at that level."""
        z = self.mixed(x, gate)
        level = np.tile(LEVELS, self.weights.shape[1])
        fixed = (self.refined[:, 1] + 2 * _squash(level)) / (self.refined.sum(1) + 2)
        return (_squash(z) + fixed.take(gate * BUCKETS + _bucket(z))) / 2


def _inputs(tables: np.ndarray, slots: list[np.ndarray], place: np.ndarray, without: np.ndarray | None = None, owner: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Stretched chances of the predictors, and the gate: the place and how well the word so far is known (never seen, seen, often).

    without: bits of occurrences to leave out of the counts, of the words that owner numbers in order; predictors by bytes count a
    word once, so that only a word seen once is left out there.
    """
    both, own = tables.view(np.uint64).ravel(), len(SLOTS) - TOKENS
    counts = [both.take(s).view(np.float32).reshape(-1, 2) for s in slots]  # both counts of a slot at once
    counts = [[n[:, 0], n[:, 1]] for n in counts]
    if without is not None and len(place):
        no, yes = (without == 0).astype(np.float32), without.astype(np.float32)
        word = counts[own][0] * no + counts[own][1] * yes
        least = np.minimum.reduceat(word, np.flatnonzero(np.diff(owner, prepend=-1)))  # how often all training texts have the word
        once = (least < 1.5).astype(np.float32).repeat(np.bincount(owner))
        for j, n in enumerate(counts):
            for k, less in enumerate((no, yes)):
                n[k] = np.maximum(n[k] - (once * less if j < own else less), 0)
    seen = counts[own][0] + counts[own][1]
    return [np.log((yes + np.float32(0.4)) / (no + np.float32(0.4))) for no, yes in counts], place * 3 + (seen > 0.5) + (seen > 20)


def spell_costs(words: Words | list[bytes], kinds: np.ndarray, counts: np.ndarray, tables: np.ndarray, length: np.ndarray, code: np.ndarray, asked: np.ndarray | None = None) -> np.ndarray:
    """log10 probability of each word in a text of its kind, spelled byte by byte; of those not asked for, 0.

    The mixer learns online, each word as often as counts says. A decision is predicted without the occurrence that it
    belongs to: what the model gives words it has not seen counts. Then it holds still and words are scored.
    """
    words, questions = listed(words), Questions(length, code)
    mixer, out = Mixer(GATES * 3, len(SLOTS)), np.zeros(len(words.lens))

    def some(which: np.ndarray) -> Iterator[tuple]:
        for at in range(0, len(which), MINIBATCH):
            here = which[at : at + MINIBATCH]
            all_ = spelled_out(words.take(here), kinds[here])
            told = decisions(all_.sym, questions)
            slots = [told.slots(j, c) for j, c in enumerate(all_.contexts)]
            yield here, np.repeat(all_.owner, told.sizes), told.bit, slots, np.repeat(np.minimum(all_.place, 7), told.sizes)

    for here, owner, bit, slots, place in some(np.flatnonzero(counts > 0)):
        x, gate = _inputs(tables, slots, place, bit, owner)
        mixer.learn(x, gate, bit, counts[here].astype(np.float64)[owner])
    for here, owner, bit, slots, place in some(np.arange(len(out)) if asked is None else np.flatnonzero(asked)):
        p = mixer.chance(*_inputs(tables, slots, place))
        out[here] = np.bincount(owner, np.log10(np.where(bit == 1, p, 1 - p).clip(1e-9, 1)), len(here))
    return out


#: Gates of the decision whether a word is one of those seen after the words before it: by how many these are, and of
#: how many occurrences.
FOLLOWED = 8


def _known_before(n: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and gates of that decision after n occurrences of d words."""
    x = [np.log((n - d + 0.5) / (d + 0.5)), np.ones(len(n))]
    size = np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), FOLLOWED - 1)
    return x, size * 3 + (d > 1) + (d > n / 2)


def follow_costs(context: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What the words before make of each of distinct (context, word), in the order of contexts, with its training occurrences.

    One decision comes before the spelling: is the word among those that training texts have after this context? Its
    chance is mixed from how new words came there so far, with weights by gate, learnt online without the occurrence
    asked about. If so, the value is the log10 probability of the word; if not, 1 more than minus that of a new one, and
    the word is spelled.
    """
    group = np.cumsum(np.diff(context, prepend=context[:1]) != 0)
    n = np.bincount(group, counts)[group]
    d = np.bincount(group, counts > 0)[group]
    mixer = Mixer(FOLLOWED * 3, 2)
    for at in range(0, len(counts), 16 * MINIBATCH):
        k = at + np.flatnonzero((counts[at : at + 16 * MINIBATCH] > 0) & (n[at : at + 16 * MINIBATCH] > 1))
        x, gate = _known_before(n[k] - 1, d[k] - (counts[k] == 1))
        mixer.learn(x, gate, (counts[k] > 1).astype(np.int64), counts[k].astype(np.float64))
    p = mixer.chance(*_known_before(n, d)).clip(1e-6, 1 - 1e-6)
    known = np.log10(p * np.maximum(counts, 1) / np.maximum(n, 1))
    return np.where(counts > 0, known, np.where(n > 0, 1 - np.log10(1 - p), 1.0))


_ZSTD = pa.Codec("zstd", compression_level=1)


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def _unpacked(packed) -> bytes:
    packed = packed.as_py() if isinstance(packed, pa.Scalar) else packed
    return _ZSTD.decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def _interned(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key its number among the distinct ones, and of these their first places."""
    found = pa.array(keys).dictionary_encode()
    ids = found.indices.to_numpy()
    first = np.empty(len(found.dictionary), np.int64)
    first[ids[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return ids, first


def kinds_of(words: Words, numbers: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The kinds of texts, lens words each: a hash of a text's most frequent word, of equally frequent ones the least.

    numbers are the words' hashes, in the order of texts; each text has a word, if only its end.
    """
    ids, first = _interned(numbers)
    met = np.sort(np.repeat(np.arange(len(lens)), lens) * len(first) + ids)
    new = np.flatnonzero(np.diff(met, prepend=-1))
    text, word, n = met[new] // len(first), met[new] % len(first), np.diff(new, append=len(met))
    best = np.flatnonzero(n == np.maximum.reduceat(n, np.flatnonzero(np.diff(text, prepend=-1)))[text])
    text, word = text[best], word[best]
    some = _distinct(word)
    spelled = words.take(first[some]).list()
    order = sorted(range(len(some)), key=spelled.__getitem__)
    rank = np.empty(len(first), np.int64)
    rank[some[order]] = np.arange(len(some))
    least = np.minimum.reduceat(rank[word], np.flatnonzero(np.diff(text, prepend=-1)))
    kinds = np.zeros(len(some), np.int64)
    for k in _distinct(least).tolist():
        kinds[k] = xxhash.xxh3_64_intdigest(spelled[order[k]], 3) % KINDS
    return kinds[least]


def unit_keys(numbers: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Of words by their hashes and the kinds of their texts."""
    return (numbers + (kinds.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)


def _part_of_words(numbers: np.ndarray, parts: int) -> np.ndarray:
    """Of all units with the same word the same."""
    return (numbers % np.uint64(parts)).astype(np.min_scalar_type(parts))


CONTEXT_BITS, WORD_BITS = 40, 24


def _among(numbers: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Whether each of numbers is one of few, which are sorted."""
    out = np.zeros(len(numbers), bool)
    if len(few):
        heads = np.zeros(1 << 16, bool)
        heads[few >> np.uint64(48)] = True
        at = np.flatnonzero(heads[numbers >> np.uint64(48)])
        out[at] = few[np.minimum(np.searchsorted(few, numbers[at]), len(few) - 1)] == numbers[at]
    return out


def passages_of(numbers: np.ndarray, lens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Per word of texts, lens words each, by their hashes: a key of CONTEXT_BITS for the words before it and WORD_BITS for
    the word.

    The words before are two, and more while all of them are frequent (hashes, sorted), four at most; a text's start has
    none before it.
    """
    often, start = _among(numbers, frequent), read_words(b"\0\n").numbers()[0]
    first = np.cumsum(lens) - lens

    def before(values: np.ndarray, k: int, none) -> np.ndarray:
        out = np.concatenate([np.full(k, none, values.dtype), values[:-k]])[: len(values)]
        for j in range(k):
            out[first[lens > j] + j] = none
        return out

    third = before(often, 1, False) & before(often, 2, False)
    fourth = third & before(often, 3, False)
    context = before(numbers, 1, start) * np.uint64(0x9E3779B97F4A7C15) + before(numbers, 2, start)
    for on, k in ((third, 3), (fourth, 4)):
        at = np.flatnonzero(on)
        c = context[at]
        context[at] = (c ^ (c >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + before(numbers, k, start)[at]
    context = (context ^ (context >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return context >> np.uint64(WORD_BITS) << np.uint64(WORD_BITS) | numbers >> np.uint64(64 - WORD_BITS)


def _distinct(keys: np.ndarray) -> np.ndarray:
    """In order; np.unique hashes, which takes longer than to sort."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _part_of(keys: np.ndarray, lots: int) -> np.ndarray:
    """Ranges of contexts."""
    return ((keys >> np.uint64(WORD_BITS)).astype(np.float64) * (lots / 2.0**CONTEXT_BITS)).astype(np.int64).clip(0, lots - 1)


def _planes(numbers: np.ndarray) -> bytes:
    """Whole numbers, first all lowest bytes, then the next: where high ones are few, they pack well."""
    return _packed(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _from_planes(packed) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unpacked(packed), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _by_block(flush):
    """Batches of rows by _block, put together: flush gets a block, its encoded texts and whether they are of training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        train: list[bool] = []
        current = None
        for batch in batches:
            for block, text, k in zip(batch.column("_block").to_pylist(), batch.column("text").to_pylist(), batch.column("_train").to_pylist(), strict=True):
                if block != current:
                    if texts:
                        yield flush(current, texts, train)
                    texts, train, current = [], [], block
                texts.append(_encoded(text))
                train.append(k)
        if texts:
            yield flush(current, texts, train)

    return run


#: A unit is a word and a kind of text that has it. Words in an order that puts those together which begin alike, how many
#: units each has, the units' kinds and counts.
UNITS = ("words", "per", "heads", "counts")
BINARY = ", ".join(f"{c} binary" for c in UNITS)


def _told_units(words: Words, word: np.ndarray, kinds: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Of units in the order of words, each the word of a number and a kind of text."""
    per = np.bincount(word, minlength=len(words.lens))
    return _packed(words.ended().tobytes()), _packed(per.astype(np.uint8).tobytes()), _packed(kinds.astype(np.uint8).tobytes()), _planes(counts)


def _read_units(*columns) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of rows one after the other, and of units the number of their word, kinds and counts."""
    words, per, heads = (b"".join([_unpacked(x) for x in c]) for c in columns[:3])
    counts = [_from_planes(x).astype(np.int64) for x in columns[3]]
    per = np.frombuffer(per, np.uint8)
    return read_words(words), np.repeat(np.arange(len(per)), per), np.frombuffer(heads, np.uint8), np.concatenate([np.zeros(0, np.int64), *counts])


def _gathered(parts: int):
    """Of each block: its distinct units by part, and by unit twice its count in training texts, with 1 more if a text that
    is held out has it."""

    def flush(block: int, texts: list[bytes], train: list[bool]) -> pa.RecordBatch:
        words, lens = cut(texts)
        numbers = words.numbers()
        kinds, learnt = np.repeat(kinds_of(words, numbers, lens), lens), np.repeat(train, lens)
        ids, first = _interned(unit_keys(numbers, kinds))
        counts = 2 * np.bincount(ids, learnt, len(first)).astype(np.int64)
        counts[_distinct(ids[~learnt])] += 1
        word, of = _interned(numbers[first])
        own = words.take(first[of])
        part = _part_of_words(numbers[first[of]], parts)
        order = own.by_bytes()
        order = order[np.argsort(part[order], kind="stable")]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        word = rank[word]
        by_word = np.argsort(word)
        word, heads, counts = word[by_word], kinds[first][by_word], counts[by_word]
        part = part[order]
        edges = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1))
        rows = []
        for a, b in zip(edges, [*edges[1:], len(part)], strict=True):
            c, d = np.searchsorted(word, (a, b))
            rows.append((block, int(part[a]), *_told_units(own.take(order[a:b]), word[c:d] - a, heads[c:d], counts[c:d])))
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "part", *UNITS])

    return _by_block(flush)


GATHERED = f"block long, part long, {BINARY}"


def _passages(lots: int, frequent: np.ndarray):
    """Of each block: its distinct passages by part, and how often its training texts have them."""

    def flush(block: int, texts: list[bytes], train: list[bool]) -> pa.RecordBatch:
        words, lens = cut(texts)
        keys = passages_of(words.numbers(), lens, frequent)
        learnt = np.repeat(train, lens)
        asked = _distinct(keys[~learnt])
        learnt = np.sort(keys[learnt])
        first = np.flatnonzero(np.concatenate([[True], learnt[1:] != learnt[:-1]])[: len(learnt)])
        keys, counts = learnt[first], np.diff(first, append=len(learnt))
        at = np.searchsorted(keys, asked)
        if len(keys):
            new = keys[np.minimum(at, len(keys) - 1)] != asked
            at, asked = at[new], asked[new]
        keys, counts = np.insert(keys, at, asked), np.insert(counts, at, 0)
        part = _part_of(keys, lots)
        edges = np.flatnonzero(np.diff(part, prepend=-1))
        rows = []
        for a, b in zip(edges, [*edges[1:], len(part)], strict=True):
            rows.append((block, int(part[a]), _planes(np.diff(keys[a:b], prepend=np.uint64(0))), _planes(counts[a:b])))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "part", "keys", "counts"])

    return _by_block(flush)


PASSAGES = "block long, part long, keys binary, counts binary"


class Merged(NamedTuple):
    """The units of a part: words, the number of each unit's word, kinds, counts in all training texts, whether texts held
    out have it, the words' hashes, and the places of each block's units."""

    words: Words
    word: np.ndarray
    kinds: np.ndarray
    total: np.ndarray
    asked: np.ndarray
    numbers: np.ndarray
    blocks: dict[int, np.ndarray]


def _merged(rows: pa.Table) -> Merged:
    columns = [rows.column(c) for c in UNITS]
    words, word, kinds, counts = _read_units(*columns)
    numbers = words.numbers()
    ids, first = _interned(unit_keys(numbers[word], kinds))
    asked = np.zeros(len(first), bool)
    asked[ids[counts & 1 == 1]] = True
    own, of = _interned(numbers)
    blocks: dict[int, list] = {}
    for block, at in zip(rows.column("block").to_pylist(), np.split(ids, np.cumsum([len(_unpacked(h)) for h in columns[2]])[:-1]), strict=True):
        blocks.setdefault(block, []).append(at)
    total = np.bincount(ids, counts >> 1, len(first)).astype(np.int64)
    return Merged(words.take(of), own[word[first]], kinds[first], total, asked, numbers[of], {b: np.concatenate(x) for b, x in blocks.items()})


TOLD = "block long, part long, counts binary, costs binary"


def _told(part: int, blocks: list[tuple[int, bytes | None, bytes]]) -> pa.Table:
    """What a part tells each block of its units, in the order of their hashes."""
    rows = [(block, part, counts, costs) for block, counts, costs in blocks]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("block", "part", "counts", "costs"), zip(*rows, strict=True), kinds, strict=True)})


def _vocabulary(rows: pa.Table) -> pa.Table:
    """Of one part: words by kind of text seen in training, their counts, sums, and the bytes that spell them."""
    own = _merged(rows)
    by_word = np.bincount(own.word, own.total, len(own.numbers))
    order = own.words.by_bytes()
    order = order[by_word[order] > 0]
    words, by_word = own.words.take(order), by_word[order]
    rank = np.empty(len(own.numbers), np.int64)
    rank[order] = np.arange(len(order))
    units = np.flatnonzero(own.total)
    units = units[np.argsort(rank[own.word[units]])]
    sym, lens = symbols(words)
    told = _told_units(words, rank[own.word[units]], own.kinds[units], own.total[units])
    cols = {"part": pa.array([rows.column("part")[0].as_py()])} | {c: pa.array([x], pa.binary()) for c, x in zip(UNITS, told, strict=True)}
    return pa.table(cols | {"n": [int(own.total.sum())], "v": [len(order)], "spelling": pa.array([np.bincount(sym, np.repeat(by_word, lens), 256).tolist()], pa.list_(pa.float64()))})


def _often(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, word, _, counts = _read_units(*[batch.column(c) for c in UNITS])
            found = words.numbers()[np.bincount(word, counts, len(words.lens)) >= least]
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["number"])

    return run


#: Tables travel in pieces of so many numbers.
PIECE = 1 << 19


def add_words(tables: np.ndarray, words: Words | list[bytes], kinds: np.ndarray, once: np.ndarray, counts: np.ndarray, length: np.ndarray, code: np.ndarray) -> None:
    """Count the decisions of words: by bytes those of `once`, by the word so far as often as the words occur. Words that
    begin alike share those decisions, which are added up before."""
    all_, questions = spelled_out(words, kinds), Questions(length, code)
    own = len(SLOTS) - TOKENS
    for js in (range(own + 1), range(own + 1, len(SLOTS))):
        ids, first = _interned(_mixed(all_.contexts[js[-1]]) + all_.sym.astype(np.uint64))
        some = all_.take(first)
        told = decisions(some.sym, questions)
        for share, which in ((once, [j for j in js if j < own]), (counts, [j for j in js if j >= own])):
            share = np.repeat(np.bincount(ids, share[all_.owner], len(first)).astype(np.float32), told.sizes)
            for j in which:
                np.add.at(tables, 2 * told.slots(j, some.contexts[j]) + told.bit, share)


def _counted(length: np.ndarray, code: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros(2 * int(BASES[-1]), np.float32)
        any_rows = False
        for batch in batches:
            words, word, kinds, counts = _read_units(*[batch.column(c) for c in UNITS])
            once = np.diff(word, prepend=-1) != 0
            for at in range(0, len(word), 16 * MINIBATCH):
                any_rows = True
                here = slice(at, at + 16 * MINIBATCH)
                add_words(tables, words.take(word[here]), kinds[here], once[here], counts[here], length, code)
        if any_rows:
            for at in range(0, len(tables), PIECE):
                piece = tables[at : at + PIECE]
                if piece.any():
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([_packed(piece.tobytes())], pa.binary())], ["at", "held"])

    return run


def _summed(rows: pa.Table) -> pa.Table:
    piece = sum(np.frombuffer(_unpacked(x), np.float32).astype(np.float64) for x in rows.column("held"))
    return pa.table({"at": rows.column("at")[:1], "held": pa.array([_packed(piece.astype(np.float32).tobytes())], pa.binary())})


def _known(tables, length: np.ndarray, code: np.ndarray):
    """Of one part: how often all training texts have the words of each block, and what it costs to spell them."""

    def run(rows: pa.Table) -> pa.Table:
        own = _merged(rows)
        counts = np.bincount(own.word, own.total, len(own.numbers)).astype(np.int64)[own.word]
        order = np.argsort(unit_keys(own.numbers[own.word], own.kinds))
        cost = spell_costs(own.words.take(own.word[order]), own.kinds[order], own.total[order], tables.value, length, code, own.asked[order]).astype(np.float32)
        counts = counts[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        told = []
        for block, at in own.blocks.items():
            at = _distinct(rank[at])
            told.append((block, _planes(counts[at]), _packed(cost[at].tobytes())))
        return _told(rows.column("part")[0].as_py(), told)

    return run


def _followed(rows: pa.Table) -> pa.Table:
    """Of one part: what the words before make of each block's passages."""
    lists: dict[int, list] = {}
    for block, keys, counts in zip(rows.column("block").to_pylist(), rows.column("keys"), rows.column("counts"), strict=True):
        lists.setdefault(block, []).append((np.cumsum(_from_planes(keys), dtype=np.uint64), _from_planes(counts)))
    names = _distinct(np.concatenate([keys for xs in lists.values() for keys, _ in xs]))
    total = np.zeros(len(names), np.int64)
    for xs in lists.values():
        for keys, counts in xs:
            total[np.searchsorted(names, keys)] += counts.astype(np.int64)  # each key once
    cost = follow_costs(names >> np.uint64(WORD_BITS), total).astype(np.float32)
    told = []
    for block, xs in lists.items():
        keys = xs[0][0] if len(xs) == 1 else _distinct(np.concatenate([keys for keys, _ in xs]))
        told.append((block, None, _packed(cost[np.searchsorted(names, keys)].tobytes())))  # few values, which pack well
    return _told(rows.column("part")[0].as_py(), told)


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their texts packed: all of them are shuffled to their blocks."""
    for batch in batches:
        texts = [None if t is None else _packed(_encoded(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_train"), batch.column("_block"), pa.array(texts, pa.binary())], ["doc_id", "_train", "_block", "packed"])


SENT = "doc_id long, _train boolean, _block long, packed binary"


def _scored(n: int, v: int, parts: int, lots: int, frequent: np.ndarray):
    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        spelled, followed = [], []
        for part, counts, costs in zip(known.column("part").to_pylist(), known.column("counts"), known.column("costs"), strict=True):
            if counts.is_valid:
                spelled.append((part, _from_planes(counts).astype(np.int64), np.frombuffer(_unpacked(costs), np.float32)))
            else:
                followed.append((part, np.frombuffer(_unpacked(costs), np.float32)))
        words, lens = cut([_unpacked(t) if t else b"" for t in docs.column("packed").to_pylist()])
        numbers = words.numbers()
        # Parts tell of units in the order of their hashes.
        units = unit_keys(numbers, np.repeat(kinds_of(words, numbers, lens), lens))
        ids, first = _interned(units)
        order = np.argsort(units[first])
        order = order[np.argsort(_part_of_words(numbers[first[order]], parts), kind="stable")]
        of_unit = []
        for values in list(zip(*sorted(spelled, key=lambda t: t[0]), strict=True))[1:]:
            own = np.empty(len(order), values[0].dtype)
            own[order] = np.concatenate(values)
            of_unit.append(own)
        count, spell = of_unit
        # They tell of passages in the order of keys, of which they are ranges.
        keys = passages_of(numbers, lens, frequent)
        order = np.argsort(keys)
        keys = keys[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        follow = np.empty(len(keys))
        follow[order] = np.repeat(np.concatenate([costs for _, costs in sorted(followed, key=lambda t: t[0])]), np.diff(new, append=len(keys)))
        base, seen = np.log10((count + 1.0) / (n + 1.0 * (v + 1)))[ids], (count > 0).astype(np.int64)[ids]
        spell = spell.astype(np.float64)[ids]
        cost = np.where(follow <= 0, follow, 1 - follow + spell)
        starts = np.cumsum(lens) - lens
        sums = [np.add.reduceat(x, starts) for x in (seen, base, cost, words.lens + 1)]
        sums[2] -= np.log10(KINDS)  # a text's kind is told first
        out = docs.select(["doc_id", "_train"])
        for name, c in zip(("n_tokens", "n_known", "base_score", "score", "_bytes"), (lens, *sums), strict=True):
            out = out.append_column(name, pa.array(c))
        return out

    return run


def _blocked(docs: DataFrame, train) -> DataFrame:
    """docs with _block: rows of a file that lie together, or where docs is no file, rows by a hash of doc_id."""
    rows = docs.withColumn("_train", train)
    try:
        block = F.xxhash64(F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / BLOCK_ROWS))
        return rows.select("doc_id", "text", "_train", block.alias("_block"))
    except AnalysisException:
        blocks = max(1, rows.count() // BLOCK_ROWS)
        rows = rows.select("doc_id", "text", "_train", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("_block"))
        return rows.repartition("_block").sortWithinPartitions("_block")


def score(docs: DataFrame, held_out_of: int = 7, held_out: int = 2) -> DataFrame:
    """Per row of docs (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Tokens are the words in lower case (A-Z) and one end a text. base_score adds up log10((c + 1) / (N + V + 1)) over
    tokens, c from the texts not held out. score is the log10 probability of the same tokens. A token's first decision is
    whether the word is one of those that training texts have after the words before it (two, or up to four while all are
    frequent); if so its share there says the rest. Else it is spelled byte by byte to its end: a Huffman code turns a
    byte into yes-no questions; hashed predictors by the last two, three and four bytes, by the word so far, and by that
    with the kind of text answer each from counts of all training texts. Weights chosen by what is known mix the answers
    in the logistic domain, learnt online within each part of the vocabulary and of the contexts; a record of what a mix
    met refines it. A text's kind, a hash of its most frequent word, is told first and costs as much as the choice of one
    in KINDS. Units go to parts by hashes of 40 bits or more, so results depend neither on the order of rows nor on
    partitioning; a context that half of all texts have is one unit a block of rows. bits_per_byte is the score in bits
    over the bytes spelled. A null or empty text is the one token of its end.
    """
    spark = docs.sparkSession
    docs = docs.select("*") if "_train" not in docs.columns else docs.drop("_train")
    rows = _blocked(docs, F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(held_out_of)) != held_out, F.lit(True)))
    chars = int(docs.agg(F.sum(F.length("text"))).first()[0] or 0)
    parts, lots = max(1, chars // PART_CHARS), max(1, chars // PASSAGE_CHARS)
    blocks = stash(byte_batches(rows, _gathered(parts), GATHERED), "blocks")
    vocabulary = stash(blocks.groupBy("part").applyInArrow(_vocabulary, f"part long, {BINARY}, n long, v long, spelling array<double>"), "vocabulary")
    sums = vocabulary.agg(F.sum("n").alias("n"), F.sum("v").alias("v"), *[F.sum(F.col("spelling")[k]).alias(f"b{k}") for k in range(256)]).first()
    n, v = int(sums["n"] or 0), int(sums["v"] or 0)
    length, code = byte_code(np.array([sums[f"b{k}"] or 0.0 for k in range(256)]))
    frequent = vocabulary.select(*UNITS).mapInArrow(_often(n / FREQUENT), "number long").collect()  # FREQUENT at most
    frequent = np.sort(np.fromiter((r.number for r in frequent), np.int64, len(frequent)).view(np.uint64))
    tasks = int(np.clip(parts // 8, 1, 256))  # each brings a table of fixed size
    counted = vocabulary.select(*UNITS).repartition(tasks).mapInArrow(_counted(length, code), "at long, held binary")
    tables = np.zeros(2 * int(BASES[-1]), np.float32)
    for row in counted.groupBy("at").applyInArrow(_summed, "at long, held binary").toLocalIterator():  # the model: of fixed size
        piece = np.frombuffer(_unpacked(row.held), np.float32)
        tables[row.at : row.at + len(piece)] = piece
    held = spark.sparkContext.broadcast(tables.reshape(-1, 2))
    found = byte_batches(rows, _passages(lots, frequent), PASSAGES)
    known = blocks.groupBy("part").applyInArrow(_known(held, length, code), TOLD).union(found.groupBy("part").applyInArrow(_followed, TOLD))
    schema = "doc_id long, _train boolean, n_tokens long, n_known long, base_score double, score double, _bytes long"
    scored = byte_batches(rows, _sent, SENT).groupBy("_block").cogroup(known.groupBy("block")).applyInArrow(_scored(n, v, parts, lots, frequent), schema)
    per_byte = -F.col("score") * float(np.log2(10)) / F.col("_bytes")
    return scored.select("doc_id", (~F.col("_train")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", per_byte.alias("bits_per_byte"))


def op8_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() of all documents."""
    return score(table(spark, sf_dir, "documents"))


SQL = None
