"""N-gram Jaccard join by T-occurrence search over inverted lists, short lists merged and long ones probed (DivideSkip)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.llm.common import byte_batches, discard, fresh, stash, table, unit_hash

WORDS, PERCENT = 5, 75
#: Bytes of inverted lists that one task of the first search holds.
LIST_BYTES = 6 << 20
#: Rounds in which a list's documents are held against one centre before all pairs between components are.
STAR_ROUNDS = 2
FLUSH = 500_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_known: dict[bytes, int] = {}


def shingle_set(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; of fewer words, the one of the whole; none of none.

    Two different shingles have one hash in 1 of 1.8e19 pairs.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_known) > 100_000:
        _known.clear()
    known = _known
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    one = np.fromiter((known[w] for w in words), np.uint64, len(words))
    width = min(size, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * _MIX[0] + one[k : len(one) - width + 1 + k]
    out ^= out >> np.uint64(30)
    out *= _MIX[1]
    out ^= out >> np.uint64(27)
    out *= _MIX[2]
    out ^= out >> np.uint64(31)
    return np.unique(out)


def set_key(shingles: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64)))


def least_overlap(n, percent: int = PERCENT):
    """The least number of shingles that a set of n shares with any set it links with."""
    return -(-n * percent // 100)


def _indexed(size: int, percent: int, bits: int):
    """Rows of documents (doc_id, n, key, text_hash) and rows of lists (bucket, keys, counts, lows)."""

    def flush(sets: dict[int, np.ndarray]) -> list[tuple]:
        keys = np.fromiter(sets, np.int64, len(sets))
        lens = np.fromiter(map(len, sets.values()), np.int64, len(sets))
        full = np.concatenate(list(sets.values()))
        owner = np.repeat(np.arange(len(sets)), lens)
        bucket = (full >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(full), np.int64)
        order = np.argsort(bucket, kind="stable")  # within a bucket still by document
        low = (full >> np.uint64(32 - bits)).astype(np.uint32)[order]
        bucket, owner = bucket[order], owner[order]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        rows = []
        for a, b in zip(edges, [*edges[1:], len(bucket)], strict=True):
            here, counts = np.unique(owner[a:b], return_counts=True)
            rows.append((int(bucket[a]), keys[here].tobytes(), counts.astype(np.uint32).tobytes(), low[a:b].tobytes()))
        return rows

    def batch_of(docs: tuple[list, ...], lists: list[tuple]) -> pa.RecordBatch:
        m, k = len(docs[0]), len(lists)
        cols = list(zip(*lists, strict=True)) or [(), (), (), ()]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([*x, *[None] * k], pa.int64()) for x in docs] + [pa.array([*[None] * m, *c], t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "n", "key", "text_hash", "bucket", "keys", "counts", "lows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            docs: tuple[list, ...] = ([], [], [], [])
            for doc_id, text, text_hash in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                s = shingle_set(text.as_py(), size)
                key = set_key(s) if len(s) else None
                for x, v in zip(docs, (doc_id.as_py(), len(s), key, text_hash.as_py()), strict=True):
                    x.append(v)
                if key is not None and key not in sets:
                    need = least_overlap(len(s), percent)
                    sets[key] = s[: len(s) - need + max(1, len(s) // 4)]
                    held += len(sets[key])
            lists = []
            if held >= FLUSH:
                lists, sets, held = flush(sets), {}, 0
            yield batch_of(docs, lists)
        if sets:
            yield batch_of(([], [], [], []), flush(sets))
        _known.clear()

    return run


def _shared(parts: int):
    """Of one bucket: how many of each document's shingles another document has too, as lists by key modulo parts."""

    def run(rows: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in rows.column("keys")])
        counts = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in rows.column("counts")])
        lows = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in rows.column("lows")])
        names, place = np.unique(keys, return_inverse=True)
        both = np.unique((lows.astype(np.uint64) << np.uint64(32)) | np.repeat(place, counts).astype(np.uint64))
        runs = np.flatnonzero(np.diff(both >> np.uint64(32), prepend=np.uint64(1 << 33)))
        lens = np.diff(runs, append=len(both))
        hits = np.bincount((both[np.repeat(lens > 1, lens)] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=len(names))
        names, hits = names[hits > 0], hits[hits > 0]
        order = np.argsort(names % parts, kind="stable")
        names, hits = names[order], hits[order]
        edges = np.searchsorted(names % parts, np.arange(parts + 1))
        found = [(p, names[a:b].tobytes(), hits[a:b].astype(np.int64).tobytes()) for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
        cols = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("part", "keys", "hits"), cols, (pa.int64(), pa.binary(), pa.binary()), strict=True)})

    return run


def _added(rows: pa.Table) -> pa.Table:
    """Of one part: each key with its hits in all buckets."""
    keys, hits = (np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in rows.column(c)]) for c in ("keys", "hits"))
    names, place = np.unique(keys, return_inverse=True)
    return pa.table({"key": names, "hits": np.bincount(place, hits, len(names)).astype(np.int64)})


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ns, sets = [], [], []
            for key, text in zip(batch.column("key"), batch.column("text"), strict=True):
                s = shingle_set(text.as_py(), size)
                if len(s) and set_key(s) == key.as_py():
                    keys.append(key.as_py())
                    ns.append(len(s))
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ns, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["key", "n", "shingles"])

    return run


def _linked(percent: int):
    """Probe the shorter set's shingles in the longer one by binary search; keep the pairs that overlap enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = sorted((x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)), key=len)
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(links: DataFrame) -> DataFrame:
    """(key, root): for each end of a link (a, b) the smallest key that it reaches.

    Large and small stars take turns: each node's larger neighbours, then its lesser ones, are tied to the least of them.
    Done when each node has one link, to a node that has none.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = stash(small, "edges")
        discard(edges)
        edges = after
        parents = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        open_ = parents.select("u", (F.col("n") > 1).alias("several")).join(edges.select(F.col("v").alias("u")), "u", "left_semi").union(parents.where("n > 1").select("u", F.lit(True)))
        if open_.isEmpty():
            return edges.select(F.col("u").alias("key"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("key").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("key").alias("b"), F.col("shingles").alias("set_b"))
    return byte_batches(pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b"), _linked(percent), "a long, b long")


def _may_link(percent: int):
    """Whether sets of n and n2 shingles, k and k2 of them in other sets, can be alike enough."""
    sizes = 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")
    return sizes & ((100 + percent) * F.least("k", "k2") >= percent * (F.col("n") + F.col("n2")))


def _linked_classes(sets: DataFrame, percent: int) -> DataFrame | None:
    """(key, root) of the sets that link with another one; None if none does."""
    entries = sets.select("key", "n", F.explode("shingles").alias("h"))
    often = entries.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    lists = entries.join(often, "h").groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("by_df"))
    need = F.ceil(F.col("n") * percent / 100).cast("int")
    need_of_longer = F.ceil(2 * F.col("n") * percent / (100 + percent)).cast("int")
    # The need - 1 longest lists of a document are only probed: it meets each partner in one of the shorter ones. A partner
    # that isn't shorter shares more, so that fewer lists (those that lead) hold all of them.
    lists = lists.where(F.size("by_df") >= need).withColumn("k", F.size("by_df"))
    lists = lists.withColumn("hub", F.aggregate("by_df", F.lit(0.0), lambda a, e: a + e["df"]) / F.col("n"))
    short = lists.select("key", "n", "k", "hub", F.posexplode(F.slice("by_df", 1, F.col("k") - need + 1)).alias("at", "e"))
    short = stash(short.select(F.col("e.h").alias("h"), "key", "n", "k", "hub", (F.col("at") <= F.col("k") - need_of_longer).alias("lead")), "lists")
    links: DataFrame | None = None
    roots: DataFrame | None = None
    tested: DataFrame | None = None
    for turn in range(STAR_ROUNDS + 1):
        at = short.withColumn("root", F.col("key")) if roots is None else short.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
        # A hub, most of whose shingles many have, links with copies that don't link with each other.
        rank = F.col("hub") * (1 + 0.1 * turn * unit_hash(F.col("key"), F.lit(turn)))
        pick = F.max(F.struct(rank.alias("r"), "key", "n", "k", "root", "lead")).alias("c")
        mixed = at.groupBy("h").agg(pick, F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        if turn < STAR_ROUNDS:
            both = at.join(mixed.select("h", *[F.col(f"c.{c}").alias(f"{c}2") for c in ("key", "n", "k", "root", "lead")]), "h").where("key <> key2")
        else:
            left = at.join(mixed.select("h"), "h")
            right = left.where("lead").select("h", *[F.col(c).alias(f"{c}2") for c in ("key", "n", "k", "root", "lead")])
            both = left.join(right, (left["h"] == right["h"]) & (F.col("root") != F.col("root2")) & ((F.col("n2") < F.col("n")) | ((F.col("n2") == F.col("n")) & F.col("lead") & (F.col("key2") < F.col("key")))) & _may_link(percent))
        near = both.where((F.col("root") != F.col("root2")) & _may_link(percent) & F.when(F.col("n2") < F.col("n"), F.col("lead2")).when(F.col("n2") > F.col("n"), F.col("lead")).otherwise(F.col("lead") & F.col("lead2")))
        pairs = near.select(F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b")).distinct()
        pairs = stash(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            if turn == STAR_ROUNDS:
                break
            continue
        found = stash(_verified(pairs, sets, percent), "links")
        tested = pairs if tested is None else tested.union(pairs)
        links = found if links is None else links.union(found)
        if not found.isEmpty():
            roots = components(links)
    return roots


def jaccard_components(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, list_bytes: int = LIST_BYTES) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id.

    Documents link when the Jaccard similarity of their sets of word shingles is percent/100 or more; component_id is the
    smallest doc_id that links reach. A null, empty or blank text has no shingles and is a component of its own. Equal
    sets count as one class before any search. Rows that repeat a doc_id share nothing but that number. A null doc_id is
    linked as any other and never the smallest, unless its component has no other.

    1. Each task holds the part of each set with the smallest hashes that must meet a partner's; lists by hash range tell
       how many of a document's shingles occur elsewhere. Too few, and it has no partner: that ends most documents.
    2. For the rest, lists are counted, and a document is put on its shortest lists only.
    3. Lists yield pairs with one centre each, whose sets are probed; links join classes into components, and a list
       whose documents are in one component is done. The last round takes all pairs between components.
    """
    found = _components(docs, size, percent, list_bytes)
    own = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def _components(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, list_bytes: int = LIST_BYTES) -> DataFrame:
    """Per row of docs: doc_id, text_hash, n, key (null without shingles), and first, the smallest document of its
    component: without_id, doc_id, text_hash. A document is a doc_id, null too, and its text."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(20, max(0, int(np.ceil(np.log2(max(1, chars * 0.4 / list_bytes))))))
    found = stash(byte_batches(docs, _indexed(size, percent, bits), "doc_id long, n long, key long, text_hash long, bucket int, keys binary, counts binary, lows binary"), "index")
    lists = found.where("bucket is not null").select("bucket", "keys", "counts", "lows")
    hits = stash(lists.groupBy("bucket").applyInArrow(_shared(1 << bits), "part long, keys binary, hits binary").groupBy("part").applyInArrow(_added, "key long, hits long"), "hits")
    rows = stash(found.where("bucket is null").select("doc_id", "n", "key", "text_hash"), "rows")
    discard(found)
    classes = stash(rows.where("key is not null").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without_id"), "doc_id", "text_hash")).alias("rep"), F.max("n").alias("n")), "classes")
    need = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / 4))
    left = classes.join(hits, "key").where(F.col("hits") >= need).select("key", F.col("rep").alias("_rep"))
    texts = docs.join(left, F.col("doc_id").eqNullSafe(F.col("_rep.doc_id")) & (F.col("text_hash") == F.col("_rep.text_hash"))).select("key", "text")
    sets = stash(byte_batches(texts, _sets(size), "key long, n long, shingles array<long>").dropDuplicates(["key"]), "sets")
    roots = _linked_classes(sets, percent)
    if roots is None:
        named = classes.select("key", F.col("rep").alias("first"))
    else:
        with_root = classes.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
        least = with_root.groupBy("root").agg(F.min("rep").alias("first"))
        named = with_root.join(least, "root").select("key", "first")
    return rows.join(named, "key", "left")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id, a null one last, and of its texts the one
    with the smallest hash; rows that repeat its doc_id and text stay with it. Texts without shingles stay."""
    key, text = fresh(docs, "_gone_id", "_gone_hash")
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    gone = _components(docs, **options).where(F.col("key").isNotNull() & ~first).select(F.col("doc_id").alias(key), F.col("text_hash").alias(text)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(text)), "left_anti")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jaccard_components() of all documents: doc_id, n_shingles, component_id."""
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingled AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END) AS s FROM words),
entries AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, hash(unnest(s)) AS h FROM shingled),
counted AS (
  SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS k FROM entries x JOIN entries y ON x.h = y.h AND x.doc_id < y.doc_id
  GROUP BY ALL),
links AS (SELECT a, b FROM counted WHERE 100 * k >= {PERCENT} * (na + nb - k)),
ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS r FROM ends UNION SELECT reach.doc_id, ends.b FROM reach JOIN ends ON reach.r = ends.a),
least AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(least.r, s.doc_id) AS component_id FROM shingled s LEFT JOIN least USING (doc_id)
"""
