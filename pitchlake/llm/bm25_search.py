"""Exact BM25 top-k search: an inverted index per shard with block-max WAND, merged under global statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchlake.llm.common import byte_batches, discard, stash, table

K, K1, B = 10, 1.2, 0.75
#: Characters of documents that one shard indexes; neighbouring documents that share one bound per term; terms whose lists
#: lie by block; queries that go through a shard together; bytes of queries that are broadcast at once.
SHARD_CHARS, BLOCK, LONG, TOGETHER, QUERY_BYTES = 48 << 20, 64, 256, 128, 32 << 20
#: Distinct terms that a task counts before it hands them on.
FLUSH = 1_000_000

_known: dict[bytes, int] = {}


def term_ids(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted distinct 64-bit ids of the words of a text, how often it has each, and how many it has in all."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if len(_known) > 400_000:
        _known.clear()
    known = _known
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w) >> 1
    ids, counts = np.unique(np.fromiter((known[w] for w in words), np.int64, len(words)), return_counts=True)
    return ids, counts, len(words)


def _counted(parts: int):
    """Rows (part, terms, dfs) of a task's documents and one row of its documents and words, at part -1."""

    def flush(found: dict[int, int]) -> list[tuple]:
        terms = np.fromiter(found, np.int64, len(found))
        dfs = np.fromiter(found.values(), np.int64, len(found))
        part = terms % parts
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        return [(p, terms[order[a:b]].tobytes(), dfs[order[a:b]].tobytes()) for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "terms", "dfs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        docs = words = 0
        for batch in batches:
            for text in batch.column(0):
                ids, _, n = term_ids(text.as_py())
                docs, words = docs + 1, words + n
                for t in ids.tolist():
                    found[t] = found.get(t, 0) + 1
            if len(found) > FLUSH:
                yield batch_of(flush(found))
                found = {}
        yield batch_of([*flush(found), (-1, np.array([docs, words], np.int64).tobytes(), b"")])

    return run


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(q, *term_ids(t.as_py())[:2]) for q, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
        qids = np.repeat(np.array([r[0] for r in rows], np.int64), [len(r[1]) for r in rows])
        terms, counts = (np.concatenate([r[k] for r in rows] or [np.zeros(0, np.int64)]) for k in (1, 2))
        yield pa.RecordBatch.from_arrays([pa.array(qids, pa.int64()), pa.array(terms, pa.int64()), pa.array(counts, pa.int64())], ["query_id", "term", "tf"])


def _with_df(rows: pa.Table, wanted: pa.Table) -> pa.Table:
    terms = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in rows.column("terms")] or [np.zeros(0, np.int64)])
    dfs = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in rows.column("dfs")] or [np.zeros(0, np.int64)])
    names, place = np.unique(terms, return_inverse=True)
    total = np.bincount(place, dfs, len(names)).astype(np.int64)
    ask = wanted.column("term").to_numpy()
    at = np.minimum(np.searchsorted(names, ask), max(len(names) - 1, 0))
    df = np.where(names[at] == ask, total[at], 0) if len(names) else np.zeros(len(ask), np.int64)
    return pa.table({"query_id": wanted.column("query_id"), "term": wanted.column("term"), "tf": wanted.column("tf"), "df": df})


class ShardIndex:
    """Inverted lists of a shard: those of the LONG most frequent terms by blocks of BLOCK documents, the others as postings.

    Documents are in the order of their heaviest frequent term and their length, so that those of a block are alike and
    its maxima, one a long list, are close to what its documents have.
    """

    def __init__(self, docs: list[tuple[int, np.ndarray, np.ndarray, int]], mean_words: float):
        at = np.repeat(np.arange(len(docs), dtype=np.int32), [len(d[1]) for d in docs])
        terms = np.concatenate([d[1] for d in docs] or [np.zeros(0, np.int64)])
        tf = np.concatenate([d[2] for d in docs] or [np.zeros(0, np.int64)]).astype(np.float64)
        words = np.array([d[3] for d in docs], np.float64)
        factor = tf * (K1 + 1) / (tf + K1 * (1 - B + B * words[at] / max(mean_words, 1e-9)))
        self.terms, term, df = np.unique(terms, return_inverse=True, return_counts=True)
        self.column = np.full(len(self.terms), -1)
        longest = np.argsort(-df, kind="stable")[:LONG]
        self.column[longest] = np.arange(len(longest))
        self.blocks = -(-len(docs) // BLOCK)
        column = self.column[term]
        on = column >= 0
        long_lists = np.zeros((self.blocks * BLOCK, max(1, len(longest))))
        long_lists[at[on], column[on]] = factor[on]
        order = np.lexsort((-words, long_lists[: len(docs)].argmax(1))) if len(docs) else np.zeros(0, np.int64)
        self.ids = np.array([d[0] for d in docs], np.int64)[order]
        long_lists[: len(docs)] = long_lists[order]
        self.long = long_lists.reshape(self.blocks, BLOCK, -1)
        self.maxima = self.long.max(1) if self.blocks else np.zeros((0, long_lists.shape[1]))
        place = np.empty(len(docs), np.int32)
        place[order] = np.arange(len(docs))
        by_term = np.argsort(term[~on], kind="stable")
        self.doc, self.factor = place[at[~on]][by_term], factor[~on][by_term]
        self.ends = np.cumsum(np.bincount(term[~on], minlength=len(self.terms)))

    def _lists(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Weights by long list, and what the short lists give each document: those are few postings and merged whole."""
        weights, given = np.zeros((len(queries), self.long.shape[2])), np.zeros((len(queries), self.blocks * BLOCK))
        for q, (terms, ws) in enumerate(queries):
            if not len(self.terms) or not len(terms):
                continue
            at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
            here = self.terms[at] == terms
            at, ws = at[here], ws[here]
            column = self.column[at]
            weights[q, column[column >= 0]] = ws[column >= 0]
            at, ws = at[column < 0], ws[column < 0]
            n = self.ends[at] - np.where(at > 0, self.ends[at - 1], 0)
            upto = np.cumsum(n)
            postings = np.arange(upto[-1] if len(upto) else 0) + np.repeat(self.ends[at] - upto, n)
            given[q] = np.bincount(self.doc[postings], np.repeat(ws, n) * self.factor[postings], given.shape[1])
        return weights, given

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The k best documents by (score, lesser doc_id) of each query (terms, weights), with their scores.

        Block-max WAND, for some queries at once. A block's bound is the sum of the long lists' maxima there, and the most
        that the short lists give one of its documents. The block of the highest bound sets the first threshold, the k-th
        best score so far. Then all lists go through the blocks in order: for a query, the next pivot is the next block
        whose bound reaches its threshold, lists skip the blocks before it unread, and the pivot's documents are scored
        whole, which raises the threshold.
        """
        weights, given = self._lists(queries)
        scores = np.zeros(given.shape)
        if not self.blocks:
            return [(self.ids, np.zeros(0)) for _ in queries]
        given = given.reshape(len(queries), self.blocks, BLOCK)
        bounds = weights @ self.maxima.T + given.max(2)
        scores = np.full(given.shape, -1.0)
        every, first = np.arange(len(queries)), bounds.argmax(1)
        scores[every, first] = np.matmul(self.long[first], weights[:, :, None])[:, :, 0] + given[every, first]
        best = np.zeros((len(queries), k))
        best = np.partition(np.concatenate([best, scores[every, first]], 1), BLOCK, axis=1)[:, BLOCK:]
        least = best.min(1)
        for b in range(self.blocks):
            pivots = np.flatnonzero((bounds[:, b] > 0) & (bounds[:, b] >= least - 1e-6 * (1 + least)) & (first != b))
            if not len(pivots):
                continue
            got = weights[pivots] @ self.long[b].T + given[pivots, b]
            scores[pivots, b] = got
            best[pivots] = np.partition(np.concatenate([best[pivots], got], 1), BLOCK, axis=1)[:, BLOCK:]
            least[pivots] = best[pivots].min(1)
        out = []
        for q, row in enumerate(scores.reshape(len(queries), -1)[:, : len(self.ids)]):
            among = np.flatnonzero((row > 0) & (row >= least[q] - 1e-6 * (1 + least[q])))
            top = np.lexsort((self.ids[among], -np.round(row[among], 6)))[:k]  # equal texts tie, in whatever block they are
            out.append((self.ids[among][top], row[among][top]))
        return out


def _searched(block, mean_words: float, k: int, shard_chars: int):
    """Of a partition: an index for each shard_chars characters of it, and what all queries of the block find there."""

    def hits(docs: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, terms, weights, ends = block.value
        index = ShardIndex(docs, mean_words)
        docs.clear()
        for at in range(0, len(ids), TOGETHER):
            asked = range(at, min(at + TOGETHER, len(ids)))
            found = index.search([(terms[ends[q] : ends[q + 1]], weights[ends[q] : ends[q + 1]]) for q in asked], k)
            cols = (np.repeat(ids[asked], [len(f[0]) for f in found]), *[np.concatenate(c) for c in zip(*found, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple] = []
        chars = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                docs.append((doc_id, *term_ids(text)))
                chars += len(text) + 64
                if chars >= shard_chars:
                    yield from hits(docs)
                    chars = 0
        if docs:
            yield from hits(docs)

    return run


def _query_blocks(ready: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """ready with _block, and their number: none has more than block_bytes but for a single query of that size."""
    sized = ready.select("query_id", (16 * F.size("terms") + 16).alias("_bytes"))
    total, count = sized.agg(F.sum("_bytes"), F.count(F.lit(1))).first()
    blocks = int((total or 0) // block_bytes) + 1
    while blocks < (count or 0):
        most = sized.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks))).agg(F.sum("_bytes").alias("n")).agg(F.max("n")).first()[0]
        if most <= block_bytes:
            break
        blocks = blocks + 1 + blocks // 4
    return ready.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), blocks


def search(docs: DataFrame, queries: DataFrame, k: int = K, shard_chars: int = SHARD_CHARS, block_bytes: int = QUERY_BYTES) -> DataFrame:
    """The k best rows of docs (doc_id, text) for each row of queries (query_id, text): query_id, rank, doc_id, score.

    score = sum over distinct query words of tf_query * ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 *
    (0.25 + 0.75 * words / mean words)), N, df and the mean over all docs; words in lower case (A-Z). Ties go to the
    lesser doc_id. Rows without a common word aren't hits; a null or empty query has none; a null doc_id can't be a hit;
    rows that repeat a doc_id are documents of their own, and so are queries that share an id, as one. Queries go to all
    workers in blocks of at most block_bytes; each partition of docs indexes itself and looks every query of the block up,
    so that neither documents nor copies of queries are shuffled.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    queries = queries.select(F.col("query_id").cast("long"), "text").where("query_id is not null")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = int(chars // (16 << 20)) + 1
    counts = stash(byte_batches(docs.select("text"), _counted(parts), "part long, terms binary, dfs binary"), "dfs")
    n = words = 0
    for row in counts.where("part = -1").select("terms").toLocalIterator():  # two numbers a task
        a = np.frombuffer(row.terms, np.int64)
        n, words = n + int(a[0]), words + int(a[1])
    mean_words = words / n if n else 1.0
    terms = byte_batches(queries, _query_terms, "query_id long, term long, tf long").withColumn("part", F.pmod("term", F.lit(parts)))
    with_df = counts.where("part >= 0").groupBy("part").cogroup(terms.groupBy("part")).applyInArrow(_with_df, "query_id long, term long, tf long, df long")
    weight = F.col("tf") * F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = with_df.where("df > 0").groupBy("query_id", "term").agg(F.sum(weight).alias("w"))
    ready = weighed.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("t")).select("query_id", F.col("t.term").alias("terms"), F.col("t.w").alias("weights"))
    ready, blocks = _query_blocks(stash(ready, "queries"), block_bytes)
    found = None
    for b in range(blocks):
        rows = ready.where(F.col("_block") == b).toArrow()  # block_bytes at most
        lists = [rows.column(c).combine_chunks() for c in ("terms", "weights")]
        flat = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
        lens = lists[0].value_lengths().to_numpy(zero_copy_only=False) if rows.num_rows else np.zeros(0, np.int64)
        block = spark.sparkContext.broadcast((rows.column("query_id").to_numpy(), *flat, np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)))
        hits = stash(byte_batches(docs, _searched(block, mean_words, k, shard_chars), "query_id long, doc_id long, score double"), "hits")
        block.unpersist()
        found = hits if found is None else found.unionByName(hits)
    discard(counts)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "doc_id"))
    return found.withColumn("rank", best.cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", F.round("score", 4).alias("score"))


def op7_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search() over all documents for those whose doc_id is divisible by 100."""
    docs = table(spark, sf_dir, "documents")
    return search(docs, docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text"))


SQL = """
WITH words AS (
  SELECT doc_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS w FROM documents),
tfs AS (SELECT doc_id, w, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf) AS n FROM tfs GROUP BY ALL),
stats AS (SELECT count(*) AS docs, (SELECT sum(n) FROM lengths) / count(*) AS mean FROM documents),
dfs AS (SELECT w, ln(1 + ((SELECT docs FROM stats) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tfs GROUP BY w),
scores AS (
  SELECT q.doc_id AS query_id, d.doc_id, sum(q.tf * idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score
  FROM tfs q JOIN dfs USING (w) JOIN tfs d USING (w) JOIN lengths l ON l.doc_id = d.doc_id CROSS JOIN stats
  WHERE q.doc_id % 100 = 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scores)
SELECT query_id, rank, doc_id, round(score, 4) AS score FROM ranked WHERE rank <= 10
"""
