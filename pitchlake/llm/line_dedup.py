"""Substring dedup by hashing lines in parts: of equal passages in the whole corpus only the earliest stays."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.llm.common import byte_batches, discard, fresh, stash, table

#: Shorter units are no evidence of copying and stay.
MIN_WORDS = 8
#: A word with the white space behind it.
TOKEN = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
SPACES = " \t\n\x0b\x0c\r"
SPANS = T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()))


def pieces(text: str, unit: str = "sentence") -> tuple[list[str], list[int]]:
    """The words of a text with the white space behind them, and the number of the first word of each piece.

    unit `sentence`: a piece starts after a line end or a word that ends in one of .!?, and at a capital; `line`: after a
    line end; `paragraph`: after an empty line.
    """
    words = TOKEN.findall(text)
    if unit == "sentence":
        starts = [k for k, (w, before) in enumerate(zip(words[1:], words, strict=False), 1) if w[0].isupper() or "\n" in before or before.rstrip(SPACES)[-1] in ".!?"]
    else:
        least = 1 if unit == "line" else 2
        starts = [k for k, before in enumerate(words[:-1], 1) if before.count("\n") >= least]
    return words, [0, *starts] if words else []


def runs(n: int, starts: list[int], min_words: int) -> list[tuple[int, int]]:
    """Units as (first word, word after the last): from each piece on the fewest pieces with min_words words, and for ends
    that none of these has, the fewest pieces that end there."""
    ends = [*starts[1:], n]
    found = []
    for a in starts:
        k = bisect_left(ends, a + min_words)
        if k == len(ends):
            break
        found.append((a, ends[k]))
    met = {e for _, e in found}
    found += [(starts[bisect_right(starts, e - min_words) - 1], e) for e in ends if e >= min_words and e not in met]
    return found


def _units(min_words: int, unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text, row in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                whole = text.as_py() or ""
                words, starts = pieces(whole, unit)
                if len(words) < min_words:
                    continue
                plain = whole.encode("utf-8", "replace").lower().split()
                for a, e in runs(len(words), starts, min_words):
                    digest = xxhash.xxh3_128_intdigest(b" ".join(plain[a:e]))
                    for col, v in zip(cols, (doc_id, row, a << 32 | e, (digest >> 64) - (1 << 63), (digest & 0xFFFFFFFFFFFFFFFF) - (1 << 63)), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "text_hash", "run", "h1", "h2"])

    return run


def _marks(docs: DataFrame, min_words: int, unit: str) -> DataFrame:
    """doc_id, text_hash, marks: the units of a document that aren't the earliest; a document is a doc_id, null too, and its text."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text"))
    rows = stash(byte_batches(rows, _units(min_words, unit), "doc_id long, text_hash long, run long, h1 long, h2 long"), "units")
    several = rows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "run", "text_hash")).alias("first"), F.max(F.struct("doc_id", "run", "text_hash")).alias("last")).where("first <> last")
    several = stash(several.select("h1", "h2", "first"), "repeated")  # read anew, so that a join may split its largest units
    again = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("run") == F.col("first.run")) & (F.col("text_hash") == F.col("first.text_hash")))
    found = stash(rows.join(several, ["h1", "h2"]).where(again).select("doc_id", "text_hash", "run"), "marks")
    discard(rows, several)
    return found.groupBy("doc_id", "text_hash").agg(F.collect_set("run").alias("marks"))


def cut(text: str, marks: list[int], unit: str = "sentence") -> tuple[str, list[dict[str, int]]]:
    """text without the units that marks number, and what went as (start, end) in code points of the original."""
    words, starts = pieces(text, unit)
    gone = [False] * len(words)
    for m in marks:
        a, e = m >> 32, m & 0xFFFFFFFF
        gone[a:e] = [True] * (e - a)
    kept, spans, at = [], [], 0
    lead = len(text) - sum(map(len, words))
    for k, a in enumerate(starts):
        e = starts[k + 1] if k + 1 < len(starts) else len(words)
        piece = (text[:lead] if k == 0 else "") + "".join(words[a:e])
        if not gone[a]:
            kept.append(piece)
        elif spans and spans[-1]["end"] == at:
            spans[-1]["end"] = at + len(piece)
        else:
            spans.append({"start": at, "end": at + len(piece)})
        at += len(piece)
    return "".join(kept), spans


def _cut(text: str, marks: str, spans: str, unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = [], []
            for t, m in zip(batch.column(text), batch.column(marks), strict=True):
                t, m = t.as_py(), m.as_py()
                t, s = cut(t, m, unit) if m else (t, [])
                texts.append(t)
                found.append(s)
            at = batch.schema.get_field_index(text)
            out = batch.set_column(at, pa.field(text, pa.string()), pa.array(texts, pa.string()))
            out = out.select([n for n in out.schema.names if n != marks])
            yield out.append_column(spans, pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))

    return run


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, unit: str = "sentence", spans: str = "spans") -> DataFrame:
    """docs with the repeated units cut out of their texts, and spans, what went: start and end in code points of the
    original text, in order, neighbours as one.

    Texts fall into pieces at line ends, sentence ends and capitals (unit `line` or `paragraph`: there only); a unit is a
    run of whole pieces with at least min_words words, so that a passage is found wherever in a line it starts. A-Z counts
    as a-z and a run of white space as one space. Of equal units that with the smallest (doc_id, place) stays, and a piece
    goes with any unit that goes; each piece that goes has an equal one at an earlier place, so none is lost. A null or
    empty text has no units; a null doc_id ranks first. Rows that repeat a doc_id and its text are one document and none
    of them loses its units to the other; other texts under one doc_id, or without one, are documents of their own, by a
    hash of the text where (doc_id, place) ties. No row goes, other columns stay; a column of spans' name is replaced. The
    number of copies of a unit is not bounded: the earliest is found by sums before the shuffle, and the join back has 40
    bytes a unit and no grouping by unit.
    """
    docs = docs.drop(spans)
    marks, key, text = fresh(docs, "_marks", "_id", "_hash")
    found = _marks(docs, min_words, unit).toDF(key, text, marks)
    joined = docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(text)), "left").drop(key, text)
    return byte_batches(joined, _cut("text", marks, spans, unit), docs.schema.add(spans, SPANS))


def without_repeated_units(docs: DataFrame, min_words: int = MIN_WORDS, unit: str = "sentence") -> DataFrame:
    """deduplicated() with the columns of docs only, in their order."""
    (spans,) = fresh(docs, "_spans")
    return deduplicated(docs, min_words, unit, spans).drop(spans)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deduplicated() over all documents: doc_id, text, n_removed (code points) and removed, the spans as `start-end`."""
    rows = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    spelled = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), " ")
    return rows.select("doc_id", "text", size.alias("n_removed"), spelled.alias("removed"))


SQL = f"""
WITH split AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*') AS t FROM documents),
flat AS (SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS k FROM split),
before AS (SELECT *, lag(tok) OVER (PARTITION BY doc_id ORDER BY k) AS prev FROM flat),
marked AS (
  SELECT doc_id, k, tok, CASE WHEN k = 1 OR regexp_matches(tok, '^\\p{{Lu}}') OR contains(prev, chr(10)) OR regexp_matches(prev, '[.!?][\\x20\\x09-\\x0D]+$') THEN 1 ELSE 0 END AS b FROM before),
numbered AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY k) AS piece FROM marked),
pieces AS (
  SELECT doc_id, piece, min(k) - 1 AS a, max(k) AS e, string_agg(tok, '' ORDER BY k) AS body FROM numbered GROUP BY doc_id, piece),
words AS (
  SELECT doc_id, list_transform(t, lambda w: translate(regexp_replace(w, '[\\x20\\x09-\\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM split),
forward AS (
  SELECT p.doc_id, p.a, min(q.e) AS e FROM pieces p JOIN pieces q ON p.doc_id = q.doc_id AND q.e >= p.a + {MIN_WORDS} GROUP BY p.doc_id, p.a),
backward AS (
  SELECT p.doc_id, max(q.a) AS a, p.e FROM pieces p JOIN pieces q ON p.doc_id = q.doc_id AND q.a <= p.e - {MIN_WORDS}
  WHERE NOT EXISTS (SELECT 1 FROM forward f WHERE f.doc_id = p.doc_id AND f.e = p.e) GROUP BY p.doc_id, p.e),
runs AS (SELECT doc_id, a, e FROM forward UNION ALL SELECT doc_id, a, e FROM backward),
units AS (SELECT r.*, array_to_string(list_slice(w, r.a + 1, r.e), ' ') AS unit FROM runs r JOIN words USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY doc_id, a) AS r FROM units),
gone AS (SELECT DISTINCT p.doc_id, p.piece FROM ranked r JOIN pieces p ON p.doc_id = r.doc_id AND p.a >= r.a AND p.e <= r.e WHERE r.r > 1),
placed AS (
  SELECT p.*, g.piece IS NOT NULL AS out, length(body) + CASE WHEN p.piece = 1 THEN length(s.text) - sum(length(body)) OVER (PARTITION BY p.doc_id) ELSE 0 END AS n,
    CASE WHEN p.piece = 1 THEN left(s.text, CAST(length(s.text) - sum(length(body)) OVER (PARTITION BY p.doc_id) AS BIGINT)) ELSE '' END || body AS whole
  FROM pieces p JOIN split s USING (doc_id) LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.piece = p.piece),
ends AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY piece) AS BIGINT) AS upto, piece - row_number() OVER (PARTITION BY doc_id, out ORDER BY piece) AS island FROM placed),
kept AS (SELECT doc_id, string_agg(whole, '' ORDER BY piece) FILTER (WHERE NOT out) AS text, CAST(coalesce(sum(n) FILTER (WHERE out), 0) AS BIGINT) AS n_removed FROM placed GROUP BY doc_id),
islands AS (SELECT doc_id, CAST(min(upto - n) AS BIGINT) AS s, max(upto) AS e FROM ends WHERE out GROUP BY doc_id, island),
spelled AS (SELECT doc_id, string_agg(s || '-' || e, ' ' ORDER BY s) AS removed FROM islands GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN k.doc_id IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text, coalesce(k.n_removed, 0) AS n_removed, coalesce(p.removed, '') AS removed
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN spelled p USING (doc_id)
"""
