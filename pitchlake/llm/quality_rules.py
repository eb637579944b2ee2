"""Quality rules: base counts of a text and how far its characters and words are from its language's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.llm.common import byte_batches, few, fresh, stash, table

# Function words that are common in English, German, French and Spanish.
COMMON = (
    "the of and to in a is that it for on was as with be by are this from have not at or "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "de la le et les des en un une du que est pour qui dans par sur pas plus au avec ce il ne se "
    "el y los del las con una su al lo como más pero sus le ya o este sí porque"
)
COMMON_WORDS = tuple(dict.fromkeys(w.encode() for w in COMMON.split()))
#: lower and digits, upper, letters beyond ASCII, white space, full stop and comma, quotes and brackets, symbols, the rest
CLASSES = 8
BINS = CLASSES + len(COMMON_WORDS) + 1
MIN_TEXT_WORDS, MAX_REPEATED = 20, 30
#: Jensen-Shannon distances (base 2, so at most 1) beyond which a text is rejected, and the lengths below which it isn't judged.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.18, 0.45
MIN_CHARS, MIN_WORDS = 100, 40

_CLASS = np.full(128, 7, np.int64)
_CLASS[[*range(97, 123)]] = 0
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(48, 58)]] = 0  # numbers and keys are no sign of junk
_CLASS[[32, *range(9, 14)]] = 3
_CLASS[[ord(c) for c in ".,"]] = 4
_CLASS[[ord(c) for c in "\"'()[]-:;?"]] = 5
_CLASS[[ord(c) for c in "#*$%&|<>!=@~^_+\\/{}"]] = 6
_SYMBOLS = np.zeros(128, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_PLACE = {w: CLASSES + k for k, w in enumerate(COMMON_WORDS)}


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """How many words lie in a window of so many words that the text has at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    if len(names) == len(words):
        return 0
    size = 1
    while size < window:  # ids become those of windows of twice the size: equal ids, equal words
        pairs = ids[: len(ids) - size] * (len(words) + 1) + ids[size:]
        ids = np.unique(pairs, return_inverse=True)[1]
        size *= 2
    hit = np.bincount(ids)[ids] > 1
    if not hit.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(hit), 1)
    np.add.at(edge, np.flatnonzero(hit) + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the histograms of a text; a null text has none."""
    hist = np.zeros(BINS, np.int64)
    if not text:
        return 0, 0, 0, 0, 0, hist
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    ascii_codes = codes[codes < 128]
    classes = np.bincount(_CLASS[ascii_codes], minlength=CLASSES)
    classes[2] += sum(map(str.isalpha, filter(lambda c: c > "\x7f", text))) if len(ascii_codes) < len(codes) else 0
    classes[7] += len(codes) - len(ascii_codes) - classes[2]
    hist[:CLASSES] = classes
    for w in raw.lower().split():
        at = _PLACE.get(w)
        if at is not None:
            hist[at] += 1
    hist[-1] = len(words) - hist[CLASSES:-1].sum()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), len(codes) - int(classes[3]), int(_SYMBOLS[ascii_codes].sum()), len(lines) - len(set(lines)), repeated_words(words), hist


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(t.as_py()) for t in batch.column("_text")]
        out = batch.select([n for n in batch.schema.names if n != "_text"])
        for k, name in enumerate(COUNTS):
            out = out.append_column(name, pa.array([r[k] for r in rows], pa.int64()))
        yield out.append_column("_hist", pa.array([r[5] for r in rows], pa.list_(pa.int64())))


def _entropy(p: np.ndarray) -> np.ndarray:
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(1)


def jensen_shannon(own: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Distances of the rows of two count matrices, 0 to 1; rows without counts give 0."""
    p = own / np.maximum(own.sum(1, keepdims=True), 1)
    q = reference / np.maximum(reference.sum(1, keepdims=True), 1)
    gap = _entropy((p + q) / 2) - (_entropy(p) + _entropy(q)) / 2
    return np.where((own.sum(1) > 0) & (reference.sum(1) > 0), np.sqrt(np.clip(gap, 0, 1)), 0.0)


def _judged(names: list[str]):
    names = [n for n in names if n not in ("char_distance", "word_distance")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, ref = (np.array([[0] * BINS if x is None else x for x in batch.column(n).to_pylist()], float) for n in ("_hist", "_reference"))
                out = batch.select(names).append_column("char_distance", pa.array(jensen_shannon(own[:, :CLASSES], ref[:, :CLASSES])))
                yield out.append_column("word_distance", pa.array(jensen_shannon(own[:, CLASSES:], ref[:, CLASSES:])))

    return run


def _compared(rows: DataFrame, reference: DataFrame, keep_hist: bool = False) -> DataFrame:
    """rows with their distances to the sum of the histograms that reference has for their language."""
    sums = [F.sum(F.col("_hist")[k]) for k in range(BINS)]
    refs = reference.groupBy(F.col("_lang").alias("_l")).agg(F.array(*sums).alias("_reference"))
    joined = rows.join(few(refs), F.col("_lang") == F.col("_l"), "left").drop("_l")
    schema = joined.drop("_reference", *([] if keep_hist else ["_hist"])).schema
    return byte_batches(joined, _judged(schema.names), schema.add("char_distance", "double").add("word_distance", "double"))


def judge(docs: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """Per row of docs: id_cols, the base counts, char_distance, word_distance, base_failed and kept.

    A language's reference is the sum of the histograms of its documents that pass the base rule, taken twice: first of
    all of them, then of those that are nearer to the first than the language's median; null is a language of its own. A text under MIN_CHARS characters or MIN_WORDS words isn't judged by the distance concerned.
    Null and empty texts have counts of 0 and fail the base rule; repeated rows are judged alike.
    """
    rows = docs.select(*id_cols, F.coalesce(F.col("lang").cast("string"), F.lit("\0")).alias("_lang"), F.col("text").alias("_text"))
    schema = rows.drop("_text").schema
    for name in COUNTS:
        schema = schema.add(name, "long")
    rows = stash(byte_batches(rows, _measured, schema.add("_hist", T.ArrayType(T.LongType()))), "rules")
    failed = (F.col("n_words") < MIN_TEXT_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    first = _compared(rows, rows.where(~F.col("base_failed")), keep_hist=True)
    first = first.where(~F.col("base_failed"))
    middle = first.groupBy(F.col("_lang").alias("_m")).agg(F.percentile_approx("char_distance", 0.5, 1000).alias("_median"))
    near = first.join(few(middle), F.col("_lang") == F.col("_m")).where("char_distance <= _median")
    judged = _compared(rows, near)
    chars_far = (F.col("word_chars") >= MIN_CHARS) & (F.col("char_distance") > max_char)
    words_far = (F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > max_word)
    return judged.drop("_lang").withColumn("kept", ~(F.col("base_failed") | chars_far | words_far))


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without the rows that judge() rejects; rows and columns are otherwise unchanged, repeated rows stay."""
    (key,) = fresh(docs, "_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "lang", "text"))
    good = judge(keyed, (key,)).where("kept").select(key).distinct()
    return keyed.join(good, key, "left_semi").select(*docs.columns)


def op4_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge() over all documents: doc_id, the base counts, base_failed, kept and both distances."""
    return judge(table(spark, sf_dir, "documents"))


SQL = None
