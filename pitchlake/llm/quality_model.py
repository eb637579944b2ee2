"""Quality classifier: ordinal cumulative-link regression on graded documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.llm.common import byte_batches, table, tokens

BITS = 18
#: The fit takes so many labelled rows at most, those with the smallest hashes of doc_id.
MOST_LABELLED = 8_000
STEPS, RATE, RIDGE, LASSO = 300, 2.0, 1e-4, 3e-3
#: Slots that fewer rows, or a lesser share of them, have keep weight 0.
LEAST_SEEN, LEAST_SHARE = 3, 0.003
GRADES = 3


def features(text: str | None) -> np.ndarray:
    """Sorted distinct slots of a text: its words, and how many of them have symbols, capitals only or occur again."""
    words = tokens(text, lower=False)
    n = max(len(words), 1)
    distinct = set(words)
    share = (
        sum(any(c in w for c in b"#*$%&|<>") for w in words) / n,
        sum(w.isupper() and len(w) > 1 for w in words) / n,
        1 - len(distinct) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
    )
    shape = [b"\0%d:%d" % (k, min(int(10 * s), 9)) for k, s in enumerate(share)]
    lowered = {w.strip(b".,;:!?\"'()").lower() for w in distinct}
    mask = (1 << BITS) - 1
    return np.unique(np.fromiter((zlib.crc32(w) & mask for w in [*lowered, *shape, b"\0len:%d" % n.bit_length()]), np.int32))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = [features(t.as_py()) for t in batch.column("text")]
        yield batch.select(["grade"]).append_column("slots", pa.array(slots, pa.list_(pa.int32())))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_ordinal(grades: np.ndarray, slots: list[np.ndarray], n_grades: int = GRADES, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds with P(grade >= k) = sigmoid(score - threshold[k - 1]), score = sum of weights.

    Full gradients with momentum; each step draws weights towards 0 (LASSO), so that words which tell nothing stay there.
    Without rows all grades are equally likely.
    """
    weights = np.zeros(1 << BITS, np.float32)
    counts = np.bincount(grades, minlength=n_grades) + 1.0 if len(grades) else np.ones(n_grades)
    above = 1 - np.cumsum(counts)[:-1] / counts.sum()
    thresholds = -np.log(above / (1 - above))
    if not len(grades):
        return weights, thresholds
    flat = np.concatenate(slots)
    ends = np.cumsum([len(s) for s in slots])
    seen = np.bincount(flat, minlength=1 << BITS) >= max(LEAST_SEEN, LEAST_SHARE * len(grades))
    per_row = np.diff(ends, prepend=0)
    starts = ends - per_row
    balance = (len(grades) / (n_grades * counts))[grades]
    speed, threshold_squares = np.zeros(1 << BITS), np.full(n_grades - 1, 1e-3)
    for _ in range(steps):
        score = np.add.reduceat(weights[flat], starts)
        cum = _sigmoid(score[:, None] - thresholds[None, :])  # P(grade >= 1), P(grade >= 2), ...
        bounds = np.hstack([np.ones((len(score), 1)), cum, np.zeros((len(score), 1))])
        p = np.maximum(bounds[np.arange(len(score)), grades] - bounds[np.arange(len(score)), grades + 1], 1e-9)
        slope = np.hstack([np.zeros((len(score), 1)), cum * (1 - cum), np.zeros((len(score), 1))])
        up, down = slope[np.arange(len(score)), grades], slope[np.arange(len(score)), grades + 1]
        g = -balance * (up - down) / p / len(score)
        grad = np.bincount(flat, np.repeat(g, per_row), 1 << BITS) * seen + RIDGE * weights
        speed = 0.9 * speed - RATE * grad
        moved = weights + speed
        weights = (np.sign(moved) * np.maximum(np.abs(moved) - RATE * LASSO, 0)).astype(np.float32)
        t_grad = np.zeros(n_grades - 1)
        np.add.at(t_grad, np.clip(grades - 1, 0, n_grades - 2), np.where(grades > 0, balance * up / p, 0) / len(score))
        np.add.at(t_grad, np.clip(grades, 0, n_grades - 2), np.where(grades < n_grades - 1, -balance * down / p, 0) / len(score))
        threshold_squares += t_grad**2
        thresholds = np.maximum.accumulate(thresholds - RATE * t_grad / np.sqrt(threshold_squares))
    return weights, thresholds


def fit(docs: DataFrame, graded: DataFrame, most: int = MOST_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """fit_ordinal() on the documents (doc_id, text) that graded (doc_id, grade) has; at most `most` graded ids count,
    those with the smallest hashes; of several grades the lowest does, of several texts of an id the least."""
    one = graded.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min(F.col("grade").cast("int")).alias("grade"))
    picked = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("text").alias("text")).select("grade", "text")
    slots, grades = [], []
    for row in byte_batches(rows, _featured, "grade int, slots array<int>").toLocalIterator():
        grades.append(row.grade)
        slots.append(np.array(row.slots, np.int32))
    return fit_ordinal(np.array(grades, int), slots)


def grades_of(labels: DataFrame) -> DataFrame:
    """Grades from labels (doc_id, quality, toxic): 0 toxic, 1 of low quality, 2 good; a row with a null has none."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when((F.col("toxic") == 0) & (F.col("quality") == 0), 1).when((F.col("toxic") == 0) & (F.col("quality") == 1), 2).alias("grade"))


def _scored(weights: np.ndarray, thresholds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.array([float(weights[features(t.as_py())].sum()) for t in batch.column("_text")])
            cum = _sigmoid(score[:, None] - thresholds[None, :]) if len(score) else np.zeros((0, len(thresholds)))
            out = batch.select([n for n in batch.schema.names if n != "_text"])
            for name, x in (("expected_grade", cum.sum(1)), ("not_worst", cum[:, 0]), ("top_grade", cum[:, -1])):
                out = out.append_column(name, pa.array(x, pa.float64()))
            yield out

    return run


def classify(docs: DataFrame, weights: np.ndarray, thresholds: np.ndarray, least: float = 0.5) -> DataFrame:
    """Per row of docs: doc_id, expected_grade, not_worst = P(grade > 0), top_grade = P(grade = highest), kept.

    kept: the highest grade has probability `least` or more. A null or empty text has only features of shape. Repeated
    rows get equal results.
    """
    rows = docs.select("doc_id", F.col("text").alias("_text"))
    schema = rows.drop("_text").schema.add("expected_grade", "double").add("not_worst", "double").add("top_grade", "double")
    return byte_batches(rows, _scored(weights, thresholds), schema).withColumn("kept", F.col("top_grade") >= least)


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """classify() all documents by a model fitted on labels: toxic, of low quality, good."""
    docs = table(spark, sf_dir, "documents")
    return classify(docs, *fit(docs, grades_of(table(spark, sf_dir, "labels"))))


SQL = None
