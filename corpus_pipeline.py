"""From raw documents to a deduplicated, mixed and tokenized corpus, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.llm.bpe import encode, vocabulary
from pitchlake.llm.common import stash, table
from pitchlake.llm.jaccard_join import one_of_each
from pitchlake.llm.line_dedup import without_repeated_units
from pitchlake.llm.mixing import mixed_rows
from pitchlake.llm.quality_rules import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null, empty and short texts among them. Repeated rows are judged alike and stay;
    a null language is a language of its own. An empty table stays empty."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id, a null one last. Rows that repeat its
    doc_id and text stay with it; null and empty texts are like nothing and stay."""
    return one_of_each(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of passages that documents have again, the earliest by (doc_id, place) stays, a null doc_id first; n_chars follows the
    text. No row goes; null and empty texts are unchanged, and rows that repeat doc_id and text are one document."""
    cut = without_repeated_units(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: sources come near their targets, null is a source of its own. A null or empty
    text is never taken in part. Which of rows that tie in doc_id and text is taken is open."""
    return mixed_rows(docs)


def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents' columns with token_ids, n_tokens, and whether decoding gives the text back; a null text is an empty one.
    No row goes, repeated ones neither."""
    path = vocabulary()
    rows = encode(docs, path, decoded=True)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return rows.select(*docs.columns, "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_lines", repeated_lines),
    ("source_mixture", source_mixture),
    ("byte_pairs", byte_pairs),
]

#: Divergence, sampling keys and merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each stage's result is a written table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
