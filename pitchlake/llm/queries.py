"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitchlake.llm import bm25_search, bpe, conversation_repair, fingerprints, html_text, jaccard_join, line_dedup, merkle_manifest, mixing, mixing_lm, quality_model, quality_rules, sharding


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": sharding.op1_sharding,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality_model": quality_model.op3_quality_model,
    "op4_divergence": quality_rules.op4_divergence,
    "op5_html_text": html_text.op5_html_text,
    "op6_jaccard": jaccard_join.op6_jaccard,
    "op7_bm25": bm25_search.op7_bm25,
    "op8_mixing_lm": mixing_lm.op8_mixing_lm,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_bpe": bpe.op10_bpe,
    "op11_merkle": merkle_manifest.op11_merkle,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_fingerprints": fingerprints.op13_fingerprints,
    "pipeline": _pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op6_jaccard": jaccard_join.SQL,
    "op7_bm25": bm25_search.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op11_merkle": merkle_manifest.SQL,
    "op12_conversation_repair": conversation_repair.SQL,
    "op13_fingerprints": fingerprints.SQL,
}
