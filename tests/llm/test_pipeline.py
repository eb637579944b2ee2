"""The corpus pipeline stage by stage on awkward documents."""

from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pitchlake.llm import bpe, jaccard_join, line_dedup, mixing, quality_rules  # noqa: E402
from tests.llm.fixtures import SCHEMA, documents  # noqa: E402


def test_stages(spark, tmp_path):
    rows = documents(5, 80)
    source = spark.createDataFrame(rows, SCHEMA)
    source.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "repeated_lines", "source_mixture", "byte_pairs"]
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
        if name == "quality_rules":
            kept = Counter((r.doc_id, r.text) for r in after.collect())
            want = Counter({(d, t): n for (d, t, *_), n in Counter(map(tuple, rows)).items() if (d, t) in kept})
            assert kept == want and all(quality_rules.measure(t)[0] >= 20 for _, t in kept)
        if name == "near_duplicates":
            parts = {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(before).collect()}
            assert {r.doc_id for r in after.collect()} == {c for _, c in parts}
        if name == "repeated_lines":
            want = Counter((r.doc_id, r.text) for r in line_dedup.deduplicated(before).collect())
            assert Counter((r.doc_id, r.text) for r in after.collect()) == want and after.count() == before.count()
            assert all(r.n_chars == len(r.text) for r in after.where("text is not null").collect())
        if name == "source_mixture":
            assert after.count() == sum(r.copies for r in mixing.mix(before).collect())
        if name == "byte_pairs":
            tok = bpe.codec(bpe.vocabulary())
            assert after.count() == before.count()
            for r in after.collect():
                assert r.round_trip and r.n_tokens == len(r.token_ids) and tok.decode(r.token_ids) == (r.text or "")
        before = after
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((r.doc_id, r.n_tokens) for r in out.collect()) == Counter((r.doc_id, r.n_tokens) for r in before.collect())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
