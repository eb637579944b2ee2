"""Link groups of any size that fit in a shard stay whole."""

from collections import Counter

from pyspark.sql import functions as F

from pitchlake.llm import sharding


def test_a_large_group_that_fits_in_a_shard_stays_whole(spark):
    ids = spark.range(180_000)
    docs = ids.select(F.col("id").alias("doc_id"), F.when(F.col("id") < 53_000, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    out = sharding.shard_documents(docs, 3).select("doc_id", "shard", "slot").cache()
    assert {r["count"] for r in out.groupBy("shard").count().collect()} == {60_000}
    assert out.select("shard", "slot").distinct().count() == 180_000
    assert out.where("doc_id < 53000").select("shard").distinct().count() == 1
    out.unpersist()


def test_rows_of_large_groups_leave_last(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE_ROWS", 20)
    groups = [(k, 1 if k < 40 else 2 if k < 90 else 3 if k < 120 else None) for k in range(130)]
    labels = spark.createDataFrame([(k, g, 0 if k < 120 else 1) for k, g in groups], "doc_id long, _group long, shard int")
    out = sharding._even_out(labels, [65, 65], 2).collect()
    assert Counter(r.shard for r in out) == {0: 65, 1: 65}
    by = Counter((r._group, r.shard) for r in out)
    assert by[3, 1] == 30 and by[1, 1] == 25 and by[2, 0] == 50  # the smallest group first
