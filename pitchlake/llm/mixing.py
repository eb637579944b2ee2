"""Mixing sources to target weights by Efraimidis-Spirakis sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchlake.llm.common import WORD, few, fresh, stash, table, unit_hash

#: Relative weights of the sources in code point order, repeating; all sizes together times SHARE are asked for.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Rows of a source that one task sorts.
BUCKET_ROWS = 20_000


def text_quality(text: Column) -> Column:
    """A document's weight: its share of characters that are no symbols, digits or capitals, 0.05 at least."""
    odd = F.length(text) - F.length(F.translate(text, "0123456789#*$%&|<>!ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return F.greatest(F.lit(0.05), F.coalesce(1 - odd / F.greatest(F.length(text), F.lit(1)), F.lit(0.05)))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source_key, source_size) with target.

    The k-th source by source_key weighs weights[k mod len]. target = level * weight, or most * source_size where that is
    less; the level makes the targets add up to share * all sizes. Each turn holds the sources found above their limit
    and shares out the rest; turns go on until none is above. Only three sums a turn come to the driver.
    """
    # A source's place is the sum of the counts of the first bytes before it and its place among those of its own.
    first = F.substring("source_key", 1, 4)
    heads = sources.groupBy(first.alias("_head")).agg(F.count(F.lit(1)).alias("_n"))
    heads = heads.withColumn("_start", F.sum("_n").over(Window.orderBy("_head")) - F.col("_n")).drop("_n")
    ranked = sources.withColumn("_head", first).join(heads, "_head")
    ranked = ranked.withColumn("_k", F.col("_start") + F.row_number().over(Window.partitionBy("_head").orderBy("source_key")) - 1).drop("_head", "_start")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("_k", F.lit(len(weights))) + 1).cast("int"))
    ranked = stash(ranked.withColumn("_w", weight.cast("long")).drop("_k"), "sources")
    asked = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    limit, level, held = F.col("source_size") * most, None, -1
    while True:
        over = F.lit(False) if level is None else (limit < F.lit(level) * F.col("_w"))
        row = ranked.agg(F.sum(F.when(over, limit)).alias("s"), F.sum(F.when(~over, F.col("_w"))).alias("w"), F.count(F.when(over, 1)).alias("n")).first()
        if row.n == held or not row.w:
            break
        held, level = row.n, (asked - (row.s or 0.0)) / row.w
    target = F.least(limit, F.lit(level or 0.0) * F.col("_w")).cast("double")
    return ranked.withColumn("target", target).drop("_w")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, quality: Column | None = None, seed: int = 17, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs with size, source_size, target, epochs and copies: how often the mix takes each row.

    Whole passes over a source come first (epochs = floor(target / source_size)); the rest of the target is filled by
    rows in the order of -ln(u) / quality, u in (0, 1) from seed, doc_id and text, until the next row would come less
    near. Sources sort by code point, null last as a source of its own. A null or empty text has size 0 and is never
    taken in part; a null quality counts as 0.05. Rows that agree in doc_id and text tie and either may be taken; other
    results don't depend on partitioning. Names of the new columns replace those of docs. A source is never sorted whole:
    sums over key ranges say where its target falls, and only that range is sorted.
    """
    weight = text_quality(F.col("text")) if quality is None else F.greatest(F.coalesce(quality.cast("double"), F.lit(0.05)), F.lit(1e-6))
    docs = docs.select("doc_id", "text", "source", *([] if quality is None else [weight.alias("_weight")]))
    key = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit("")))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    draw = -F.log(unit_hash(F.lit(seed), F.col("doc_id"), F.xxhash64("text")) + F.lit(2.0**-54)) / (weight if quality is None else F.col("_weight"))
    rows = stash(docs.select("doc_id", F.xxhash64("text").alias("_text"), key.alias("source_key"), size.alias("size"), draw.alias("_draw"), (weight if quality is None else F.col("_weight")).alias("_w")), "mix")
    targets = source_targets(rows.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    targets = targets.withColumn("epochs", epochs).withColumn("_rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # The share of a source's draws below x is 1 - mean(exp(-weight * x)), from its weights in 64 bins at most: that rises
    # with x and is about even on (0, 1), whatever the weights.
    bins = rows.groupBy("source_key", F.least(F.lit(63), F.greatest(F.lit(0), F.floor(-8 * F.log("_w")))).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"), F.avg("_w").alias("_mean"))
    bins = bins.groupBy("source_key").agg(F.sum("_n").alias("_all"), F.collect_list(F.struct("_n", "_mean")).alias("_bins"))
    above = F.aggregate("_bins", F.lit(0.0), lambda a, b: a + b["_n"] * F.exp(-b["_mean"] * F.col("_draw"))) / F.col("_all")
    pieces = F.ceil(F.col("_rows") / bucket_rows)
    bucket = F.least(pieces - 1, F.floor((1 - above) * pieces)).cast("long")
    rows = rows.join(few(targets.join(bins, "source_key")), "source_key").withColumn("_bucket", bucket).drop("_bins", "_all", "_w")
    sums = rows.groupBy("source_key", "_bucket").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("_upto", F.sum("_sum").over(before)).withColumn("_before", F.col("_upto") - F.col("_sum")).drop("_sum")
    rows = rows.join(sums, ["source_key", "_bucket"])
    whole, none = F.col("_upto") <= F.col("_rest"), F.col("_before") >= F.col("_rest")
    sure = rows.where(whole | none).withColumn("_taken", whole)
    within = Window.partitionBy("source_key", "_bucket").orderBy("_draw", "doc_id", "_text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = rows.where(~(whole | none)).withColumn("_sum", F.sum("size").over(within) + F.col("_before"))
    cut = cut.withColumn("_taken", F.col("_sum") - F.col("size") / 2 <= F.col("_rest")).drop("_sum")
    picked = sure.unionByName(cut).withColumn("copies", F.col("epochs") + F.when(F.col("_taken") & (F.col("size") > 0), 1).otherwise(0))
    return picked.select("doc_id", "_text", "source_key", "size", "source_size", "target", "epochs", "copies")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as mix() takes it, with the columns of docs."""
    digest, source, nth = fresh(docs, "_digest", "_source", "_copy")
    key = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit("")))
    same = ["doc_id", "_text", "source_key"]
    picked = mix(docs, **options).groupBy(*same).agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("rows")).where("n > 0").toDF(*fresh(docs, "_picked", "_picked_text", "_picked_source", "_n", "_rows"))
    p_id, p_text, p_source, p_n, p_rows = picked.columns
    keyed = docs.withColumns({digest: F.xxhash64("text"), source: key})
    met = F.col("doc_id").eqNullSafe(F.col(p_id)) & (F.col(digest) == F.col(p_text)) & (F.col(source) == F.col(p_source))
    rows = keyed.join(picked, met)
    # Rows that tie share their copies: each takes an equal part, and as many as are left over one more.
    least, over = F.floor(F.col(p_n) / F.col(p_rows)).cast("int"), F.col(p_n) % F.col(p_rows)
    number = F.row_number().over(Window.partitionBy(p_id, p_text, p_source).orderBy(F.xxhash64(*[F.col(c) for c in docs.columns])))
    even = rows.where(over == 0).withColumn(nth, least)
    uneven = rows.where(over > 0).withColumn(nth, number).withColumn(nth, least + F.when(F.col(nth) <= over, 1).otherwise(0))
    taken = even.unionByName(uneven).where(F.col(nth) > 0)
    return taken.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(nth)))).select(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix() of all documents: doc_id, size, source_size, target, and taken, the words that the mix takes of the row."""
    rows = mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = None
