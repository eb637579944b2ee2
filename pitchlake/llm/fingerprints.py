"""Document fingerprints: sketches that keep every shingle hash below a fixed share of all hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchlake.llm.common import few, fresh, table
from pitchlake.llm.common import before as cell_before

#: Words of a shingle, share of hashes kept, hexadecimal digits kept of a hash.
WORDS, SHARE, DIGITS = 5, 0.25, 12
#: doc_ids of a cell whose documents one task puts in order.
CELL_BITS = 10
UPPER, LOWER, WHITE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "\t\n\x0b\x0c\r"


def limit(share: float = SHARE) -> str:
    """The hash that `share` of all hashes are below."""
    return f"{int(share * 16**8):08x}"


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once a row, however often `then` uses it."""
    return F.get(F.transform(F.array(value), then), 0)


def sketch(text: Column, share: float = SHARE) -> Column:
    """The sorted distinct hashes, of all five-word shingles of a text, that are below share; its least one if none is.

    A-Z count as a-z; a text of fewer words is one shingle, one without words (null, empty) has no hash. The sketch of
    several texts together follows from theirs alone, see merged().
    """
    words = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER + WHITE, LOWER + " " * len(WHITE)), " "), lambda w: w != "")

    def hashes(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.greatest(F.size(w) - (WORDS - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.md5(F.array_join(F.slice(w, at, WORDS), " ")))

    return bound(words, lambda w: bound(hashes(w), lambda h: kept(h, share)))


def kept(hashes: Column, share: float = SHARE) -> Column:
    """The first digits of the hashes below share, or of the least one, sorted and distinct."""

    def some(low: Column) -> Column:
        least = F.when(F.size(low) > 0, low).when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(low)
        return F.array_sort(F.array_distinct(F.transform(least, lambda h: F.left(h, F.lit(DIGITS)))))

    return bound(F.filter(hashes, lambda h: h < limit(share)), some)


def merged(sketches: DataFrame, keys: list[str], column: str = "sketch", share: float = SHARE) -> DataFrame:
    """keys and column: the sketch of all texts with the same keys, from the sketches of each."""
    hashes = sketches.select(*keys, F.explode(column).alias("_hash")).distinct()
    least = F.array(F.min("_hash"))
    low = F.collect_list(F.when(F.col("_hash") < limit(share), F.col("_hash")))
    return hashes.groupBy(*keys).agg(low.alias("_low"), least.alias("_least")).select(*keys, F.array_sort(F.when(F.size("_low") > 0, F.col("_low")).otherwise(F.col("_least"))).alias(column))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of all hashes of both; 1 where neither has any."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / every)


def containment(a: Column, b: Column) -> Column:
    """Share of a's hashes that b has; 1 where a has none."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def with_next(docs: DataFrame, columns: list[str], bits: int = CELL_BITS, known: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, ...) with next_<c> for each c of columns: that of the next document by doc_id, the last one's of the first.

    A null doc_id is less than all; rows of one doc_id follow by a hash of `columns`. Documents lie in cells of 2^bits ids,
    ordered by themselves; the first one of each cell also goes to the cell before, behind that cell's own. known: a table of
    the same doc_ids that is cheaper to read than docs.
    """
    cell, tie, guest, head, where, to = fresh(docs, "_cell", "_tie", "_guest", "_head", "_where", "_to")
    ids = (docs if known is None else known).select(F.shiftright("doc_id", bits).alias(cell), "doc_id")
    heads = ids.groupBy(cell).agg(F.min("doc_id").alias(head))
    heads = few(cell_before(heads.select(cell, head), cell, where).select(F.col(head), F.col(where), F.lit(True).alias(guest)))
    rows = docs.withColumns({cell: F.shiftright("doc_id", bits), tie: F.xxhash64(*columns)})
    rows = rows.join(heads, F.col("doc_id").eqNullSafe(F.col(head)), "left")
    own = F.struct(F.col(cell).alias(to), F.lit(False).alias("g"))
    there = F.struct(F.col(where).alias(to), F.lit(True).alias("g"))
    rows = rows.withColumn(head, F.explode(F.when(F.col(guest), F.array(own, there)).otherwise(F.array(own))))
    rows = rows.withColumns({to: F.col(head)[to], guest: F.col(head)["g"]})
    order = Window.partitionBy(to).orderBy(guest, F.col("doc_id").asc_nulls_first(), tie)
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return rows.where(~F.col(guest)).drop(cell, tie, guest, head, where, to)


def edited(text: Column, following: Column) -> Column:
    """text with its last quarter of code points (rounded down) replaced by as many first ones of following, or all."""
    n = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - n), F.substring(following, F.lit(1), n))


def packed(hashes: Column) -> Column:
    """A sketch as bytes, a quarter of the array's size."""
    return F.unhex(F.array_join(hashes, ""))


def unpacked(column: Column) -> Column:
    size = DIGITS // 2

    def pieces(data: Column) -> Column:
        starts = F.when(F.length(data) > 0, F.sequence(F.lit(1), F.length(data), F.lit(size))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.lower(F.hex(F.substring(data, at, F.lit(size)))))

    return bound(column, pieces)


def fingerprints(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, text, sketch, next_text and next_sketch, null texts as empty ones.

    Texts and packed sketches are shuffled once, by cell.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.explode(F.array(packed(sketch(F.col("text"), share)))).alias("_sketch"))
    rows = with_next(rows, ["text", "_sketch"], known=docs)
    return rows.select("doc_id", "text", unpacked(F.col("_sketch")).alias("sketch"), "next_text", unpacked(F.col("next__sketch")).alias("next_sketch"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with their likeness: shared share of the hashes of both.

    Beside it contained_edited and contained_next: the share of the document's hashes that the other one has. A null text is
    an empty one and has an empty fingerprint, like only to empty ones. Repeated rows follow each other, a null doc_id comes
    first; a lone document is its own next one; an empty table gives an empty result.
    """
    rows = fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = rows.withColumn("_edited", edited(F.col("text"), F.col("next_text")))
    # A generator is never merged with what uses its columns, so each sketch is computed once a row.
    sketches = F.struct("sketch", "next_sketch", sketch(F.col("_edited")).alias("edited_sketch"))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"), F.inline(F.array(sketches)))
    out = {
        "fingerprint": F.array_join("sketch", ","), "edited_fingerprint": F.array_join("edited_sketch", ","),
        "near_edited": jaccard(F.col("sketch"), F.col("edited_sketch")), "near_next": jaccard(F.col("sketch"), F.col("next_sketch")),
        "contained_edited": containment(F.col("sketch"), F.col("edited_sketch")), "contained_next": containment(F.col("sketch"), F.col("next_sketch")),
    }
    return rows.select("doc_id", "n_chars", "edited_sha256", *[c.alias(n) for n, c in out.items()])


def _sketch_sql(text: str) -> str:
    words = f"list_filter(string_split_regex(translate({text}, '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    hashes = f"list_transform(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1), lambda i: left(md5(array_to_string(w[i:i + {WORDS - 1}], ' ')), {DIGITS}))"
    keep = f"CASE WHEN len(list_filter(h, lambda x: x < '{limit()}')) > 0 THEN list_filter(h, lambda x: x < '{limit()}') WHEN len(h) > 0 THEN [list_min(h)] ELSE [] END"
    return f"(SELECT list_sort(list_distinct({keep})) FROM (SELECT CASE WHEN len(w) > 0 THEN {hashes} ELSE [] END AS h FROM (SELECT {words} AS w)))"


SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
sketched AS (SELECT *, {_sketch_sql("text")} AS sketch FROM texts),
followed AS (
  SELECT *, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text, coalesce(lead(sketch) OVER o, first_value(sketch) OVER o) AS next_sketch FROM sketched WINDOW o AS (ORDER BY doc_id NULLS FIRST)),
edits AS (SELECT *, left(text, length(text) - length(text) // 4) || left(next_text, length(text) // 4) AS edited FROM followed),
paired AS (SELECT *, {_sketch_sql("edited")} AS edited_sketch FROM edits)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(sketch, ',') AS fingerprint, array_to_string(edited_sketch, ',') AS edited_fingerprint,
  CASE WHEN len(sketch) + len(edited_sketch) = 0 THEN 1.0 ELSE len(list_intersect(sketch, edited_sketch)) / len(list_distinct(list_concat(sketch, edited_sketch))) END AS near_edited,
  CASE WHEN len(sketch) + len(next_sketch) = 0 THEN 1.0 ELSE len(list_intersect(sketch, next_sketch)) / len(list_distinct(list_concat(sketch, next_sketch))) END AS near_next,
  CASE WHEN len(sketch) = 0 THEN 1.0 ELSE len(list_intersect(sketch, edited_sketch)) / len(sketch) END AS contained_edited,
  CASE WHEN len(sketch) = 0 THEN 1.0 ELSE len(list_intersect(sketch, next_sketch)) / len(sketch) END AS contained_next
FROM paired"""
