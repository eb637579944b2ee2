"""Sharding by balanced label propagation: linked documents move to their neighbours' shards under row quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.llm.common import discard, gapless, stash, table, unit_hash

ROUNDS = 4
#: Rows that one task numbers.
PIECE_ROWS = 20_000


def _of(values: list[float], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def _loads(rows: DataFrame, n_shards: int, what: Column | None = None) -> list[int]:
    """Rows (or the sum of what) by shard: n_shards numbers."""
    measure = F.count(F.lit(1)) if what is None else F.sum(what)
    found = {r.shard: int(r.n or 0) for r in rows.groupBy("shard").agg(measure.alias("n")).collect()}
    return [found.get(s, 0) for s in range(n_shards)]


def label_propagation(docs: DataFrame, n_shards: int, link: Column, rounds: int = ROUNDS) -> DataFrame:
    """docs (doc_id and any others) with shard: row counts differ by one at most and few link groups are cut.

    Rows with equal, not null `link` are neighbours of each other. Each starts in a shard by hash. In each round a group
    counts its members by shard, takes the shard with most of those that have room, and its other members move there if
    the quota, with what is about to leave, admits the group; when more ask than fit, a hash of group and round decides. Groups of more than nine tenths
    of a shard are cut by a hash of doc_id first; what is still large starts whole. In the end rows beyond a shard's quota, those without
    neighbours first and those of large groups last, go to shards that are short. Only sums by shard, and large groups, come to the driver. Equal rows tie: which of
    them goes where is open, the counts are not.
    """
    rows = stash(docs.withColumn("_link", link), "shard")
    total = rows.count()
    quota = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    most = max(1, int(0.9 * max(1, total // n_shards)))
    groups = rows.where("_link is not null").groupBy("_link").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    rows = rows.join(groups, "_link", "left")
    chunk = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.ceil(F.col("_size") / most))
    labels = rows.withColumn("_group", F.when(F.col("_size").isNotNull(), F.xxhash64("_link", chunk))).drop("_link", "_size")
    start = F.pmod(F.xxhash64("doc_id", F.col("_group")), F.lit(n_shards)).cast("int")
    labels = _large_first(labels, n_shards, total).withColumn("shard", F.coalesce("_at", start)).drop("_at")
    labels = stash(labels, "labels")
    for turn in range(rounds):
        linked = labels.where("_group is not null")
        room = [q - n for q, n in zip(quota, _loads(linked, n_shards), strict=True)]
        open_shards = [s for s in range(n_shards) if room[s] >= 0] or list(range(n_shards))
        cells = linked.groupBy("_group", "shard").agg(F.count(F.lit(1)).alias("n"))
        here = F.when(_of([float(s in open_shards) for s in range(n_shards)], F.col("shard")) > 0, F.struct("n", F.xxhash64("_group", "shard", F.lit(turn)).alias("r"), "shard"))
        votes = cells.groupBy("_group").agg(F.max(here).alias("best"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("spread")).where("spread > 1")
        any_open = _of(open_shards, F.pmod(F.xxhash64("_group", F.lit(turn)), F.lit(len(open_shards))))
        votes = votes.select("_group", F.coalesce("best.shard", any_open).cast("int").alias("shard"), (F.col("size") - F.coalesce("best.n", F.lit(0))).alias("inflow"))
        votes = stash(votes, "votes")
        asked = _loads(votes, n_shards, F.col("inflow"))
        if not any(asked):
            break
        leaving = cells.join(votes.select("_group", F.col("shard").alias("_to")), "_group").where(F.col("shard") != F.col("_to"))
        room = [r + int(0.9 * n) for r, n in zip(room, _loads(leaving, n_shards, F.col("n")), strict=True)]
        admit = [1.1 if a <= max(r, 0) else 0.95 * max(r, 0) / a for a, r in zip(asked, room, strict=True)]
        moves = votes.where(unit_hash(F.col("_group"), F.lit(turn + 100)) < _of(admit, F.col("shard"))).select(F.col("_group").alias("_g"), F.col("shard").alias("_to"))
        after = labels.join(moves, F.col("_group") == F.col("_g"), "left").withColumn("shard", F.coalesce("_to", "shard")).drop("_g", "_to")
        after = stash(after, "labels")
        discard(labels, votes)
        labels = after
    return _even_out(labels, quota, n_shards).drop("_group")


def _large_first(labels: DataFrame, n_shards: int, total: int) -> DataFrame:
    """labels with _at, the shard where a group of more than a tenth of a shard starts whole, the largest group first.

    At most 10 * n_shards groups can be so large; those come to the driver.
    """
    sizes = labels.where("_group is not null").groupBy("_group").agg(F.count(F.lit(1)).alias("n"))
    large = sorted(((r.n, r._group) for r in sizes.where(F.col("n") * 10 * n_shards > total).where("n > 2").limit(10 * n_shards).collect()), reverse=True)
    loads, chosen = [0] * n_shards, []
    for n, group in large:
        least = min(range(n_shards), key=lambda s: (loads[s], s))
        loads[least] += n
        chosen.append((group, least))
    if not chosen:
        return labels.withColumn("_at", F.lit(None).cast("int"))
    places = labels.sparkSession.createDataFrame(chosen, "_large long, _at int")
    return labels.join(F.broadcast(places), F.col("_group") == F.col("_large"), "left").drop("_large")


def _even_out(labels: DataFrame, quota: list[int], n_shards: int) -> DataFrame:
    """Move the rows beyond each shard's quota to shards that are short of it.

    Of a shard, rows without neighbours go first (class 0), then those of groups that one task numbers (1), then those of
    larger groups, the smallest first (a class each, of which there are no more than rows / PIECE_ROWS): those are numbered
    in pieces by doc_id.
    """
    spark = labels.sparkSession
    if not any(n > q for n, q in zip(_loads(labels, n_shards), quota, strict=True)):
        return labels
    sizes = labels.where("_group is not null").groupBy("_group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PIECE_ROWS)
    large = [(r._group, k + 2) for k, r in enumerate(sorted(sizes.collect(), key=lambda r: (r.n, r._group)))]
    known = spark.createDataFrame(large, "_large long, _class int")
    labels = labels.join(F.broadcast(known), F.col("_group") == F.col("_large"), "left").drop("_large")
    labels = labels.withColumn("_class", F.when(F.col("_group").isNull(), 0).otherwise(F.coalesce("_class", F.lit(1))))
    held = sorted((r.shard, r._class, r.n) for r in labels.groupBy("shard", "_class").agg(F.count(F.lit(1)).alias("n")).collect())
    over = [-q for q in quota]
    for s, _, n in held:
        over[s] += n
    cells, ends, to, at, room = [], [], [], 0, 0
    left = [max(0, o) for o in over]
    for s, kind, n in held:  # those that go are numbered through
        go = min(left[s], n)
        left[s] -= go
        if go:
            cells.append((s, kind, go, at))
        at += go
    for s in range(n_shards):
        if over[s] < 0:
            room -= over[s]
            ends.append(room)
            to.append(s)
    salts = max(8, max(n for *_, n in held) // PIECE_ROWS + 1)
    salt = F.when(F.col("_class") == 1, F.col("_group")).otherwise(F.col("doc_id"))
    rows = gapless(labels, ["shard", "_class"], [F.xxhash64("_group"), F.col("doc_id")], salt, salts, "_at")
    leaving = spark.createDataFrame(cells, "_s int, _c int, _go long, _from long")
    rows = rows.join(F.broadcast(leaving), (F.col("shard") == F.col("_s")) & (F.col("_class") == F.col("_c")), "left")
    place = F.col("_from") + F.col("_at")
    target = F.element_at(F.array(*[F.lit(s) for s in to]), (F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= place)) + 1).cast("int"))
    go = F.coalesce(F.col("_at") < F.col("_go"), F.lit(False))
    return rows.withColumn("shard", F.when(go, target).otherwise(F.col("shard")).cast("int")).drop("_class", "_at", "_s", "_c", "_go", "_from")


def shard_documents(docs: DataFrame, n_shards: int = 40, rounds: int = ROUNDS) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Rows with equal texts are linked. law is rows: shard sizes differ by one row at most. slot numbers a shard's rows from
    0 by doc_id's hash and doc_id. A null text has size 16, no checksum and no links; empty texts are equal. Repeated rows
    are rows of their own; an empty table gives an empty result.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    rows = docs.select(F.col("doc_id").cast("long"), size.alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"), F.md5("text").alias("_md5"))
    placed = stash(label_propagation(rows, n_shards, F.col("_md5"), rounds).drop("_md5"), "placed")
    salts = max(8, placed.count() // n_shards // PIECE_ROWS + 1)
    out = gapless(placed, ["shard"], [F.col("doc_id")], F.col("doc_id"), salts, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shard_documents() of all documents into shards 0 to 39."""
    return shard_documents(table(spark, sf_dir, "documents"))


SQL = None
