"""Merkle manifest of a dataset: a tree of hashes per group, and one over the groups, with a proof for every row."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchlake.llm.common import discard, few, stash, table

#: Ids of a bitmap container, and leaves or nodes of a slot array, as powers of two.
CONTAINER_BITS, SLOT_BITS = 12, 12
#: Directories over containers: each sums over ranges of 2^RANGE_BITS entries of the one below.
RANGE_BITS = 16
#: The container of rows without an id lies before all others.
NO_ID = -(1 << 60)
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(fields: tuple[str, ...] = FIELDS, changed: dict[str, Column] | None = None) -> Column:
    """Hex sha256 of the fields in turn: `-` if null, else UTF-8 length, `:`, value."""
    parts = []
    for name in fields:
        value = (changed or {}).get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


# ---- bitmaps: the ids of a group, by containers ----


def packed(lows: np.ndarray) -> bytes:
    """A set of numbers below 2^CONTAINER_BITS: sorted 16-bit numbers while they are few, else one bit each."""
    if len(lows) * 2 < (1 << CONTAINER_BITS) // 8:
        return b"a" + np.sort(lows).astype("<u2").tobytes()
    bits = np.zeros(1 << CONTAINER_BITS, dtype=np.uint8)
    bits[lows] = 1
    return b"b" + np.packbits(bits, bitorder="little").tobytes()


def words_of(container: bytes) -> np.ndarray:
    """The container as 64-bit words."""
    if container[:1] == b"b":
        return np.frombuffer(container[1:], dtype="<u8")
    bits = np.zeros(1 << CONTAINER_BITS, dtype=np.uint8)
    bits[np.frombuffer(container[1:], dtype="<u2")] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def merged(containers: list[bytes]) -> bytes:
    words = np.zeros((1 << CONTAINER_BITS) // 64, dtype="<u8")
    for c in containers:
        words |= words_of(c)
    bits = np.unpackbits(words.view(np.uint8), bitorder="little")
    return packed(np.flatnonzero(bits))


def ranks(container: bytes, lows: np.ndarray) -> np.ndarray:
    """How many members are below each of lows: the directory of counts by word, and the bits of its own word below it."""
    words = words_of(container)
    directory = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    at = lows.astype(np.int64)
    below = words[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
    return directory[at >> 6] + np.bitwise_count(below)


PIECES = "key string, chunk long, bits binary, extra_at binary, extra_n binary, most int"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers of the ids that a task sees: extras are ids with several rows, most is their greatest number of texts."""
    for batch in batches:
        frame = batch.to_pandas()
        out = []
        for (key, chunk), rows in frame.groupby(["key", "chunk"], sort=False):
            lows, n = rows.low.to_numpy(), rows.rows.to_numpy()
            many = n > 1
            out.append((key, int(chunk), packed(lows), lows[many].astype("<u2").tobytes(), (n[many] - 1).astype("<i8").tobytes(), int(rows.kinds.max())))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32()), strict=True)], names=["key", "chunk", "bits", "extra_at", "extra_n", "most"]) if out else batch.slice(0, 0)


def _merge(rows: pa.Table) -> pa.Table:
    bits = merged(rows["bits"].to_pylist())
    extra_at, extra_n = (b"".join(rows[c].to_pylist()) for c in ("extra_at", "extra_n"))
    count = int(np.bitwise_count(words_of(bits)).sum()) + int(np.frombuffer(extra_n, "<i8").sum())
    return pa.table({"key": rows["key"][:1], "chunk": rows["chunk"][:1], "bits": [bits], "extra_at": [extra_at], "extra_n": [extra_n], "most": pa.array([max(rows["most"].to_pylist())], pa.int32()), "rows": pa.array([count], pa.int64())})


def directory(counts: DataFrame) -> DataFrame:
    """key, chunk, start: rows of the key in the containers before, from counts (key, chunk, rows).

    A directory of sums by ranges of chunks, one of those by ranges of ranges and so on; each range is summed up by itself,
    so that no task sees more than 2^RANGE_BITS entries.
    """
    levels, level = [], counts.select("key", F.col("chunk").alias("at"), "rows")
    for k in range(4):
        up = F.shiftright("at", RANGE_BITS) if k < 3 else F.lit(0)
        level = level.withColumn("up", up.cast("long"))
        before = Window.partitionBy("key", "up").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        levels.append(level.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0))))
        level = level.groupBy("key", "up").agg(F.sum("rows").alias("rows")).select("key", F.col("up").alias("at"), "rows")
    found = levels[3].select("key", "at", "start")
    for lower in (levels[2], levels[1], levels[0]):
        up = found.select(F.col("key").alias("_k"), F.col("at").alias("_at"), F.col("start").alias("_s"))
        found = lower.join(up, (F.col("key") == F.col("_k")) & (F.col("up") == F.col("_at"))).select("key", "at", (F.col("start") + F.col("_s")).alias("start"))
    return found.select("key", F.col("at").alias("chunk"), "start")


def _probe(leaves: pa.Table, containers: pa.Table) -> pa.Table:
    """Coordinates of a container's leaves: rows before it, members below, further rows of those, and its place among equal ids."""
    extra_at = np.frombuffer(containers["extra_at"][0].as_py(), "<u2")
    extra_n = np.frombuffer(containers["extra_n"][0].as_py(), "<i8")
    order = np.argsort(extra_at)
    extras = np.concatenate([[0], np.cumsum(extra_n[order])])
    low = leaves["low"].to_numpy().astype(np.int64)
    at = containers["start"][0].as_py() + ranks(containers["bits"][0].as_py(), low) + extras[np.searchsorted(extra_at[order], low)] + leaves["tie"].to_numpy()
    return pa.table({"key": leaves["key"], "doc_id": leaves["doc_id"], "at": pa.array(at, pa.int64()), "copies": leaves["copies"], "leaf": leaves["leaf"], "forged": leaves["forged"]})


def coordinates(leaves: DataFrame) -> DataFrame:
    """leaves (key, doc_id, leaf, forged, copies) with `at`, the first of their places among the key's leaves by doc_id.

    The ids of each task's rows become bitmap containers, merged by (key, range of ids); directories of counts lead to a
    container's first place, and a rank query in the container to the id's. Nothing is sorted but texts that share an id:
    those follow by leaf.
    """
    same = Window.partitionBy("key", "doc_id")
    tie = F.coalesce(F.sum("copies").over(same.orderBy("leaf", "forged").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = leaves.withColumns({
        "tie": tie.cast("long"), "kind": (F.row_number().over(same.orderBy("leaf", "forged")) - 1).cast("int"),
        "chunk": F.coalesce(F.shiftright("doc_id", CONTAINER_BITS), F.lit(NO_ID)), "low": F.coalesce(F.col("doc_id").bitwiseAND((1 << CONTAINER_BITS) - 1), F.lit(0)).cast("int"),
    })
    rows = stash(rows, "leaves")
    ids = rows.groupBy("key", "chunk", "low").agg(F.sum("copies").alias("rows"), F.max("kind").alias("kinds"))
    containers = ids.mapInArrow(_pieces, PIECES).groupBy("key", "chunk").applyInArrow(_merge, PIECES + ", rows long")
    containers = stash(containers, "containers")
    placed = containers.join(directory(containers.select("key", "chunk", "rows")), ["key", "chunk"])
    # Ids with very many texts: 16 texts of each id of a container go to a task of their own.
    placed = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.shiftright("most", 4))))
    rows = rows.withColumn("part", F.shiftright("kind", 4))
    by = ["key", "chunk", "part"]
    out = rows.groupBy(*by).cogroup(placed.groupBy(*by)).applyInArrow(_probe, "key string, doc_id long, at long, copies long, leaf binary, forged binary")
    return stash(out, "coordinates")


# ---- slot arrays: 2^SLOT_BITS nodes and the levels above them ----


def levels_of(count: int) -> int:
    """Levels from `count` nodes to one."""
    return (count - 1).bit_length() if count > 1 else 0


def reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes, and `levels` times what every two of them become; a last single one becomes its own hash."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest(below[k : k + 2]) for k in range(0, len(below), 2)])
    return out


def siblings(tree: list[list[str]], at: int) -> list[str]:
    """The other node of each run from a slot up, where there is one."""
    return [level[at >> k ^ 1] for k, level in enumerate(tree[:-1]) if at >> k ^ 1 < len(level)]


def folded(start: str, at: int, count: int, proof: list[str], levels: int | None = None) -> tuple[str, int]:
    """The node that `start` at place `at` of `count` leads to with the siblings of proof, and how many of them it took."""
    node, used = start, 0
    for _ in range(levels_of(count) if levels is None else levels):
        if at ^ 1 < count:
            other = proof[used]
            node, used = digest([other, node] if at & 1 else [node, other]), used + 1
        else:
            node = digest([node])
        at, count = at >> 1, (count + 1) >> 1
    return node, used


def _block(rows: pa.Table) -> pa.Table:
    """A slot array of leaves: rows (key, block, at, copies, ...) put where their place says, and its node above."""
    key, block, total = (rows[c][0].as_py() for c in ("key", "block", "total"))
    first, size = block << SLOT_BITS, 1 << SLOT_BITS
    n = min(size, total - first)
    ids, leaves, forged = [None] * n, [b""] * n, [b""] * n
    for at, copies, doc_id, leaf_, forged_ in zip(*[rows[c].to_pylist() for c in ("at", "copies", "doc_id", "leaf", "forged")], strict=True):
        for slot in range(max(at - first, 0), min(at + copies - first, n)):
            ids[slot], leaves[slot], forged[slot] = doc_id, leaf_, forged_
    node = reduced([b.hex() for b in leaves], min(SLOT_BITS, levels_of(total)))[-1][0]
    return pa.table({"key": [key], "block": pa.array([block], pa.int64()), "total": pa.array([total], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "leaves": [b"".join(leaves)], "forged": [b"".join(forged)], "node": [node]})


def _level(rows: pa.Table) -> pa.Table:
    """A slot array of nodes (key, at, count, node): its node above, and the siblings of each of its nodes on the way."""
    count = rows["count"][0].as_py()
    slot = np.argsort(rows["at"].to_numpy())
    rows = rows.take(pa.array(slot))
    levels = min(SLOT_BITS, levels_of(count))
    tree = reduced(rows["node"].to_pylist(), levels)
    others = ["".join(siblings(tree, k)) for k in range(rows.num_rows)]
    return pa.table({"key": rows["key"], "at": rows["at"], "up": rows["up"], "above": [tree[-1][0]] * rows.num_rows, "siblings": others})


def reduce_levels(nodes: DataFrame, most: int) -> DataFrame:
    """Per node of nodes (key, at, count, node): key, at, top (the key's last node) and siblings up to it, as one string.

    nodes lie in slot arrays keyed by (key, at >> SLOT_BITS); a pass turns each into one node, and passes go on until one
    is left of the key that has the most, of which there are `most`.
    """
    passes = []
    level = nodes
    for k in range(max(1, math.ceil(levels_of(most) / SLOT_BITS))):
        rows = level.withColumn("up", F.shiftright("at", SLOT_BITS))
        done = stash(rows.groupBy("key", "up").applyInArrow(_level, "key string, at long, up long, above string, siblings string"), f"level{k}")
        passes.append(done)
        size = F.shiftright(F.col("count") + (1 << SLOT_BITS) - 1, SLOT_BITS)
        ups = done.groupBy("key", "up").agg(F.first("above").alias("node"))
        counts = level.select("key", size.alias("count")).distinct()
        level = ups.join(counts, "key").select("key", F.col("up").alias("at"), "count", "node")
    path = passes[-1].select("key", "at", F.col("above").alias("top"), "siblings")
    for lower in reversed(passes[:-1]):
        over = path.select(F.col("key").alias("_k"), F.col("at").alias("_at"), "top", F.col("siblings").alias("_s"))
        path = lower.join(over, (F.col("key") == F.col("_k")) & (F.col("up") == F.col("_at"))).select("key", "at", "top", F.concat("siblings", "_s").alias("siblings"))
    return path


PROOFS = "doc_id long, leaf string, subroot string, root string, proof string, folded_root string, verified boolean"


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block with their proofs, and the roots that their forged leaves lead to."""
    for batch in batches:
        for row in batch.to_pylist():
            n, total = len(row["ids"]), row["total"]
            leaves, forged = ([row[c][32 * k : 32 * k + 32].hex() for k in range(n)] for c in ("leaves", "forged"))
            inner = min(SLOT_BITS, levels_of(total))
            tree = reduced(leaves, inner)
            upper = [row["siblings"][k : k + 64] for k in range(0, len(row["siblings"]), 64)]
            blocks = (total + (1 << SLOT_BITS) - 1) >> SLOT_BITS
            out = []
            for k, doc_id in enumerate(row["ids"]):
                proof = siblings(tree, k) + upper
                node, used = folded(forged[k], k, n, proof, inner)
                node, more = folded(node, row["block"], blocks, proof[used:])
                node, _ = folded(node, row["place"], row["keys"], proof[used + more :])
                out.append((doc_id, leaves[k], row["subroot"], row["root"], "".join(proof), node, node == row["root"]))
            for at in range(0, n, 512):
                columns = zip(*out[at : at + 512], strict=True)
                kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"])


def manifest(rows: DataFrame) -> DataFrame:
    """Per row of rows (key, doc_id, leaf, forged; hex leaves): doc_id, leaf, subroot, root, proof, folded_root, verified.

    A key's leaves ascend by doc_id (null first, those of one id by leaf); while several nodes remain, every two become the
    hash of both, a last single one its own. What remains is the subroot; subroots by key likewise give the root. proof is
    the siblings from the leaf to the root, joined; folded_root is what the forged leaf leads to with them. Equal rows are
    leaves of their own. Keys ascend bytewise.
    """
    leaves = rows.groupBy("key", "doc_id", F.unhex("leaf").alias("leaf"), F.unhex("forged").alias("forged")).agg(F.count(F.lit(1)).alias("copies"))
    placed = coordinates(leaves)
    totals = stash(placed.groupBy("key").agg(F.sum("copies").alias("total")), "totals")
    most = totals.agg(F.max("total"), F.count(F.lit(1))).first()
    blocks = F.explode(F.sequence(F.shiftright("at", SLOT_BITS), F.shiftright(F.col("at") + F.col("copies") - 1, SLOT_BITS)))
    slots = placed.join(few(totals), "key").withColumn("block", blocks)
    kinds = "key string, block long, total long, ids array<long>, leaves binary, forged binary, node string"
    arrays = stash(slots.groupBy("key", "block").applyInArrow(_block, kinds), "blocks")
    discard(placed)
    count = F.shiftright(F.col("total") + (1 << SLOT_BITS) - 1, SLOT_BITS)
    nodes = arrays.select("key", F.col("block").alias("at"), count.alias("count"), "node")
    paths = stash(reduce_levels(nodes, max(1, ((most[0] or 0) + (1 << SLOT_BITS) - 1) >> SLOT_BITS)), "paths")
    tops = stash(paths.where("at = 0").select("key", F.col("top").alias("subroot")), "tops")
    keys = most[1]
    known = stash(_places(tops), "places")
    over = reduce_levels(known.select(F.lit("").alias("key"), F.col("place").alias("at"), F.lit(keys).cast("long").alias("count"), F.col("subroot").alias("node")), max(1, keys))
    over = over.select(F.col("at").alias("place"), F.col("top").alias("root"), F.col("siblings").alias("_over"))
    groups = few(known.join(over, "place").withColumn("keys", F.lit(keys).cast("long")))
    ways = paths.select(F.col("key").alias("_key"), F.col("at").alias("_at"), "siblings")
    proven = arrays.join(ways, (F.col("key") == F.col("_key")) & (F.col("block") == F.col("_at"))).join(groups, "key")
    proven = proven.select("block", "total", "ids", "leaves", "forged", "subroot", "root", "place", "keys", F.concat("siblings", "_over").alias("siblings"))
    return proven.mapInArrow(_prove, PROOFS)


def _places(tops: DataFrame) -> DataFrame:
    """tops with place, from 0 by key: the count of keys with smaller first bytes, and the place among those with the same."""
    head = F.substring("key", 1, 3)
    heads = tops.groupBy(head.alias("_head")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_first", F.substring("_head", 1, 2))
    within = F.sum("_n").over(Window.partitionBy("_first").orderBy("_head")) - F.col("_n")
    firsts = heads.groupBy("_first").agg(F.sum("_n").alias("_all"))
    firsts = firsts.select(F.col("_first").alias("_f"), (F.sum("_all").over(Window.orderBy("_first")) - F.col("_all")).alias("_start"))
    heads = heads.withColumn("_within", within).join(firsts, F.col("_first") == F.col("_f")).select("_head", (F.col("_start") + F.col("_within")).alias("_start"))
    rows = tops.withColumn("_head", head).join(heads, "_head")
    return rows.select("key", "subroot", (F.col("_start") + F.row_number().over(Window.partitionBy("_head").orderBy("key")) - 1).alias("place"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents by lang, and whether each verifies after a row in seven had 1 added to n_chars.

    Nulls hash as `-`; a null n_chars stays null, so its row verifies; a row without doc_id isn't tampered with and comes
    first in its lang; a null lang is a group before all others. An empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    key = F.concat(F.when(F.col("lang").isNull(), "0").otherwise("1"), F.coalesce("lang", F.lit("")))
    chosen = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0
    more = F.when(chosen, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("leaf"), leaf(changed={"n_chars": more}).alias("forged"))
    out = manifest(rows)
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


SQL = """
WITH RECURSIVE leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, sha256(lead_ || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
      sha256(lead_ || coalesce(strlen(forged::VARCHAR) || ':' || forged, '-') || coalesce(strlen(text) || ':' || text, '-')) AS forged
    FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS lead_,
        CASE WHEN (4294967295 - list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: list_concat([ascii(ch)::BIGINT], list_transform(range(8), lambda z: -1::BIGINT))))),
          lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END)) % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS forged FROM documents))),
nodes AS (
  SELECT lang, 0 AS level, pos, n, leaf AS node FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(node || coalesce(other, '')) FROM (SELECT *, lead(node) OVER (PARTITION BY lang ORDER BY pos) AS other FROM nodes WHERE n > 1) WHERE pos % 2 = 0),
tops AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS langs FROM nodes WHERE n = 1),
upper_nodes AS (
  SELECT 0 AS level, place AS pos, langs AS n, subroot AS node FROM tops
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(node || coalesce(other, '')) FROM (SELECT *, lead(node) OVER (ORDER BY pos) AS other FROM upper_nodes WHERE n > 1) WHERE pos % 2 = 0),
every_node AS (SELECT 0 AS phase, lang, level, pos, node FROM nodes UNION ALL SELECT 1, NULL, level, pos, node FROM upper_nodes),
ways AS (
  SELECT 0 AS phase, doc_id, lang, pos AS start, leaf, 0 AS level, pos, n AS amount, forged AS node, '' AS proof FROM leaves
  UNION ALL
  SELECT CASE WHEN up THEN 1 ELSE w.phase END, w.doc_id, w.lang, w.start, w.leaf, CASE WHEN up THEN 0 ELSE w.level + 1 END, CASE WHEN up THEN w.place ELSE w.pos // 2 END, CASE WHEN up THEN w.langs ELSE (w.amount + 1) // 2 END,
    CASE WHEN up THEN w.node WHEN w.pos % 2 = 1 THEN sha256(e.node || w.node) ELSE sha256(w.node || coalesce(e.node, '')) END, CASE WHEN up THEN w.proof ELSE w.proof || coalesce(e.node, '') END
  FROM (SELECT ways.*, t.place, t.langs, ways.amount = 1 AND phase = 0 AS up FROM ways JOIN tops t ON t.lang IS NOT DISTINCT FROM ways.lang WHERE ways.amount > 1 OR phase = 0) w
  LEFT JOIN every_node e ON e.phase = w.phase AND e.lang IS NOT DISTINCT FROM (CASE WHEN w.phase = 0 THEN w.lang END) AND e.level = w.level AND e.pos = xor(w.pos, 1))
SELECT w.doc_id, w.leaf, t.subroot, r.node AS root, sha256(w.proof) AS proof_sha256, w.node AS folded_root, w.node = r.node AS verified
FROM ways w JOIN tops t ON t.lang IS NOT DISTINCT FROM w.lang JOIN (SELECT node FROM upper_nodes WHERE n = 1) r ON true WHERE w.phase = 1 AND w.amount = 1"""
