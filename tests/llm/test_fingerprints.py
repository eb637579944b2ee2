"""Fingerprints against plain Python, and their likeness against true shares of shingles."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from pitchlake.llm import fingerprints as fp
from pitchlake.llm.common import before
from tests.llm.fixtures import documents, frame, words


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(fp.UPPER, fp.LOWER)))
    return [" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, 1))] if w else []


def sketch(text, share=fp.SHARE):
    hashes = [hashlib.md5(s.encode()).hexdigest() for s in shingles(text)]
    low = [x for x in hashes if x < fp.limit(share)] or sorted(hashes)[:1]
    return sorted({x[: fp.DIGITS] for x in low})


def near(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def test_fingerprints_equal_plain_ones(spark, tmp_path):
    rows = [r for k, r in enumerate(documents()) if r not in documents()[:k]][:-1]  # one row an id, one without
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    want = []
    for k, (doc_id, text, *_) in enumerate(rows):
        text, other = text or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text) // 4
        changed = text[: len(text) - n] + other[:n]
        a, b = sketch(text), sketch(changed)
        want.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), ",".join(a), ",".join(b), near(a, b), near(a, sketch(other))))
    got = fp.op13_fingerprints(spark, str(tmp_path)).collect()
    assert sorted((tuple(r)[:7] for r in got), key=repr) == sorted(want, key=repr)


def test_repeated_ids_empty_table_and_lone_document(spark, tmp_path):
    rows = [(3, "b c", "en", "a", 1)] * 3 + [(3, "other text", "en", "a", 1), (None, None, None, None, None), (None, None, None, None, None)]
    for name, part in (("many", rows), ("none", []), ("lone", rows[:1])):
        frame(spark, part).write.parquet(str(tmp_path / name / "documents.parquet"))
        got = fp.op13_fingerprints(spark, str(tmp_path / name)).collect()
        assert len(got) == len(part)
    assert got[0].near_next == 1.0 and got[0].near_edited < 1.0 or got[0].n_chars < 4


def test_next_documents_over_far_cells(spark):
    rng = random.Random(2)
    ids = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(60)] + list(range(3000, 3400, 7)) + [None, 1 << 40, (1 << 40) + 1]
    docs = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    order = sorted(ids, key=lambda x: (x is not None, x or 0))
    want = {i: str(order[(k + 1) % len(order)]) for k, i in enumerate(order)}
    assert {r.doc_id: r.next_text for r in fp.with_next(docs, ["text"], bits=4).collect()} == want
    cells = spark.createDataFrame([(i,) for i in ids], "c long")
    got = {r.c: r.p for r in before(cells, "c", "p").collect()}
    assert got == {i: order[k - 1] for k, i in enumerate(order)}


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(4)
    long = " ".join(words(rng, 6000, 900))
    part = " ".join(long.split()[1000:1600])
    rows = [(1, "a", long), (2, "b", part), (3, "b", " ".join(words(rng, 40))), (4, "c", "tiny text"), (5, "c", None)]
    df = spark.createDataFrame(rows, "doc_id long, g string, text string").withColumn("sketch", fp.sketch(F.col("text")))
    merged = {r.g: r.sketch for r in fp.merged(df, ["g"]).collect()}
    for g in "ab":
        low = {h for _, k, t in rows if k == g for s in shingles(t) if (h := hashlib.md5(s.encode()).hexdigest()) < fp.limit()}
        assert merged[g] == sorted(h[: fp.DIGITS] for h in low)
    assert merged["c"] == sketch("tiny text")
    pair = df.where("doc_id = 2").select(F.col("sketch").alias("s")).crossJoin(df.where("doc_id = 1").select("sketch"))
    got = pair.select(fp.containment(F.col("s"), F.col("sketch")).alias("c"), fp.jaccard(F.col("s"), F.col("sketch")).alias("j")).first()
    assert got.c > 0.95 and abs(got.j - 0.1) < 0.04
