"""Small documents with every awkward case: nulls, empty and long texts, ties, repeated rows, hot groups."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def documents(seed=3, n=60):
    rng = random.Random(seed)
    rows = []
    passage = " ".join(words(rng, 60))
    base = words(rng, 80)
    for k in range(n):
        text = " ".join(words(rng, rng.choice([1, 3, 5, 25, 90])))
        if k % 6 == 0:
            text += "\n" + passage
        if k % 5 == 1:
            near = list(base)
            for _ in range(rng.randrange(3)):
                near[rng.randrange(len(near))] = f"x{rng.randrange(9)}"
            text = " ".join(near)
        if k % 7 == 2:
            text = "Same text\tfor ALL of\nthem"
        rows.append((k, text, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "Z", None]), len(text)))
    rows += [(n, None, "en", "a", None), (n + 1, "", "en", "b", 0), (n + 2, " \n\t ", None, "b", 4), (n + 3, "ÄÖ é  漢字 ÄÖ", "de", "c", 11), (n + 4, " ".join(words(rng, 20_000)), "en", "a", 1)]
    rows += [rows[4], rows[4], (None, "no id here at all", "en", "a", 3), (None, None, None, None, None)]
    return rows


def frame(spark, rows=None, extra=True):
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    if not extra:
        return df
    for name in ("size", "_text", "key", "shard", "token_ids", "score", "kept", "grade", "copies", "rank", "_spans", "_id", "block", "hits"):
        df = df.selectExpr("*", f"'mine' AS {name}")
    return df
