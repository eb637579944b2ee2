"""Encoding and decoding against the tokenizers library on whole texts."""

import random

import pytest
from tokenizers import Tokenizer

from pitchlake.llm import bpe

PATH = bpe.vocabulary()


@pytest.fixture(scope="module")
def whole():
    tok = Tokenizer.from_file(PATH)
    tok.no_truncation()
    tok.no_padding()
    return lambda text: tok.encode(text, add_special_tokens=False).ids


def texts():
    rng = random.Random(5)
    alphabet = "aab  \n\t'sétrell123.,!?éü 　漢字🙂\u0085"
    yield from ("", " ", "a", "\n\n  x", "it's <|endoftext|> over", "<|endof" + "text|>x", "a" * 9000, "ab1!" * 4000, "é" * 5000, "漢" * 700 + " " + "字" * 700)
    for n in (5, 40, 300, 3000):
        for _ in range(12):
            yield "".join(rng.choice(alphabet) for _ in range(n))


@pytest.mark.parametrize("leaf", [16, 64, 4096])
def test_trees_agree_with_whole_texts(whole, leaf):
    tok = bpe.codec(PATH)
    for text in texts():
        assert bpe.encode_whole(tok, text, leaf) == whole(text)
        assert bpe.encode_unsplit(tok, text.replace("<|endoftext|>", ""), leaf) == whole(text.replace("<|endoftext|>", ""))


def test_long_texts_are_dealt_out_and_joined(spark, whole):
    rows = [(k, t, "kept", [1]) for k, t in enumerate(texts())] + [(None, None, "null", None), (3, "same", "x", None), (3, "same", "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _note string, token_ids array<int>")
    out = bpe.decode(bpe.encode(docs, PATH, spread=100), PATH).collect()
    assert len(out) == len(rows)
    both = bpe.encode(docs, PATH, spread=100, decoded=True)
    assert both.columns == [*docs.drop("token_ids").columns, "token_ids", "decoded"]
    assert sorted(map(repr, both.collect())) == sorted(map(repr, out))
    for row in out:
        assert row.token_ids == whole(row.text or "")
        assert row.decoded == (row.text or "")
    assert bpe.encode(docs.limit(0), PATH).collect() == []


def test_three_million_code_points_in_a_wide_row(spark, whole):
    text = "wide é 漢 text " * 220_000
    docs = spark.createDataFrame([(1, text, "en", "x" * 1000), (2, "short", "de", None)], "doc_id long, text string, lang string, note string")
    rows = {r.doc_id: r for r in bpe.encode(docs, PATH).collect()}
    assert rows[1].token_ids == whole(text) and rows[1].note == "x" * 1000 and rows[1].text == text and rows[2].token_ids == whole("short")
    plan = bpe.encode(docs, PATH)._jdf.queryExecution().optimizedPlan().toString()
    dealt = next(line for line in plan.splitlines() if "Generate posexplode" in line)
    assert "note" not in dealt.split("Generate posexplode")[1]
