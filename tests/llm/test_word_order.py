"""The language model's predictors reach over the borders of words."""

import random
import zlib

import pytest

from pitchlake.llm import mixing_lm
from tests.llm.fixtures import frame


@pytest.mark.parametrize("sizes", [None, (64, 2_000)])
def test_score_depends_on_the_order_of_words(spark, monkeypatch, sizes):
    if sizes:
        monkeypatch.setattr(mixing_lm, "BLOCK_ROWS", sizes[0])
        monkeypatch.setattr(mixing_lm, "PASSAGE_CHARS", sizes[1])
    rng = random.Random(5)
    phrases = ["red apples fall", "cold rivers run", "old doors creak", "wise owls sleep"]
    held = [k for k in range(10_000, 20_000) if zlib.crc32(str(k).encode()) % 7 == 2][:2]
    rows = [(k, " ".join(rng.choice(phrases) for _ in range(12)), "en", "a", 1) for k in range(200)]
    words = [w for p in phrases for w in p.split()]
    rows += [(held[0], " ".join(words), "en", "a", 1), (held[1], " ".join(words[::-1]), "en", "a", 1)]
    got = {r.doc_id: r for r in mixing_lm.score(frame(spark, rows)).where("held_out").collect()}
    known, mixed = got[held[0]], got[held[1]]
    assert round(known.base_score, 6) == round(mixed.base_score, 6) and known.n_tokens == mixed.n_tokens
    assert known.score > mixed.score + 1
