"""The cheapest repair of conversations against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from pitchlake.llm import conversation_repair as cr

WHITE = " \t\n\v\f\r"


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        here = out.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        here += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(WHITE)
        out.append("blank" if not body.strip(WHITE) else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def search(rows, kinds):
    """The least (cost, audit) of all, by taking edits in that order; and the turns that it leaves."""
    heap, best = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, at, roles, turns = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in turns)
        state = (at, roles[-1:])
        if best.setdefault(state, (cost, audit)) < (cost, audit):
            continue
        for role in ("user", "assistant"):
            if re.fullmatch("(s?(ua)*u?)?", roles + role[0]):
                heapq.heappush(heap, (cost + 2, audit + "I", at, roles + role[0], (*turns, (role, ""))))
        if at < len(rows):
            _, own, text = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, roles, turns))
            if kinds[at] not in ("blank", "duplicate"):
                more = int(kinds[at] == "truncated")
                for letter, role, price in (("K", own, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if role and re.fullmatch("(s?(ua)*u?)?", roles + role[0]):
                        heapq.heappush(heap, (cost + price + more, audit + letter, at + 1, roles + role[0], (*turns, (role, text))))


def brute(rows):
    out = []
    for conv, here in damage(rows).items():
        kinds = faults(here)
        cost, audit, text = search(here, kinds)
        turns = [t for t, *_ in here if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in here]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out.append((conv, gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def table(seed=5, n=120):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "bot", ""])
            text = rng.choice(["Fine.", "Cut of", "So? ", None, " \t", "Éh!\n", "Fine.", "x.y"])
            rows.append((c, rng.choice([turn, turn, turn * 2, None]), role, text))
    rows += [(None, 0, "user", "No id."), (None, 1, "assistant", "Yes."), (-5, None, None, None)]
    return rows + rows[:6]


def run(spark, rows, tmp_path):
    spark.createDataFrame([(*r, "mine", 1) for r in rows], "conv_id long, turn long, role string, text string, place string, fault int").write.parquet(str(tmp_path / "conversations.parquet"))
    return sorted((tuple(r) for r in cr.op12_conversation_repair(spark, str(tmp_path)).collect()), key=repr)


@pytest.mark.parametrize("seed", [5, 6])
def test_repair_equals_a_search(spark, tmp_path, seed):
    rows = table(seed)
    assert run(spark, rows, tmp_path) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


def test_lost_conversations_have_an_empty_audit(spark, tmp_path):
    lost = next((c, t) for c in range(99) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    assert run(spark, [(*lost, "user", "Gone.")], tmp_path) == [(lost[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("width", [8, 48])
def test_paths_settle_letters_and_widen(width):
    rng = random.Random(width)
    for n in (0, 1, 7, 60):
        rows = [(k, rng.choice(["user", "assistant", "bot", "system"]), rng.choice(["a.", "b", ""])) for k in range(n)]
        kinds = [rng.choice([None, "truncated", "blank", "duplicate"]) for _ in rows]
        paths = cr.Paths(width)
        told = "".join(paths.row(r[:1], f) for (_, r, _), f in zip(rows, kinds, strict=True))
        cost, rest = paths.close()
        assert (cost, told + rest) == search(rows, kinds)[:2]


def test_a_long_conversation_needs_few_open_letters():
    paths = cr.Paths()
    told = "".join(paths.row("ua"[k % 2], None) for k in range(20_000))
    assert paths.width <= 2 * cr.WIDTH and told + paths.close()[1] == "K" * 20_000
