"""Cheapest repair of conversations whose turns are lost, emptied, cut, repeated or given to the wrong role."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchlake.llm.common import discard, stash, table

#: Digits of audit letters in ASCII order; 0 is the padding behind an audit's end. A digit takes BITS bits.
DELETE, INSERT, KEEP, REROLE, BITS = 1, 2, 3, 4, 3
LETTERS = "-DIKR"
#: What each edit costs; an undeleted truncated row costs ONE_CUT more.
COST, ONE_CUT = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}, 1
#: States of a path: nothing yet, after system, after user, after assistant. Initials that a state may be followed by.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: A path dearer by more than this than another one can't win: two inserts and one deletion lead from any state on as from any other.
SLACK = 2 * COST[INSERT] + COST[DELETE]
#: Digits of a weight at first.
WIDTH = 48


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone of conversations, damaged by crc32(conv_id:turn) % 20.

    0 marks the row gone, 1 empties the text, 2 takes out . ! ?, 3 repeats the row, 4 sets role user; a null is one space.
    """
    text = F.coalesce(F.col("text"), F.lit(" "))
    number = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.pmod(F.crc32(F.encode(number, "UTF-8")), F.lit(20))
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit(" ")).alias("role"), text.alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")), "gone": F.col("_kind") == 0})
    times = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("_time", times).select("conv_id", "turn", "role", "text", "gone")


def with_faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, gone) with place, from 1 by turn (nulls first; ties by role and text), and fault:
    blank, duplicate, truncated or null. One shuffle by conversation; rows that are gone only tell that it exists."""
    word = r"[^\x20\x09-\x0D]"
    blank, whole = ~F.col("text").rlike(word), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    order = Window.partitionBy("conv_id", "gone").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    again = Window.partitionBy("conv_id", "gone", "role", "_digest").orderBy("place")
    rows = rows.repartition("conv_id").withColumn("place", F.row_number().over(order).cast("long"))
    rows = rows.withColumn("_digest", F.sha2("text", 256)).withColumn("_seen", F.row_number().over(again) > 1)
    fault = F.when(blank, "blank").when(F.col("_seen"), "duplicate").when(~whole, "truncated")
    return rows.withColumn("fault", fault).drop("_digest", "_seen")


class Paths:
    """The cheapest edits of a conversation so far, one path per state, each a single integer.

    Its high digits are the cost; `width` digits below are the letters, the first one highest, zeros behind the last. The
    least integer is then the cheapest path and among equally cheap ones the ASCII-least. (Of two equally cheap paths over
    the same rows none begins the other: more letters over the same rows are inserts and cost more.) Letters that all
    paths agree on are settled and make room; while they agree on none the width doubles.
    """

    def __init__(self, width: int = WIDTH):
        self.width, self.cut = width, 0
        self.best: list[tuple[int, int] | None] = [(0, 0), None, None, None]

    def _edited(self, path: tuple[int, int], letter: int, more: int = 0) -> tuple[int, int]:
        weight, used = path
        return weight + ((COST[letter] + more) << BITS * self.width) + (letter << BITS * (self.width - 1 - used)), used + 1

    def _inserted(self) -> None:
        """Let paths insert a user and then an assistant; longer runs of inserts return to a state at a cost."""
        old = self.best
        users = [old[USER], *[self._edited(old[s], INSERT) for s in (START, SYSTEM, ASSISTANT) if old[s]]]
        user = min((p for p in users if p), default=None)
        assistants = [p for p in (old[ASSISTANT], self._edited(user, INSERT) if user else None) if p]
        self.best = [old[START], old[SYSTEM], user, min(assistants, default=None)]

    def row(self, initial: str, fault: str | None) -> str:
        """Take a row; return the letters that it settles."""
        out = self._settled() if max(p[1] for p in self.best if p) > self.width - 4 else ""
        self._inserted()
        new: list[tuple[int, int] | None] = [self._edited(p, DELETE) if p else None for p in self.best]
        if fault not in ("blank", "duplicate"):
            more = ONE_CUT if fault == "truncated" else 0
            for state, path in enumerate(self.best):
                if path:
                    kept = FOLLOWS[state].get(initial)
                    into = ASSISTANT if state == USER else USER
                    for to, letter in ((kept, KEEP), (into, REROLE)):
                        if to is not None:
                            other = self._edited(path, letter, more)
                            new[to] = other if new[to] is None else min(new[to], other)
        top = BITS * self.width
        most = min(p[0] >> top for p in new if p) + SLACK
        self.best = [p if p and p[0] >> top <= most else None for p in new]
        return out

    def letters(self, path: tuple[int, int]) -> str:
        return "".join(LETTERS[path[0] >> BITS * (self.width - 1 - k) & 7] for k in range(path[1]))

    def _settled(self) -> str:
        told = [self.letters(p) for p in self.best if p]
        low, high = min(told), max(told)
        n = next((k for k, c in enumerate(low) if k >= len(high) or high[k] != c), len(low))
        size, mask = BITS * self.width, (1 << BITS * self.width) - 1
        if n:
            self.best = [p and ((p[0] >> size << size) + ((p[0] & mask) << BITS * n & mask), p[1] - n) for p in self.best]
        else:
            self.width *= 2
            self.best = [p and ((p[0] >> size << 2 * size) + ((p[0] & mask) << size), p[1]) for p in self.best]
        return low[:n]

    def close(self) -> tuple[int, str]:
        """The cost, and the letters not yet settled."""
        if max(p[1] for p in self.best if p) > self.width - 4:
            out = self._settled()
            cost, rest = self.close()
            return cost, out + rest
        self._inserted()
        path = min(p for p in (self.best[START], self.best[ASSISTANT]) if p)
        return path[0] >> BITS * self.width, self.letters(path)


DECISIONS = pa.schema([
    ("conv_id", pa.int64()), ("place", pa.int64()), ("edits", pa.string()), ("closes", pa.bool_()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
])


class _Conversation:
    """One conversation as its rows go by in order."""

    def __init__(self, conv_id):
        self.conv_id, self.paths, self.state, self.place, self.open = conv_id, Paths(), START, 1, ""
        self.waiting: deque[str] = deque()
        self.audit: list[str] = []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.turns = 0
        self.first = self.last = self.initial = None

    def row(self, turn, initial: str, fault: str | None) -> list[dict]:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        if fault:
            self.counts[fault] += 1
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        self.waiting.append(initial)
        return self._told(self.paths.row(initial, fault))

    def _told(self, letters: str) -> list[dict]:
        """Rows of edits for letters that are decided: each edit with the role it leads to, `.` where the row's own stays."""
        out = []
        if letters:
            self.audit.append(letters)
        for letter in letters:
            into = "."
            if letter in "IR":
                self.state = ASSISTANT if self.state == USER else USER
                into = "ua"[self.state == ASSISTANT]
            self.open += letter + into
            if letter != "I":
                initial = self.waiting.popleft()
                if letter == "K":
                    self.state = FOLLOWS[self.state][initial]
                out.append({"conv_id": self.conv_id, "place": self.place, "edits": self.open, "closes": False})
                self.place, self.open = self.place + 1, ""
        return out

    def close(self) -> list[dict]:
        cost, letters = self.paths.close()
        out = self._told(letters)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        last = {"conv_id": self.conv_id, "place": self.place, "edits": self.open, "closes": True, "gaps": gaps, "illegal": self.illegal, "cost": cost, "audit": "".join(self.audit)}
        return [*out, last | self.counts]


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, told = None, []
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("conv_id", "gone", "turn", "initial", "fault")]
        for conv_id, gone, turn, initial, fault in zip(*columns, strict=True):
            if now is None or now.conv_id != conv_id:
                told += now.close() if now else []
                now = _Conversation(conv_id)
            if not gone:
                told += now.row(turn, initial, fault)
        if told:
            yield pa.RecordBatch.from_pylist(told, DECISIONS)
            told = []
    if now:
        yield pa.RecordBatch.from_pylist(now.close(), DECISIONS)


def decisions(rows: DataFrame) -> DataFrame:
    """The cheapest edits of each conversation of with_faults(): a row per place with edits, and a closing row per
    conversation with the edits behind its last row, its counts, cost and audit.

    edits are pairs of a letter (Delete, Insert, Keep, Rerole) and u, a or `.`. Rows pass a task in order and are not
    gathered: a conversation of any length needs room for the letters that aren't decided yet.
    """
    narrow = rows.select(F.col("conv_id").cast("long"), "gone", "place", F.col("turn").cast("long"), F.substring("role", 1, 1).alias("initial"), "fault")
    ordered = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "gone", "place")
    kinds = "conv_id long, place long, edits string, closes boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    return ordered.mapInArrow(_decide, kinds)


def repaired_turns(rows: DataFrame, told: DataFrame) -> DataFrame:
    """conv_id, place, nth, edit, role, text of what is left or put in: rows of with_faults() by their decisions()."""
    edits = told.select(F.col("conv_id").alias("_conv"), F.col("place").alias("_place"), "edits").where("edits <> ''")
    known = rows.where("not gone").select("conv_id", "place", "role", "text")
    joined = edits.join(known, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("place") == F.col("_place")), "left")
    nth = F.explode(F.sequence(F.lit(1), (F.length("edits") / 2).cast("int")))
    joined = joined.withColumn("nth", nth).withColumns({"edit": F.expr("substring(edits, 2 * nth - 1, 1)"), "_into": F.expr("substring(edits, 2 * nth, 1)")})
    role = F.when(F.col("_into") == "u", "user").when(F.col("_into") == "a", "assistant").otherwise(F.col("role"))
    text = F.when(F.col("edit") == "I", "").otherwise(F.col("text"))
    return joined.where("edit <> 'D'").select(F.col("_conv").alias("conv_id"), F.col("_place").alias("place"), "nth", "edit", role.alias("role"), text.alias("text"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    now, hashed, told = None, None, []
    for batch in batches:
        for conv_id, role, text in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "role", "text")], strict=True):
            if hashed is None or conv_id != now:
                if hashed:
                    told.append({"conv_id": now, "repaired_sha256": hashed.hexdigest()})
                now, hashed = conv_id, hashlib.sha256()
            else:
                hashed.update(b"\n")
            hashed.update(f"{role}:{text}".encode("utf-8", "replace"))
        if told:
            yield pa.RecordBatch.from_pylist(told, schema)
            told = []
    if hashed:
        yield pa.RecordBatch.from_pylist([{"conv_id": now, "repaired_sha256": hashed.hexdigest()}], schema)


def repaired_digests(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 over the role:text lines of repaired_turns(), which pass a task in order."""
    ordered = turns.select("conv_id", "place", "nth", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "place", "nth")
    return ordered.mapInArrow(_digest, "conv_id long, repaired_sha256 string")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations and their cheapest repair, one row per original conv_id.

    Null role, text, conv_id and turn count as one space where they are hashed or compared; a null conv_id is a conversation
    of its own. Rows of one turn follow by role and text. A conversation without rows has zeros, an empty audit and the
    hash of an empty string; an empty table gives an empty result. Repeated rows are duplicates.
    """
    rows = stash(with_faults(damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))), "turns")
    told = stash(decisions(rows), "decisions")
    digests = stash(repaired_digests(repaired_turns(rows, told)).select(F.col("conv_id").alias("_conv"), "repaired_sha256"), "digests")
    discard(rows)
    ends = told.where("closes").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    out = ends.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))


def _sql() -> str:
    def edited(path: str, letter: str, cost: str, line: str = "''") -> str:
        return f"CASE WHEN {path} IS NOT NULL THEN {{'c': {path}.c + {cost}, 'a': {path}.a || '{letter}', 't': {path}.t || {line}}} END"

    def closed(names: tuple[str, ...], rest: str) -> str:
        """rest over bu and ba after inserts."""
        b0, bs, bu, ba = names
        user = ", ".join(edited(s, "I", "2", "'user:' || chr(10)") for s in (b0, bs, ba))
        return f"(SELECT *, least(ba_, {edited('u1', 'I', '2', chr(39) + 'assistant:' + chr(39) + ' || chr(10)')}) AS a1 FROM (SELECT *, {ba} AS ba_, least({bu}, {user}) AS u1 FROM {rest}))"

    own, cut = "role || ':' || text || chr(10)", "CASE fault WHEN 'truncated' THEN 1 ELSE 0 END"

    def taken(path: str, initial: str, role: str) -> str:
        keep = f"CASE WHEN NOT gone_ AND left(role, 1) = '{initial}' THEN {edited(path, 'K', cut, own)} END"
        into = "" if role == "system" else f", CASE WHEN NOT gone_ THEN {edited(path, 'R', '2 + ' + cut, chr(39) + role + ':' + chr(39) + ' || text || chr(10)')} END"
        return keep + into

    step = closed(("b0", "bs", "bu", "ba"), "(SELECT d.conv_id, d.n + 1 AS n, d.b0, d.bs, d.bu, d.ba, role, text, fault, coalesce(fault IN ('blank', 'duplicate'), false) AS gone_ FROM dp d JOIN placed p ON p.conv_id = d.conv_id AND p.place = d.n + 1)")
    kind = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    crc = "4294967295 - list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id || ':' || turn, ''), lambda ch: list_concat([ascii(ch)::BIGINT], list_transform(range(8), lambda z: -1::BIGINT))))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END)"
    return f"""
WITH RECURSIVE kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, ({crc}) % 20 AS kind FROM conversations),
broken AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS nth FROM kinds WHERE kind <> 0)),
placed AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' END AS fault,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY place), 1) || left(role, 1) AS pair
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM broken)),
dp AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, CAST({{'c': 0, 'a': '', 't': ''}} AS {kind}) AS b0, CAST(NULL AS {kind}) AS bs, CAST(NULL AS {kind}) AS bu, CAST(NULL AS {kind}) AS ba FROM conversations
  UNION ALL
  SELECT conv_id, n, {edited("b0", "D", "3")}, least({edited("bs", "D", "3")}, {taken("b0", "s", "system")}),
    least({edited("u1", "D", "3")}, {taken("b0", "u", "user")}, {taken("bs", "u", "user")}, {taken("a1", "u", "user")}), least({edited("a1", "D", "3")}, {taken("u1", "a", "assistant")})
  FROM {step}),
ends AS (
  SELECT conv_id, least(b0, a1) AS best FROM {closed(("b0", "bs", "bu", "ba"), "(SELECT d.* FROM dp d JOIN (SELECT conv_id, max(n) AS n FROM dp GROUP BY conv_id) m ON m.conv_id = d.conv_id AND m.n = d.n)")}),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM placed GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.c AS cost, best.a AS audit, sha256(left(best.t, greatest(length(best.t) - 1, 0))) AS repaired_sha256
FROM ends LEFT JOIN counts USING (conv_id)"""


SQL = _sql()
