"""Plain-text schedules: headings, dates, and lines of two teams with a score."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame

from pitchlake.functions.values import MONTHS
from pitchlake.sources.landing import text_of

MONTH = {name: m for m, names in MONTHS.items() for name in names.split()}
WEEKDAYS = r"(?:mon|tue|wed|thu|fri|sat|sun|mo|di|mi|do|fr|sa|so|lun|mar|mié|mie|jue|vie|sáb|sab|dom)[a-zäáé]*\.?"
NAMED_DATE = re.compile(rf"^\[?\s*(?:{WEEKDAYS}[,\s]+)?(?:(?P<m>[A-Za-zäéá]{{3,}})[./\s]+(?P<d>\d{{1,2}})|(?P<d2>\d{{1,2}})\.?\s+(?P<m2>[A-Za-zäéá]{{3,}}))(?:[,\s/]+(?P<y>\d{{4}}))?\s*\]?", re.I)
NUMBER_DATE = re.compile(rf"^\[?\s*(?:{WEEKDAYS}[,\s]+)?(?:(?P<y>\d{{4}})-(?P<m>\d{{1,2}})-(?P<d>\d{{1,2}})|(?P<d2>\d{{1,2}})[./](?P<m2>\d{{1,2}})(?:[./](?P<y2>\d{{4}}|\d{{2}}))?)\.?\s*\]?", re.I)
TIME = re.compile(r"^(\d{1,2})[:.](\d{2})(?:\s*h)?(?:\s*(UTC\s*[+-]\s*\d{1,2}(?::\d{2})?))?\s+", re.I)
GOALS = r"\d{1,2}\s*[-–]\s*\d{1,2}"
SCORE = re.compile(rf"(?<![\d-])({GOALS})(?![\d-])\s*((?:pen|pso|p|aet|a\.e\.t|agg|gg|ft)\.?(?:/\w+)?)?", re.I)
PARENS = re.compile(rf"\(\s*({GOALS}(?:\s*,\s*{GOALS})*)\s*\)")
LABELLED = re.compile(rf"\b(HT|FT|ET)\s*:?\s*({GOALS})|\b({GOALS})\s*(HT)\b", re.I)
STATUS = re.compile(r"\[?\b(postponed|cancelled|canceled|abandoned|awarded|suspended)\b\.?\]?", re.I)
PLACE = re.compile(r"\s@\s*(.+?)(?:\s+att(?:endance)?\.?:?\s*([\d.,]+))?\s*$", re.I)
ROUND = re.compile(r"^(?:[▪»*#-]+\s*)?((?:matchday|round|week|spieltag|jornada|group|final|semi-?finals?|quarter-?finals?|play-?offs?|\d+\.\s*(?:spieltag|runde|round))\b.*|.*\b(?:round of \d+|finals?)\b.*)$", re.I)
NOTE = re.compile(r"\[([^\]]*)\]\s*$")
SEASON = re.compile(r"((?:19|20)\d{2})(?:\s*[/-]\s*(\d{4}|\d{2}))?")
#: Which periods parentheses hold, by the marker of the main score and how many there are.
INNER = {("pen", 3): ("et", "ft", "ht"), ("pen", 2): ("ft", "ht"), ("pen", 1): ("ft",), ("aet", 2): ("ft", "ht"), ("aet", 1): ("ft",), ("agg", 2): ("ft", "ht"), ("agg", 1): ("ft",), ("ft", 1): ("ht",), ("ft", 2): ("ht",)}
MAIN = {"pen": "pen", "pso": "pen", "p": "pen", "aet": "et", "a.e.t": "et", "agg": "agg", "gg": "et", "ft": "ft", "": "ft"}
COLUMNS = "path string, line int, competition string, season string, round string, matchday int, day date, time string, home_team string, away_team string, status string, hg int, ag int, hht int, aht int, het int, aet int, hp int, ap int, hagg int, aagg int, venue string, attendance int, notes string"


@dataclass
class Match:
    line: int
    round: str | None
    day: date | None
    time: str | None
    home: str
    away: str
    status: str
    scores: dict[str, tuple[int, int]] = field(default_factory=dict)
    venue: str | None = None
    attendance: int | None = None
    notes: list[str] = field(default_factory=list)


def _goals(text: str) -> tuple[int, int]:
    a, b = re.split(r"[-–]", text)
    return int(a), int(b)


def scores(text: str) -> tuple[dict[str, tuple[int, int]], str, str] | None:
    """Goals by period and what stands before and after the score; None without one.

    The first score is the main one, its marker says of which period; parentheses after it hold earlier periods; more
    tagged scores may follow; labels name their period and win.
    """
    main = SCORE.search(text)
    if main is None:
        return None
    before, rest = text[: main.start()].strip(), text[main.end() :]
    marker = re.sub(r"\.$", "", (main[2] or "").lower()).split("/")[0]
    period = MAIN[marker if marker in MAIN else ""]
    found = {period: _goals(main[1])}
    named = {"et": "aet"}.get(period, period)
    while True:
        rest = rest.lstrip(" .,")
        inner, more = PARENS.match(rest), SCORE.match(rest)
        if inner:
            parts = [_goals(x) for x in inner[1].split(",")]
            for key, goals in zip(INNER.get((named, min(len(parts), 3)), ()), parts, strict=False):
                found.setdefault(key, goals)
            rest = rest[inner.end() :]
        elif more and more[2]:
            found.setdefault(MAIN.get(more[2].lower().rstrip(".").split("/")[0], "ft"), _goals(more[1]))
            rest = rest[more.end() :]
        else:
            break
    for m in LABELLED.finditer(text):
        label = (m[1] or m[4]).lower()
        found[{"aet": "et"}.get(label, label)] = _goals(m[2] or m[3])
    return found, before, LABELLED.sub("", rest).strip(" .,()")


def _date(line: str, years: tuple[int | None, int | None]) -> tuple[date | None, str] | None:
    """A date at the start of a line and what follows it."""
    for pattern in (NUMBER_DATE, NAMED_DATE):
        m = pattern.match(line)
        if not m:
            continue
        g = m.groupdict()
        month = g.get("m") or g.get("m2")
        day, year = int(g.get("d") or g.get("d2")), g.get("y") or g.get("y2")
        number = int(month) if month.isdigit() else MONTH.get(month.lower().rstrip("."))
        if number is None:
            continue
        if year is not None:
            whole = int(year) + (2000 if len(year) == 2 else 0)
        elif years[0] is not None:
            whole = years[0] if number >= 7 or years[1] is None else years[1]
        else:
            return None, line[m.end() :].strip()
        try:
            return date(whole, number, day), line[m.end() :].strip()
        except ValueError:
            return None, line[m.end() :].strip()
    return None


def _years(season: str | None) -> tuple[int | None, int | None]:
    m = SEASON.search(season or "")
    if not m:
        return None, None
    start = int(m[1])
    if not m[2]:
        return start, None
    return start, int(m[2]) if len(m[2]) == 4 else start // 100 * 100 + int(m[2]) + (100 if int(m[2]) < start % 100 else 0)


def parse(text: str, competition: str | None = None, season: str | None = None) -> tuple[str | None, str | None, list[Match]]:
    """Competition, season and matches of one file, line by line: headings, dates and times hold for the lines below."""
    title, team, round_, day, time = competition, None, None, None, None
    out: list[Match] = []
    for n, raw in enumerate(text.splitlines(), 1):
        line = raw.split("##")[0].rstrip()
        body = line.strip()
        if not body or body.startswith("#") or set(body) <= set("=-_*"):
            continue
        if body.startswith("="):
            head = body.strip("= ").strip()
            if body.startswith("==") and not body.startswith("= "):
                round_, day, time = head, None, None
                continue
            parts = [p.strip() for p in head.split("|")]
            team = parts[1] if len(parts) > 1 else None
            found = SEASON.search(parts[0])
            title = competition or (SEASON.sub("", parts[0]).strip(" ,-/") or None)
            season = season or (found[0].replace(" ", "") if found else None)
            continue
        inner = PARENS.fullmatch(body)
        if inner and out:
            parts = [_goals(x) for x in inner[1].split(",")]
            last = out[-1]
            kind = "pen" if "pen" in last.scores else "aet" if "et" in last.scores else "ft"
            for key, goals in zip(INNER.get((kind, min(len(parts), 3)), ()), parts, strict=False):
                last.scores.setdefault(key, goals)
            continue
        if body[0] in "([" and body[-1] in ")]" and out and not _date(body, _years(season)):
            out[-1].notes.append(body.strip("()[]"))
            continue
        found_date = _date(body, _years(season))
        if found_date is not None:
            day, body = found_date
            time = None
            if not body:
                continue
        found_time = TIME.match(body + " ")
        if found_time:
            time = f"{int(found_time[1]):02d}:{found_time[2]}" + (f" {found_time[3]}" if found_time[3] else "")
            body = (body + " ")[found_time.end() :].strip()
        if not body:
            continue
        venue, attendance, notes = None, None, []
        note = NOTE.search(body)
        if note and not STATUS.search(note[0]):
            notes.append(note[1])
            body = body[: note.start()].rstrip()
        place = PLACE.search(body)
        if place:
            venue, body = place[1].strip(), body[: place.start()].rstrip()
            attendance = int(re.sub(r"\D", "", place[2])) if place[2] else None
        state = STATUS.search(body)
        if state:
            body = (body[: state.start()] + body[state.end() :]).strip()
        own = re.match(r"^\(([hHaA])\)\s*(.+)$", body)
        got = scores(body)
        sides: tuple[str, str] | None = None
        if own and team:
            other = got[1] if got else own[2]
            other = re.sub(r"^\([hHaA]\)\s*", "", other).strip()
            sides = (team, other) if own[1] in "hH" else (other, team)
        elif got and got[1] and got[2]:
            sides = (re.sub(r"\s+(?:v|vs)\.?\s*$", "", got[1], flags=re.I).strip(), got[2].strip())
        else:
            bare = re.split(r"\s+(?:v|vs)\.?\s+|\s+[-–]\s+", body, maxsplit=1, flags=re.I)
            if got and re.search(r"\s+(?:v|vs)\.?\s+", got[1] or "", re.I):
                bare = re.split(r"\s+(?:v|vs)\.?\s+", got[1], maxsplit=1, flags=re.I)
            if len(bare) == 2 and all(x.strip() for x in bare) and (got is None or got[1] and not got[2]):
                sides = (bare[0].strip(), bare[1].strip())
        if sides is None or not all(sides):
            if ROUND.match(body) or re.match(r"^[▪»]", raw.strip()):
                round_ = re.sub(r"^[▪»*#-]+\s*", "", body)
                shown = re.search(r"[|,(]\s*(.+?)\)?$", round_)
                inline = _date(shown[1], _years(season)) if shown else None
                day = inline[0] if inline else None
                time = None
            elif out:
                out[-1].notes.append(body)
            continue
        period = got[0] if got else {}
        word = state[1].lower().replace("canceled", "cancelled") if state else None
        status = word or ("finished" if period else "scheduled")
        out.append(Match(n, round_, day, time, *sides, status, period, venue, attendance, notes))
    return title, season, out


def rows_of(path: str, content: bytes, competition: str | None = None, season: str | None = None) -> list[tuple]:
    title, season, found = parse(text_of(content), competition, season)
    out = []
    for m in found:
        number = re.search(r"\d+", m.round or "")
        periods = [g for p in ("ft", "ht", "et", "pen", "agg") for g in m.scores.get(p, (None, None))]
        out.append((path, m.line, title, season, m.round, int(number[0]) if number else None, m.day, m.time, m.home, m.away, m.status, *periods, m.venue, m.attendance, "; ".join(m.notes) or None))
    return out


def matches(found: DataFrame, competition: str | None = None, season: str | None = None) -> DataFrame:
    """Matches of schedule files (path, content). A file is one state machine and stays in one task; files are parallel."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for p, c in zip(frame.path, frame.content, strict=True) if c is not None for r in rows_of(p, c, competition, season)]
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in COLUMNS.split(", ")])
            yield out.astype({x.split()[0]: "Int32" for x in COLUMNS.split(", ") if x.endswith(" int")})

    return found.select("path", "content").mapInPandas(run, COLUMNS)


def rendered(home: str, away: str, ft: tuple[int, int] | None, ht: tuple[int, int] | None = None) -> str:
    """One line that parse() reads back."""
    if ft is None:
        return f"{home} v {away}"
    return f"{home} {ft[0]}-{ft[1]}" + (f" ({ht[0]}-{ht[1]})" if ht else "") + f" {away}"
