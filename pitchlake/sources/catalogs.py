"""Identity catalogs of leagues, clubs and players."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame

from pitchlake.sources.landing import text_of
from pitchlake.sources.schedule_text import MONTH

COLUMNS = "path string, kind string, line int, code string, name string, country string, aliases array<string>, division int, founded_year int, city string, stadium string, position string, height_m double, birth_date date, birthplace string"
BORN = re.compile(r"\bb\.?\s*(\d{1,2})\s+([A-Za-zäéá]+)\.?\s+(\d{4})(?:\s*@\s*([^,]+))?", re.I)
HEIGHT = re.compile(r"^(\d[.,]\d{1,2})\s*m$|^(\d{3})\s*(?:cm)?$", re.I)
# Positions in catalogs.
POSITION = re.compile(r"^(?:GK|DF|MF|FW|G|D|M|F)$", re.I)


def _aliases(text: str) -> list[str]:
    return [a.strip() for a in text.split("|") if a.strip()]


def _league(body: str) -> dict:
    m = re.match(r"^(\S+)\s{1,}(.+)$", body)
    if not m:
        return {"name": body}
    names = _aliases(m[2])
    number = re.search(r"\.(\d+)$|^[a-z]+(\d+)$", m[1])
    return {"code": m[1], "name": names[0], "aliases": names[1:], "division": int(number[1] or number[2]) if number else None}


def _club(body: str) -> dict:
    names, *rest = [p.strip() for p in body.split(",")]
    out = {"name": _aliases(names)[0], "aliases": _aliases(names)[1:]}
    for part in rest:
        if re.fullmatch(r"\d{4}", part):
            out["founded_year"] = int(part)
        elif part.startswith("@"):
            out["stadium"] = part[1:].strip() or None
        elif part:
            out.setdefault("city", part)
    return out


def _player(body: str) -> dict:
    names, *rest = [p.strip() for p in body.split(",")]
    out = {"name": _aliases(names)[0], "aliases": _aliases(names)[1:]}
    born = BORN.search(body)
    if born and MONTH.get(born[2].lower()):
        try:
            out["birth_date"] = date(int(born[3]), MONTH[born[2].lower()], int(born[1]))
        except ValueError:
            pass
        out["birthplace"] = born[4].strip() if born[4] else None
    for part in rest:
        tall = HEIGHT.match(part)
        if tall:
            out["height_m"] = float(tall[1].replace(",", ".")) if tall[1] else int(tall[2]) / 100
        elif POSITION.match(part):
            out["position"] = part.upper()
    return out


def parse(kind: str, text: str) -> list[dict]:
    """Records of one file: `= Heading` sets the country, a line that starts with | adds aliases to the record before."""
    read = {"leagues": _league, "clubs": _club, "players": _player}[kind]
    country, out = None, []
    for n, raw in enumerate(text.splitlines(), 1):
        body = re.sub(r"(^|\s)#.*$", "", raw).strip()
        if not body:
            continue
        if body.startswith("="):
            country = body.strip("= ").strip() or None
        elif body.startswith("|"):
            if out:
                out[-1]["aliases"] += _aliases(body)
        else:
            record = {"aliases": [], **read(body), "line": n, "country": country}
            out.append(record)
    return out


def records(found: DataFrame) -> DataFrame:
    """Records of catalog files (path, kind, content) of kind leagues, clubs or players; other kinds are skipped."""
    kinds = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "double": pa.float64(), "date": pa.date32()}
    columns = [(x.split()[0], kinds[x.split()[1]]) for x in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"path": f["path"], "kind": f["kind"], **r} for f in batch.to_pylist() for r in parse(f["kind"], text_of(f["content"]))]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in columns], [c for c, _ in columns])

    return found.where("kind in ('leagues', 'clubs', 'players')").select("path", "kind", "content").mapInArrow(run, COLUMNS)
