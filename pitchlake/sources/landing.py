"""Files as they lie: which to read, what they are, their members and hashes."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a dataset may consist of and how large it may be.
SUFFIXES = (".txt", ".json", ".csv", ".zip")
IGNORED = (".git", ".github", "node_modules", "__MACOSX", "__pycache__")
MAX_FILES, MAX_FILE, MAX_TOTAL, MAX_MEMBERS, MAX_RATIO = 5000, 25 << 20, 250 << 20, 20, 100


def files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES, strict: bool = True) -> DataFrame:
    """path, length, content, sha256 of the files below a folder with such suffixes, outside ignored folders.

    strict: more files, or larger ones, than a dataset may have raise ValueError; only sizes are read for that.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    parts = F.split("path", "/")
    kept = found.where(F.lower("path").rlike(r"\.(" + "|".join(s[1:] for s in suffixes) + r")$") & ~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in IGNORED])))
    if strict:
        n, most, total = kept.agg(F.count(F.lit(1)), F.max("length"), F.sum("length")).first()
        if n > MAX_FILES or (most or 0) > MAX_FILE or (total or 0) > MAX_TOTAL:
            raise ValueError(f"dataset beyond its limits: {n} files, the largest of {most} bytes, {total} in all")
    return kept.select("path", "length", "content", F.sha2("content", 256).alias("sha256"))


def safe_member(name: str) -> bool:
    """Whether an archive member stays below the folder that it is unpacked to."""
    path = PurePosixPath(name.replace("\\", "/"))
    return not (path.is_absolute() or ".." in path.parts or (path.parts and ":" in path.parts[0]) or any(p in IGNORED for p in path.parts))


def unpack(path: str, content: bytes, suffixes: tuple[str, ...], max_members: int = MAX_MEMBERS, max_bytes: int = MAX_FILE) -> list[tuple[str, str | None, bytes | None, str | None]]:
    """(path, member, content, error) of an archive; one row with an error if it must not be unpacked."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            members = [i for i in archive.infolist() if not i.is_dir()]
            wanted = [i for i in members if i.filename.lower().endswith(suffixes) and safe_member(i.filename)]
            if len(members) > max_members:
                return [(path, None, None, "too_many_members")]
            if any(not safe_member(i.filename) and not any(p in IGNORED for p in PurePosixPath(i.filename).parts) for i in members):
                return [(path, None, None, "unsafe_member")]
            if any((i.external_attr >> 16) & 0o170000 == 0o120000 for i in members):
                return [(path, None, None, "symbolic_link")]
            if any(i.file_size > max_bytes or i.file_size > MAX_RATIO * max(i.compress_size, 1) for i in wanted) or sum(i.file_size for i in wanted) > 2 * max_bytes:
                return [(path, None, None, "too_large")]
            return [(path, i.filename, archive.read(i), None) for i in wanted]
    except (zipfile.BadZipFile, RuntimeError, OSError):
        return [(path, None, None, "not_an_archive")]


def members(found: DataFrame, suffixes: tuple[str, ...] = (".csv", ".json", ".txt")) -> DataFrame:
    """path, member, content, error: archives as their members, other files as themselves (member null)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for path, content in zip(frame.path, frame.content, strict=True):
                rows += unpack(path, content, suffixes) if path.lower().endswith(".zip") else [(path, None, content, None)]
            yield pd.DataFrame(rows, columns=["path", "member", "content", "error"])

    return found.select("path", "content").mapInPandas(run, "path string, member string, content binary, error string")


def payload(path: str, content: bytes, most: int) -> tuple[str | None, bytes | None, str | None]:
    """(suffix, content, error) of an upload: a CSV or JSON file, or an archive with exactly one of them."""
    suffix = PurePosixPath(path).suffix.lower()
    if len(content) > most:
        return suffix, None, "too_large"
    if suffix in (".csv", ".json"):
        return suffix, content, None
    if suffix != ".zip":
        return suffix, None, "unsupported"
    rows = unpack(path, content, (".csv", ".json"), max_bytes=most)
    if any(error for *_, error in rows):
        return suffix, None, next(error for *_, error in rows if error)
    if len(rows) != 1:
        return suffix, None, "not_one_payload"
    return PurePosixPath(rows[0][1]).suffix.lower(), rows[0][2], None


def uploads(found: DataFrame, most: int = MAX_FILE) -> DataFrame:
    """path, suffix, content, error of uploaded files (path, content): the one payload of each, or why it has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, *payload(p or "", c or b"", most)) for p, c in zip(frame.path, frame.content, strict=True)]
            yield pd.DataFrame(rows, columns=["path", "suffix", "content", "error"])

    return found.select("path", "content").mapInPandas(run, "path string, suffix string, content binary, error string")


def json_records(content: Column) -> Column:
    """The objects of a JSON payload as maps: a list, what `records` or else `matches` lists, or one object; null if it is
    none of these."""
    text = F.regexp_replace(F.decode(content, "UTF-8"), "^\ufeff", "")
    rows = "array<map<string, string>>"
    listed = F.from_json(text, f"records {rows}, matches {rows}")
    one = F.from_json(text, "map<string, string>")
    named = F.map_contains_key(one, F.lit("records")) | F.map_contains_key(one, F.lit("matches"))
    found = F.when(F.ltrim(text).startswith("["), F.from_json(text, rows)).when(named, F.coalesce(listed["records"], listed["matches"])).when(one.isNotNull(), F.array(one))
    return F.when(~F.exists(found, lambda x: x.isNull()), found)


def kind(path: Column) -> Column:
    """results, leagues, clubs, players or auxiliary, by a file's name and folders."""
    low = F.lower(path)
    return (
        F.when(low.rlike(r"\.(props|history|stadiums|seasons)\.txt$"), "auxiliary")
        .when(low.rlike(r"(^|/)(leagues?)(/|[^/]*\.txt$)"), "leagues")
        .when(low.rlike(r"(^|/)(clubs?|teams?)(/|[^/]*\.txt$)"), "clubs")
        .when(low.rlike(r"(^|/)(players?)(/|[^/]*\.txt$)"), "players")
        .otherwise("results")
    )


def text_of(content: bytes) -> str:
    """UTF-8 with or without a mark, else Windows Latin, else Latin-1."""
    for encoding in ("utf-8-sig", "cp1252"):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1")
