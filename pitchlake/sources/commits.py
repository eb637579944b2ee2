"""Tables of Parquet files that change by commits: only those parts are written anew that hold rows a commit touches.

A table's rows are placed in a fixed number of parts by a hash of some columns. A commit writes its parts below
data/commit=N and then one row below log/commit=N that says, for every part, which commit wrote it last. A commit counts
once its row is there; an attempt that dies before is overwritten by the next one. Files are never changed, so that a
reader goes on undisturbed, and an earlier commit can be read until vacuum(). One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.operators.consolidate import upsert

HEAD = "number long, action string, run string, places map<int, long>, done map<string, long>"


@dataclass(frozen=True)
class Table:
    """A folder that driver and executors share; `by`: the columns rows are placed by; parts: as many as a table of this size
    needs for a part to fit a task. by and parts must not change."""

    folder: str
    schema: T.StructType
    by: tuple[str, ...] = ("match_id",)
    parts: int = 64

    def place(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.parts)).cast("int").alias("_part")


@dataclass(frozen=True)
class Once:
    """Who asks for a commit, and that asker's number of it: a number not above the last one done changes nothing."""

    writer: str
    number: int


def _listed(spark: SparkSession, folder: str) -> list:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []


def commits(spark: SparkSession, table: Table) -> list[int]:
    """Numbers of the commits that count, in order."""
    found = {p.getName(): p for p in _listed(spark, f"{table.folder}/log")}
    whole = [n for n, p in found.items() if any(q.getName() == "_SUCCESS" for q in _listed(spark, p.toString()))]
    return sorted(int(n.split("=")[1]) for n in whole)


def _head(spark: SparkSession, table: Table, at: int | None = None) -> tuple[int, dict[int, int], dict[str, int]]:
    known = commits(spark, table)
    if at is None:
        at = known[-1] if known else -1
    elif at not in known:
        raise ValueError(f"no commit {at}")
    if at < 0:
        return -1, {}, {}
    row = spark.read.schema(HEAD).parquet(f"{table.folder}/log/commit={at}").first()
    return at, dict(row.places), dict(row.done)


def _rows(spark: SparkSession, table: Table, places: dict[int, int]) -> DataFrame:
    paths = [f"{table.folder}/data/commit={n}/_part={p}" for p, n in sorted(places.items())]
    return spark.read.schema(table.schema).parquet(*paths) if paths else spark.createDataFrame([], table.schema)


def read(spark: SparkSession, table: Table, at: int | None = None) -> DataFrame:
    """The table as its last commit left it, or commit `at`."""
    return _rows(spark, table, _head(spark, table, at)[1])


def commit(spark: SparkSession, table: Table, touched: DataFrame, change: Callable[[DataFrame], DataFrame], once: Once, action: str, run: str | None = None) -> bool:
    """Replace the parts that hold the keys of touched (its columns `by`) by change(their rows); False if it was done already.

    change gets all rows of those parts and gives all that are to be there; a row that belongs elsewhere is an error.
    """
    last, places, done = _head(spark, table)
    if done.get(once.writer, -1) >= once.number:
        return False
    wanted = {r[0] for r in touched.select(table.place()).distinct().collect()}  # table.parts numbers at most
    held = {p: n for p, n in places.items() if p in wanted}
    path = f"{table.folder}/data/commit={last + 1}"
    after = change(_rows(spark, table, held)).select(*table.schema.names, table.place())
    after.repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(path)
    written = {int(p.getName().split("=")[1]) for p in _listed(spark, path) if p.getName().startswith("_part=")}
    if not written <= wanted:
        raise ValueError(f"rows of parts that aren't touched: {sorted(written - wanted)}")
    now = {p: n for p, n in places.items() if p not in wanted} | dict.fromkeys(written, last + 1)
    row = (last + 1, action, run, now, done | {once.writer: once.number})
    spark.createDataFrame([row], HEAD).coalesce(1).write.mode("overwrite").parquet(f"{table.folder}/log/commit={last + 1}")
    return True


def history(spark: SparkSession, table: Table) -> DataFrame:
    """number, action, run and the parts that each commit left in place, as the log has them."""
    paths = [f"{table.folder}/log/commit={n}" for n in commits(spark, table)]
    return spark.read.schema(HEAD).parquet(*paths) if paths else spark.createDataFrame([], HEAD)


def vacuum(spark: SparkSession, table: Table, keep: int = 1) -> int:
    """Delete all but the last `keep` commits, and files that none of those reads; how many folders went."""
    known = commits(spark, table)
    kept = known[-keep:]
    used = {(p, n) for at in kept for p, n in _head(spark, table, at)[1].items()}
    gone = [p for p in _listed(spark, f"{table.folder}/log") if int(p.getName().split("=")[1]) not in kept]
    for top in _listed(spark, f"{table.folder}/data"):
        n = int(top.getName().split("=")[1])
        gone += [p for p in _listed(spark, top.toString()) if p.getName().startswith("_part=") and (int(p.getName().split("=")[1]), n) not in used]
    for path in gone:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


def put(spark: SparkSession, table: Table, incoming: DataFrame, keys: list[str], once: Once, run: str | None = None) -> bool:
    """Upsert incoming (one row a key): known values overwrite, unknown ones leave what is there."""
    return commit(spark, table, incoming, lambda before: upsert(before, incoming, keys), once, "upsert", run)


def insert(spark: SparkSession, table: Table, incoming: DataFrame, keys: list[str], once: Once, run: str | None = None) -> bool:
    """Add the rows of incoming whose keys the table lacks; what is stored stays. All rows of one new key come in."""
    return commit(spark, table, incoming, lambda before: before.unionByName(_new(incoming, before, keys)), once, "insert", run)


def _new(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    return incoming.join(stored.select(*keys).distinct(), keys, "left_anti").select(*incoming.columns)


def _guarded(own: DataFrame, predictions: DataFrame | None) -> None:
    if predictions is not None and not predictions.join(own.select("match_id"), "match_id", "left_semi").isEmpty():
        raise ValueError("predictions refer to this import")


def _cascade(spark: SparkSession, children: list[Table], gone: DataFrame, once: Once, run: str) -> None:
    for child in children:
        commit(spark, child, gone, lambda before: before.join(gone, "match_id", "left_anti"), once, "cascade", run)


def delete_run(spark: SparkSession, matches: Table, children: list[Table], run: str, once: Once, predictions: DataFrame | None = None) -> bool:
    """Delete the matches of an import (run_id) and, before them, what children (placed by match_id) hold of those.

    ValueError if predictions refer to one of them. If it dies between two tables, the same call takes it to its end.
    """
    own = read(spark, matches).where(F.col("run_id") == run)
    _guarded(own, predictions)
    gone = own.select("match_id").distinct()
    _cascade(spark, children, gone, once, run)
    return commit(spark, matches, gone, lambda before: before.where(~F.col("run_id").eqNullSafe(run)), once, "delete", run)


def reprocess(spark: SparkSession, matches: Table, children: list[Table], run: str, incoming: DataFrame, once: Once, predictions: DataFrame | None = None) -> bool:
    """Delete an import's matches with what hangs on them and import incoming in their place, in one commit of the matches.

    incoming has the table's columns but run_id. Its rows that other imports hold stay theirs.
    """
    own = read(spark, matches).where(F.col("run_id") == run)
    _guarded(own, predictions)
    gone = own.select("match_id").distinct()
    _cascade(spark, children, gone, once, run)
    rows = incoming.withColumn("run_id", F.lit(run))

    def change(before: DataFrame) -> DataFrame:
        others = before.where(~F.col("run_id").eqNullSafe(run))
        return others.unionByName(_new(rows, others, ["match_id"]))

    return commit(spark, matches, gone.union(incoming.select("match_id")), change, once, "reprocess", run)
