"""Helpers that the text operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import PySparkRuntimeError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: str | None, lower: bool = True) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() and bytes.lower() know ASCII only, as WORD does."""
    raw = (text or "").encode("utf-8", "replace")
    return (raw.lower() if lower else raw).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names with as many underscores as no column of df needs them to clash."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


#: What a function of Arrow batches gets at once: rows, and bytes of texts beyond one long row.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def in_bounds(run: Callable, most: int = BATCH_BYTES) -> Callable:
    """run with its batches cut to `most` bytes; a row that is larger comes alone."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(BATCH_ROWS, batch.num_rows * most // max(1, batch.nbytes)))
            at = 0
            while at < batch.num_rows:
                n = min(step, batch.num_rows - at)
                while n > 1 and batch.slice(at, n).nbytes > 2 * most:
                    n = -(-n // 2)
                yield batch.slice(at, n)
                at += n

    return lambda batches: run(slices(batches))


def byte_batches(rows: DataFrame, run: Callable, schema) -> DataFrame:
    """rows.mapInArrow(run, schema), where run gets few rows and bytes at a time: rows here may be whole documents.

    Spark bounds what it hands over by its own settings (maxRecordsPerBatch and maxBytesPerBatch); those stay as they are.
    """
    return rows.mapInArrow(in_bounds(run), schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where a session of one process names none, as in
    tests, a temporary folder of it; a cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise PySparkRuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write df below the shared folder and read it back: its lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


#: Rows of a table of known narrow rows (1 or 2 KB at most) up to which it is broadcast.
FEW = 5_000


def few(df: DataFrame) -> DataFrame:
    """df, stashed, as a side of a join: broadcast if it has FEW rows at most, else left to Spark's joins."""
    df = stash(df, "few")
    return F.broadcast(df) if df.count() <= FEW else df


def discard(*frames: DataFrame | None) -> None:
    """Delete stashed tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "stash_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns only."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def gapless(df: DataFrame, parts: list[str], order: list[Column], salt: Column, salts: int, out: str) -> DataFrame:
    """Number the rows of each part from 0 without a gap.

    A part may hold any share of all rows: it is cut into `salts` pieces by hash, each piece is numbered by itself and
    starts where the pieces before it end. df is read twice, so it should be cheap (stashed).
    """
    df = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    by = Window.partitionBy(*parts).orderBy("_salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = df.groupBy(*parts, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.withColumn("_start", F.sum("_n").over(by) - F.col("_n")).drop("_n")
    within = F.row_number().over(Window.partitionBy(*parts, "_salt").orderBy(*order)) - 1
    numbered = df.withColumn("_within", within).join(starts, [*parts, "_salt"])
    return numbered.withColumn(out, F.col("_start") + F.col("_within")).drop("_start", "_within", "_salt")


def before(cells: DataFrame, cell: str, out: str, bits: int = 16) -> DataFrame:
    """cells (distinct longs, a null among them) with out, the next smaller one; the least gets the greatest one.

    A null is less than all. Cells are ordered within ranges of 2^bits; the first of a range follows the greatest of the
    range before, found the same way one level up. No task orders more than 2^bits cells, at the top 2^(64 - 3 * bits).
    """
    rows = cells.withColumn("_key", F.coalesce(F.col(cell), F.lit(-(1 << 62))))
    level = rows.select(F.col("_key").alias("_id"), F.shiftright("_key", bits).alias("_up"), F.col("_key").alias("_most"))
    levels = []
    for k in range(3):
        levels.append(level.withColumn("_prev", F.lag("_most").over(Window.partitionBy("_up").orderBy("_id"))))
        level = level.groupBy("_up").agg(F.max("_most").alias("_most")).select(F.col("_up").alias("_id"), (F.shiftright("_up", bits) if k < 1 else F.lit(0)).alias("_up"), "_most")
    found = levels[2]
    top = found.agg(F.max("_most").alias("_last"))
    found = found.join(F.broadcast(top), F.lit(True)).select("_id", F.coalesce("_prev", "_last").alias("_prev"))
    for lower in (levels[1], levels[0]):
        up = found.select(F.col("_id").alias("_over"), F.col("_prev").alias("_far"))
        found = lower.join(up, F.col("_up") == F.col("_over")).select("_id", F.coalesce("_prev", "_far").alias("_prev"))
    found = found.select(F.col("_id").alias("_key"), F.when(F.col("_prev") > -(1 << 62), F.col("_prev")).alias(out))
    return rows.join(found, "_key").drop("_key")
