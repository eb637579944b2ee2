"""Live scoreboards and box scores as streams: one state per match, statistics of a match once only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.operators.consolidate import next_status
from pitchlake.sources import commits, shared

SNAPSHOT = T.StructType().add("match_id", "long").add("seen_at", "timestamp").add("status", "string").add("hg", "long").add("ag", "long")
BOX = T.StructType().add("match_id", "long").add("venue", "string").add("shots", "long").add("corners", "long").add("data_source", "string")


def newest(snapshots: DataFrame) -> DataFrame:
    """The latest snapshot of each match; of several at one time, the greatest by status, then by goals."""
    order = Window.partitionBy("match_id").orderBy(*[F.desc_nulls_last(c) for c in ("seen_at", "status", "hg", "ag")])
    return snapshots.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def applied(state: DataFrame, batch: DataFrame) -> DataFrame:
    """state after a batch: a newer snapshot changes status and score where the status order lets it."""
    new = newest(batch).select("match_id", *[F.col(c).alias(f"_{c}") for c in ("seen_at", "status", "hg", "ag")])
    rows = state.join(new, "match_id", "full_outer")
    step = next_status(F.col("status"), F.col("_status"))
    newer = F.col("_seen_at").isNotNull() & (F.col("seen_at").isNull() | (F.col("_seen_at") >= F.col("seen_at"))) & (step != "conflict")
    pick = lambda c: F.when(newer, F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c)
    return rows.select("match_id", pick("seen_at"), F.when(newer, step).otherwise(F.col("status")).alias("status"), pick("hg"), pick("ag"))


def states(folder: str, parts: int = 64) -> commits.Table:
    """The table of the states of matches."""
    return commits.Table(folder, SNAPSHOT, ("match_id",), parts)


def boxes(folder: str, parts: int = 64) -> commits.Table:
    """The table of the statistics of matches."""
    return commits.Table(folder, BOX, ("match_id",), parts)


def _pages(spark: SparkSession, landing: str, schema: T.StructType, pages: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", pages) if pages else reader).parquet(landing)


def _started(stream: DataFrame, step, checkpoint: str, trigger: dict | None):
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def run(spark: SparkSession, landing: str, table: commits.Table, checkpoint: str, trigger: dict | None = None, pages: int | None = None):
    """Follow snapshot files (Parquet) that land in a folder; each batch is a commit to the parts of its matches.

    A batch that is run again is known by its number and changes nothing. trigger: {"processingTime": "30 seconds"} to
    follow, {"availableNow": True} to catch up and end. pages: how many files a batch takes at most.
    """

    def merge(batch: DataFrame, number: int) -> None:
        commits.commit(batch.sparkSession, table, batch, lambda before: applied(before, batch), commits.Once(checkpoint, number), "snapshots")

    return _started(_pages(spark, landing, SNAPSHOT, pages), merge, checkpoint, trigger)


def one_source(rows: DataFrame) -> DataFrame:
    """Of each match the rows of one source, the first by name; of rows that one source repeats, the greatest."""
    least = rows.groupBy("match_id").agg(F.min("data_source").alias("_least"))
    own = rows.join(least, "match_id").where(F.col("data_source").eqNullSafe(F.col("_least")))
    best = own.groupBy("match_id", "venue").agg(F.max(F.struct("shots", "corners")).alias("_b"), F.first("data_source").alias("data_source"))
    return best.select("match_id", "venue", "_b.shots", "_b.corners", "data_source")


def statistics(spark: SparkSession, landing: str, table: commits.Table, checkpoint: str, pages: int | None = None, trigger: dict | None = None):
    """Import pages of box scores (Parquet files) that land in a folder, at most `pages` a batch; goes on where it stopped.

    A match's statistics are taken once, from one source: those of the first page that has it stay, whatever comes later.
    """

    def take(batch: DataFrame, number: int) -> None:
        commits.insert(batch.sparkSession, table, one_source(batch), ["match_id"], commits.Once(checkpoint, number))

    return _started(_pages(spark, landing, BOX, pages), take, checkpoint, trigger)


def replayed(spark: SparkSession, events: DataFrame) -> DataFrame:
    """The state after events (event_id, ts, user_id, event_type, value) have run through run() as snapshots, landing in
    three parts by id, each followed by a run that goes on from the last one's state."""
    snapshots = events.select(
        F.col("user_id").alias("match_id"),
        F.col("ts").cast("timestamp").alias("seen_at"),
        F.when(F.col("event_type") == "purchase", "finished").when(F.col("event_type") == "click", "live").otherwise("scheduled").alias("status"),
        (F.col("event_id") % 4).alias("hg"),
        (F.col("event_id") % 3).alias("ag"),
        (F.col("event_id") % 7 % 3).alias("_landing"),
    )
    top = shared.folder(spark, "live")
    table = states(f"{top}/state")
    for k in range(3):
        snapshots.where(F.col("_landing") == k).drop("_landing").write.mode("append").parquet(f"{top}/landing")
        run(spark, f"{top}/landing", table, f"{top}/offsets").awaitTermination()
    return commits.read(spark, table)
