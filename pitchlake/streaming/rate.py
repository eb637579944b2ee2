"""How many requests a client made within a sliding window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sliding(events: DataFrame, client: str, at: str = "ts", seconds: int = 60, limit: int = 120) -> DataFrame:
    """events with n, those of the client in the last `seconds` up to this one, and limited: n is above the limit."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    window = Window.partitionBy(client).orderBy(micros).rangeBetween(-seconds * 1_000_000, Window.currentRow)
    return events.withColumn("n", F.count(F.lit(1)).over(window)).withColumn("limited", F.col("n") > limit)


def tumbling(events: DataFrame, client: str, at: str = "ts", seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Counts by client and window of a stream or table; a stream drops events later than `late`."""
    stamped = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    by = stamped.groupBy(F.window("_at", f"{seconds} seconds").alias("w"), client).agg(F.count(F.lit(1)).alias("n"))
    return by.select(client, F.col("w.start").alias("start"), "n")
