"""Elo ratings as a stream: each competition's ratings are state, and matches are rated as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pitchlake.operators.history import micros
from pitchlake.operators.rating import Ratings, with_expectation
from pitchlake.sources import shared

MATCH = "competition_id long, match_id long, at long, home_team_id long, away_team_id long, hg long, ag long"
OUT = "competition_id long, match_id long, at long, home_elo double, away_elo double, late boolean"


class EloProcessor(StatefulProcessor):
    """State of a competition: an entry per team, see Ratings, and the latest kickoff that changed them.

    What a batch brings of a competition is put in order; how much that is the source's limits say (maxFilesPerTrigger).
    A match before the latest kickoff comes too late: it is told so, sees the ratings of now and changes none.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.teams = handle.getMapState("teams", "team long", "before double, since double, at long")
        self.latest = handle.getValueState("latest", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple | None] = {}

        def get(team: int):
            if team not in held:
                held[team] = tuple(self.teams.getValue((team,))) if self.teams.containsKey((team,)) else None
            return held[team]

        changed: set[int] = set()

        def put(team: int, entry: tuple) -> None:
            held[team] = entry
            changed.add(team)

        ratings = Ratings(get, put)
        last = self.latest.get()[0] if self.latest.exists() else None
        batch = pd.concat(list(rows)).sort_values(["at", "match_id"])
        told = []
        for r in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
            late = last is not None and r.at < last
            scores = (None, None) if late else (r.hg, r.ag)
            told.append((key[0], r.match_id, r.at, *ratings.play(r.at, r.home_team_id, r.away_team_id, *scores), late))
            if not late and r.hg is not None and r.ag is not None:
                last = r.at
        for team in changed:
            self.teams.updateValue((team,), held[team])
        if last is not None:
            self.latest.update((last,))
        yield pd.DataFrame(told, columns=["competition_id", "match_id", "at", "home_elo", "away_elo", "late"])

    def close(self) -> None:
        pass


def rows_of(matches: DataFrame) -> DataFrame:
    """matches as the stream takes them."""
    names = ("home_team_id", "away_team_id", "hg", "ag")
    return matches.select(F.col("competition_id").cast("long"), F.col("match_id").cast("long"), micros().alias("at"), *[F.col(c).cast("long") for c in names])


def run(spark: SparkSession, landing: str, out: str, checkpoint: str, files: int | None = None, trigger: dict | None = None):
    """Rate the matches (Parquet, see rows_of()) that land in a folder; ratings go to out, each row once.

    files: how many files a batch takes at most. trigger as in live.run().
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    reader = spark.readStream.schema(MATCH)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(landing)
    rated = stream.groupBy("competition_id").transformWithStateInPandas(EloProcessor(), OUT, "append", "none")
    return rated.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def caught_up(spark: SparkSession, matches: DataFrame, batches: int = 3) -> DataFrame:
    """Ratings of matches that land in `batches` parts by kickoff, each followed by a run that goes on from the last one's state."""
    top = shared.folder(spark, "elo")
    rows_of(matches).write.parquet(f"{top}/matches")
    rows = spark.read.schema(MATCH).parquet(f"{top}/matches")
    ends = rows.approxQuantile("at", [k / batches for k in range(1, batches)], 0.01)
    for k in range(batches):
        part = rows.where(F.lit(True) if k == 0 else F.col("at") > ends[k - 1]).where(F.lit(True) if k == batches - 1 else F.col("at") <= ends[k])
        part.write.mode("append").parquet(f"{top}/landing")
        run(spark, f"{top}/landing", f"{top}/rated", f"{top}/offsets").awaitTermination()
    return with_expectation(spark.read.schema(OUT).parquet(f"{top}/rated"))
