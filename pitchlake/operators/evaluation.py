"""Error measures of predicted goals and results, calibration, and splits in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.operators import prefix
from pitchlake.operators.history import micros


def deviance(actual: Column, predicted: Column) -> Column:
    """Poisson deviance of one count; predictions are 1e-12 at least."""
    p = F.greatest(predicted, F.lit(1e-12))
    return F.when(actual == 0, 2 * p).otherwise(2 * (actual * F.log(actual / p) - (actual - p)))


def count_metrics(rows: DataFrame) -> DataFrame:
    """scope (home, away, combined), n, mae, rmse, deviance, bias of lambda_home and lambda_away against hg and ag."""
    long = rows.where("hg is not null and ag is not null").select(
        F.inline(F.array(F.struct(F.lit("home").alias("side"), F.col("hg").alias("a"), F.col("lambda_home").alias("p")), F.struct(F.lit("away").alias("side"), F.col("ag").alias("a"), F.col("lambda_away").alias("p"))))
    )
    error = F.col("p") - F.col("a")
    out = long.rollup("side").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(deviance(F.col("a").cast("double"), F.col("p"))).alias("deviance"), F.avg(error).alias("bias"))
    return out.select(F.coalesce("side", F.lit("combined")).alias("scope"), "n", "mae", "rmse", "deviance", "bias")


def result_rows(rows: DataFrame) -> DataFrame:
    """rows of finished matches with the indicators of home_win, draw and away_win (oh, od, oa) and the probability of
    what happened (p_true)."""
    out = rows.where("hg is not null and ag is not null").withColumns({
        "oh": (F.col("hg") > F.col("ag")).cast("double"), "od": (F.col("hg") == F.col("ag")).cast("double"), "oa": (F.col("hg") < F.col("ag")).cast("double"),
    })
    return out.withColumn("p_true", F.col("oh") * F.col("home_win") + F.col("od") * F.col("draw") + F.col("oa") * F.col("away_win"))


def result_metrics(rows: DataFrame) -> DataFrame:
    """One row: n, accuracy, log_loss, brier (over three classes), rps."""
    rows = result_rows(rows)
    best = F.greatest("home_win", "draw", "away_win")
    hit = F.when(F.col("home_win") == best, F.col("oh")).when(F.col("draw") == best, F.col("od")).otherwise(F.col("oa"))
    dh, dd, da = (F.col(p) - F.col(o) for p, o in (("home_win", "oh"), ("draw", "od"), ("away_win", "oa")))
    rps = (dh * dh + (dh + dd) * (dh + dd)) / 2
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"), F.avg(-F.log(F.greatest(F.col("p_true"), F.lit(1e-15)))).alias("log_loss"), F.avg(dh * dh + dd * dd + da * da).alias("brier"), F.avg(rps).alias("rps"))


def calibration(rows: DataFrame, probability: str, happened: Column, bins: int = 10) -> DataFrame:
    """bin, n, confidence, frequency of one event; bins are [i/bins, (i+1)/bins), the last one closed."""
    bin_ = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("long")
    return rows.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(probability).alias("confidence"), F.avg(happened.cast("double")).alias("frequency"))


def calibration_error(rows: DataFrame, probability: str, happened: Column, bins: int = 10) -> DataFrame:
    """One row: n, ece."""
    by = calibration(rows, probability, happened, bins)
    return by.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("frequency"))) / F.sum("n")).alias("ece"))


def _ranked(rows: DataFrame, date: str) -> DataFrame:
    """rows with the rank of their timestamp among the distinct ones (g) and the number of those (groups)."""
    days = rows.select(date).distinct()
    places = prefix.with_sums_before(days, [], micros(date), {"g": F.lit(1)})
    many = days.agg(F.count(F.lit(1)).alias("groups"))  # one row
    return rows.join(places.join(F.broadcast(many), F.lit(True)), date)


def chronological_split(rows: DataFrame, date: str = "match_date", train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """rows with split: train, validation or test, by whole timestamps; at least three are needed for all three."""
    ranked = _ranked(rows, date)
    train_end = F.greatest(F.lit(1), F.least(F.col("groups") - 2, F.floor(F.col("groups") * train)))
    val_end = F.least(F.col("groups") - 1, train_end + F.greatest(F.lit(1), F.floor(F.col("groups") * validation)))
    return ranked.withColumn("split", F.when(F.col("g") < train_end, "train").when(F.col("g") < val_end, "validation").otherwise("test")).drop("g", "groups")


def holdout(rows: DataFrame, date: str = "match_date", share: float = 0.2) -> DataFrame:
    """rows with split: validation for the last share of timestamps, one at least, else train."""
    days = _ranked(rows.select(date).distinct(), date)
    last = F.greatest(F.lit(1), F.floor(F.col("groups") * share))
    first = days.where(F.col("g") >= F.col("groups") - last).agg(F.min(date).alias("_first"))  # one row
    told = rows.where(F.col(date).isNotNull()).join(F.broadcast(first), F.lit(True))
    return told.withColumn("split", F.when(F.col(date) >= F.col("_first"), "validation").otherwise("train")).drop("_first")


def walk_forward(rows: DataFrame, initial: int, test: int, step: int, date: str = "match_date") -> DataFrame:
    """fold, split, n: expanding training windows of timestamps, each with the `test` timestamps after it."""
    days = _ranked(rows.groupBy(date).agg(F.count(F.lit(1)).alias("rows")), date)
    ends = F.sequence(F.lit(initial).cast("long"), F.col("groups") - test, F.lit(step).cast("long"))
    folds = days.select(F.max("groups").alias("groups")).where(F.col("groups") >= initial + test).select(F.posexplode(ends).alias("fold", "end"))
    joined = days.join(F.broadcast(folds), F.col("g") < F.col("end") + test)  # one row a fold
    split = F.when(F.col("g") < F.col("end"), "train").otherwise("test")
    return joined.groupBy(F.col("fold").cast("long").alias("fold"), split.alias("split")).agg(F.sum("rows").alias("n"))


def medians(rows: DataFrame, columns: list[str]) -> DataFrame:
    """feature, median: exact medians of the known values, for imputation."""
    return rows.agg(*[F.median(c).alias(c) for c in columns]).unpivot([], columns, "feature", "median")
