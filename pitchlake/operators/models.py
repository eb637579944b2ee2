"""Goal models in Spark ML: Poisson regression and boosted trees, their registry and promotion."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.operators import boosting, impacts
from pitchlake.operators.evaluation import count_metrics, deviance, holdout
from pitchlake.operators.history import micros
from pitchlake.sources.shared import written

MIN_ROWS = 30
#: Boosted trees, their size and the share of each that is added.
TREES = boosting.Settings(rounds=200, depth=4, step=0.05)
#: Parts of names that no feature may have: they tell the result.
FORBIDDEN = ("target_", "actual_", "outcome", "_result_")


def feature_names(rows: DataFrame, candidates: list[str] | None = None) -> list[str]:
    """Numeric columns that are known somewhere and don't tell the result; one pass over the rows."""
    numeric = {c for c, t in rows.dtypes if t in ("double", "float", "int", "bigint", "long")}
    names = candidates or [c for c in rows.columns if c.startswith(("home_", "away_", "league_")) and not c.endswith(("_id", "_key"))]
    bad = [c for c in names if c.startswith("_") or any(c.startswith(f) or f in c for f in FORBIDDEN[:3])]
    if bad:
        raise ValueError(f"features that tell the result: {', '.join(sorted(bad))}")
    names = [c for c in names if c in numeric]
    known = rows.agg(*[F.count(c).alias(c) for c in names]).first()
    return [c for c in names if known[c]]


def _stages(names: list[str], target: str) -> list:
    filled = [f"{c}__filled" for c in names]
    imputer = Imputer(strategy="median", inputCols=names, outputCols=filled)
    assembler = VectorAssembler(inputCols=filled, outputCol="features")
    return [imputer, assembler, GeneralizedLinearRegression(family="poisson", link="log", regParam=0.1, labelCol=target, predictionCol=f"predicted_{target}", maxIter=25)]


def train(rows: DataFrame, names: list[str], kind: str = "poisson", settings: boosting.Settings = TREES) -> dict[str, PipelineModel] | boosting.Forest:
    """A model of each side's goals (hg, ag): poisson is a pipeline each, of median imputation and regression; trees is one
    forest for both, in which a null is a value of its own."""
    rows = rows.select(*[F.col(c).cast("double").alias(c) for c in (*names, "hg", "ag")]).where("hg is not null and ag is not null")
    if kind == "trees":
        return boosting.fit(rows, names, ["hg", "ag"], settings)
    return {t: Pipeline(stages=_stages(names, t)).fit(rows) for t in ("hg", "ag")}


def predict(models: dict[str, PipelineModel] | boosting.Forest, rows: DataFrame, names: list[str]) -> DataFrame:
    """rows with lambda_home and lambda_away; rates that aren't finite or not in [0, 20] become null."""
    rows = rows.select(*[c for c in rows.columns if c not in names], *[F.col(c).cast("double").alias(c) for c in names])
    for target, out in (("hg", "lambda_home"), ("ag", "lambda_away")):
        keep = rows.columns
        if isinstance(models, boosting.Forest):
            done = rows.withColumn(f"predicted_{target}", boosting.rates(models, target))
        else:
            done = models[target].transform(rows)
        p = F.col(f"predicted_{target}")
        rows = done.select(*[c for c in keep if c != out], F.when((p >= 0) & (p <= 20) & ~F.isnan(p), p).alias(out))
    return rows


def explain(models: dict[str, PipelineModel], rows: DataFrame, names: list[str], n: int = 6) -> DataFrame:
    """match_id, target, rank, factor, value, weight, contribution, impact: for each side's goals the n features with the
    largest value * coefficient of a Poisson model, a null value being the median it was fitted with. Ties go by name."""
    found = []
    for target, model in models.items():
        medians, weights = model.stages[0].surrogateDF.first(), model.stages[-1].coefficients
        parts = [(c, F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(medians[c])), float(w)) for c, w in zip(names, weights, strict=True)]
        each = F.array(*[F.struct((-F.abs(v * w)).alias("_by"), F.lit(c).alias("factor"), v.alias("value"), F.lit(w).alias("weight"), (v * w).alias("contribution")) for c, v, w in parts])
        told = rows.select("match_id", F.posexplode(F.slice(F.array_sort(each), 1, n)).alias("_rank", "x"))
        found.append(told.select("match_id", F.lit(target).alias("target"), (F.col("_rank") + 1).alias("rank"), "x.factor", "x.value", "x.weight", "x.contribution"))
    return reduce(DataFrame.unionByName, found).withColumn("impact", impacts.of_contribution(F.col("contribution")))


def promoted(metrics: DataFrame, n_rows: int, baseline: str = "poisson") -> DataFrame:
    """metrics (model, mae) with active: the best other model if it beats the baseline on enough rows, else the baseline."""
    base = metrics.where(F.col("model") == baseline).select(F.col("mae").alias("_base"))
    rows = metrics.crossJoin(F.broadcast(base))  # one row
    better = (F.col("model") != baseline) & (F.col("mae") < F.col("_base")) & F.lit(n_rows >= MIN_ROWS)
    best = rows.where(better).orderBy("mae", "model").limit(1).select(F.col("model").alias("_best"))
    return rows.join(F.broadcast(best), F.lit(True), "left").withColumn("active", F.col("model") == F.coalesce("_best", F.lit(baseline))).drop("_base", "_best")


WANTED = [f"{v}_{m}_avg_{n}" for v in ("home", "away") for m in ("goals_for", "goals_against", "shots") for n in (5, 10)] + ["league_home_goals_avg", "league_away_goals_avg"]


def _parted(features: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows to learn from, the last fifth of timestamps, and the features; written once, since each is read several times."""
    rows = boosting.settled(holdout(features.where("hg is not null and ag is not null").select("match_id", "match_date", "hg", "ag", *WANTED)))
    return rows.where("split = 'train'"), rows.where("split = 'validation'"), feature_names(rows, WANTED)


def goal_model_report(features: DataFrame, settings: boosting.Settings = TREES) -> DataFrame:
    """model, scope, n, mae, rmse, deviance, bias, active on the last fifth of timestamps, for both learners."""
    learn, held, names = _parted(features)
    reports = [count_metrics(predict(train(learn, names, kind, settings), held, names).where("lambda_home is not null and lambda_away is not null")).withColumn("model", F.lit(kind)) for kind in ("poisson", "trees")]
    report = reduce(DataFrame.unionByName, reports)
    combined = promoted(report.where("scope = 'combined'").select("model", "mae"), learn.count())
    out = report.join(combined.select("model", "active"), "model")
    return out.select("model", "scope", "n", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "deviance", "bias")], "active")


def linear_factors(features: DataFrame, n: int = 6) -> DataFrame:
    """explain() of the last fifth of timestamps by Poisson models fitted on those before."""
    learn, held, names = _parted(features)
    return explain(train(learn, names), held, names, n)


def tree_factors(features: DataFrame, settings: boosting.Settings = TREES, n: int = 6) -> DataFrame:
    """boosting.factors() of the last fifth of timestamps by trees fitted on those before, with what each feature weighs over
    all (weight_impact) beside what it does in this row (impact)."""
    learn, held, names = _parted(features)
    told = boosting.factors(train(learn, names, "trees", settings), held, ["match_id"], impacts.of_contribution, n)
    return told.withColumn("weight_impact", impacts.of_importance(F.col("importance")))


def _held(rows: DataFrame, learner, names: list[str]) -> DataFrame:
    """The last fifth of timestamps as a model sees it that is fitted on those before: median imputation, then the learner.

    The rows are written once, as each step of a fit reads them anew."""
    rows = holdout(written(rows, "held"))
    filled = [f"{c}__filled" for c in names]
    stages = [Imputer(strategy="median", inputCols=names, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features"), learner]
    return Pipeline(stages=stages).fit(rows.where("split = 'train'")).transform(rows.where("split = 'validation'"))


def cards_report(features: DataFrame, totals: DataFrame) -> DataFrame:
    """n, mae, rmse, deviance, bias of a Poisson model of a match's total_cards (totals: match_id, total_cards).

    Rows without a total are left out. Held out is the last fifth of timestamps, so that a kickoff isn't in both parts.
    """
    names = [f"{v}_cards_avg_{n}" for v in ("home", "away") for n in (5, 10)]
    rows = features.join(totals.where("total_cards is not null").select("match_id", F.col("total_cards").cast("double").alias("total_cards")), "match_id")
    rows = rows.select("match_date", "total_cards", *[F.col(c).cast("double").alias(c) for c in names])
    learner = GeneralizedLinearRegression(family="poisson", link="log", regParam=0.1, labelCol="total_cards", predictionCol="p", maxIter=25)
    held, error = _held(rows, learner, names), F.col("p") - F.col("total_cards")
    return held.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(deviance(F.col("total_cards"), F.col("p"))).alias("deviance"), F.avg(error).alias("bias")
    )


def scorer_rows(appearances: DataFrame) -> DataFrame:
    """match_id, match_date, player_id, scored, and of the player's appearances before this kickoff: games, goals_avg,
    minutes_avg, cards_avg (null without any). appearances: match_id, match_date, player_id, minutes, goals, cards."""
    own = Window.partitionBy("player_id").orderBy(micros("match_date")).rangeBetween(Window.unboundedPreceding, -1)
    before = {"games": F.count(F.lit(1)).over(own).cast("double"), **{f"{c}_avg": F.avg(c).over(own) for c in ("goals", "minutes", "cards")}}
    rows = appearances.withColumns(before).withColumn("scored", (F.col("goals") > 0).cast("double"))
    return rows.select("match_id", "match_date", "player_id", "scored", *before)


def scorer_report(appearances: DataFrame) -> DataFrame:
    """n, brier, log_loss, base_brier of a logistic model of who scores, on the last fifth of timestamps; base_brier is that
    of the share that scores there."""
    names = ["games", "goals_avg", "minutes_avg", "cards_avg"]
    held = _held(scorer_rows(appearances).drop("match_id", "player_id"), LogisticRegression(labelCol="scored", maxIter=100), names)
    p = F.least(F.greatest(vector_to_array("probability")[1], F.lit(1e-15)), F.lit(1 - 1e-15))
    y = F.col("scored")
    share = F.avg(y)
    return held.agg(F.count(F.lit(1)).alias("n"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"), (share * (1 - share)).alias("base_brier"))
