"""Versions of trained models: saved once, listed with their features and measures, loaded if active."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = "name string, version string, status string, path string, features array<string>, metrics map<string, double>, data_hash string, at timestamp"


def data_hash(rows: DataFrame) -> str:
    """Of all rows, in any order: tells whether two models learnt from the same data."""
    digest = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(rows.columns)]).cast("decimal(20,0)")
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("s"))
    return found.select(F.sha2(F.concat_ws(":", F.lit(",".join(sorted(rows.columns))), "n", "s"), 256).alias("h")).first()["h"]


def record(spark: SparkSession, registry: str, name: str, version: str, status: str, path: str, features: list[str], metrics: dict[str, float], hashed: str) -> None:
    """Append what holds for a version from now on; its earlier entries stay."""
    row = spark.createDataFrame([(name, version, status, path, features, metrics, hashed, None)], ENTRY)
    row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(registry)


def save(models: dict[str, PipelineModel], spark: SparkSession, registry: str, root: str, name: str, version: str, features: list[str], metrics: dict[str, float], hashed: str, status: str = "candidate") -> str:
    """Write one model a target below root and record the version; fails, and records nothing, where the version is there."""
    path = f"{root}/{name}/{version}"
    for target, model in models.items():
        model.write().save(f"{path}/{target}")
    record(spark, registry, name, version, status, path, features, {k: float(v) for k, v in metrics.items()}, hashed)
    return path


def versions(entries: DataFrame) -> DataFrame:
    """The latest entry of each version."""
    order = Window.partitionBy("name", "version").orderBy(F.desc("at"))
    return entries.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def load_active(spark: SparkSession, registry: str, root: str, name: str, targets: tuple[str, ...] = ("hg", "ag")) -> tuple[dict[str, PipelineModel] | None, list[str], str | None]:
    """The active version's models and features, or None and why: the caller falls back to its baseline.

    Of several active ones the latest counts. Its path has to be that of its name and version below root, and its models
    have to take the features that the registry lists, in this order.
    """
    found = versions(spark.read.schema(ENTRY).parquet(registry)).where((F.col("name") == name) & (F.col("status") == "active")).orderBy(F.desc("at"), F.desc("version")).limit(1).collect()
    if not found:
        return None, [], "no active version"
    entry = found[0]
    if entry.path != f"{root}/{name}/{entry.version}":
        return None, [], "the artifact lies outside the model folder"
    try:
        models = {t: PipelineModel.load(f"{entry.path}/{t}") for t in targets}
    except (Py4JError, PySparkException, OSError) as missing:
        return None, [], f"the artifact can't be loaded: {str(missing).splitlines()[0]}"
    if any(m.stages[0].getInputCols() != list(entry.features) for m in models.values()):
        return None, [], "the artifact's features aren't those of the registry"
    return models, list(entry.features), None
