"""Names of one entity over several catalogs: alias links closed over, with decisions that stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.sources.shared import settled


def components(links: DataFrame) -> DataFrame:
    """key, component for links (record_id, key): the least key that is reachable over records.

    Each round gives a key the least label of the records it is in, and then that label's own label, so that rounds grow
    with the logarithm of the longest chain. A frequent key or a long record is summed before it is shuffled. Labels are
    checkpointed each round. Joins are by sorted partitions: tables of names that look small enough to be broadcast would all
    pass the driver.
    """
    links = settled(links.where("record_id is not null and key is not null").distinct())
    labels = links.select("key", F.col("key").alias("label")).distinct()
    while True:
        least = links.join(labels.hint("merge"), "key").groupBy("record_id").agg(F.min("label").alias("label"))
        near = links.join(least.hint("merge"), "record_id").groupBy("key").agg(F.min("label").alias("label"))
        far = near.select(F.col("key").alias("label"), F.col("label").alias("_far"))
        after = near.join(far.hint("merge"), "label").select("key", F.least("label", "_far"))
        after = after.toDF("key", "new").join(labels.hint("merge"), "key").select("key", F.col("new").alias("label"), (F.col("new") < F.col("label")).alias("_moved"))
        after = settled(after)
        labels = after.drop("_moved")
        if after.where("_moved").isEmpty():
            return labels.withColumnRenamed("label", "component")


def _entities(rows: DataFrame, name: str) -> DataFrame:
    """component, n_<name>, <name>: how many entities, and the one if it is one."""
    one = rows.where("entity_id is not null").groupBy("component").agg(F.min("entity_id").alias("_a"), F.max("entity_id").alias("_z"))
    return one.select("component", F.when(F.col("_a") == F.col("_z"), F.col("_a")).alias(name), F.lit(True).alias(f"has_{name}"))


def resolved(records: DataFrame, known: DataFrame, decisions: DataFrame) -> DataFrame:
    """repository, key, component, resolution, entity_id of every name and alias of records (record_id, repository, keys).

    known: key, entity_id of what is stored. decisions: repository, key, entity_id (null: the name is nobody's), one row a
    name of a repository. A decided name keeps its decision whatever links say: decided or rejected. The others follow
    their component: the entity decided in it (by_decision), none where decisions in it contradict each other
    (contradiction), else the entity stored in it (matched), none where it has several (ambiguous) or none (new). Null and
    empty keys are left out; a null repository is a repository.
    """
    uses = records.select("record_id", "repository", F.explode("keys").alias("key")).where("key <> ''")
    groups = components(uses.select("record_id", "key"))
    chosen = decisions.withColumnsRenamed({"repository": "_repository", "key": "_key", "entity_id": "_entity"})
    decided = _entities(decisions.join(groups.hint("merge"), "key"), "decided")
    stored = _entities(known.join(groups.hint("merge"), "key"), "stored")
    names = uses.select("repository", "key").distinct().join(groups.hint("merge"), "key").join(decided.hint("merge"), "component", "left").join(stored.hint("merge"), "component", "left")
    names = names.join(chosen.hint("merge"), F.col("repository").eqNullSafe(F.col("_repository")) & (F.col("key") == F.col("_key")), "left")
    kind = (
        F.when(F.col("_key").isNotNull(), F.when(F.col("_entity").isNotNull(), "decided").otherwise("rejected"))
        .when(F.col("has_decided"), F.when(F.col("decided").isNotNull(), "by_decision").otherwise("contradiction"))
        .when(F.col("has_stored"), F.when(F.col("stored").isNotNull(), "matched").otherwise("ambiguous"))
        .otherwise("new")
    )
    entity = F.when(kind == "decided", F.col("_entity")).when(kind == "by_decision", F.col("decided")).when(kind == "matched", F.col("stored"))
    return names.select("repository", "key", "component", kind.alias("resolution"), entity.alias("entity_id"))
