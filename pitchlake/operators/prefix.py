"""Sums over everything earlier, without a task that sees all rows of a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Moments (microseconds) are summed within 19 hours, those sums within 814 days, and those over all time.
SHIFTS = (36, 46)


def _same(pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs])


def sums_before(rows: DataFrame, keys: list[str], at: Column, values: dict[str, Column]) -> DataFrame:
    """keys, _moment and, by name, the sum of each value over the rows of the same keys at earlier moments; 0 without any.

    One row per keys and moment. Rows are summed by moment before anything is ordered; then a scan goes over the moments of
    a stretch, one over the stretches of a range and one over the ranges, each in tasks of their own, and a moment's sum is
    that of its stretch so far, of the stretches and of the ranges before. A key may hold all rows.
    """
    names = list(values)
    level = rows.groupBy(*keys, at.alias("_moment")).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in values.items()])
    levels = []
    for k, shift in enumerate((*SHIFTS, None)):
        base = SHIFTS[k - 1] if k else 0
        up = F.lit(0).cast("long") if shift is None else F.shiftright("_moment", shift - base)
        level = level.withColumn("_up", up)
        before = Window.partitionBy(*keys, "_up").orderBy("_moment").rowsBetween(Window.unboundedPreceding, -1)
        levels.append(level.select(*keys, "_moment", "_up", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in names]))
        level = level.groupBy(*keys, "_up").agg(*[F.sum(n).alias(n) for n in names]).withColumnRenamed("_up", "_moment")
    found = levels[-1].drop("_up")
    for lower in reversed(levels[:-1]):
        over = found.toDF(*[f"_over_{c}" for c in found.columns])
        joined = lower.join(over, _same([(c, f"_over_{c}") for c in keys] + [("_up", "_over__moment")]))
        found = joined.select(*keys, "_moment", *[(F.col(n) + F.col(f"_over_{n}")).alias(n) for n in names])
    return found


def with_sums_before(rows: DataFrame, keys: list[str], at: Column, values: dict[str, Column]) -> DataFrame:
    """rows with the columns of sums_before()."""
    found = sums_before(rows, keys, at, values)
    found = found.toDF(*[f"_before_{c}" if c in (*keys, "_moment") else c for c in found.columns])
    same = _same([(c, f"_before_{c}") for c in (*keys, "_moment")])
    return rows.withColumn("_moment", at).join(found, same).drop("_moment", *[f"_before_{c}" for c in (*keys, "_moment")])


def mean_of_last(rows: DataFrame, keys: list[str], at: Column, order: list[str], done: Column, values: dict[str, Column], n: int) -> DataFrame:
    """rows with n_seen and, by name, the mean of each value over the last n done rows of the same keys before their moment.

    The sums before a moment less those before the row n places back: done rows are numbered by (moment, order) through
    sums_before(), and the row n places back is met by an equality join. The values of done rows must be known.
    """
    own = {"_done": done.cast("long"), **{f"_sum_{v}": F.when(done, c) for v, c in values.items()}}
    counted = with_sums_before(rows, keys, at, own)
    here = Window.partitionBy(*keys, at).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("_done") + F.coalesce(F.count(F.lit(1)).over(here), F.lit(0))
    upto = [(F.col(f"_sum_{v}") + F.coalesce(F.sum(c).over(here), F.lit(0))).alias(f"_back_{v}") for v, c in values.items()]
    back = counted.where(done).select(*[F.col(c).alias(f"_back_{c}") for c in keys], place.alias("_place"), *upto)
    met = counted.join(back, _same([(c, f"_back_{c}") for c in keys]) & (F.col("_place") == F.col("_done") - n), "left")
    seen = F.least(F.col("_done"), F.lit(n))
    means = {v: F.when(seen > 0, (F.col(f"_sum_{v}") - F.coalesce(f"_back_{v}", F.lit(0))) / seen) for v in values}
    return met.withColumns({"n_seen": seen, **means}).drop("_done", "_place", *own, *[f"_back_{c}" for c in (*keys, *values)])
