"""How strongly, and which way, a factor moves a prediction: magnitude_direction words in four variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _words(size: Column, high: float, medium: float, up: Column) -> Column:
    magnitude = F.when(size >= high, "high").when(size >= medium, "medium").otherwise("low")
    return F.when(size.isNotNull(), F.concat(magnitude, F.when(up, "_positive").otherwise("_negative")))


def of_rate(contribution: Column, rate: Column, baseline: Column) -> Column:
    """By the contribution's share of the rate; without a baseline every direction is positive. Null without a contribution."""
    return _words(F.abs(contribution) / F.greatest(rate, F.lit(1e-12)), 0.35, 0.2, baseline.isNull() | (contribution >= 0))


def of_value(value: Column, baseline: Column, inverse: bool = False) -> Column:
    """By the value's relative distance from the baseline; inverse where less is better. neutral without a baseline or with
    one of 0, null without a value."""
    change = (value - baseline) / F.nullif(baseline, F.lit(0.0))
    change = -change if inverse else change
    return F.when(value.isNotNull(), F.coalesce(_words(F.abs(change), 0.35, 0.15, change >= 0), F.lit("neutral")))


def of_contribution(contribution: Column) -> Column:
    """By what the factor adds to the log of the rate. Null without a contribution."""
    return _words(F.abs(contribution), 0.5, 0.2, contribution >= 0)


def of_importance(importance: Column) -> Column:
    """By a feature's share of the gain over all trees, which has no direction but positive."""
    return _words(F.abs(importance), 0.1, 0.02, F.lit(True))
