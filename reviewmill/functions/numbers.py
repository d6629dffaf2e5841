"""Small numeric expressions used across the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def n(condition: Column | None = None) -> Column:
    """Row count, or the count of rows where a condition holds."""
    return F.count(F.lit(1)) if condition is None else F.count_if(condition)


def ratio(part: Column, whole: Column, scale: float = 1.0, digits: int = 6) -> Column:
    """``part / whole`` as a rounded double; null for an empty whole."""
    value = part.cast("double") * F.lit(float(scale)) / F.nullif(whole.cast("double"), F.lit(0.0))
    return F.round(value, digits)


def rounded(value: Column, digits: int = 6) -> Column:
    return F.round(value.cast("double"), digits)


def wilson_low(hits: Column, trials: Column, z: float = 1.96) -> Column:
    """Lower end of the Wilson score interval of a share."""
    total = F.nullif(trials.cast("double"), F.lit(0.0))
    p = hits.cast("double") / total
    z2 = z * z
    margin = F.lit(z) * F.sqrt((p * (F.lit(1.0) - p)) / total + F.lit(z2) / (F.lit(4.0) * total * total))
    bound = (p + F.lit(z2) / (F.lit(2.0) * total) - margin) / (F.lit(1.0) + F.lit(z2) / total)
    return F.coalesce(bound, F.lit(0.0))
