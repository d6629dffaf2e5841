"""Exact quantiles of any number of values, without one task that holds them all."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many values are ordered on the driver in the end.
FEW = 4096
#: By which share of the values a bracket reaches past the wanted rank on both sides; a sketch is off by less.
MARGIN = 0.03
SKETCH = 400


def exact_quantile(values: DataFrame, column: str, share: float) -> DataFrame:
    """Linear-interpolated quantile (one row, column ``quantile``; null without values).

    A sketch of the values (KLL: a few kilobytes, merged from all tasks) names two values that should bracket the wanted
    rank; one pass counts exactly what lies below, inside and above, and the part that holds the rank is sketched again
    until ``FEW`` values or copies of one are left.  A part has about ``2 * MARGIN`` of the values before it, however
    they are spread; a sketch that missed the rank costs a round, never a wrong result.
    """
    rows = values.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    spark = values.sparkSession
    total = rows.agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    if not total["n"]:
        return spark.createDataFrame([(None,)], "quantile double")
    rank = (total["n"] - 1) * float(share)
    place = math.floor(rank)
    v, low, high, below, inside = F.col("v"), total["low"], total["high"], 0, total["n"]
    while low < high and inside > FEW:
        held = rows.where(v.between(low, high))
        ends = [min(max((place - below) / inside + step, 0.0), 1.0) for step in (-MARGIN, MARGIN)]
        first, last = held.agg(F.kll_sketch_agg_double("v", F.lit(SKETCH)).alias("s")).select(
            *[F.kll_sketch_get_quantile_double("s", F.lit(end)) for end in ends]).first()
        if (first, last) == (low, high):
            # Most values are copies of the two ends: what lies between them is the middle part.
            first, last = held.agg(F.min(F.when(v > low, v)), F.max(F.when(v < high, v))).first()
        under, over, left, right = held.agg(
            F.count(F.when(v < first, v)), F.count(F.when(v > last, v)), F.max(F.when(v < first, v)), F.min(F.when(v > last, v))).first()
        if first > last:  # two values only
            first, last, under, over, left, right = low, low, 0, held.where(v > low).count(), None, high
        if place < below + under:
            high, inside = left, under
        elif place >= below + inside - over:
            low, below, inside = right, below + inside - over, over
        else:
            low, high, below, inside = first, last, below + under, inside - under - over
    ordered = [low] if low == high else [row["v"] for row in rows.where(v.between(low, high)).orderBy("v").collect()]
    value = ordered[min(place - below, len(ordered) - 1)]
    after = value
    if rank > place:
        next_ = place - below + 1
        after = rows.where(v > high).agg(F.min("v")).first()[0] if next_ >= inside else ordered[min(next_, len(ordered) - 1)]
    return spark.createDataFrame([(value + (after - value) * (rank - place),)], "quantile double")
