"""Ordered work on groups of any size.

A window over ``partitionBy(group)`` puts a whole group into one task, which
fails once a group holds a large part of the table.  The helpers here cut an
ordered group into fixed-width blocks of its order column, work inside the
blocks, and carry only one summary row per block across block borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpointed

BLOCK_WIDTH = 1 << 16
BLOCK = "_block"


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group.

    The rank filter is pushed below the shuffle as a group limit, so each task
    sends at most ``k`` rows of a group however large the group is.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def with_blocks(df: DataFrame, order: str, width: int = BLOCK_WIDTH) -> DataFrame:
    """Mark the block of each row; later steps then share one shuffle."""
    return df.withColumn(BLOCK, F.floor(F.col(order) / F.lit(width)).cast("bigint"))


def before(blocked: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column]) -> DataFrame:
    """Add, per value, its maximum over the earlier rows of the group.

    The maximum of ``struct(order, x)`` is the previous row's ``x``, so this is
    also a lag.  ``order`` must be a unique whole number inside the group, the
    keys must not be null, and the rows must carry blocks (``with_blocks``).
    """
    return _carried(blocked, keys, order, values, forward=True)


def after(blocked: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column]) -> DataFrame:
    """Add, per value, its minimum over the later rows of the group (a lead)."""
    return _carried(blocked, keys, order, values, forward=False)


def _carried(blocked, keys, order, values, forward):
    pick = F.max if forward else F.min
    staged = blocked.withColumns({f"_v_{name}": value for name, value in values.items()})

    def earlier(column):
        return Window.orderBy(F.col(column).asc() if forward else F.col(column).desc()).rowsBetween(
            Window.unboundedPreceding, -1
        )

    inside = earlier(order).partitionBy(*keys, BLOCK)
    local = staged.withColumns({f"_in_{name}": pick(f"_v_{name}").over(inside) for name in values})
    summary = staged.groupBy(*keys, BLOCK).agg(*[pick(f"_v_{name}").alias(f"_b_{name}") for name in values])
    across = earlier(BLOCK).partitionBy(*keys)
    carried = summary.select(
        *keys, BLOCK, *[pick(f"_b_{name}").over(across).alias(f"_out_{name}") for name in values]
    )
    joined = local.join(carried, [*keys, BLOCK], "left")
    result = {}
    for name in values:
        near, far = F.col(f"_in_{name}"), F.col(f"_out_{name}")
        wins = (near >= far) if forward else (near <= far)
        result[name] = F.when(near.isNotNull() & far.isNotNull(), F.when(wins, near).otherwise(far)).otherwise(
            F.coalesce(near, far)
        )
    return joined.withColumns(result).drop(*[f"_{kind}_{name}" for name in values for kind in ("v", "in", "out")])


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "position", start: int = 0) -> DataFrame:
    """Number all rows ``start, start+1, ...`` in order, without one global task.

    Rows are range-partitioned and pinned with a checkpoint; each range gets the
    count of the ranges before it as an offset.
    """
    pinned = checkpointed(
        df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    )
    counts = pinned.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_range",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    return (
        pinned.withColumn("_at", F.row_number().over(inside) - 1)
        .join(offsets, "_range")
        .withColumn(name, (F.col("_at") + F.col("_offset") + F.lit(start)).cast("bigint"))
        .drop("_range", "_at", "_offset")
    )


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page of an ordered result; only ``(number + 1) * size`` rows are kept per task."""
    return df.orderBy(*order).offset(number * size).limit(size)
