"""Running aggregates that stay parallel inside one hot key.

A plain window puts all rows of a key into one task.  Here a key is cut into
blocks along its order: each block runs its own window, the per-block totals
(a few rows) carry over, and a join adds them back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 100_000


def running(
    df: DataFrame,
    keys: Sequence[str],
    block: Column,
    order: Sequence[Column],
    agg: Callable[[Column], Column],
    value: Column,
    combine: Callable[[Column, Column], Column],
    out: str,
) -> DataFrame:
    """Add ``out``: inclusive running ``agg`` of ``value`` per key along ``order``.

    ``block`` must not decrease along the order.
    """
    df = df.withColumns({"_block": block, "_value": value})
    here = Window.partitionBy(*keys, "_block").orderBy(*order)
    local = df.withColumn(
        "_local", agg(F.col("_value")).over(here.rowsBetween(Window.unboundedPreceding, 0))
    )
    totals = df.groupBy(*keys, "_block").agg(agg(F.col("_value")).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_block", agg(F.col("_total")).over(before).alias("_carry"))
    joined = local.join(carried, [*keys, "_block"], "left")
    return joined.withColumn(
        out,
        F.when(F.col("_carry").isNull(), F.col("_local"))
        .when(F.col("_local").isNull(), F.col("_carry"))
        .otherwise(combine(F.col("_carry"), F.col("_local"))),
    ).drop("_block", "_value", "_local", "_carry")


def running_sum(df, keys, block, order, value: Column, out: str) -> DataFrame:
    return running(df, keys, block, order, F.sum, value, lambda a, b: a + b, out)


def running_max(df, keys, block, order, value: Column, out: str) -> DataFrame:
    return running(df, keys, block, order, F.max, value, F.greatest, out)
