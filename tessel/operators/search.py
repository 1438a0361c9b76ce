"""Lower and upper bounds in sorted series, and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at_least(value: Column, target: Column) -> Column:
    """Aggregate: the first place whose value is at least the target, else the length."""
    return F.count_if(value < target)


def at_most(value: Column, target: Column) -> Column:
    """Aggregate: the last place whose value is at most the target; the length where there is none."""
    n = F.count_if(value <= target)
    return F.when(n == 0, F.count(value)).otherwise(n - 1)


def after_at_most(value: Column, target: Column) -> Column:
    """Aggregate: the place after the last value at most the target."""
    return F.count_if(value <= target)


def asof(left: DataFrame, right: DataFrame, by: str, time: str, value: str, forward: bool = False) -> DataFrame:
    """``left`` with the right side's last row at or before its time (``forward``: first at or after): ``asof_time`` and ``asof_value``.

    The sides are stacked, and a window per key carries the right side's rows along; nothing is joined, so a key costs
    its rows and not their product. Of right rows at one time the largest value counts.
    """
    own = [F.col(c) for c in left.columns]
    here = left.select(F.struct(*own).alias("row"), by, F.col(time).alias("t"), F.lit(None).cast(right.schema[value].dataType).alias("v"), F.lit(1).alias("side"))
    there = right.select(F.lit(None).cast(here.schema["row"].dataType).alias("row"), by, F.col(time).alias("t"), F.col(value).alias("v"), F.lit(0).alias("side"))
    if forward:
        order = [F.col("t").desc(), F.col("side"), F.col("v")]
    else:
        order = [F.col("t"), F.col("side"), F.col("v")]
    carried = F.last(F.when(F.col("side") == 0, F.struct("t", "v")), ignorenulls=True).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = here.unionByName(there).withColumn("m", carried).where("side = 1")
    return both.select("row.*", F.col("m.t").alias("asof_time"), F.col("m.v").alias("asof_value"))
