"""Sorting, ranks and sortedness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.sources.tables import written

#: A number that Spark gives a row has its partition above so many bits, and its place in the partition below.
PLACE = 33


def ranked(df: DataFrame, key: str, *ties: str, ascending: bool = True, dedup: bool = False, parts: int | None = None) -> DataFrame:
    """``df`` with ``rank``, from 1, in the order of ``key`` and then ``ties``; it replaces a column of that name.

    Rows are divided into ranges by all that orders them, so that ties divide a value that very many rows share. Each range is
    sorted by itself and written once; ranks are places in a range after the rows of the ranges before it. ``dedup`` keeps
    distinct rows. NaN is the largest value. Nulls come first ascending and last descending.
    """
    names = [c for c in df.columns if c.lower() != "rank"]
    rows = df.distinct() if dedup else df
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(F.struct(*[F.col(c) for c in names]).alias("row"), F.col(key).alias("k"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(ties)])
    order = [F.col("k").asc() if ascending else F.col("k").desc(), *[F.col(f"t{i}").asc() for i in range(len(ties))]]
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("row", F.monotonically_increasing_id().alias("at"))
    placed = written(placed).withColumn("part", F.shiftright("at", PLACE))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row per range
    sizes = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.col("at").bitwiseAND((1 << PLACE) - 1) + F.col("before") + 1
    return placed.join(F.broadcast(sizes), "part").select(*[F.col("row")[c].alias(c) for c in names], rank.alias("rank"))


def ranked_nan_last(df: DataFrame, key: str, *ties: str, ascending: bool = True) -> DataFrame:
    """As ``ranked``, with NaN last either way."""
    if ascending:
        return ranked(df, key, *ties)
    numbers, nans = df.where(~F.isnan(key)), df.where(F.isnan(key))
    n = numbers.agg(F.count("*").alias("n"))
    last = ranked(nans, ties[0], *ties[1:]) if ties else ranked(nans, key)
    return ranked(numbers, key, *ties, ascending=False).unionByName(last.crossJoin(F.broadcast(n)).withColumn("rank", F.col("rank") + F.col("n")).drop("n"))


def is_sorted(df: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """For each series, whether its values never fall in the given order."""
    before = F.lag(value).over(Window.partitionBy(series).orderBy(*order))
    steps = df.select(series, (F.coalesce(before <= F.col(value), F.lit(True))).alias("step"))
    return steps.groupBy(series).agg(F.bool_and("step").alias("is_sorted"))
