"""Filters. Each is one predicate that reaches the scan; a limit, where given, follows a total order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.sources.tables import written

#: Rows of a lot, and pairs that a task tests, in a join of ranges.
LOT, TESTS = 1500, 8_000_000


def first(df: DataFrame, most: int | None, *order: str) -> DataFrame:
    return df if most is None else df.orderBy(*order).limit(most)


def in_range(df: DataFrame, column: str, lo, hi) -> DataFrame:
    """Rows whose value lies within both bounds; NaN and null lie in no range."""
    kept = df.where(F.col(column).between(lo, hi))
    return kept.where(~F.isnan(column)) if dict(df.dtypes)[column] in ("double", "float") else kept


def in_time_range(df: DataFrame, id_: str, time: str, start, end, most: int | None = None) -> DataFrame:
    """Ids of rows within the time range."""
    return first(df.where(F.col(time).between(start, end)), most, time, id_).select(id_)


def with_count_at_least(df: DataFrame, id_: str, count: str, least: int, most: int | None = None) -> DataFrame:
    return first(df.where(F.col(count) >= least), most, id_).select(id_)


def seen_at_least(df: DataFrame, id_: str, least: int, most: int | None = None) -> DataFrame:
    """Ids that ``least`` rows or more have."""
    return first(df.groupBy(id_).agg(F.count("*").alias("count")).where(F.col("count") >= least), most, id_)


def where_text(df: DataFrame, test: Column, column: str, most: int | None = None) -> DataFrame:
    return first(df.where(test), most, column)


def overlapping(df: DataFrame, start: str, end: str, lo, hi) -> DataFrame:
    """Ranges that have a point in common with [lo, hi]."""
    return df.where((F.col(start) <= hi) & (F.col(end) >= lo))


def range_overlap_join(a: DataFrame, b: DataFrame, a_range: tuple[str, str], b_range: tuple[str, str], width: float) -> DataFrame:
    """Pairs of rows whose ranges overlap.

    Ranges are laid over buckets of ``width``, joined by bucket, and tested; a pair is given by the first bucket both are
    in, so that none is given twice. ``width`` should be near the usual length of a range.

    The pairs of a bucket grow with the product of its sides. So each side is cut into lots of some ``LOT`` rows, every lot
    of one side meets every lot of the other by itself, and there are as many tasks as the pairs to test need.
    """
    (s, e), (t, f) = a_range, b_range

    def bucketed(df: DataFrame, lo: str, hi: str, begin: str, at: str) -> DataFrame:
        # Written with its rows' numbers, so that a lot is the same whenever it is read.
        buckets = [F.floor(F.col(c) / F.lit(float(width))) for c in (lo, hi)]
        rows = written(df.withColumns({at: F.xxhash64(F.monotonically_increasing_id()), begin: buckets[0], "buckets_": F.sequence(*buckets)}))
        return rows.withColumn("bucket_", F.explode("buckets_")).drop("buckets_")

    left, right = bucketed(a, s, e, "begin_a_", "at_a_"), bucketed(b, t, f, "begin_b_", "at_b_")
    sizes = written(left.groupBy("bucket_").agg(F.count("*").alias("a_")).join(right.groupBy("bucket_").agg(F.count("*").alias("b_")), "bucket_"))
    tests = sizes.agg(F.sum(F.col("a_").cast("double") * F.col("b_"))).first()[0] or 0.0
    tasks, cell = math.ceil(tests / TESTS) or 1, ["bucket_", "lot_a_", "lot_b_"]

    def celled(df: DataFrame, own: str, other: str) -> DataFrame:
        lots = {x: F.ceil(F.col(f"{x}_") / LOT) for x in (own, other)}
        cut = df.join(sizes, "bucket_").withColumn(f"lot_{own}_", F.pmod(f"at_{own}_", lots[own])).withColumn(f"lot_{other}_", F.explode(F.sequence(F.lit(0), lots[other] - 1)))
        return cut.drop("a_", "b_", f"at_{own}_").repartition(tasks, *cell)

    # Merged, since a lot's rows, one for every lot it meets, are far more than a broadcast's estimate.
    both = celled(left, "a", "b").join(celled(right, "b", "a").hint("merge"), cell).where((F.col(s) <= F.col(f)) & (F.col(e) >= F.col(t)))
    return both.where(F.col("bucket_") == F.greatest("begin_a_", "begin_b_")).drop(*cell, "begin_a_", "begin_b_")
