"""Aggregates with IEEE rules for NaN and defined values for nothing. All combine partially before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The range of nulls, after that of NaN.
NULLS = 2_000_000
NAN, INF = float("nan"), float("inf")
UINT32, INT64 = 4294967295, 9223372036854775807


def any_nan(v: Column) -> Column:
    return F.coalesce(F.bool_or(F.isnan(v)), F.lit(False))


def sum_f64(v: Column) -> Column:
    return F.coalesce(F.sum(v), F.lit(0.0))


def sum_u64(v: Column) -> Column:
    """Modulo 2^64, as a decimal."""
    return F.pmod(F.coalesce(F.sum(v.cast("decimal(20,0)")), F.lit(0)), F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)")


def sum_u32(v: Column) -> Column:
    return F.coalesce(F.sum(v.cast("bigint")), F.lit(0))


def weighted_sum(v: Column, w: Column) -> Column:
    return F.coalesce(F.sum(v * w), F.lit(0.0))


def min_f64(v: Column) -> Column:
    """NaN if there is one; +infinity of nothing."""
    return F.when(any_nan(v), NAN).otherwise(F.coalesce(F.min(v), F.lit(INF)))


def max_f64(v: Column) -> Column:
    """NaN if there is one; -infinity of nothing."""
    return F.coalesce(F.max(v), F.lit(-INF))


def min_u32(v: Column) -> Column:
    return F.coalesce(F.min(v.cast("bigint")), F.lit(UINT32))


def max_u32(v: Column) -> Column:
    return F.coalesce(F.max(v.cast("bigint")), F.lit(0))


def min_i64(v: Column) -> Column:
    return F.coalesce(F.min(v.cast("bigint")), F.lit(INT64))


def max_i64(v: Column) -> Column:
    return F.coalesce(F.max(v.cast("bigint")), F.lit(-INT64 - 1))


def avg(v: Column) -> Column:
    return F.coalesce(F.avg(v), F.lit(NAN))


def present(v: Column) -> Column:
    return F.coalesce(F.bool_or(~F.isnan(v)), F.lit(False)).cast("double")


def numbers(v: Column) -> Column:
    return F.when(~F.isnan(v), v)


def variance(v: Column) -> Column:
    """Population variance without NaN; NaN of nothing."""
    return F.coalesce(F.var_pop(numbers(v)), F.lit(NAN))


def mean_deviation(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Mean absolute deviation about each group's mean, without NaN; NaN of nothing. Two aggregations and a join of groups."""
    keys = [f"k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], numbers(F.col(column)).alias("v"))
    means = rows.groupBy(*keys).agg(F.avg("v").alias("m"))
    off = rows.join(means, keys).groupBy(*keys).agg(F.coalesce(F.avg(F.abs(F.col("v") - F.col("m"))), F.lit(NAN)).alias("mad"))
    return off.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "mad")


def percentiles(df: DataFrame, by: list[str], column: str, ps: list[float]) -> DataFrame:
    """``by`` and ``p``, each group's exact percentiles with linear interpolation in the order asked; NaN outside 0 to 100.

    Equal values are counted before anything is shuffled. Values fall into ranges on a logarithmic scale, running sums over a
    group's ranges (some hundreds) give each range's first rank, and only within a range are values put in order: no
    task holds a group, or sorts one. Nulls don't count; NaN is the largest value; a group of nulls alone has NaN.
    """
    keys = [f"k{i}" for i in range(len(by))]
    inside = [p for p in ps if 0 <= p <= 100]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(column).cast("double").alias("v"))
    v = F.col("v")
    scale = F.when(F.isnan(v), 1e6).otherwise(F.floor(F.signum(v) * F.least(F.log1p(F.abs(v)), F.lit(1000.0)) * 64))  # never falls as values grow
    counts = rows.withColumn("range", scale.cast("int")).groupBy(*keys, "range", "v").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*keys)
    # Nulls make a last range, so that a group of nothing else has a row; they are in no other's rank.
    counts = counts.select(*keys, F.coalesce("range", F.lit(NULLS)).alias("range"), "v", "n")
    starts = counts.groupBy(*keys, "range").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select(*keys, "range", before.alias("before"), F.sum(F.when(F.col("range") < NULLS, F.col("n")).otherwise(0)).over(group).alias("total"))
    here = Window.partitionBy(*keys, "range").orderBy("v")
    ranks = counts.withColumn("end", F.sum("n").over(here))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, "range")]
    ranks = ranks.alias("a").join(starts.alias("b"), same).select("a.*", "b.before", "b.total")
    ranks = ranks.select(*keys, "v", "total", (F.col("before") + F.col("end")).alias("end"), (F.col("before") + F.col("end") - F.col("n")).alias("start"))
    at = [F.lit(p / 100) * (F.col("total") - 1) for p in inside]
    picked = []
    for i, x in enumerate(at):
        for side, r in (("lo", F.floor(x)), ("hi", F.ceil(x))):
            picked.append(F.max(F.when((F.col("start") <= r) & (r < F.col("end")), F.col("v"))).alias(f"{side}{i}"))
    got = ranks.groupBy(*keys).agg(F.max("total").alias("total"), *picked)
    value = lambda i: F.when(F.col(f"lo{i}") == F.col(f"hi{i}"), F.col(f"lo{i}")).otherwise(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (at[i] - F.floor(at[i])))
    out = F.array(*[F.coalesce(value(inside.index(p)), F.lit(NAN)) if p in inside else F.lit(NAN) for p in ps])
    return got.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], out.alias("p"))
