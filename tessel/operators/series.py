"""Functions of a series in time order, one row per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def steps(df: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(series).orderBy(*order)
    return df.select(series, F.col(value).alias("v"), F.lag(value).over(w).alias("before"), (F.row_number().over(w) > 1).alias("later"))


def changes(df: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """How often a value differs from the one before; NaN differs from everything."""
    differs = F.col("later") & ((F.col("v") != F.col("before")) | F.isnan("v"))
    return steps(df, series, order, value).groupBy(series).agg(F.count_if(differs).cast("double").alias("changes"))


def resets(df: DataFrame, series: str, order: list[str], value: str, ascending: bool = True) -> DataFrame:
    """How often a value falls, or, if not ``ascending``, rises."""
    v, b = F.col("v"), F.col("before")
    turned = (v < b) & ~F.isnan(b) if ascending else (v > b) & ~F.isnan(v)
    return steps(df, series, order, value).groupBy(series).agg(F.count_if(turned).cast("double").alias("resets"))


def increase(df: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """Last less first; the last where that is negative; 0 for a series of one."""
    at = F.struct(*order)
    ends = df.groupBy(series).agg(F.min_by(value, at).alias("a"), F.max_by(value, at).alias("b"), F.count("*").alias("n"))
    d = F.col("b") - F.col("a")
    return ends.select(series, F.when(F.col("n") < 2, 0.0).when(d < 0, F.col("b")).otherwise(d).alias("increase"))


def slope(v: Column, t: Column) -> Column:
    """Aggregate: least-squares slope; 0 for fewer than two points or times that are all one."""
    return F.coalesce(F.regr_slope(v, t), F.lit(0.0))


def predicted(v: Column, t: Column, at: Column) -> Column:
    """Aggregate: the least-squares line at a time; the only value where there is one, and the mean where times are all one."""
    return F.when(F.count(v) == 1, F.max(v)).otherwise(F.coalesce(F.regr_intercept(v, t) + F.regr_slope(v, t) * at, F.avg(v)))
