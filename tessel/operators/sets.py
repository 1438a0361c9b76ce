"""Set operations and deduplication of posting lists, one row per id; results are bags unless ordered by the caller."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def limited(df: DataFrame, most: int | None, ascending: bool = True) -> DataFrame:
    if most is None:
        return df
    keys = [F.col(c).asc() if ascending else F.col(c).desc() for c in df.columns]
    return df.orderBy(*keys).limit(most)


def intersect(a: DataFrame, b: DataFrame, dedup: bool = False, most: int | None = None, ascending: bool = True) -> DataFrame:
    """Rows in both, as often as in the side that has fewer, or once each with ``dedup``."""
    return limited(a.intersect(b) if dedup else a.intersectAll(b), most, ascending)


def difference(a: DataFrame, b: DataFrame, dedup: bool = False, most: int | None = None, ascending: bool = True) -> DataFrame:
    """Rows of ``a`` that ``b`` has none of; each repeat is kept unless ``dedup``."""
    kept = a.join(b.distinct(), a.columns, "left_anti")
    return limited(kept.distinct() if dedup else kept, most, ascending)


def union(parts: list[DataFrame], most: int | None = None, ascending: bool = True) -> DataFrame:
    """Distinct rows of any number of lists."""
    return limited(reduce(DataFrame.unionByName, parts).distinct(), most, ascending)


def dedup(df: DataFrame) -> DataFrame:
    return df.distinct()


def dedup_doubles(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column of doubles: 0.0 and -0.0 are one, and every NaN stays, as none equals another."""
    v = F.col(column)
    return df.where(~F.isnan(v)).select((v + F.lit(0.0)).alias(column)).distinct().unionAll(df.where(F.isnan(v)).select(column))


def without_deleted(docs: DataFrame, deleted: DataFrame, id_: str) -> DataFrame:
    """``docs`` without the deleted ids. How they are sent is decided by their size at run time (adaptive execution)."""
    return docs.join(deleted.select(id_), id_, "left_anti")
