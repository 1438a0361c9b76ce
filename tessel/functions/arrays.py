"""Set, order, search and reduction functions of array columns; tables of one row per value have theirs in ``operators``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

PLACES = ArrayType(IntegerType())


def places(a, b, kept):
    """For each pair of arrays, the places in the first that ``kept`` gives of both arrays' values, numbered alike."""
    import numpy as np
    import pyarrow as pa

    out = []
    for x, y in zip(a, b, strict=True):
        if not (x.is_valid and y.is_valid):
            out.append(None)
            continue
        codes = pa.concat_arrays([x.values, y.values]).dictionary_encode().indices.fill_null(-1).to_numpy()
        x, y = codes[: len(x.values)], codes[len(x.values) :]
        out.append(np.flatnonzero(kept(x, y) & (x >= 0)).astype(np.int32))  # null equals nothing
    return pa.array(out, pa.list_(pa.int32()))


@F.arrow_udf(PLACES)
def unshared(a, b):
    import numpy as np

    return places(a, b, lambda x, y: ~np.isin(x, y))


@F.arrow_udf(PLACES)
def matched(a, b):
    import numpy as np

    def kept(x, y):
        order = np.argsort(x, kind="stable")
        there = x[order]
        first = np.flatnonzero(np.append(True, there[1:] != there[:-1])) if len(there) else there
        number = np.zeros(len(x), np.int64)  # which of its value's repeats a place has
        number[order] = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
        counts = np.bincount(y[y >= 0], minlength=max(x.max(initial=-1), 0) + 1)
        return number < counts[x]

    return places(a, b, kept)


def at_places(a: Column, where: Column) -> Column:
    return F.transform(where, lambda i: F.get(a, i))


def limited(a: Column, most: int | None) -> Column:
    return a if most is None else F.slice(a, 1, most) if most > 0 else F.slice(a, 1, 0)


def intersect(a: Column, b: Column, dedup: bool = True, ascending: bool = True, most: int | None = None) -> Column:
    """Values in both; without ``dedup``, as often as in the array that has fewer."""
    if dedup:
        return limited(F.sort_array(F.array_intersect(a, b), ascending), most)
    return limited(F.sort_array(at_places(a, matched(a, b)), ascending), most)


def difference(a: Column, b: Column, dedup: bool = False, ascending: bool = True, most: int | None = None) -> Column:
    """Values of ``a`` that ``b`` lacks, repeats kept unless ``dedup``."""
    kept = F.array_except(a, b) if dedup else at_places(a, unshared(a, b))
    return limited(F.sort_array(kept, ascending), most)


def union(arrays: list[Column], ascending: bool = True, most: int | None = None) -> Column:
    """Distinct values of all arrays."""
    return limited(F.sort_array(F.array_distinct(F.flatten(F.array(*arrays))), ascending), most)


def dedup(a: Column) -> Column:
    """Each run of equal neighbours as one; NaN equals nothing, and 0.0 equals -0.0."""
    before = F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    kept = F.zip_with(F.slice(a, 2, F.size(a)), before, lambda x, y: F.when((x != y) | (x.cast("string") == "NaN"), F.array(x)).otherwise(F.slice(F.array(x), 1, 0)))
    return F.concat(F.slice(a, 1, 1), F.flatten(kept))


def sort(a: Column, dedup_: bool = False, ascending: bool = True) -> Column:
    """NaN comes last ascending and first descending."""
    ordered = F.sort_array(a, ascending)
    return dedup(ordered) if dedup_ else ordered


def argsort(values: Column, ascending: bool = True, nan_last: bool = True) -> Column:
    """Places, from 0, in order of their values; ties by place, and NaN last either way."""
    sign = 1 if ascending else -1
    keyed = F.transform(values, lambda v, i: F.struct((F.isnan(v.cast("double")) if nan_last else F.lit(False)).alias("n"), F.when(~F.isnan(v.cast("double")), v * sign).alias("v"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda x: x["i"])


def is_sorted(a: Column) -> Column:
    return a == F.sort_array(a)


def lower_bound(a: Column, target: Column) -> Column:
    """The first place whose value is at least the target, else the length."""
    return F.size(F.filter(a, lambda x: x < target))


def last_at_most(a: Column, target: Column) -> Column:
    """The last place whose value is at most the target; the length where none is, 0 for an empty array."""
    n = F.size(F.filter(a, lambda x: x <= target))
    return F.when(n == 0, F.size(a)).otherwise(n - 1)


def after_last_at_most(a: Column, target: Column) -> Column:
    """The place after the last value at most the target."""
    return F.size(F.filter(a, lambda x: x <= target))


def in_range(a: Column, lo, hi) -> Column:
    """Values within both bounds; NaN is in no range."""
    return F.filter(a, lambda x: (x >= lo) & (x <= hi) & (x.cast("string") != "NaN"))
