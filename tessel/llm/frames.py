"""Frames whose own columns can't clash with an operator's, and what workers keep and give back."""

from __future__ import annotations

import functools
import gc
import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.sources.tables import release, table, written

__all__ = ["Packed", "find", "kept_in_worker", "lean", "partitions", "release", "table", "trimmed", "written"]


class Packed:
    """A frame with every input column in one struct, so that an operator may name its own columns freely.

    ``frame`` has ``row`` and, for each name in ``need``, a column of that name. A needed column is found by its exact
    name, else without regard to case; the first counts where there are several. ``unpack`` gives the input's columns
    back, in their order, with ``added`` after them: an input column of an added name gives way to it.
    """

    def __init__(self, df: DataFrame, *need: str):
        self.names = df.columns
        flat = df.toDF(*[f"c{i}" for i in range(len(self.names))])
        self.at = {n: find(self.names, n) for n in need}
        self.frame = flat.select(F.struct(*flat.columns).alias("row"), *[F.col(f"c{i}").alias(n) for n, i in self.at.items()])

    def columns(self, **replaced: Column) -> list[Column]:
        """The input's columns; ``replaced`` gives new values for needed ones."""
        new = {self.at[n]: c for n, c in replaced.items()}
        return [(new[i] if i in new else F.col(f"row.c{i}")).alias(n) for i, n in enumerate(self.names)]

    def unpack(self, frame: DataFrame, added: dict[str, Column] | None = None, **replaced: Column) -> DataFrame:
        added = added or {}
        taken = {n.lower() for n in added}
        own = [c for c, n in zip(self.columns(**replaced), self.names, strict=True) if n.lower() not in taken]
        return frame.select(*own, *[c.alias(n) for n, c in added.items()])


def find(names: list[str], name: str) -> int:
    if name in names:
        return names.index(name)
    for i, n in enumerate(names):
        if n.lower() == name.lower():
            return i
    raise ValueError(f"no column {name!r} among {names}")


def kept_in_worker() -> dict:
    """What a Python worker keeps from one task to the next, such as a loaded tokenizer."""
    return sys.modules.setdefault("tessel_kept", types.ModuleType("tessel_kept")).__dict__.setdefault("kept", {})


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lean(task):
    """A generator of Arrow batches that gives its memory back to the machine at its end: workers live on, and would keep it."""

    @functools.wraps(task)
    def run(*args):
        yield from task(*args)  # its frame, and all it refers to, is gone at the next line
        trimmed()

    return run


def trimmed() -> None:
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)
