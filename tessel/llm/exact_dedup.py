"""Exact deduplication by sorting the contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.frames import Packed, partitions

SPACE = r"[ \t\n\r\f\x0B]+"
#: Characters of a content that a splitter has; contents that begin alike are split by their digests.
SPLITTER = 64


def normalised(text: Column) -> Column:
    """The text's UTF-8 bytes with each run of ASCII white space as one space and none at either end."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def dedup_exact(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """One row, that of the smallest identifier, of each set of rows whose normalised contents are equal.

    Sampled splitters range-partition the rows by their normalised bytes, an external sort places equal ones next to each
    other, and each is compared in full with its neighbour. A splitter is the beginning of a content and a digest of
    all of it, so that what goes to the driver stays small however long texts are. Partitioning by range needs no second exchange for
    the comparison. All copies of one content meet in one task, which streams through them and spills as it sorts.

    Columns are those of ``docs``. Null texts equal nothing: their rows all stay. Empty and blank texts equal one
    another. A null identifier counts as larger than any other. Rows that tie in content and identifier are reduced to
    one of them; which one is open where other columns differ. An empty table gives an empty table.
    """
    p = Packed(docs, text, id_)
    rows = p.frame.select("row", F.col(id_).alias("id"))
    whole = F.col(f"row.c{p.at[text]}")
    content = normalised(whole)
    # Splitters are short: the first bytes and a digest of all of them. What is made of the text is made anew after the
    # exchange rather than carried through it.
    split = [F.substring(content, 1, SPLITTER), F.xxhash64(content)]
    ranged = rows.where(whole.isNotNull()).repartitionByRange(partitions(docs.sparkSession), *split)
    by = Window.partitionBy(*split, content).orderBy(F.col("id").asc_nulls_last())
    kept = ranged.withColumn("n", F.row_number().over(by)).where("n = 1").select("row")
    return p.unpack(kept.unionByName(rows.where(whole.isNull()).select("row")))


ORACLE = r"""
SELECT doc_id, text, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'), ' ') ORDER BY doc_id NULLS LAST) AS n
  FROM documents)
WHERE n = 1 OR text IS NULL
"""
