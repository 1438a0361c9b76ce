"""Substring deduplication by hashing lines or paragraphs, and the clauses within them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tessel.llm.frames import Packed, lean

#: Clauses tile a text, and lines and paragraphs each hold whole clauses: all run up to and with the marks that close them.
CLAUSE = r"[^.,;:!?\n]+[.,;:!?\n]*|[.,;:!?\n]+"
UNITS = {"line": r"[^\n]*\n[.,;:!?\n]*|[^\n]+", "paragraph": r"(?s).+?(?:\n[.,;:!?]*\n[.,;:!?\n]*|(?!.))"}
NOT_WORD = r"[^0-9a-z\x{80}-\x{10FFFF}]+"


def normalised(unit: Column) -> Column:
    """Lower case, with each run of ASCII characters other than letters and digits as one space and none at either end."""
    return F.trim(F.regexp_replace(F.lower(unit), NOT_WORD, " "))


@lean
def cut(batches: Iterator, at: int, unit: str, min_words: int) -> Iterator:
    """Rows, their texts (field number ``at``) without what is marked, and the spans taken out.

    Marks are the numbers of clauses, and of lines or paragraphs as -1, -2 and so on.
    """
    import re

    import pyarrow as pa

    clauses, units, word = re.compile(CLAUSE), re.compile(unit), re.compile("[0-9A-Za-z\\x80-\\U0010ffff]+")

    def one(text: str, marked: list[int]) -> tuple[str, list[dict]]:
        marks, spans, whole = set(marked), [], []
        if min(marked) < 0:
            whole = [(m.start(), m.end()) for i, m in enumerate(units.finditer(text)) if -1 - i in marks]
        run: list = []  # clauses of a run: where each begins, and whether its line goes in any case
        words, in_whole = 0, iter(whole)
        a, z = next(in_whole, (len(text), len(text)))

        def take(start: int, end: int) -> None:
            if spans and spans[-1]["end"] == start:
                spans[-1]["end"] = end
            else:
                spans.append({"start": start, "end": end})

        def close() -> None:
            nonlocal words
            for start, end, gone in run:
                if gone or words >= min_words:
                    take(start, end)
            run.clear()
            words = 0

        for i, m in enumerate(clauses.finditer(text)):
            start, end = m.span()
            while start >= z:
                a, z = next(in_whole, (len(text), len(text) + 1))
            gone = a <= start < z
            n = len(word.findall(m[0])) if gone or run or i in marks else 0
            if n and (gone or i in marks):
                run.append((start, end, gone))
                words += n
            elif run and not n:  # a clause without words doesn't end a run
                run.append((start, end, gone))
            else:
                close()
                if gone:
                    take(start, end)
        close()
        kept, last = [], 0
        for s in spans:
            kept.append(text[last : s["start"]])
            last = s["end"]
        return "".join([*kept, text[last:]]), spans

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        texts, marks = b.column("row").field(at), b.column("marked")
        cleaned, spans = texts, pa.array([[]] * b.num_rows, kind)
        if marks.null_count < b.num_rows:
            done = [(t.as_py(), []) if not m.is_valid or not t.is_valid else one(t.as_py(), m.as_py()) for t, m in zip(texts, marks, strict=True)]
            cleaned, spans = pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], kind)
            done = None
        rest = [pa.nulls(b.num_rows, pa.string()) if i == at else b.column("row").field(i) for i in range(b.column("row").type.num_fields)]
        row = pa.StructArray.from_arrays(rest, fields=list(b.column("row").type))
        yield pa.RecordBatch.from_arrays([row, cleaned, spans], names=["row", "clean", "spans"])


def dedup_units(docs: DataFrame, unit: str = "line", min_words: int = 20, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """Documents without what an earlier document, or an earlier place of the same one, has already said.

    Units, ``line`` or ``paragraph``, and the clauses within them are normalised and hashed to 64 bits, digests are grouped
    over all documents, and the earliest occurrence by (identifier, digest of the text, place) is ranked first. Every
    other occurrence of a unit is taken out, however short it is. Passages that repeat within lines are found by their
    clauses: of these, runs of neighbouring repeats with at least ``min_words`` words together are taken out, so that common
    phrases stay.

    Columns are those of ``docs``, with ``text`` cleaned, and ``removed``: the spans taken out, as [start, end) in
    characters of the original text, in order. ``removed`` replaces an input column of that name. Units without a letter
    or digit are never marked. A null text stays null with no spans; an empty one stays empty. A null identifier ranks
    after all others. Rows equal in identifier and text count as one document and are treated alike. An empty table
    gives an empty table.
    """
    p = Packed(docs, text, id_)
    rows = p.frame.select("row", F.col(id_).alias("id"), F.col(text).alias("text"), F.xxhash64(id_, text).alias("key"))

    def cut_up(pattern: str, number: Column, kind: int) -> DataFrame:
        parts = rows.select("id", "key", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("at", "unit"))
        parts = parts.withColumn("unit", normalised(F.col("unit"))).where("unit <> ''")
        return parts.select(F.xxhash64("unit", F.lit(kind)).alias("digest"), "id", "key", number.alias("at"))

    units = cut_up(CLAUSE, F.col("at"), 0).unionByName(cut_up(UNITS[unit], -1 - F.col("at"), 1))
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("key").alias("key"), F.abs("at").alias("place"), F.col("at").alias("at"))
    # Repeated digests only; counted with map-side partial sums, so that a common line is no hot key.
    firsts = units.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    later = units.join(firsts, "digest").where((F.col("key") != F.col("first.key")) | (F.col("at") != F.col("first.at")))
    marked = later.groupBy("key").agg(F.collect_set("at").alias("marked"))
    both = rows.select("row", "key").join(marked, "key", "left").select("row", "marked")
    span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
    schema = StructType([both.schema["row"], StructField("clean", StringType()), StructField("spans", ArrayType(span))])
    pattern, at = UNITS[unit], p.at[text]
    done = both.mapInArrow(lambda it: cut(it, at, pattern, min_words), schema)
    return p.unpack(done, {"removed": F.col("spans")}, **{text: F.col("clean")})


ORACLE = r"""
WITH u AS (
  SELECT doc_id, generate_subscripts(us, 1) AS k, unnest(us) AS unit FROM (
    SELECT doc_id, regexp_extract_all(text, '[^.,;:!?\n]+[.,;:!?\n]*|[.,;:!?\n]+') AS us FROM documents)),
n AS (
  SELECT *, trim(regexp_replace(lower(unit), '[^0-9a-z\x{80}-\x{10FFFF}]+', ' ', 'g'), ' ') AS norm,
    sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY k) - length(unit) AS start,
    sum(CASE WHEN contains(unit, chr(10)) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) - CASE WHEN contains(unit, chr(10)) THEN 1 ELSE 0 END AS line FROM u),
-- lines: every occurrence but the first goes
l AS (
  SELECT doc_id, line, trim(regexp_replace(lower(string_agg(unit, '' ORDER BY k)), '[^0-9a-z\x{80}-\x{10FFFF}]+', ' ', 'g'), ' ') AS norm FROM n GROUP BY doc_id, line),
again AS (SELECT doc_id, line FROM l WHERE norm <> '' QUALIFY row_number() OVER (PARTITION BY norm ORDER BY doc_id, line) > 1),
m AS (
  SELECT n.*, again.line IS NOT NULL AS whole,
    norm <> '' AND (again.line IS NOT NULL OR row_number() OVER (PARTITION BY norm ORDER BY n.doc_id, k) > 1) AS marked,
    CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END AS words FROM n LEFT JOIN again ON n.doc_id = again.doc_id AND n.line = again.line),
-- units without words go with the run before them
g AS (
  SELECT *, sum(CASE WHEN norm <> '' AND NOT marked THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM m),
h AS (
  SELECT *, max(CASE WHEN marked THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run ORDER BY k) AS in_run FROM g),
r AS (
  SELECT *, whole OR ((marked OR (norm = '' AND in_run = 1)) AND sum(CASE WHEN marked THEN words ELSE 0 END) OVER (PARTITION BY doc_id, run) >= 20) AS gone FROM h),
i AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS island FROM r WHERE gone),
s AS (
  SELECT doc_id, island, min(start)::INT AS a, max(start + length(unit))::INT AS b FROM i GROUP BY doc_id, island),
t AS (SELECT doc_id, list({'start': a, 'end': b} ORDER BY a) AS removed FROM s GROUP BY doc_id),
c AS (SELECT doc_id, string_agg(unit, '' ORDER BY k) AS clean FROM r WHERE NOT gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(c.clean, '') END AS text, lang, source, n_chars,
  coalesce(removed, []::STRUCT("start" INTEGER, "end" INTEGER)[]) AS removed
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
