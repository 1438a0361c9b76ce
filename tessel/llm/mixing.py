"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.frames import Packed, release, written

#: Slices of virtual time, of which one is summed document by document.
BUCKETS = 4096
#: Documents of a bucket of the shuffled order, about; only running sums within a bucket are sequential.
BUCKET_ROWS = 10_000


def words(text: Column) -> Column:
    """Tokens of a text: runs of anything but ASCII white space. Null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0B]+")), F.lit(0)).cast("bigint")


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float],
    budget_share: float,
    default_weight: float = 1.0,
    seed: int = 0,
    text: str = "text",
    id_: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """Documents in the order of weighted fair queueing, up to a budget of tokens.

    Each source's documents are shuffled by a seeded digest of identifier and text. A document's virtual finish time is
    its source's tokens up to and with it, divided by the source's weight; documents are range-sorted by that time and
    kept while their running total stays within ``budget_share`` of all tokens. A source that runs out leaves its share
    to the others.

    No running sum is sequential over more than one bucket: sums over (source, bucket of the shuffled order) give every
    bucket's start, and sums over slices of virtual time find the one slice in which the budget ends; only that one is summed
    document by document. Buckets are as many as the rows ask for, so that their size doesn't grow with a source.

    Columns are those of ``docs`` and ``virtual_time``, which replaces an input column of that name. A null source is a
    source of its own with the default weight. A source whose weight is 0 or less gives nothing. Null and empty texts
    have no tokens and take no time. Documents of equal time are ordered by source (null first), digest and identifier;
    rows equal in all of these stay or go together, and stay if all of them are within the budget. An empty table gives an empty table.
    """
    p = Packed(docs, text, id_, source)
    weight = F.lit(float(default_weight))
    for name, w in weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_).cast("string"), F.col(text)).cast("binary"))
    rows = p.frame.select("row", F.col(id_).alias("id"), F.col(source).alias("source"), digest.alias("at"), words(F.col(text)).alias("tokens"))
    rows = rows.withColumn("weight", weight).where("weight > 0")
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("+"), "source"), F.lit("")))
    thin = first = written(rows.select("key", "weight", "source", "at", "id", "tokens"))
    # As many hexadecimal digits of the digest as give buckets of that size, were all rows of one source.
    digits, n = 1, thin.count()
    while 16**digits * BUCKET_ROWS < n:
        digits += 1
    bucket = F.conv(F.substring("at", 1, digits), 16, 10).cast("bigint")
    thin, rows = thin.withColumn("bucket", bucket), rows.withColumn("bucket", bucket)
    # Starts of the buckets of each source: a row for each, which is a share of 1 / BUCKET_ROWS of the rows and some.
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = thin.groupBy("key", "bucket", "weight").agg(F.sum("tokens").alias("sum"))
    sums = written(sums.withColumn("start", F.coalesce(F.sum("sum").over(before), F.lit(0))))
    all_tokens, last = sums.agg(F.sum("sum"), F.max((F.col("start") + F.col("sum")) / F.col("weight"))).first()
    budget, width = int((all_tokens or 0) * budget_share), (last or 0.0) / BUCKETS or 1.0

    def timed(frame: DataFrame) -> DataFrame:
        within = Window.partitionBy("key", "bucket").orderBy("at", F.col("id").asc_nulls_last())
        summed = frame.withColumn("run", F.sum("tokens").over(within)).drop("weight")
        starts = sums.select("key", "bucket", "weight", "start")  # the window's partitioning serves the join too
        return summed.join(starts, ["key", "bucket"]).withColumn("time", (F.col("start") + F.col("run")) / F.col("weight"))

    order = [F.col("time"), F.col("source").asc_nulls_first(), F.col("at"), F.col("id").asc_nulls_last()]
    thin = written(timed(thin).select(F.floor(F.col("time") / width).alias("slice"), "time", "source", "at", "id", "tokens"))
    release(first)
    spent, edge = 0, None
    for r in thin.groupBy("slice").agg(F.sum("tokens").alias("sum")).orderBy("slice").collect():  # at most BUCKETS + 1 rows
        if spent + r["sum"] > budget:
            edge = r["slice"]
            break
        spent += r["sum"]
    kept = timed(rows)
    if edge is not None:
        running = thin.where(F.col("slice") == edge).withColumn("run", F.sum("tokens").over(Window.partitionBy("slice").orderBy(*order)))
        past = running.where(F.col("run") > budget - spent).orderBy("run", *order).select("time", "source", "at", "id").first()
        end = F.struct(F.lit(past["time"]).alias("a"), F.lit("" if past["source"] is None else "+" + past["source"]).alias("b"), F.lit(past["at"]).alias("c"))
        here = F.struct(F.col("time").alias("a"), F.col("key").alias("b"), F.col("at").alias("c"))
        earlier = F.col("id").isNotNull() if past["id"] is None else F.coalesce(F.col("id") < F.lit(past["id"]), F.lit(False))
        kept = kept.where((here < end) | ((here == end) & earlier))
    return p.unpack(kept.orderBy(*order), {"virtual_time": F.col("time")})


#: Weights of the registered query: the largest source counts half, three others double, and the rest once.
WEIGHTS = {"src0": 0.5, "src1": 2.0, "src2": 2.0, "src3": 2.0}
BUDGET_SHARE = 0.8

ORACLE = r"""
WITH d AS (
  SELECT *, md5(concat_ws('|', '0', doc_id, text)) AS k,
    coalesce(len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')), 0)::BIGINT AS tokens,
    CASE source WHEN 'src0' THEN 0.5::DOUBLE WHEN 'src1' THEN 2.0::DOUBLE WHEN 'src2' THEN 2.0::DOUBLE WHEN 'src3' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM documents),
t AS (
  SELECT *, (sum(tokens) OVER (PARTITION BY source ORDER BY k, doc_id))::BIGINT::DOUBLE / weight AS virtual_time FROM d),
r AS (
  SELECT *, sum(tokens) OVER (ORDER BY virtual_time, source NULLS FIRST, k, doc_id) AS run FROM t)
SELECT doc_id, text, lang, source, n_chars, virtual_time FROM r
WHERE run <= (SELECT floor(sum(tokens)::BIGINT::DOUBLE * 0.8::DOUBLE) FROM d)
"""
