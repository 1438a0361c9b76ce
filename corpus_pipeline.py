"""Documents to training shards: each stage works on all that the one before it kept.

Every stage takes the columns of ``documents`` by their exact names, or without regard to case where that name is missing, and
drops all others. An empty table goes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessel.llm import decontaminate, mixing, ngram_join, quality, wavelet
from tessel.llm.frames import Packed, release, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def own(docs: DataFrame) -> DataFrame:
    """The columns of documents alone."""
    return Packed(docs, *COLUMNS).frame.select(*COLUMNS)


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    Null, empty and blank texts are rejected. A null identifier has no label, and is judged like any other document; equal texts
    are judged alike, and repeated rows all stay or all go. Without labels of both classes every document with words stays.
    """
    return quality.filter_quality(own(docs), table(spark, sf_dir, "labels")).select(*COLUMNS)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest identifier.

    Null identifiers and null texts are in no group and stay. Rows that share an identifier are one document: all of them stay or
    go, repeated rows among them.
    """
    return ngram_join.dedup_near(own(docs)).select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts have none and stay; every row is judged by itself."""
    return decontaminate.decontaminate(own(docs), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the target mix, up to the budget of words.

    A null source is a source with the default weight; null and empty texts take nothing of the budget; rows that tie in all that
    orders them stay or go together.
    """
    return mixing.mix_sources(own(docs), mixing.WEIGHTS, mixing.BUDGET_SHARE).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, a wavelet matrix per shard. Null texts are left out; an empty one is its end alone; repeats are coded again."""
    return wavelet.wavelet_shards(own(docs))


STAGES = [
    ("quality classifier", accept_quality),
    ("n-gram Jaccard join", keep_one_of_near),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", pack),
]

#: Training a classifier, aligning with a budget and coding tokens have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of the whole table of documents.

    Every stage's result is written to the shared folder and read again; each is deleted once the next has been written, but
    for the last, which the returned frame reads.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
