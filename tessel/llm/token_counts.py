"""Token counts without token ids."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.frames import Packed, lean, written
from tessel.llm.tokens import VOCABULARY, Numbers, PreTokens, encoded, encoding, hashed, lots

#: Distinct pre-tokens whose counts every worker holds: about 4 MB. All others are joined by a shuffle.
HEAD = 1 << 18


@lean
def distinct(batches: Iterator, most: int = 300_000) -> Iterator:
    """The distinct pre-tokens of the texts, and how often each occurs."""
    import numpy as np
    import pyarrow as pa

    def out():
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts)], names=["piece", "n"])

    numbers, names, counts = Numbers(), [], np.zeros(0, np.int64)
    for b in batches:
        for lot in lots(b.column("text").drop_null()):
            found = PreTokens(lot)
            codes, new = numbers.of(found.hashes)
            names += found.spelled(new)
            n = np.bincount(codes, minlength=len(numbers))
            n[: len(counts)] += counts
            counts = n
            if len(names) > most:
                yield out()
                numbers, names, counts = Numbers(), [], np.zeros(0, np.int64)
    if names:
        yield out()


@lean
def counted(batches: Iterator, path: str) -> Iterator:
    import pyarrow as pa

    encoder = encoding(path)
    for b in batches:
        names = b.column("piece").to_pylist()
        yield pa.RecordBatch.from_arrays([b.column("piece"), b.column("n"), pa.array(encoded(names, encoder)[1])], names=["piece", "n", "tokens"])


@lean
def summed(batches: Iterator, head) -> Iterator:
    """For each document, the sum over pre-tokens in ``head`` and the frequencies of the others."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    hashes, tokens = head.value
    uid = TaskContext.get().partitionId() << 40
    for b in batches:
        at = 0
        for lot in lots(b.column("text").fill_null("")):
            found = PreTokens(lot)
            doc = np.repeat(np.arange(len(lot)), found.counts)
            place = np.searchsorted(hashes, found.hashes)
            place[place == len(hashes)] = 0
            known = hashes[place] == found.hashes
            sums = np.bincount(doc[known], tokens[place[known]], len(lot)).astype(np.int64)
            codes, first = Numbers().of(found.hashes[~known])
            names = pa.array(found.spelled(np.flatnonzero(~known)[first]), pa.string())
            pairs, n = np.unique(doc[~known] * max(1, len(names)) + codes, return_counts=True)
            own, codes = np.divmod(pairs, max(1, len(names)))
            offsets = np.searchsorted(own, np.arange(len(lot) + 1)).astype(np.int32)
            rest = pa.StructArray.from_arrays([names.take(pa.array(codes)), pa.array(n.astype(np.int64))], names=["piece", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(uid + np.arange(len(lot))), b.column("id").slice(at, len(lot)), pa.array(sums), pa.ListArray.from_arrays(pa.array(offsets), rest)], names=["uid", "id", "known", "rest"])
            at += len(lot)
            uid += len(lot)


def hashes_of(names: list[str]):
    """Hashes of pre-tokens, as ``PreTokens`` has them."""
    import numpy as np

    ends = np.cumsum(np.fromiter(map(len, names), np.int64, len(names)))
    return hashed(np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32), np.append(0, ends[:-1]), ends)


def token_counts(docs: DataFrame, path: str = VOCABULARY, head: int = HEAD, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """``id_`` and ``n_tokens`` for every row of ``docs``: the number of ids the vocabulary gives its text.

    Distinct pre-tokens, the vocabulary's own, are gathered over all documents and each is encoded once, for its number of ids
    only. Documents become pre-token frequencies. The ``head`` most frequent pre-tokens, a bounded table known by 64-bit
    hashes, go to every worker and are summed where the documents are read; the frequencies of all others are joined to
    their counts by a shuffle.

    A null or empty text has 0 tokens. Identifiers may be null or repeated: every row gives its own row. Strings of
    special tokens in a text are ordinary text. An empty table gives an empty table.
    """
    p = Packed(docs, text, id_)
    spark = docs.sparkSession
    texts = p.frame.select(F.col(id_).alias("id"), F.col(text).alias("text"))
    found = texts.select("text").mapInArrow(distinct, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    vocabulary = written(found.mapInArrow(lambda it: counted(it, path), "piece string, n long, tokens long"))
    # The most frequent, by steps of a quarter of a power of two: as many steps as give no more than ``head`` pre-tokens.
    step = F.floor(F.log2("n") * 4)
    most, least = 0, None
    for r in vocabulary.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.col("step").desc()).collect():  # at most 256 rows
        if most + r["n"] > head:
            break
        most, least = most + r["n"], r["step"]
    import numpy as np

    hashes, tokens = np.zeros(1, np.uint64), np.zeros(1, np.int64)
    if least is not None:
        top = vocabulary.where(step >= least).select("piece", "tokens").toArrow()  # at most ``head`` rows
        hashes = hashes_of(top.column("piece").to_pylist())
        order = np.argsort(hashes)
        hashes, tokens = hashes[order], top.column("tokens").to_numpy()[order]
    known = spark.sparkContext.broadcast((hashes, tokens))
    id_type = dict(texts.dtypes)["id"]
    docs_ = written(texts.mapInArrow(lambda it: summed(it, known), f"uid long, id {id_type}, known long, rest array<struct<piece:string,n:long>>"))
    rest = docs_.select("uid", F.explode("rest").alias("r")).select("uid", "r.piece", "r.n")
    rest = rest.join(vocabulary.select("piece", "tokens"), "piece").groupBy("uid").agg(F.sum(F.col("n") * F.col("tokens")).alias("more"))
    total = (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens")
    return docs_.select("uid", "id", "known").join(rest, "uid", "left").select(F.col("id").alias(id_), total)
