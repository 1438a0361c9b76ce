"""Exact Jaccard join of word n-gram sets in their metric space."""

from __future__ import annotations

import functools
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.frames import Packed, lean, partitions, release, written

#: Words of a gram, and the least Jaccard similarity of a pair.
N, THRESHOLD = 3, 0.55
#: One document in so many becomes a pivot, from one level of the recursion to the next. At the last each one left is. As each
#: level has eight times the pivots of the one before, a cluster of any size is settled by few, and sent to few regions.
LEVELS = (512, 64, 8, 1)
#: Rows up to which a table of keys, and one of pivots' grams, is sent to every worker rather than shuffled: at most some 50 MB.
SENT, SENT_GRAMS = 500_000, 200_000
#: Levels of one pivot in so many documents or fewer are counted: each document's overlap with every pivot. Pivots' grams, about,
#: and hits, that a worker holds at once.
COUNTED, HELD, HITS = 64, 2_000_000, 4_000_000
#: Members of a class, about, that are spread over its pairs at once, and of a cell that are held at once.
BLOCK, CELL = 1000, 1500
#: Members of a cell from which a gram has a column of the matrix; such columns, and rows to join, that are multiplied at once.
COLUMN, COLUMNS, ROWS = 16, 2048, 1000
#: Bits of a signature, from which an upper bound of two documents' overlap follows.
SIGNATURE = 2048
#: Grams, about, and documents, at most, that are counted together before any is sent.
LOT, LOT_DOCS = 1_000_000, 30_000
#: What a row is in a block of a region: one of its members; one that members are joined with.
INSIDE, OUTSIDE = 0, 1


def gram_sets(texts: list[str], n: int) -> list:
    """Each text's distinct word n-grams as sorted 64-bit hashes.

    Words are runs of ASCII letters and digits and of any other characters beyond ASCII, in lower case. A text with fewer
    than n words has one gram, of all its words; one without words has none.
    """
    import numpy as np

    def mixed(x):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    coded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    edges = np.cumsum([0] + [len(c) + 1 for c in coded])
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    is_word = np.zeros(256, bool)
    is_word[128:] = is_word[48:58] = is_word[97:123] = True
    inside = np.concatenate(([False], is_word[data], [False])).astype(np.int8)
    turn = np.diff(inside)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    odd = 0x9E3779B97F4A7C15
    power = np.full(len(data) + 1, odd, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    back = np.full(len(data) + 1, pow(odd, -1, 1 << 64), np.uint64)
    back[0] = 1
    back = np.cumprod(back, dtype=np.uint64)
    summed = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)))
    words = mixed((summed[end] - summed[start]) * back[start])
    first = np.searchsorted(start, edges)
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        grams = mixed(grams * np.uint64(odd) + words[k : len(words) - n + 1 + k] + np.uint64(n)) if len(grams) else grams
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            g = np.zeros(1, np.uint64)
            for k in range(a, b):
                g = mixed(g * np.uint64(odd) + words[k : k + 1] + np.uint64(b - a))
            out.append(g)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def divided(part, parts: int, *columns):
    """The columns ordered by part, as lists, one for each part that has something; and these parts."""
    import numpy as np
    import pyarrow as pa

    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    there = np.flatnonzero(cut[1:] > cut[:-1])
    offsets = pa.array(np.append(cut[there], cut[-1]), pa.int32())
    return there, [pa.ListArray.from_arrays(offsets, pa.array(c[order])) for c in columns]


def number_of_lots():
    """Numbers for a task's lots, the same in any attempt at it."""
    import itertools

    from pyspark import TaskContext

    return itertools.count(TaskContext.get().partitionId() << 32)


@lean
def offered(batches: Iterator, n: int, parts: int) -> Iterator:
    """Halves of gram hashes, divided among ``parts``: for each lot of documents and part, what other lots may share.

    Grams of several documents of a lot are known to be shared; they are sent once, in ``common``, and counted in ``known``. So
    a gram of very many documents is sent as often as there are lots. Of other grams the document's number in the lot goes
    along, in ``docs``. A row of its own has the lot's ``keys``, their ``sizes`` and what is ``known``.
    """
    import numpy as np
    import pyarrow as pa

    from tessel.llm.tokens import lots

    kinds = {"part": pa.int32(), "lot": pa.int64(), "keys": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "known": pa.list_(pa.int32()), "docs": pa.list_(pa.int16()), "grams": pa.list_(pa.int32()), "common": pa.list_(pa.int32())}
    numbers = number_of_lots()

    def half(g):
        return (g >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def row(**columns):
        size = len(columns["part"])
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.array([[]] * size, k) for c, k in kinds.items()], names=list(kinds))

    def out(keys, sets):
        lot = next(numbers)
        sizes = np.array([len(s) for s in sets], np.int32)
        grams, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(grams, kind="stable")
        grams, doc = grams[order], doc[order]
        same = grams[1:] == grams[:-1]
        often = np.append(same, False) | np.append(False, same)
        known = np.bincount(doc[often], minlength=len(sets)).astype(np.int32)
        common = grams[often & ~np.append(False, same)]
        grams, doc = grams[~often], doc[~often].astype(np.int16)
        yield row(part=pa.array([lot % parts], pa.int32()), lot=pa.array([lot]), keys=pa.array([keys]), sizes=pa.array([sizes]), known=pa.array([known]))
        there, (docs, halves) = divided((grams % np.uint64(parts)).astype(np.int32), parts, doc, half(grams))
        yield row(part=pa.array(there, pa.int32()), lot=pa.array(np.full(len(there), lot)), docs=docs, grams=halves)
        there, (halves,) = divided((common % np.uint64(parts)).astype(np.int32), parts, half(common))
        yield row(part=pa.array(there, pa.int32()), lot=pa.array(np.full(len(there), lot)), common=halves)

    keys, sets, size = [], [], 0
    for b in batches:
        at, all_keys = 0, b.column("key").to_numpy()
        for lot in lots(b.column("text")):
            for k, s in zip(all_keys[at : at + len(lot)], gram_sets(lot, n), strict=True):
                if len(s):
                    keys.append(k)
                    sets.append(s)
                    size += len(s)
                if size > LOT or len(keys) == LOT_DOCS:
                    yield from out(np.array(keys), sets)
                    keys, sets, size = [], [], 0
                    pa.default_memory_pool().release_unused()
            at += len(lot)
    if size:
        yield from out(np.array(keys), sets)


def by_part(batches: Iterator, part: str, *columns: str):
    """The rows of each part, which come together: its number, and for each column the rows' lists."""
    import numpy as np

    held, now = None, None
    for b in batches:
        p, values = b.column(part).to_numpy(), [lists(b, c) if str(b.column(c).type).startswith("list") else b.column(c).to_numpy(zero_copy_only=False) for c in columns]
        cut = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1]))) if len(p) else []
        for a, z in zip(cut, np.append(cut[1:], len(p)), strict=True):
            if p[a] != now:
                if held:
                    yield now, held
                held, now = [[] for _ in columns], p[a]
            for h, v in zip(held, values, strict=True):
                h += [v[1][v[0][i] : v[0][i + 1]].copy() for i in range(a, z)] if isinstance(v, tuple) else v[a:z].tolist()
    if held:
        yield now, held


@lean
def met(batches: Iterator) -> Iterator:
    """For each part and lot, how many of its documents' grams in the part other lots have too; and the lots' own rows as they are."""
    import numpy as np
    import pyarrow as pa

    names = ["lot", "kind", "keys", "sizes", "known", "docs", "counts"]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 2, *[pa.list_(pa.int16())] * 2]
    for _, (lot, keys, sizes, known, docs, grams, common) in by_part(batches, "part", "lot", "keys", "sizes", "known", "docs", "grams", "common"):
        own = [i for i, k in enumerate(keys) if len(k)]
        if own:
            columns = [[lot[i] for i in own], [0] * len(own), *([c[i] for i in own] for c in (keys, sizes, known)), [[]] * len(own), [[]] * len(own)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        row = np.repeat(np.arange(len(lot)), [len(g) for g in grams])
        if not len(row):
            continue
        g, doc, common = np.concatenate(grams), np.concatenate(docs).astype(np.int64), np.unique(np.concatenate(common))
        order = np.argsort(g, kind="stable")
        g = g[order]
        same = g[1:] == g[:-1]
        there = np.append(same, False) | np.append(False, same)
        if len(common):
            at = np.searchsorted(common, g)
            at[at == len(common)] = 0
            there |= common[at] == g
        at = order[there]
        both, counts = np.unique(row[at] * (1 << 15) + doc[at], return_counts=True)
        there, (docs, counts) = divided(both >> 15, len(lot), (both & 0x7FFF).astype(np.int16), np.minimum(counts, 0x7FFF).astype(np.int16))
        empty = [pa.array([[]] * len(there), k) for k in kinds[2:5]]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(lot)[there], pa.int64()), pa.array(np.ones(len(there), np.int32)), *empty, docs, counts], names=names)


@lean
def hopeful(batches: Iterator, threshold: float) -> Iterator:
    """Keys of a lot's documents of which others share enough grams; rows come sorted by lot, its own row first."""
    import numpy as np
    import pyarrow as pa

    for _, (keys, sizes, known, docs, counts) in by_part(batches, "lot", "keys", "sizes", "known", "docs", "counts"):
        shared = known[0].astype(np.int64)
        for d, c in zip(docs[1:], counts[1:], strict=True):
            shared[d] += c  # of each document once
        yield pa.RecordBatch.from_arrays([pa.array(keys[0][shared >= threshold * sizes[0] - 1e-9])], names=["key"])


@lean
def bundled(batches: Iterator) -> Iterator:
    """Documents with their grams in lots, a row each."""
    import numpy as np
    import pyarrow as pa

    numbers = number_of_lots()
    for b in batches:
        offsets, flat = lists(b, "grams")
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + LOT // 2)))
            z = min(z, b.num_rows)
            columns = [b.column("key").to_numpy()[a:z], b.column("mult").to_numpy()[a:z], np.diff(offsets[a : z + 1]).astype(np.int32), flat[offsets[a] : offsets[z]]]
            yield pa.RecordBatch.from_arrays([pa.array([next(numbers)]), *(pa.array([c]) for c in columns)], names=["lot", "keys", "mults", "lens", "grams"])
            a = z


@lean
def offered_once(batches: Iterator, parts: int) -> Iterator:
    """Each lot's distinct grams and how many of its documents have them, divided among ``parts``."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        for lot, grams in zip(b.column("lot").to_pylist(), b.column("grams"), strict=True):
            g, counts = np.unique(grams.values.to_numpy().view(np.uint64), return_counts=True)
            there, columns = divided((g % np.uint64(parts)).astype(np.int32), parts, g.view(np.int64), counts.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(np.full(len(there), lot)), *columns], names=["part", "lot", "grams", "counts"])


@lean
def frequencies(batches: Iterator) -> Iterator:
    """For each part and lot, its grams that several documents have, and how many do."""
    import numpy as np
    import pyarrow as pa

    for _, (lot, grams, counts) in by_part(batches, "part", "lot", "grams", "counts"):
        row = np.repeat(np.arange(len(lot)), [len(g) for g in grams])
        g, counts = np.concatenate(grams), np.concatenate(counts).astype(np.int64)
        order = np.argsort(g, kind="stable")
        first = np.flatnonzero(np.append(True, g[order][1:] != g[order][:-1]))
        df = np.zeros(len(g), np.int64)
        df[order] = np.repeat(np.add.reduceat(counts[order], first), np.diff(np.append(first, len(g))))
        some = df > 1
        there, columns = divided(row[some], len(lot), g[some], np.minimum(df[some], 0x7FFFFFFF).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.array(lot)[there], pa.int64()), *columns], names=["lot", "grams", "df"])


@lean
def rarest_first(batches: Iterator, threshold: float) -> Iterator:
    """A lot's documents with their shared grams from the rarest on; rows come sorted by lot, its own row first."""
    import numpy as np
    import pyarrow as pa

    for _, (keys, mults, lens, grams, df) in by_part(batches, "lot", "keys", "mults", "lens", "grams", "df"):
        key, mult, size, own = keys[0], mults[0], lens[0], grams[0]
        known, often = np.concatenate(grams[1:] or [own[:0]]), np.concatenate(df[1:] or [np.zeros(0, np.int32)])
        order = np.argsort(known)
        known, often = known[order], often[order]
        if not len(known):
            continue
        at = np.searchsorted(known, own)
        at[at == len(known)] = 0
        there = known[at] == own
        doc = np.repeat(np.arange(len(key)), size)[there]
        own, often = own[there], often[at[there]]
        own = own[np.lexsort((own, often, doc))]
        offsets = np.searchsorted(doc, np.arange(len(key) + 1))
        n = np.diff(offsets)
        some = np.flatnonzero(n >= np.maximum(1, threshold * size - 1e-9))
        values = own[np.repeat(offsets[some] - (np.cumsum(n[some]) - n[some]), n[some]) + np.arange(n[some].sum())]
        columns = [pa.array(key[some]), pa.array(size[some]), pa.array(mult[some]), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n[some])), pa.int32()), pa.array(values))]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "size", "mult", "grams"])


@lean
def with_grams(batches: Iterator, n: int) -> Iterator:
    import hashlib

    import numpy as np
    import pyarrow as pa

    from tessel.llm.tokens import lots

    for b in batches:
        at = 0
        for lot in lots(b.column("text"), 1_000_000):
            sets = gram_sets(lot, n)
            offsets = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            values = np.concatenate(sets).view(np.int64)
            same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            own = b.slice(at, len(lot))
            at += len(lot)
            yield pa.RecordBatch.from_arrays([own.column("id"), own.column("key"), pa.array(same, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["id", "key", "same", "grams"])


def small(df: DataFrame, most: int = SENT) -> DataFrame:
    """``df``, sent to every worker if it has few enough rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def lists(b, name: str):
    import numpy as np

    column = b.column(name)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))), flat


def overlaps(grams, offsets, flat):
    """How many members of the sorted ``grams`` each list has."""
    import numpy as np

    if not len(flat):
        return np.zeros(len(offsets) - 1, np.int64)
    at = np.searchsorted(grams, flat)
    at[at == len(grams)] = 0
    there = np.concatenate(([0], np.cumsum(grams[at] == flat)))
    return there[offsets[1:]] - there[offsets[:-1]]


@lean
def signed(batches: Iterator) -> Iterator:
    """Documents with signatures: which of ``SIGNATURE`` classes of hashes their grams are in."""
    import numpy as np
    import pyarrow as pa

    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            b = whole.slice(at, 2000)
            offsets, flat = lists(b, "grams")
            bits = np.zeros((b.num_rows, SIGNATURE), bool)
            bits[np.repeat(np.arange(b.num_rows), np.diff(offsets)), (flat.view(np.uint64) % np.uint64(SIGNATURE)).astype(np.int64)] = True
            words = np.packbits(bits, axis=1).view(np.int64)
            packed = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * words.shape[1], pa.int32()), pa.array(words.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("size"), pa.array(np.diff(offsets), pa.int32()), packed], names=["key", "size", "n", "bits"])


def least_distance(near: DataFrame, signatures: DataFrame) -> DataFrame:
    """``near`` with ``least``, a lower bound of its pairs' distance.

    Each bit in which signatures differ is a gram that only one of both has, which bounds their overlap from above.
    """
    for side in ("key", "pivot"):
        own = signatures.select(F.col("key").alias(side), F.struct("size", "n", "bits").alias(f"{side}_s"))
        near = near.join(own, side)
    x, y = F.col("pivot_s"), F.col("key_s")
    apart = F.aggregate(F.zip_with(x["bits"], y["bits"], lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    both = F.least(x["n"], y["n"], (x["n"] + y["n"] - apart) / 2)
    return near.select("pivot", "key", (1 - both / (x["size"] + y["size"] - both)).alias("least"))


@lean
def distances(batches: Iterator) -> Iterator:
    """Distances of documents to the pivot of their region; rows come sorted by pivot, the pivot's own row first."""
    import numpy as np
    import pyarrow as pa

    pivot, own, size = None, None, 0
    for b in batches:
        p, key, sizes = (b.column(c).to_numpy() for c in ("pivot", "key", "size"))
        offsets, flat = lists(b, "grams")
        cut = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        d = np.zeros(len(p))
        for a, z in zip(cut, np.append(cut[1:], len(p)), strict=True):
            if p[a] != pivot:
                pivot, own, size = p[a], np.sort(flat[offsets[a] : offsets[a + 1]]), sizes[a]
            both = overlaps(own, offsets[a : z + 1] - offsets[a], flat[offsets[a] : offsets[z]])
            d[a:z] = 1 - both / (sizes[a:z] + size - both)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(key), pa.array(d)], names=["pivot", "key", "d"])


@lean
def counted(batches: Iterator, held, least: float) -> Iterator:
    """Pairs of a pivot and a document whose Jaccard similarity is ``least`` or more, with their distance.

    ``held`` has the pivots' keys and sizes, their distinct grams, and for each of these where its pivots begin in a list of them.
    """
    import numpy as np
    import pyarrow as pa

    pivots, pivot_sizes, known, begins, owners = held.value
    for b in batches:
        key, size = b.column("key").to_numpy(), b.column("size").to_numpy()
        offsets, flat = lists(b, "grams")
        at = np.searchsorted(known, flat)
        at[at == len(known)] = 0
        there = np.flatnonzero(known[at] == flat)
        at, doc = at[there], np.searchsorted(offsets, there, side="right") - 1
        hits = begins[at + 1] - begins[at]
        before = np.append(0, np.cumsum(hits))
        ends = np.searchsorted(doc, np.arange(len(key) + 1))  # of each document's grams among those found
        first = 0
        while first < len(key):
            last = int(np.searchsorted(before[ends], before[ends[first]] + HITS, side="right")) - 1
            last = min(max(last, first + 1), len(key))
            a, z = ends[first], ends[last]
            n = hits[a:z]
            pivot = owners[np.repeat(begins[at[a:z]] - (before[a:z] - before[a]), n) + np.arange(before[z] - before[a])]
            both, overlap = np.unique(np.repeat(doc[a:z], n) * len(pivots) + pivot, return_counts=True)
            d, p = both // len(pivots), both % len(pivots)
            j = overlap / (size[d] + pivot_sizes[p] - overlap)
            good = (j >= least - 1e-9) & (key[d] != pivots[p])
            yield pa.RecordBatch.from_arrays([pa.array(pivots[p[good]]), pa.array(key[d[good]]), pa.array(1 - j[good])], names=["pivot", "key", "least"])
            first = last


def near_pivots(core: DataFrame, is_pivot, least: float) -> list[DataFrame]:
    """Written pairs of pivots and other documents of at least that similarity, over 0: ``pivot``, ``key``, their distance ``least``.

    Pivots' grams go to the workers, in as many passes as their number asks for, so that nothing is shuffled and each overlap
    is counted in full.
    """
    import numpy as np

    pivots = written(core.where(is_pivot).select("key", "size", "grams"))
    passes = max(1, -(-(pivots.agg(F.sum(F.size("grams"))).first()[0] or 0) // HELD))
    out = []
    for number in range(passes):
        some = pivots.where(F.pmod(F.xxhash64("key", F.lit("pass")), F.lit(passes)) == number).toArrow().combine_chunks()
        for some in some.to_batches():  # one, or none
            offsets, flat = lists(some, "grams")
            order = np.argsort(flat, kind="stable")
            known, begins = np.unique(flat[order], return_index=True)
            owners = np.repeat(np.arange(some.num_rows), np.diff(offsets))[order]
            arrays = (some.column("key").to_numpy(), some.column("size").to_numpy().astype(np.int64), known, np.append(begins, len(flat)).astype(np.int32), owners.astype(np.int32))
            held = core.sparkSession.sparkContext.broadcast(arrays)
            found = core.select("key", "size", "grams").mapInArrow(lambda it, held=held: counted(it, held, least), "pivot long, key long, least double")
            out.append(written(found))
            held.destroy()
    release(pivots)
    return out or [written(core.select(F.col("key").alias("pivot"), "key", F.lit(0.0).alias("least")).where("false"))]


class Block:
    """Members of a block of a cell, and how many documents each is linked to."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.keys = None

    def add(self, *part) -> None:
        """Keys, sizes, multiplicities, lengths and grams of some members."""
        self.parts.append(part)

    def close(self) -> None:
        """Makes the matrix of members and grams: bits for grams of many members, lists of members for the others."""
        import numpy as np

        self.keys, self.sizes, self.mults, lens, flat = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts = []
        self.n = np.zeros(len(self.keys), np.int64)
        self.root = np.arange(len(self.keys))
        owner = np.repeat(np.arange(len(self.keys)), lens)
        order = np.argsort(flat, kind="stable")
        self.known, first, counts = np.unique(flat[order], return_index=True, return_counts=True)
        self.owners, self.first = owner[order], np.append(first, len(flat))
        self.column = np.where(counts >= COLUMN, np.cumsum(counts >= COLUMN) - 1, -1)
        self.bits = np.zeros((len(self.keys), int((counts >= COLUMN).sum())), bool)
        column = np.repeat(self.column, counts)
        self.bits[self.owners[column >= 0], column[column >= 0]] = True

    def overlaps(self, lens, flat):
        """How many grams each member has in common with each of these documents."""
        import numpy as np

        both = np.zeros((len(self.keys), len(lens)), np.float32)  # exact up to 16 million
        if not len(flat):
            return both
        at = np.searchsorted(self.known, flat)
        at[at == len(self.known)] = 0
        there = self.known[at] == flat
        at, doc = at[there], np.repeat(np.arange(len(lens)), lens)[there]
        column = self.column[at]
        often = column >= 0
        for c in range(0, self.bits.shape[1], COLUMNS):
            mine = self.bits[:, c : c + COLUMNS]
            here = often & (column >= c) & (column < c + COLUMNS)
            if here.any():
                theirs = np.zeros((mine.shape[1], len(lens)), np.float32)
                theirs[column[here] - c, doc[here]] = 1
                both += mine.astype(np.float32) @ theirs
        at, doc = at[~often], doc[~often]
        n = self.first[at + 1] - self.first[at]
        member = self.owners[np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        both += np.bincount(member * len(lens) + np.repeat(doc, n), minlength=both.size).reshape(both.shape)
        return both

    def similar(self, sizes, lens, flat):
        import numpy as np

        both = self.overlaps(lens, flat).astype(np.float64)
        return both / np.maximum(1, self.sizes[:, None] + sizes[None, :] - both)

    def union(self, good) -> None:
        """Joins the members that are linked to one document."""
        import numpy as np

        low = np.where(good, self.root[:, None], len(self.root)).min(axis=0)
        high = np.where(good, self.root[:, None], -1).max(axis=0)
        for i in np.flatnonzero(low < high):
            roots = np.unique(self.root[good[:, i]])
            if len(roots) > 1:
                self.root[np.isin(self.root, roots)] = roots[0]


@lean
def joined(batches: Iterator, r: float, links: bool) -> Iterator:
    """The join of regions: members of a block of the cell, which come first, against each other, other blocks and window.

    Pairs (x, y, jaccard), or, with ``links``, rows (x, y, n): x has n more links, and is in one group with y. Overlaps of many
    documents with many members are products of matrices, so that a pair costs no pass over its grams.
    """
    import numpy as np
    import pyarrow as pa

    kinds = (pa.int64(), pa.int64(), pa.int64() if links else pa.float64())

    def batch(x, y, v):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((x, y, v), kinds, strict=True)], names=["x", "y", "v"])

    def pairs(j, good, cell, key):
        x, y = np.nonzero(good)
        return batch(cell.keys[x], key[y], j[x, y])

    def closed(cell: Block):
        """The block with its members' pairs among themselves, and these."""
        lens, flat = np.concatenate([p[3] for p in cell.parts]), np.concatenate([p[4] for p in cell.parts])
        cell.close()
        ends = np.append(0, np.cumsum(lens))
        for a in range(0, len(lens), ROWS):
            z = min(a + ROWS, len(lens))
            j = cell.similar(cell.sizes[a:z], lens[a:z], flat[ends[a] : ends[z]])
            good = 1 - j <= r + 1e-9
            good[np.arange(a, z), np.arange(z - a)] = False
            if not links:
                good &= np.arange(len(lens))[:, None] < np.arange(a, z)[None, :]
                yield pairs(j, good, cell, cell.keys[a:z])
                continue
            cell.n += (good @ cell.mults[a:z].astype(np.float64)).astype(np.int64)
            good[np.arange(a, z), np.arange(z - a)] = True
            cell.union(good)

    def rest(cell: Block):
        return batch(cell.keys, cell.keys[cell.root], cell.n)

    here, cell = None, None
    for b in batches:
        p, part, key, sizes, mults, role = (b.column(c).to_numpy() for c in ("pivot", "block", "key", "size", "mult", "role"))
        offsets, flat = lists(b, "grams")
        cut = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (part[1:] != part[:-1]) | (role[1:] != role[:-1])))) if len(p) else []
        for a, z in zip(cut, np.append(cut[1:], len(p)), strict=True):
            if (p[a], part[a]) != here:
                if cell and cell.parts:
                    yield from closed(cell)
                if links and cell and cell.keys is not None:
                    yield rest(cell)
                here, cell = (p[a], part[a]), Block()
            if role[a] == INSIDE:
                cell.add(key[a:z], sizes[a:z].astype(np.int64), mults[a:z], np.diff(offsets[a : z + 1]), flat[offsets[a] : offsets[z]])
                continue
            if cell.parts:
                yield from closed(cell)
            if cell.keys is None:
                continue
            for i in range(a, z, ROWS):
                e = min(i + ROWS, z)
                j = cell.similar(sizes[i:e].astype(np.int64), np.diff(offsets[i : e + 1]), flat[offsets[i] : offsets[e]])
                good = 1 - j <= r + 1e-9
                if not links:
                    yield pairs(j, good, cell, key[i:e])
                    continue
                cell.n += (good @ mults[i:e].astype(np.float64)).astype(np.int64)
                n = (cell.mults.astype(np.float64) @ good).astype(np.int64)
                cell.union(good)
                there = np.flatnonzero(n)
                yield batch(key[i:e][there], cell.keys[good[:, there].argmax(axis=0)], n[there])
    if cell and cell.parts:
        yield from closed(cell)
    if links and cell and cell.keys is not None:
        yield rest(cell)


def sharing_rarest(core: DataFrame, is_pivot, least: float, all_: bool, signatures: DataFrame) -> DataFrame:
    """Pairs of a pivot and another document that share as many of their rarest grams as a similarity of ``least`` asks for, with a
    lower bound of their distance; with ``all_``, where all are pivots, each pair once.

    Of the two documents' prefixes, let x's end at the rarer gram. What both share up to there is in both prefixes and counted;
    what they share beyond is among x's other grams. So their overlap is at most that count and the longer rest. Signatures
    alone don't part long documents, which have grams in nearly all classes of hashes: any two would pass for one shared gram.
    """

    def rest(size):
        return F.ceil(F.lit(least) * size - 1e-9) - 1

    # Grams that are in no other document come before those of the array, and take their places in the prefix.
    length = F.size("grams") - rest(F.col("size"))
    prefix = core.withColumn("n", length.cast("int")).where("n > 0").select("key", "size", F.explode(F.slice("grams", 1, F.col("n"))).alias("gram"))
    pivots = prefix.where(is_pivot).select(F.col("key").alias("pivot"), F.col("size").alias("pivot_size"), "gram")
    close = (F.col("size") >= F.col("pivot_size") * least - 1e-9) & (F.col("pivot_size") >= F.col("size") * least - 1e-9)
    close = close & (F.col("key") != F.col("pivot"))
    if all_:
        close = close & (F.col("key") > F.col("pivot"))  # either is the other's pivot
    shared = prefix.join(small(pivots, SENT_GRAMS), "gram").where(close).groupBy("pivot", "key", "size", "pivot_size").agg(F.count("*").alias("shared"))
    most = F.col("shared") + rest(F.greatest("size", "pivot_size"))
    near = shared.where(most >= least / (1 + least) * (F.col("size") + F.col("pivot_size")) - 1e-6).select("pivot", "key")
    return least_distance(near, signatures)


def region_join(core: DataFrame, r: float, levels: tuple[int, ...], links: bool = False) -> DataFrame:
    """Pairs (x, y, v) within distance ``r``, of documents with ``key``, ``size``, ``mult`` and ``grams`` from the rarest on.

    ``v`` is the similarity. With ``links`` it is a part of x's number of links instead, and the rows' pairs are only so many
    that they connect the same documents: the result grows with the regions, not with the pairs.

    At each level some documents are pivots. A document within ``radius`` of a pivot belongs to the cell of its nearest one
    and is settled. By the triangle inequality its partners lie within the cell's radius and ``r`` of that pivot: this
    window is replicated to the cell's region, and the region joined, a block of the cell's members at a time. What isn't
    settled goes on to the next level; at the last every document is the pivot of a cell of its own.

    The first levels, with few pivots, count every document's overlap with each of them (``near_pivots``), so that cells can be
    wide: as wide as ``r`` where that leaves the window some similarity. Near copies of one text may differ by more than half of
    ``r``; if they stayed on to levels of many pivots, each would be sent to the regions of a share of its whole group.

    At the others a document close enough to a pivot to matter shares one of both's rarest grams (the prefix bound), for which the radius
    has to leave some similarity; and their signatures don't differ in too many bits. Grams are sent only for such pairs.
    """
    if not levels or levels[-1] != 1:
        raise ValueError("at the last level every document must be a pivot: levels end with 1")
    parts = partitions(core.sparkSession)
    signatures = written(core.select("key", "size", "grams").mapInArrow(signed, "key long, size int, n int, bits array<long>"))
    out = None

    def sent(rows: DataFrame, order) -> DataFrame:
        """Rows with their grams, in order in their regions."""
        full = core.select("key", "size", "mult", "grams").join(small(rows), "key")
        keys = [c for c in ("pivot", "block") if c in rows.columns]
        return full.repartition(parts, *keys).sortWithinPartitions(*keys, order)

    for number, every in enumerate(levels):
        is_pivot = F.pmod(F.xxhash64("key", F.lit(number)), F.lit(every)) == 0
        if every >= COUNTED:
            radius = min(r, 0.9 * (1 - r))
            done = near_pivots(core, is_pivot, 1 - radius - r)
            near = functools.reduce(DataFrame.unionByName, done)
        else:
            radius = 0.0 if every == 1 else min(r, 1 - r) / 2
            near = written(sharing_rarest(core, is_pivot, 1 - radius - r, every == 1, signatures).where(F.col("least") <= radius + r + 1e-9))
            done = [near]
        selves = near.select("pivot").distinct().select("pivot", F.col("pivot").alias("key"))
        if every == 1:
            region = near.select("pivot", "key").unionByName(selves)
            region = region.select("pivot", F.lit(0).alias("block"), "key", F.when(F.col("key") == F.col("pivot"), INSIDE).otherwise(OUTSIDE).alias("role"))
        else:
            d = near.where(F.col("least") <= radius + 1e-9).select("pivot", "key", F.col("least").alias("d"))
            if every < COUNTED:
                d = sent(d.select("pivot", "key").unionByName(d.select("pivot").distinct().select("pivot", F.col("pivot").alias("key"))), F.col("key") != F.col("pivot"))
                d = d.select("pivot", "key", "size", "grams").mapInArrow(distances, "pivot long, key long, d double").where(F.col("d") <= radius + 1e-9)
            d = d.unionByName(selves.select("pivot", "key", F.lit(0.0).alias("d")))
            homes = d.groupBy("key").agg(F.min(F.struct("d", "pivot")).alias("m")).select("key", F.col("m.pivot").alias("home"), F.col("m.d").alias("home_d"))
            homes = written(homes)
            cells = homes.groupBy(F.col("home").alias("pivot")).agg((F.max("home_d") + r).alias("reach"), F.ceil(F.count("*") / CELL).cast("int").alias("blocks"))
            region = near.unionByName(selves.select("pivot", "key", F.lit(0.0).alias("least")))
            region = region.join(cells, "pivot").where(F.col("least") <= F.col("reach") + 1e-9).join(homes.select("key", "home"), "key", "left")
            own = F.coalesce(F.col("home") == F.col("pivot"), F.lit(False))
            # A pair of two cells is given by that of the smaller pivot, one of two blocks by the smaller block.
            region = region.where(F.col("home").isNull() | (F.col("home") >= F.col("pivot")))
            mine = F.when(own, F.pmod(F.xxhash64("key", F.lit("block")), F.col("blocks")).cast("int"))
            region = region.select("pivot", "key", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
            region = region.where(F.col("mine").isNull() | (F.col("block") <= F.col("mine")))
            role = F.when(F.col("mine") == F.col("block"), INSIDE).otherwise(OUTSIDE)
            region = written(region.select("pivot", "block", "key", role.alias("role")))
            done += [homes, region]
        rows = sent(region, F.col("role")).select("pivot", "block", "key", "size", "mult", "role", "grams")
        pairs = written(rows.mapInArrow(lambda it: joined(it, r, links), f"x long, y long, v {'long' if links else 'double'}"))
        if every != 1:
            left = written(core.join(homes.select("key"), "key", "left_anti"))
        release(*done, core)
        if every != 1:
            core = left
        out = pairs if out is None else out.unionByName(pairs)
    release(signatures)
    return out


def class_join(docs: DataFrame, n: int, threshold: float, levels: tuple[int, ...], text: str, id_: str, links: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Identifiers, members (class, id) of the classes of documents with equal gram sets, and the classes' pairs (``region_join``).

    Before the join, grams are counted over all documents: only grams of two documents or more can meet, and a document
    with fewer of them than ``threshold`` of its grams has no partner. The others are joined in regions around pivots
    (``region_join``), one document for each class. Every step is exact for 64-bit gram hashes.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    r, parts = 1 - threshold, partitions(docs.sparkSession)
    ids = Packed(docs, text, id_).frame.select(F.col(id_).alias("id"), F.col(text).alias("text"), F.xxhash64(id_, text).alias("key")).where("id IS NOT NULL")
    rows = ids.where("text IS NOT NULL")
    own, short = "keys array<long>, sizes array<int>, known array<int>", "docs array<short>"
    offers = rows.select("key", "text").mapInArrow(lambda it: offered(it, n, parts), f"part int, lot long, {own}, {short}, grams array<int>, common array<int>")
    replies = offers.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(met, f"lot long, kind int, {own}, {short}, counts array<short>")
    hopes = replies.repartition(parts, "lot").sortWithinPartitions("lot", "kind").mapInArrow(lambda it: hopeful(it, threshold), "key long")
    maybe = written(hopes)
    id_type = dict(rows.dtypes)["id"]
    found = rows.join(small(maybe), "key", "left_semi").select("id", "key", "text")
    found = written(found.mapInArrow(lambda it: with_grams(it, n), f"id {id_type}, key long, same binary, grams array<long>"))
    owners = written(found.groupBy("same", "id").agg(F.min("key").alias("key")))
    classes = owners.groupBy("same").agg(F.min(F.struct("id", "key")).alias("m"), F.count("*").alias("mult"))
    classes = written(classes.select("same", F.col("m.key").alias("class"), "mult"))
    members = written(owners.join(classes, "same").select("class", "id"))
    one = found.join(small(classes.select(F.col("class").alias("key"), "mult")), "key").select("key", "mult", "grams").dropDuplicates(["key"])
    bundles = "keys array<long>, mults array<long>, lens array<int>, grams array<long>"
    one = written(one.mapInArrow(bundled, f"lot long, {bundles}"))
    release(maybe, found, owners, classes)
    offers = one.select("lot", "grams").mapInArrow(lambda it: offered_once(it, parts), "part int, lot long, grams array<long>, counts array<int>")
    df = offers.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(frequencies, "lot long, grams array<long>, df array<int>")
    df = df.select("lot", F.lit(1).alias("kind"), *[F.array().cast(f"array<{t}>").alias(c) for c, t in (("keys", "long"), ("mults", "long"), ("lens", "int"))], "grams", "df")
    both = one.select("lot", F.lit(0).alias("kind"), "keys", "mults", "lens", "grams", F.array().cast("array<int>").alias("df")).unionByName(df)
    core = both.repartition(parts, "lot").sortWithinPartitions("lot", "kind").mapInArrow(lambda it: rarest_first(it, threshold), "key long, size int, mult long, grams array<long>")
    core = written(core)
    release(one)
    return ids.select("id"), members, region_join(core, r, levels, links)


def near_groups(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, levels: tuple[int, ...] = LEVELS, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """The join as one row per document: ``id_``, ``class_id``, the smallest identifier of its group, and ``n_links``.

    Groups are the connected components of all pairs with at least ``threshold`` Jaccard similarity of their sets of word
    n-grams, and ``n_links`` is the number of a document's pairs, with its copies and all others: every pair is found and
    counted, though none is listed (``all_pairs`` lists them). A document without a partner is its own class, with 0 links.

    Null identifiers are in no row. Null texts and texts without words have no partner. Rows that share an identifier are one
    document: its links are those of all its texts, a partner counting once for each pair of differing texts. An empty table
    gives an empty table. Other columns are ignored.
    """
    ids, members, found = class_join(docs, n, threshold, levels, text, id_, links=True)
    firsts = written(members.groupBy("class").agg(F.min("id").alias("first"), F.count("*").alias("mult")))
    copies = members.join(firsts, "class").select("class", F.col("first").alias("a"), F.col("id").alias("b"), (F.col("mult") - 1).alias("copies"))
    ties = found.where("x <> y").join(firsts.select(F.col("class").alias("x"), F.col("first").alias("a")), "x").join(firsts.select(F.col("class").alias("y"), F.col("first").alias("b")), "y")
    groups = components(copies.select("a", "b").unionByName(ties.select("a", "b")))
    counts = found.groupBy(F.col("x").alias("class")).agg(F.sum("v").alias("n"))
    n_links = copies.join(counts, "class", "left").groupBy(F.col("b").alias("id")).agg(F.sum(F.col("copies") + F.coalesce("n", F.lit(0))).alias("n_links"))
    known = n_links.join(groups.select(F.col("node").alias("id"), "root"), "id", "left")
    out = ids.distinct().join(known, "id", "left")
    return out.select(F.col("id").alias(id_), F.coalesce("root", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def all_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, levels: tuple[int, ...] = LEVELS, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """Every pair of documents whose sets of word n-grams have at least ``threshold`` Jaccard similarity: ``doc_a`` < ``doc_b``, ``jaccard``.

    Jaccard distance is a metric. Documents at distance 0 form classes, of which one document each is joined
    (``class_join``); pairs of classes, and each class with itself, are then spread to all members. Members are held in
    blocks, and pairs of blocks shuffled, so that neither a large class nor its pairs meet in one task.

    Null identifiers or texts, and texts without words, are in no pair. Rows that share an identifier are one document: they
    aren't paired with each other, and a pair's similarity is the highest of its rows. An empty table gives an empty
    table. Other columns are ignored.
    """
    _, members, pairs = class_join(docs, n, threshold, levels, text, id_)
    pairs = pairs.withColumnRenamed("v", "jaccard")
    # Only documents of several classes, whose rows differ, can be in a pair twice.
    member = members.groupBy("id").agg(F.collect_list("class").alias("c")).select("id", (F.size("c") > 1).alias("many"), F.explode("c").alias("class"))
    sizes = members.groupBy("class").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    block = F.pmod(F.xxhash64("id"), F.col("parts")).alias("block")
    blocks = written(member.join(sizes, "class").groupBy("class", block).agg(F.collect_list(F.struct("id", "many")).alias("m")))
    x, y = (blocks.select(F.col("class").alias(c), F.col("block").alias(f"{c}_block"), F.col("m").alias(f"{c}_m")) for c in "xy")
    other = pairs.join(x, "x").join(y, "y").select("x_m", "y_m", "jaccard", F.lit(False).alias("own"))
    same = x.join(y, (F.col("x") == F.col("y")) & (F.col("x_block") <= F.col("y_block")))
    same = same.select("x_m", "y_m", F.lit(1.0).alias("jaccard"), (F.col("x_block") == F.col("y_block")).alias("own"))
    spread = other.unionByName(same).repartition(partitions(docs.sparkSession))
    spread = spread.select(F.explode("x_m").alias("a"), "y_m", "jaccard", "own").select("a", F.explode("y_m").alias("b"), "jaccard", "own")
    spread = spread.where((F.col("a.id") < F.col("b.id")) | (~F.col("own") & (F.col("a.id") > F.col("b.id"))))
    spread = spread.select(F.least("a.id", "b.id").alias("doc_a"), F.greatest("a.id", "b.id").alias("doc_b"), "jaccard", (F.col("a.many") | F.col("b.many")).alias("many"))
    if not blocks.where(F.exists("m", lambda m: m["many"])).limit(1).count():
        return spread.drop("many")
    twice = spread.where("many").groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))
    return spread.where("NOT many").drop("many").unionByName(twice)


def components(pairs: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of the pairs (``a``, ``b``).

    Large and small stars take turns until nothing changes; rounds grow with the logarithm of the largest component.
    """
    edges = written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        # Large star: each node's larger neighbours go to the smallest node it knows.
        ways = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: each node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u")
        after = written(down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        release(edges)
        edges = after
        now =edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint"))).first()
        if now == before:
            break
        before = now
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(roots)


def dedup_near(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, levels: tuple[int, ...] = LEVELS, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without those of documents that aren't the smallest identifier of their group.

    Groups are those of ``near_groups``. Rows without an identifier stay, and so do all rows of a document that stays.
    """
    groups = near_groups(docs, n, threshold, levels, text, id_)
    gone = written(groups.where(F.col(id_) != F.col("class_id")).select(F.col(id_).alias("gone")))
    p = Packed(docs, id_)
    return p.unpack(p.frame.join(small(gone), F.col(id_) == F.col("gone"), "left_anti"))
