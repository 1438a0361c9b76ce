"""Benchmark decontamination by q-gram lemma filtering and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.frames import Packed, lean
from tessel.llm.tokens import lots

Q = 10  # characters of a gram
SEGMENT, STRIDE = 80, 5  # characters of a benchmark segment, and from one to the next: at most the edits allowed
EDITS = 0.07  # edits allowed, as a share of a segment's characters
BAND = 16  # diagonals from one band to the next; each reaches over into the next by the edits allowed
PART = SEGMENT - STRIDE  # a verbatim part of an item is found from so many characters on, wherever it begins
#: Characters of benchmark that workers hold at once, in some 22 bytes each; a larger benchmark takes several passes over the documents.
HELD = 2_000_000
BITS = 22
ONCE = 2_000_000  # hits in segments that are counted at once


@dataclass
class Index:
    """The segments of a benchmark: their characters and grams."""

    items: list
    of: object  # a segment's item
    chars: object  # the items' folded characters, one after another
    start: object  # where a segment begins in them, in order
    size: object  # a segment's characters
    edits: object
    need: object  # grams that a region must share with the segment
    grams: object  # distinct gram hashes, sorted
    first: object  # where a gram's places begin in the next
    place: object  # where a gram stands in the items' characters
    seen: object  # bitmap over the hashes' top bits


def folding():
    """Lower case, and every white space a space, one character for one."""
    import numpy as np

    table = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x10000):
        c = chr(i)
        low = c.lower()
        table[i] = 32 if c.isspace() else ord(low) if len(low) == 1 else i
    return table


def folded(text: str, table):
    import numpy as np

    return table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def gram_hashes(chars):
    """A 64-bit hash of the Q = 10 characters from each place on."""
    import numpy as np

    b = 0x9E3779B97F4A7C15
    powers = [np.uint64(pow(b, 1 << k, 1 << 64)) for k in range(4)]  # b, b^2, b^4, b^8
    if len(chars) < Q:
        return np.zeros(0, np.uint64)
    c = chars.astype(np.uint64)
    with np.errstate(over="ignore"):
        two = c[:-1] * powers[0] + c[1:]
        four = two[:-2] * powers[1] + two[2:]
        eight = four[:-4] * powers[2] + four[4:]
        ten = eight[:-2] * powers[1] + two[8:]
        ten ^= ten >> np.uint64(29)
        return ten * np.uint64(0xBF58476D1CE4E5B9)


def index_of(items: list[tuple], table) -> Index:
    import numpy as np

    kept, of, chars, start, size, edits, need, hashes, place, total = [], [], [], [], [], [], [], [], [], 0
    for item, text in items:
        c = folded(text or "", table)
        if len(c) < Q:
            continue
        starts = list(range(0, max(1, len(c) - SEGMENT + 1), STRIDE))
        if len(c) > SEGMENT and starts[-1] != len(c) - SEGMENT:
            starts.append(len(c) - SEGMENT)
        n = min(SEGMENT, len(c))
        e = int(EDITS * n)
        while n + 1 - Q * (e + 1) < 1:  # fewer edits where the lemma would ask for nothing
            e -= 1
        for s in starts:
            of.append(len(kept))
            start.append(total + s)
            size.append(n)
            edits.append(e)
            need.append(n + 1 - Q * (e + 1))
        kept.append(item)
        chars.append(c)
        h = gram_hashes(c)
        hashes.append(h)
        place.append(total + np.arange(len(h)))
        total += len(c)
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    h = cat(hashes, np.uint64)
    order = np.argsort(h, kind="stable")
    grams, first = np.unique(h[order], return_index=True)
    seen = np.zeros(1 << BITS, bool)
    seen[(grams >> np.uint64(64 - BITS)).astype(np.int64)] = True
    whole = lambda x, kind=np.int32: np.array(x, kind)
    return Index(kept, whole(of), cat(chars, np.uint32), whole(start), whole(size, np.int16), whole(edits, np.int8), whole(need, np.int16), grams, whole(np.append(first, len(h))), cat(place, np.int64)[order].astype(np.int32), seen)


def regions(index: Index, chars):
    """Candidates (segment, place of its diagonal's band, document) that share enough grams in a band of diagonals.

    ``chars`` holds several documents one after another, with more characters of no item between them than any edit budget.
    """
    import numpy as np

    none = (np.zeros(0, np.int64),) * 2
    h = gram_hashes(chars)
    if not len(h) or not len(index.grams):
        return none
    at = np.flatnonzero(index.seen[(h >> np.uint64(64 - BITS)).astype(np.int64)])
    g = np.searchsorted(index.grams, h[at])
    g[g == len(index.grams)] = 0
    true = index.grams[g] == h[at]
    at, g = at[true], g[true]
    # A region has at least the least number of hits, within a segment and its edits.
    least, span = int(index.need.min()), SEGMENT + BAND + 2 * int(index.edits.max())
    if len(at) < least:
        return none
    dense = np.zeros(len(at) + 1, np.int64)
    near = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] <= span)
    np.add.at(dense, near, 1)
    np.add.at(dense, near + least, -1)
    use = np.cumsum(dense[:-1]) > 0
    at, g = at[use], g[use]
    if not len(at):
        return none
    n = (index.first[g + 1] - index.first[g]).astype(np.int64)
    place = index.place[np.repeat(index.first[g] - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(np.int64)
    at = np.repeat(at, n)
    # The segments that hold a gram are neighbours: from the first that ends after it to the last that begins before it.
    low = np.searchsorted(index.start + index.size, place + Q)
    n = np.searchsorted(index.start, place, side="right") - low
    order = np.argsort(low, kind="stable")
    at, place, low, n = at[order], place[order], low[order], n[order]
    # Counted in lots of whole items.
    item = index.of[low]
    cut = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
    lot = np.add.reduceat(n, cut).cumsum() // ONCE
    cut = np.append(cut[np.concatenate(([True], lot[1:] != lot[:-1]))], len(at))
    width, found = len(chars) // BAND + len(index.chars) // BAND + SEGMENT, []
    for a, z in zip(cut[:-1], cut[1:], strict=True):
        m = n[a:z]
        seg = np.repeat(low[a:z] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        diagonal = np.repeat(at[a:z] - place[a:z], m) + index.start[seg] + SEGMENT  # not negative
        band, over = np.divmod(diagonal, BAND)
        also = over < index.edits[seg]
        keys, counts = np.unique(np.concatenate((seg * width + band, (seg * width + band - 1)[also])), return_counts=True)
        seg, band = np.divmod(keys, width)
        enough = counts >= index.need[seg]
        found.append((seg[enough], band[enough] * BAND - SEGMENT))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def aligned(index: Index, chars, seg, start):
    """Least edits of each candidate's segment against the text on its band of diagonals, and where that begins and ends.

    Costs carry the diagonal on which their path began, so that of equal ones the earliest counts.
    """
    import numpy as np

    best, begin, end = (np.zeros(len(seg), np.int64) for _ in range(3))
    lens = index.size.astype(np.int64)
    one = 1 << 20  # an edit, beside which diagonals don't count
    for n in np.unique(lens[seg]):
        mine = np.flatnonzero(lens[seg] == n)
        for lot in np.array_split(mine, -(-len(mine) // 4096)):
            e = int(index.edits[seg[lot]].max())
            width = BAND + 3 * e + 1
            base = start[lot] - e
            pattern = index.chars[index.start[seg[lot]][:, None] + np.arange(n)]
            place = base[:, None] + np.arange(n + width)
            text = np.where((place >= 0) & (place < len(chars)), chars[np.clip(place, 0, len(chars) - 1)], np.uint32(0x110000))
            slope = np.arange(width) * one
            cost = np.tile(np.arange(width), (len(lot), 1))  # free to begin on any diagonal of the band
            for i in range(n):
                step = cost + (text[:, i : i + width] != pattern[:, i : i + 1]) * one
                step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + one)
                cost = np.minimum.accumulate(step - slope, axis=1) + slope
            d = cost.argmin(1)
            edits, first = np.divmod(cost[np.arange(len(lot)), d], one)
            best[lot], begin[lot], end[lot] = edits, base + first, base + d + n
    return best, begin, end


@lean
def matches(batches: Iterator, shared, at: int) -> Iterator:
    """Every row with the items found in its text, field number ``at``: item number, start, end, edits and segments."""
    import numpy as np
    import pyarrow as pa

    index, table = shared.value, folding()
    gap = "\x00" * (int(index.edits.max(initial=0)) + 1)
    kind = pa.list_(pa.struct([("item", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32()), ("segments", pa.int32())]))
    for b in batches:
        out = []
        for lot in lots(b.column("row").field(at).fill_null("")):
            chars = folded("".join(t + gap for t in lot), table)
            sizes = np.fromiter(map(len, lot), np.int64, len(lot))
            ends = np.cumsum(sizes + len(gap))
            found: list[dict] = [{} for _ in lot]
            seg, start = regions(index, chars)
            if len(seg):
                edits, begin, end = aligned(index, chars, seg, start)
                good = np.flatnonzero(edits <= index.edits[seg])
                # Edits at either end may reach into the gap between texts.
                docs = np.minimum(np.searchsorted(ends, (begin[good] + end[good]) // 2, side="right"), len(lot) - 1)
                for k, doc in zip(good.tolist(), docs.tolist(), strict=True):
                    size = int(sizes[doc])
                    first = int(ends[doc]) - size - len(gap)
                    a, z = min(max(0, int(begin[k]) - first), size), min(max(0, int(end[k]) - first), size)
                    item, e = int(index.of[seg[k]]), int(edits[k])
                    was = found[doc].setdefault(item, {"item": item, "start": a, "end": z, "edits": e, "segments": set()})
                    was["start"], was["end"], was["edits"] = min(was["start"], a), max(was["end"], z), min(was["edits"], e)
                    was["segments"].add(int(seg[k]))
            out += [[x | {"segments": len(x["segments"])} for _, x in sorted(f.items())] for f in found]
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, kind)], names=["row", "found"])


def passes(benchmark: DataFrame, text: str, item: str):
    """Indexes of the benchmark, each small enough to be held by every worker."""
    rows = Packed(benchmark, text, item).frame.select(F.col(item).alias("item"), F.col(text).alias("text"))
    rows = rows.where(F.length("text") >= Q)
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // HELD))
    table = folding()
    for k in range(parts):
        some = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k).orderBy("item", "text").collect()
        yield index_of([(r["item"], r["text"]) for r in some], table)


SCHEMA = "array<struct<item:int,start:int,end:int,edits:int,segments:int>>"


def searched(rows: DataFrame, index: Index, at: int) -> DataFrame:
    from pyspark.sql.types import StructField, StructType

    shared = rows.sparkSession.sparkContext.broadcast(index)
    found = rows.sparkSession.createDataFrame([], f"found {SCHEMA}").schema["found"].dataType
    return rows.select("row").mapInArrow(lambda it: matches(it, shared, at), StructType([rows.schema["row"], StructField("found", found)]))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_: str = "doc_id", item: str = "item_id") -> DataFrame:
    """The benchmark items found in documents: ``id_``, ``item``, ``start``, ``end``, ``edits`` and ``segments``.

    Items are cut into overlapping segments, which begin so densely that every verbatim part of ``PART`` = 75 characters or more
    is found, wherever it begins. Shared grams are counted in overlapping bands of diagonals over whole texts; a
    band is retained if it has as many as the q-gram lemma asks of a match within the segment's edit budget, and the segment
    is then aligned within the band. [start, end) spans the item's aligned segments, in characters of the text, each from where its
    alignment begins to where it ends; ``edits`` is the least over its segments and ``segments`` how many of them were found. Letter case and the kind of white
    space don't matter.

    Null and empty texts match nothing, nor do items that are null or shorter than a gram, ``Q`` = 10 characters, which have no
    gram to be found by. Items that are repeated are found once for each time. Identifiers may be null or repeated: each row is searched by itself. Empty tables give an
    empty table; other columns are ignored.
    """
    rows = Packed(docs, text, id_).frame.select(F.struct(F.col(id_).alias("id"), F.col(text).alias("text")).alias("row"))
    out = None
    for index in passes(benchmark, text, item):
        names = docs.sparkSession.createDataFrame([(k, v) for k, v in enumerate(index.items)], f"item int, name {dict(Packed(benchmark, item).frame.dtypes)[item]}")
        hits = searched(rows, index, 1).select("row.id", F.explode("found").alias("f")).select("id", "f.*")
        part = hits.join(F.broadcast(names), "item").select(F.col("id").alias(id_), F.col("name").alias(item), "start", "end", "edits", "segments")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """The rows of ``docs`` in which ``contaminated`` finds nothing, with all their columns; nothing is shuffled."""
    p = Packed(docs, text)
    rows = p.frame.select("row")
    for index in passes(benchmark, text, item):
        rows = searched(rows, index, p.at[text]).where(F.size("found") == 0).select("row")
    return p.unpack(rows)
