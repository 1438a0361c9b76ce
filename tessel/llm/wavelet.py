"""Token ids in wavelet matrices, one compressed file per shard."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.frames import Packed, trimmed
from tessel.llm.tokens import VOCABULARY, Coder, lots

MAGIC = b"WVMX0001"
BLOCK = 1 << 16  # bytes of a plane that are compressed together
SHARD = 1 << 22  # tokens after which a shard closes
BITS, END = 16, 50256


def build(ids, bits: int = BITS) -> bytes:
    """A wavelet matrix of the ids: bit planes from the highest bit down, each in blocks compressed on their own.

    Layout: magic, lengths and flags, then for each plane its number of zeros, each block's count of ones before it and
    place in the file, and the blocks.
    """
    import numpy as np
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    x = np.ascontiguousarray(ids, np.uint16 if bits <= 16 else np.uint32)
    if len(x) and int(x.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    n = len(x)
    blocks = -(-n // (8 * BLOCK))
    zeros, ones, places, body, at = np.zeros(bits, np.int64), np.zeros((bits, blocks + 1), np.int64), np.zeros((bits, blocks + 1), np.int64), [], 0
    for p in range(bits):
        bit = (x & x.dtype.type(1 << (bits - 1 - p))).astype(bool)
        packed = np.packbits(bit, bitorder="little")
        for k in range(blocks):
            part = packed[k * BLOCK : (k + 1) * BLOCK]
            body.append(press.compress(part.tobytes()))
            places[p, k] = at
            at += len(body[-1])
            ones[p, k + 1] = ones[p, k] + int(np.bitwise_count(part).sum())
        places[p, blocks] = at
        zeros[p] = n - ones[p, blocks]
        if p < bits - 1:
            x = np.concatenate((x[~bit], x[bit]))
    head = np.array([n, bits, blocks], np.int64).tobytes() + zeros.tobytes() + ones.tobytes() + places.tobytes()
    return MAGIC + head + b"".join(body)


class WaveletMatrix:
    """Access, counting and occurrence lookup over one file's bytes; only the blocks asked for are expanded."""

    def __init__(self, file: bytes, cached: int = 256):
        import functools

        import numpy as np
        import zstandard

        if file[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet matrix")
        at = len(MAGIC)
        self.n, self.bits, self.blocks = (int(v) for v in np.frombuffer(file, np.int64, 3, at))
        at += 24
        self.zeros = np.frombuffer(file, np.int64, self.bits, at)
        at += 8 * self.bits
        shape = (self.bits, self.blocks + 1)
        self.ones = np.frombuffer(file, np.int64, shape[0] * shape[1], at).reshape(shape)
        at += self.ones.nbytes
        self.places = np.frombuffer(file, np.int64, shape[0] * shape[1], at).reshape(shape)
        at += self.places.nbytes
        body, expand = memoryview(file)[at:], zstandard.ZstdDecompressor()

        @functools.lru_cache(cached)
        def block(p: int, k: int):
            got = np.frombuffer(expand.decompress(body[self.places[p, k] : self.places[p, k + 1]]), np.uint8)
            words = np.zeros(BLOCK // 8, np.uint64)
            words.view(np.uint8)[: len(got)] = got
            return words, np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

        self.block = block

    def __len__(self) -> int:
        return self.n

    def _ones(self, p: int, i: int) -> int:
        """Ones among the first i bits of plane p."""
        k, r = divmod(i, 8 * BLOCK)
        if r == 0:
            return int(self.ones[p, k])
        words, before = self.block(p, k)
        w, b = divmod(r, 64)
        part = (int(words[w]) & ((1 << b) - 1)).bit_count() if b else 0
        return int(self.ones[p, k]) + int(before[w]) + part

    def _select(self, p: int, bit: int, j: int) -> int:
        """Where plane p has its bit number j (from 0) of that value."""
        import numpy as np

        total = self.ones[p] if bit else np.minimum(np.arange(self.blocks + 1) * 8 * BLOCK, self.n) - self.ones[p]
        k = int(np.searchsorted(total, j, side="right")) - 1
        words, before = self.block(p, k)
        count = before if bit else np.arange(len(before)) * 64 - before
        rest = j - int(total[k])
        w = int(np.searchsorted(count, rest, side="right")) - 1
        rest -= int(count[w])
        word = int(words[w]) if bit else ~int(words[w]) & (1 << 64) - 1
        for _ in range(rest):
            word &= word - 1
        return k * 8 * BLOCK + w * 64 + (word & -word).bit_length() - 1

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for p in range(self.bits):
            ones = self._ones(p, i)
            bit = self._ones(p, i + 1) - ones
            token = token << 1 | bit
            i = int(self.zeros[p]) + ones if bit else i - ones
        return token

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        for p in range(self.bits):
            x, y = self._ones(p, a), self._ones(p, b)
            if token >> (self.bits - 1 - p) & 1:
                a, b = int(self.zeros[p]) + x, int(self.zeros[p]) + y
            else:
                a, b = a - x, b - y
        return a, b

    def rank(self, token: int, i: int) -> int:
        """How often the token occurs before place i."""
        return self.count(token, 0, i)

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """How often the token occurs in [a, b)."""
        if token < 0 or token >> self.bits:
            return 0
        a, b = self._range(token, a, self.n if b is None else b)
        return b - a

    def select(self, token: int, j: int) -> int:
        """The place of occurrence number j (from 0) of the token."""
        if token < 0 or token >> self.bits:
            raise IndexError(j)
        a, b = self._range(token, 0, self.n)
        if not 0 <= j < b - a:
            raise IndexError(j)
        i = a + j
        for p in reversed(range(self.bits)):
            bit = token >> (self.bits - 1 - p) & 1
            i = self._select(p, bit, i - int(self.zeros[p]) if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, j) for j in range(self.count(token))]

    def all(self):
        """Every token, in order."""
        import numpy as np

        planes = []
        for p in range(self.bits):
            parts = [self.block(p, k)[0].view(np.uint8) for k in range(self.blocks)]
            planes.append(np.unpackbits(np.concatenate(parts), bitorder="little", count=self.n) if parts else np.zeros(0, np.uint8))
        place, out = np.arange(self.n), np.zeros(self.n, np.uint32)
        for p, plane in enumerate(planes):
            ones = np.cumsum(plane, dtype=np.int64)
            bit = plane[place]
            out = out << 1 | bit
            place = np.where(bit == 1, self.zeros[p] + ones[place] - 1, place - ones[place])
        return out


def shards(batches: Iterator, path: str, bits: int, end: int | None, most: int) -> Iterator:
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    coder, part, number = Coder(path), TaskContext.get().partitionId(), 0
    ids, lens, docs, size = [], [], [], 0
    kind = np.uint16 if bits <= 16 else np.uint32

    def close():
        nonlocal ids, lens, docs, size, number
        file = build(np.concatenate(ids), bits)
        n = np.concatenate(lens)
        starts = pa.array(np.cumsum(n) - n)
        row = [pa.array([(part << 32) + number]), pa.array([len(n)]), pa.array([size])]
        listed = [pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), v) for v in (pa.concat_arrays(docs), starts)]
        number, ids, lens, docs, size = number + 1, [], [], [], 0
        return pa.RecordBatch.from_arrays([*row, *listed, pa.array([file], pa.binary())], names=["shard", "n_docs", "n_tokens", "doc_ids", "starts", "file"])

    for b in batches:
        b, at = b.filter(b.column("text").is_valid()), 0
        for lot in lots(b.column("text")):
            got, n = coder.encode(lot, end)
            ids.append(got.astype(kind))
            lens.append(n)
            docs.append(b.column("id").slice(at, len(lot)))
            at += len(lot)
            size += len(got)
            if size >= most:
                yield close()
    if lens:
        yield close()
    coder = None
    trimmed()


def wavelet_shards(docs: DataFrame, path: str = VOCABULARY, bits: int = BITS, end: int | None = END, shard_tokens: int = SHARD, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """Documents as token ids in wavelet matrices, one row and one compressed file per shard.

    Documents keep their order; a shard closes once it has ``shard_tokens`` tokens, and at the end of a task's input,
    so that nothing is shuffled. No document is divided. Each ends with the id ``end`` unless that is None.

    Gives ``shard``, ``n_docs``, ``n_tokens``, ``doc_ids``, ``starts`` (where each document begins in the shard) and ``file``,
    which ``WaveletMatrix`` opens. A null text is left out; an empty one is its end id alone. Identifiers may be null or
    repeated. An empty table gives an empty table. Other columns are ignored.
    """
    p = Packed(docs, text, id_)
    rows = p.frame.select(F.col(id_).alias("id"), F.col(text).alias("text"))
    id_type = dict(rows.dtypes)["id"]
    return rows.mapInArrow(lambda it: shards(it, path, bits, end, shard_tokens), f"shard long, n_docs long, n_tokens long, doc_ids array<{id_type}>, starts array<long>, file binary")
