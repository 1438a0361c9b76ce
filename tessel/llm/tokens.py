"""A public byte-level BPE vocabulary, applied once to each distinct pre-token.

Pre-tokens are exactly the matches of ``PATTERN``, found by whole-array operations on code points: runs of letters, of digits
and of other marks, each with one space before it; white space, whose last space goes to what follows; and the seven
English contractions, where an apostrophe begins a pre-token. Within a worker a pre-token is known by a 64-bit hash.
"""

from __future__ import annotations

from tessel.llm.frames import kept_in_worker

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's published pre-tokeniser.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER, LETTER, NUMBER, SPACE, BORDER = range(5)
WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ODD = 0x9E3779B97F4A7C15


def encoding(path: str):
    """The vocabulary's encoder, loaded once for each worker."""
    kept = kept_in_worker()
    if path not in kept:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        kept[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[path]


def classes():
    """The class of every code point."""
    kept = kept_in_worker()
    if "classes" not in kept:
        import unicodedata

        import numpy as np

        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        table[list(WHITE)] = SPACE
        kept["classes"] = table
    return kept["classes"]


def powers(n: int):
    """The hash's powers and their inverses up to n, held up to a million."""
    import numpy as np

    kept = kept_in_worker()
    if "powers" not in kept or len(kept["powers"][0]) < n:
        both = []
        for base in (ODD, pow(ODD, -1, 1 << 64)):
            p = np.full(max(n, 1 << 20), base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        if n > 1 << 20:
            return both
        kept["powers"] = both
    return kept["powers"]


def hashed(c, starts, ends):
    """64-bit hashes of spans of code points."""
    import numpy as np

    up, down = powers(len(c) + 1)
    summed = np.zeros(len(c) + 1, np.uint64)
    np.cumsum((c + np.uint32(1)).astype(np.uint64) * up[: len(c)], out=summed[1:])
    h = (summed[ends] - summed[starts]) * down[starts]
    h ^= h >> np.uint64(31)
    return h * np.uint64(0xBF58476D1CE4E5B9)


class PreTokens:
    """The pre-tokens of some texts: where each begins and ends in ``joined``, their hashes, and how many each text has."""

    def __init__(self, texts: list[str]):
        import numpy as np

        self.joined = "\x00".join(texts) + "\x00"
        c = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        borders = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        kind = np.append(classes()[c], BORDER)
        kind[borders] = BORDER
        begin = np.append(True, kind[1:] != kind[:-1])
        begin[borders] = True  # so that two in a row part an empty text
        # White space before something else: its last character is apart, and goes with what follows if it is a space.
        after = np.flatnonzero((kind[1:] < SPACE) & (kind[:-1] == SPACE)) + 1
        begin[after - 1] = True
        begin[after[c[after - 1] == 32]] = False
        # An apostrophe that begins a pre-token and is its only mark takes a contraction's letters.
        mark = np.flatnonzero(c == 39)
        mark = mark[begin[mark] & (kind[mark + 1] == LETTER)]
        one = c[np.minimum(mark + 1, len(c) - 1)]
        two = c[np.minimum(mark + 2, len(c) - 1)]
        is_ = lambda x, letters: np.isin(x, [ord(a) for a in letters])
        long = (is_(one, "rv") & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        size = np.where(is_(one, "stmd"), 1, np.where(long, 2, 0))
        mark, size = mark[size > 0], size[size > 0]
        begin[mark + 1] = False
        rest = mark + 1 + size
        begin[rest[kind[rest] == LETTER]] = True
        starts = np.flatnonzero(begin)
        self.ends = np.append(starts[1:], len(c))
        own = kind[starts] != BORDER
        self.starts, self.ends = starts[own], self.ends[own]
        edges = np.searchsorted(self.starts, borders)
        self.counts = np.diff(np.append(0, edges))
        self.hashes = hashed(c, self.starts, self.ends)

    def spelled(self, at) -> list[str]:
        return [self.joined[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


class Numbers:
    """Numbers pre-tokens by their hashes, in the order in which they come."""

    def __init__(self):
        import numpy as np

        self.hashes, self.codes = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.hashes)

    def of(self, hashes):
        """Each hash's number, and where the new ones stand, in the order of their numbers."""
        import numpy as np

        u, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, u)
        known = np.zeros(len(u), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == u[inside]
        codes = np.zeros(len(u), np.int64)
        codes[known] = self.codes[at[known]]
        new = np.flatnonzero(~known)
        codes[new] = len(self.hashes) + np.arange(len(new))
        self.hashes, self.codes = np.insert(self.hashes, at[new], u[new]), np.insert(self.codes, at[new], codes[new])
        return codes[back], first[new]


def encoded(names: list[str], encoder):
    """Ids of pre-tokens: all of them in one array, and how many each has."""
    import numpy as np

    lone = {i for i, t in enumerate(names) if not t or t[-1].isspace()}
    break_ = encoder.encode_ordinary("\n")
    out: list = [None] * len(names)
    together = [i for i in range(len(names)) if i not in lone]
    # A line break between two pre-tokens is always one of its own.
    for a in range(0, len(together), 65536):
        part = together[a : a + 65536]
        ids = encoder.encode_to_numpy("\n".join(names[i] for i in part))
        at = np.flatnonzero(ids == break_[0])
        if len(break_) != 1 or len(at) != len(part) - 1:
            lone.update(part)
            continue
        edges = np.concatenate(([-1], at, [len(ids)]))
        for k, i in enumerate(part):
            out[i] = ids[edges[k] + 1 : edges[k + 1]]
    for i in lone:
        out[i] = np.asarray(encoder.encode_ordinary(names[i]), np.uint32)
    lens = np.fromiter(map(len, out), np.int64, len(out))
    return (np.concatenate(out) if out else np.zeros(0, np.uint32)).astype(np.uint32), lens


class Coder:
    """Token ids of many texts; what a pre-token becomes is remembered for up to ``most`` of them, then learnt anew."""

    def __init__(self, path: str, most: int = 300_000):
        self.encoder, self.most = encoding(path), most
        self.forget()

    def forget(self) -> None:
        import numpy as np

        self.numbers, self.ids, self.lens = Numbers(), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def encode(self, texts: list[str], tail: int | None = None):
        """Ids of all texts in one array, each text's closed by ``tail`` if given, and each text's number of ids."""
        import numpy as np

        if len(self.numbers) > self.most:
            self.forget()
        found = PreTokens(texts)
        codes, new = self.numbers.of(found.hashes)
        if len(new):
            ids, lens = encoded(found.spelled(new), self.encoder)
            self.ids, self.lens = np.concatenate((self.ids, ids)), np.concatenate((self.lens, lens))
        starts = np.cumsum(self.lens) - self.lens
        n = self.lens[codes]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(starts[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(found.counts)))]
        if tail is not None:
            ids = np.insert(ids, edges[1:], tail)
            return ids, np.diff(edges) + 1
        return ids, np.diff(edges)


def lots(column, most: int = 1_000_000):
    """Neighbouring texts of an Arrow column without nulls, in lots of about ``most`` bytes.

    Only one lot at a time is made into strings, so that memory follows neither a batch's size nor, beyond one, its longest texts.
    """
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(column):
        z = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + most)))
        yield column.slice(a, z - a).to_pylist()
        a = z
