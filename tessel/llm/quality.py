"""A quality classifier by attention-based multiple-instance learning."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tessel.llm.frames import Packed, lean, release, trimmed, written
from tessel.llm.tokens import lots

#: Words of a passage.
PASSAGE = 64
#: The classifier is fitted on at most so many labelled documents, those of the smallest digests of their identifiers.
TRAINING = 4000
#: Share of good documents, held out from fitting, that the threshold may reject.
LOSS = 0.005
#: Hashed words and pairs of words with a vector of their own, its length, and documents that must have one for it to be learnt.
BUCKETS, WIDTH, LEAST = 1 << 16, 8, 4
SHAPES, PRIORS = 8, 5
#: Pace at which vectors of words are learnt, beside that of the other weights.
PACE = 0.1
#: Times, at most, that every text is learnt from.
ROUNDS = 30
#: Words, about, that are counted or scored together while fitting, so that memory doesn't follow the number of texts.
TOGETHER = 100_000
EDGE = ".,;:!?()[]{}\"'«»¿¡*#%&$|-_<>/\\"


@dataclass
class Model:
    weights: dict  # "words" has the hashed words' vectors
    odds: object  # a hashed word's log odds of standing in a bad text
    mean: object  # of the passages' shapes and priors
    scale: object
    threshold: float


@dataclass
class Passages:
    """Texts as bags of passages: each word's bucket and that of it with the word before, and each passage's shape."""

    words: object
    pairs: object
    starts: object  # a passage's first word
    shapes: object
    bags: object  # a text's number of passages

    @property
    def sizes(self):
        import numpy as np

        return np.diff(np.append(self.starts, len(self.words)))

    def of(self, texts) -> Passages:
        """Those of some texts."""
        import numpy as np

        first = np.cumsum(self.bags) - self.bags
        passages = spread(first[texts], self.bags[texts])
        sizes = self.sizes[passages]
        at = spread(self.starts[passages], sizes)
        return Passages(self.words[at], self.pairs[at], np.cumsum(sizes) - sizes, self.shapes[passages], self.bags[texts])


def spread(starts, lens):
    """All places of the ranges of ``lens`` from ``starts``."""
    import numpy as np

    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())


def texts_of(d: Passages):
    """Each word's text."""
    import numpy as np

    return np.repeat(np.repeat(np.arange(len(d.bags)), d.bags), d.sizes).astype(np.int64)


def in_lots(d: Passages):
    """Numbers of neighbouring texts, in lots of about ``TOGETHER`` words."""
    import numpy as np

    ends = np.append(0, np.cumsum(d.sizes))[np.cumsum(d.bags)]
    return np.split(np.arange(len(ends)), np.flatnonzero(np.diff(ends // TOGETHER)) + 1)


def texts_with(d: Passages, *columns: str, some=None):
    """How many texts have each bucket in one of the columns, and how many of ``some`` do."""
    import numpy as np

    there, of_some = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for lot in in_lots(d):
        own = d.of(lot)
        text = texts_of(own)
        seen = np.unique(np.concatenate([text * BUCKETS + getattr(own, c) for c in columns]))
        there += np.bincount(seen % BUCKETS, minlength=BUCKETS)
        if some is not None:
            of_some += np.bincount(seen[some[lot][seen // BUCKETS]] % BUCKETS, minlength=BUCKETS)
    return there, of_some


def odds_of(d: Passages, good):
    """Smoothed log odds, from texts that have the word, for words of at least ``LEAST`` texts; others have 0."""
    import numpy as np

    there, bad = texts_with(d, "words", some=~good)
    odds = np.log((bad + 1) / ((~good).sum() + 2)) - np.log((there - bad + 1) / (good.sum() + 2))
    return np.where(there >= LEAST, odds, 0).astype(np.float32)


def priors(odds, d: Passages):
    """Mean, greatest and least log odds of a passage's words, and what of them is high, as a share and as a sum."""
    import numpy as np

    own = odds[d.words]
    high = np.add.reduceat(np.maximum(0, own - 1.5), d.starts)
    known = np.maximum(1, np.add.reduceat((own != 0).astype(np.float32), d.starts))
    columns = [np.add.reduceat(own, d.starts) / known, np.maximum.reduceat(own, d.starts), np.minimum.reduceat(own, d.starts), high / d.sizes * 8, np.minimum(high, 6)]
    return np.stack(columns, 1)


def stem(word: str) -> str:
    return word.strip(EDGE).lower()


class Encoder:
    """Cuts texts into passages of ``PASSAGE`` words.

    What depends on a word alone is worked out once for each distinct word, and gathered. A passage's shape has its repetition,
    case, symbols, digits and lengths; what its words say is for the model to learn.
    """

    def __init__(self, most: int = 100_000):
        self.most = most
        self.forget()

    def forget(self) -> None:
        import numpy as np

        class Numbers(dict):
            def __missing__(self, word):
                self[word] = n = len(self)
                return n

        self.numbers, self.table, self.hashes = Numbers(), np.zeros((0, 5), np.float32), np.zeros(0, np.uint32)

    def of_word(self, w: str) -> tuple:
        upper = sum(c.isupper() for c in w) if not w.islower() else 0
        digits = sum(c.isdigit() for c in w) if not w.isalpha() else 0
        marks = sum(not c.isalnum() and c not in ".,;:'\"" for c in w) if not w.isalnum() else 0
        return len(w), upper, digits, marks, not stem(w)

    def encode(self, texts: list[str]) -> Passages:
        import itertools
        import zlib

        import numpy as np

        if len(self.numbers) > self.most:
            self.forget()
        lists = [t.split() for t in texts]
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        known = len(self.numbers)
        codes = np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(lists)), np.int64, int(n.sum()))
        if len(self.numbers) > known:
            new = list(itertools.islice(self.numbers, known, None))
            self.table = np.concatenate((self.table, np.array([self.of_word(w) for w in new], np.float32).reshape(-1, 5)))
            self.hashes = np.append(self.hashes, np.array([zlib.crc32(stem(w).encode("utf-8", "surrogatepass")) for w in new], np.uint32))
        bags = -(-n // PASSAGE)
        total = int(bags.sum())
        if not total:
            return Passages(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros((0, SHAPES), np.float32), bags)
        number = np.arange(total) - np.repeat(np.cumsum(bags) - bags, bags)
        starts = np.repeat(np.cumsum(n) - n, bags) + number * PASSAGE
        sizes = np.diff(np.append(starts, len(codes)))
        sums = np.add.reduceat(self.table[codes], starts, axis=0)
        passage = np.repeat(np.arange(total), sizes)
        pairs = np.sort(passage * len(self.numbers) + codes)
        different = np.bincount(pairs[np.append(True, pairs[1:] != pairs[:-1])] // len(self.numbers), minlength=total)
        again = np.append(False, (codes[1:] == codes[:-1]) & (passage[1:] == passage[:-1]))
        repeats = np.bincount(passage[again], minlength=total)
        chars = np.maximum(sums[:, 0], 1)
        shapes = [different / sizes, repeats / sizes, sums[:, 0] / sizes, sums[:, 1] / chars, sums[:, 2] / chars, sums[:, 3] / chars, sums[:, 4] / sizes, np.log1p(sizes)]
        h = self.hashes[codes]
        before = np.append(np.uint32(0), h[:-1])
        before[starts] = 0
        both = (before * np.uint32(0x9E3779B1)) ^ (h * np.uint32(0x85EBCA6B))
        both ^= both >> np.uint32(15)
        bucket = lambda x: (x % np.uint32(BUCKETS)).astype(np.int32)
        return Passages(bucket(h), bucket(both), starts, np.stack(shapes, 1).astype(np.float32), bags)


def forward(w: dict, d: Passages, shapes):
    """Passages' inputs, hidden values, gates, attention, and the bags' logits; ``shapes`` are scaled.

    A passage is the mean and the greatest of its words' vectors, the mean of its pairs', its shape, and its words' priors.
    """
    import numpy as np

    own, n = w["words"][d.words], d.sizes[:, None]
    top = np.maximum.reduceat(own, d.starts, axis=0)
    x = np.concatenate((np.add.reduceat(own, d.starts, axis=0) / n, top, np.add.reduceat(w["words"][d.pairs], d.starts, axis=0) / n, shapes), axis=1)
    h = np.tanh(x @ w["e"] + w["eb"])
    v, u = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
    s = (v * u) @ w["a"]
    starts = np.cumsum(d.bags) - d.bags
    s = s - np.repeat(np.maximum.reduceat(s, starts), d.bags)
    a = np.exp(s)
    a /= np.repeat(np.add.reduceat(a, starts), d.bags)
    z = np.add.reduceat(h * a[:, None], starts, axis=0)
    return x, h, v, u, a, z, z @ w["c"] + w["cb"]


def loss_of(w: dict, d: Passages, shapes, good, each):
    """Cross entropy, each text weighing as in ``each``, and its gradient in all weights."""
    import numpy as np

    x, h, v, u, a, z, logit = forward(w, d, shapes)
    starts = np.cumsum(d.bags) - d.bags
    loss = float((each * (np.logaddexp(0, logit) - good * logit)).sum())
    dl = (1 / (1 + np.exp(-logit)) - good) * each
    g = {"c": z.T @ dl, "cb": dl.sum()}
    dz = np.repeat(dl[:, None] * w["c"], d.bags, axis=0)
    da = (dz * h).sum(1)
    ds = a * (da - np.repeat(np.add.reduceat(a * da, starts), d.bags))
    g["a"] = (v * u).T @ ds
    dv, du = ds[:, None] * w["a"] * u * (1 - v * v), ds[:, None] * w["a"] * v * u * (1 - u)
    g["v"], g["u"] = h.T @ dv, h.T @ du
    dh = (dz * a[:, None] + dv @ w["v"].T + du @ w["u"].T) * (1 - h * h)
    g["e"], g["eb"] = x.T @ dh, dh.sum(0)
    dx = dh @ w["e"].T
    k, sizes = w["words"].shape[1], d.sizes
    own, top = w["words"][d.words], np.repeat(x[:, k : 2 * k], sizes, axis=0)
    peak = own == top
    peak = peak / np.repeat(np.add.reduceat(peak, d.starts, axis=0, dtype=float), sizes, axis=0)
    per_word = np.repeat(dx[:, :k] / sizes[:, None], sizes, axis=0) + peak * np.repeat(dx[:, k : 2 * k], sizes, axis=0)
    per_pair = np.repeat(dx[:, 2 * k : 3 * k] / sizes[:, None], sizes, axis=0)
    buckets, back = np.unique(np.concatenate((d.words, d.pairs)), return_inverse=True)
    both = np.concatenate((per_word, per_pair))
    g["words"] = buckets, np.stack([np.bincount(back, both[:, j], len(buckets)) for j in range(k)], 1)
    return loss, g


def fit(d: Passages, shapes, good, hidden: int = 16, gate: int = 8, steps: int = 400, lot: int = 100, seed: int = 0) -> dict:
    """Words' vectors, gated attention and classifier, learnt together by Adam; both classes weigh the same.

    Buckets that fewer than ``LEAST`` of the texts have keep a vector of zeros.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    f = 3 * WIDTH + shapes.shape[1]
    w = {"e": rng.normal(0, f**-0.5, (f, hidden)), "eb": np.zeros(hidden), "v": rng.normal(0, hidden**-0.5, (hidden, gate)), "u": rng.normal(0, hidden**-0.5, (hidden, gate)), "a": rng.normal(0, gate**-0.5, gate), "c": rng.normal(0, hidden**-0.5, hidden), "cb": np.zeros(())}
    often = texts_with(d, "words", "pairs")[0] >= LEAST
    w["words"] = rng.normal(0, 0.05, (BUCKETS, WIDTH)) * often[:, None]
    m, q = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    each = np.where(good, 0.5 / max(1, good.sum()), 0.5 / max(1, (~good).sum())) * len(good)
    parts = max(1, round(len(good) / lot))
    rounds, t = min(ROUNDS, -(-steps // parts)), 0
    for number in range(rounds):
        rate = 0.02 * (1 - number / rounds)
        for some in np.array_split(rng.permutation(len(good)), parts):
            t += 1
            _, g = loss_of(w, d.of(some), shapes[spread((np.cumsum(d.bags) - d.bags)[some], d.bags[some])], good[some], each[some] / len(some))
            at, gw = g.pop("words")
            for k, at_, grad in [*((k, ..., v) for k, v in g.items()), ("words", at, gw * often[at, None])]:
                grad = grad + (1e-4 if k != "words" else 1e-5) * w[k][at_]
                m[k][at_] = 0.9 * m[k][at_] + 0.1 * grad
                q[k][at_] = 0.999 * q[k][at_] + 0.001 * grad**2
                w[k][at_] -= rate * (PACE if k == "words" else 1) * (m[k][at_] / (1 - 0.9**t)) / (np.sqrt(q[k][at_] / (1 - 0.999**t)) + 1e-8)
    return w


def halves_of(good):
    """Texts of two halves, which take turns within each class."""
    import numpy as np

    half = np.zeros(len(good), int)
    for c in (True, False):
        half[np.flatnonzero(good == c)] = np.arange((good == c).sum()) % 2
    return [np.flatnonzero(half == k) for k in (0, 1)]


def fitted(d: Passages, good, number: int):
    """One of the three fits to labelled texts, or None where a class has fewer than two texts with words.

    Of number 0 and 1, the logits of this half's good texts by a model of the other half; of 2, all of a
    model of all texts but its threshold.
    """
    import numpy as np

    good = np.asarray(good, bool)
    there = np.flatnonzero(d.bags)
    if len(there) < len(good):
        d, good = d.of(there), good[there]
    if min(good.sum(), (~good).sum()) < 2:
        return None
    # Each half's priors come from the other half, so that passages don't know their own labels.
    raw, first = np.zeros((len(d.shapes), SHAPES + PRIORS), np.float32), d.bags.cumsum() - d.bags
    halves = halves_of(good)
    for mine, other in (halves, halves[::-1]):
        own = d.of(mine)
        raw[spread(first[mine], d.bags[mine])] = np.concatenate((own.shapes, priors(odds_of(d.of(other), good[other]), own)), axis=1)
    mean, scale = raw.mean(0), raw.std(0) + 1e-6
    shapes = ((raw - mean) / scale).astype(float)
    if number == 2:
        return {"weights": {k: v.astype(np.float32) for k, v in fit(d, shapes, good).items()}, "odds": odds_of(d, good), "mean": mean, "scale": scale}
    mine, other = halves[number], halves[1 - number]
    w = fit(d.of(other), shapes[spread(first[other], d.bags[other])], good[other])
    d, shapes, good = d.of(mine), shapes[spread(first[mine], d.bags[mine])], good[mine]
    first = d.bags.cumsum() - d.bags
    return np.concatenate([forward(w, d.of(lot), shapes[spread(first[lot], d.bags[lot])])[-1] for lot in in_lots(d)])[good]


def model_of(fits: list, loss: float = LOSS) -> Model | None:
    """The model from its three fits; the threshold comes from scoring each half of the texts by a model of the other."""
    import numpy as np

    one, other, whole = fits
    if whole is None:
        return None
    cut = 1 / (1 + math.exp(-float(np.quantile(np.concatenate((one, other)), loss))))
    return Model(**whole, threshold=min(0.5, cut))


def train(texts: list[str], good, loss: float = LOSS) -> Model | None:
    """A model of texts at hand."""
    d = Encoder().encode([t or "" for t in texts])
    return model_of([fitted(d, good, k) for k in range(3)], loss)


def gathered(batches: Iterator):
    """Labelled texts as passages, whether each is good, and the number of the fit; None without rows. The batches aren't kept."""
    import numpy as np
    import pyarrow as pa

    parts = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not parts:
        return None
    found = pa.concat_tables(parts).sort_by("id")
    n = np.array([len(x) for x in found.column("words")], np.int64)
    bags = -(-n // PASSAGE)
    flat = lambda c, kind: np.concatenate([np.zeros(0, kind), *(x.values.to_numpy() for x in found.column(c))])
    at = np.arange(bags.sum()) - np.repeat(np.cumsum(bags) - bags, bags)
    starts = np.repeat(np.cumsum(n) - n, bags) + at * PASSAGE
    d = Passages(flat("words", np.int32), flat("pairs", np.int32), starts, flat("shapes", np.float32).reshape(-1, SHAPES), bags)
    return d, np.array(found.column("good").to_pylist()) == 1, found.column("number")[0].as_py()


@lean
def fits(batches: Iterator) -> Iterator:
    """A fit, from rows with its number and all labelled texts as passages."""
    import pyarrow as pa

    rows = gathered(batches)
    if rows is None:
        return
    number = rows[-1]
    trimmed()
    got = fitted(*rows)
    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([pickle.dumps(got)], pa.binary())], names=["number", "got"])


def probabilities(model: Model, d: Passages):
    """For each text with words, the probability that it is good and its passages' attention."""
    import numpy as np

    some = np.flatnonzero(d.bags)
    with_words = Passages(d.words, d.pairs, d.starts, d.shapes, d.bags[some])
    shapes = np.concatenate((d.shapes, priors(model.odds, with_words)), axis=1)
    *_, a, _, logit = forward(model.weights, with_words, ((shapes - model.mean) / model.scale).astype(np.float32))
    return 1 / (1 + np.exp(-logit.astype(float))), a


@lean
def scored(batches: Iterator, shared, at: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    model = shared.value
    encoder = Encoder()
    for b in batches:
        scores, peaks = [], []
        for lot in lots(b.column("row").field(at).fill_null("")):
            s, p = np.zeros(len(lot)), np.full(len(lot), -1, np.int32)
            if model:
                d = encoder.encode(lot)
                some = np.flatnonzero(d.bags)
                if len(some):
                    s[some], a = probabilities(model, d)
                    starts = np.cumsum(d.bags[some]) - d.bags[some]
                    best = np.flatnonzero(a == np.repeat(np.maximum.reduceat(a, starts), d.bags[some]))
                    bag = np.repeat(some, d.bags[some])
                    p[bag[best[::-1]]] = (best - np.repeat(starts, d.bags[some])[best])[::-1]
            else:
                s[:] = [1.0 if t and not t.isspace() else 0.0 for t in lot]
            scores.append(s)
            peaks.append(p)
        columns = [pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(np.concatenate(peaks) if peaks else [], pa.int32())]
        yield pa.RecordBatch.from_arrays([b.column("row"), *columns], names=["row", "score", "peak"])


@lean
def features(batches: Iterator) -> Iterator:
    """Labelled texts as passages, so that no text goes to the driver."""
    import pyarrow as pa

    encoder = Encoder()
    for b in batches:
        at = 0
        for lot in lots(b.column("text").fill_null("")):
            for k, t in enumerate(lot):
                d = encoder.encode([t])
                own = b.slice(at + k, 1)
                lists = [pa.array([x], pa.list_(kind)) for x, kind in ((d.words, pa.int32()), (d.pairs, pa.int32()), (d.shapes.ravel(), pa.float32()))]
                yield pa.RecordBatch.from_arrays([own.column("id"), own.column("good"), *lists], names=["id", "good", "words", "pairs", "shapes"])
            at += len(lot)


def trained(docs: DataFrame, labels: DataFrame, training: int = TRAINING, text: str = "text", id_: str = "doc_id") -> Model | None:
    """A model from the labels of at most ``training`` documents; good are those of quality 1 that aren't toxic.

    A document with several labels has the worst of them, and of rows that share an identifier the one of the least text is
    fitted. Labels without an identifier or a quality don't count. Texts are encoded by the workers, and the three fits are three
    tasks that read the encoded texts, so that the driver sees only what they give.
    """
    lab = Packed(labels, id_, "quality", "toxic").frame
    lab = lab.where(F.col(id_).isNotNull() & F.col("quality").isNotNull())
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) == 1
    lab = lab.groupBy(F.col(id_).alias("label_id")).agg(F.min(((F.col("quality") == 1) & ~toxic).cast("int")).alias("good"))
    chosen = lab.orderBy(F.xxhash64("label_id"), "label_id").limit(training)  # bounded, hence broadcast
    own = Packed(docs, text, id_).frame.select(F.col(id_).alias("id"), F.col(text).alias("text"))
    found = own.join(F.broadcast(chosen), F.col("id") == F.col("label_id")).groupBy("id", "good").agg(F.min("text").alias("text"))
    kind = dict(found.dtypes)["id"]
    found = found.select("id", "good", "text").mapInArrow(features, f"id {kind}, good int, words array<int>, pairs array<int>, shapes array<float>")
    found = written(found)  # at most ``training`` rows, all of which each fit reads
    rows = found.withColumn("number", F.explode(F.array(*map(F.lit, range(3))))).repartitionById(3, F.col("number")).mapInArrow(fits, "number int, got binary")
    got = {r["number"]: pickle.loads(r["got"]) for r in rows.collect()}
    release(found)
    return model_of([got.get(k) for k in range(3)])


def score_quality(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``quality_score``, the probability that a document is good, and ``quality_passage``, the number of the
    passage that got most attention; both replace input columns of those names.

    Every passage of the whole text is encoded, gated attention weighs the passages, and the weighted representation is
    scored. Null, empty and blank texts have no passage: their score is 0 and their passage -1. Without a model, which
    is so where labels lack a class, every document with words scores 1. Equal texts score alike; rows are never joined.
    An empty table gives an empty table.
    """
    p = Packed(docs, text)
    rows, at = p.frame.select("row"), p.at[text]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([rows.schema["row"], StructField("score", DoubleType()), StructField("peak", IntegerType())])
    return p.unpack(rows.mapInArrow(lambda it: scored(it, shared, at), schema), {"quality_score": F.col("score"), "quality_passage": F.col("peak")})


def filter_quality(docs: DataFrame, labels: DataFrame, training: int = TRAINING, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """The documents that the classifier fitted on ``labels`` accepts, with their scores; see ``trained`` and ``score_quality``.

    Documents without words are rejected. The threshold is that at which ``LOSS`` of the good documents held out from
    fitting would be rejected, and at most 0.5.
    """
    model = trained(docs, labels, training, text, id_)
    return score_quality(docs, model, text).where(F.col("quality_score") >= (model.threshold if model else 0.5))
