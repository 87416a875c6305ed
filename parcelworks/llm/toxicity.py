"""Toxicity by cumulative-link ordinal regression over sparse text features.

Severity has grades 0 to ``GRADES``: ``P(grade >= k) = logistic(x . w - cut_k)``
with one weight vector shared by all ordered cuts. Every word of a text is a feature,
``log(1 + count)``, and so is the logarithm of the text's length. A word is in lower
case, without what isn't a letter at its ends; one without letters is itself, and a
long one also gives its parts of ``PART`` characters. The output is the expected
grade, ``sum_k P(grade >= k)``; a document is toxic where ``P(grade >= 1)`` is at
least ``LIMIT``.

Training: about ``SAMPLE`` labelled documents, half of either label where there are
enough, chosen by a hash of doc_id, are the bound. All their words are in the model;
a word is scaled by how far above or below chance toxic documents hold it, so that
words which tell little are held near zero by the same ridge. ``labels.toxic`` is 0 or
1; the grades of toxic documents come from other documents: the sample is halved, each
half's words get log-odds of toxicity, and a toxic document of the other half has the
sum of those that speak for it, whose terciles are the grades 1 to ``GRADES``. Every
whole text is scored by the model.

Defined results: null, empty or wordless text has expected severity 0 and is not
toxic; without labels of both kinds nothing is toxic; a null doc_id teaches nothing
and its row is scored like others; repeated rows and equal texts score alike; extra
columns are ignored, and stay in clean documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bounds, packed_row, read, text_bytes

SAMPLE = 8_000
LEAST_SCALE = 1e-3
GRADES = 3
LIMIT = 0.7
#: Words of more characters than ``LONG`` also give their parts.
LONG, PART = 24, 4
SCHEMA = "doc_id long, n_words long, n_hits long, p_toxic double, severity double, grade int, toxic boolean"


def word_features(word: bytes) -> tuple[str, ...]:
    """The word in lower case without what isn't a letter at its ends, and the parts
    of a long one."""
    w = word.decode("utf-8", "replace").lower()
    if not w.isalpha():
        lo, hi = 0, len(w)
        while lo < hi and not w[lo].isalpha():
            lo += 1
        while hi > lo and not w[hi - 1].isalpha():
            hi -= 1
        w = w[lo:hi] or w
    if len(w) <= LONG:
        return (w,)
    return (w, *("~" + w[i : i + PART] for i in range(len(w) - PART + 1)))


class _Features(dict):
    """Names of the features of words; emptied when full."""

    limit = 60_000

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        got = tuple(xxhash.xxh3_64_intdigest(f.encode("utf-8", "surrogatepass")) for f in word_features(word))
        if len(word) <= 4 * LONG:
            if len(self) >= self.limit:
                self.clear()
            self[word] = got
        return got


_features = _Features()


def counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: words of each, then (text, feature, count) of all."""
    n_words, owner, names = [], [], []
    for i, t in enumerate(texts):
        words = text_bytes(t).split()
        n_words.append(len(words))
        got = [f for w in words for f in _features[w]]
        names.append(np.array(got, np.uint64))
        owner.append(np.full(len(got), i))
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner, names = np.concatenate(owner), np.concatenate(names)
    by = np.lexsort((names, owner))
    owner, names = owner[by], names[by]
    start = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (names[1:] != names[:-1])])) if len(names) else np.zeros(0, np.int64)
    return np.array(n_words), owner[start], names[start], np.diff(np.append(start, len(names)))


def length_feature(n_words) -> np.ndarray:
    return (np.log1p(n_words) - 5) / 2


class Ordinal:
    """Words' names (ascending) with their weights, the length's weight, and cuts."""

    def __init__(self, names: np.ndarray, weights: np.ndarray, length: float, cuts: np.ndarray) -> None:
        self.names, self.length, self.cuts = names, length, cuts
        self.weights = np.append(weights, 0).astype(np.float32)  # the last is any other word's
        self.places = None

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, words of weight, and the odds of each grade or more, of each text."""
        if self.places is None:
            self.places = _Places(self.names)
        others, m = len(self.names), len(texts)
        split = [text_bytes(t).split() for t in texts]
        self.places.learn({w for words in split for w in words})
        look, n, found = self.places.__getitem__, np.array([len(w) for w in split], np.int64), []
        for i, words in enumerate(split):
            at = np.fromiter(map(look, words), np.int64, len(words))
            if (at < 0).any():  # words of several features
                more = [place for w in words if look(w) < 0 for place in self.places.several[w]]
                at = np.concatenate([at[at >= 0], np.array(more, np.int64)])
            found.append(at + i * (others + 1))
        key, count = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        owner, weight = key // (others + 1), self.weights[key % (others + 1)].astype(np.float64)
        line = np.bincount(owner, weight * np.log1p(count), m) + self.length * length_feature(n)
        hits = np.bincount(owner, (np.abs(weight) > 0.5) * count, m).astype(np.int64)
        p = 1 / (1 + np.exp(np.clip(self.cuts - line[:, None], -30, 30)))
        return n, hits, np.where(n[:, None] > 0, p, 0.0)


class _Places(dict):
    """Places of words in a model's names, the number of names for others, and -1 for
    words of several features, whose places are in ``several``."""

    limit = 60_000

    def __init__(self, names: np.ndarray) -> None:
        self.names, self.several = names, {}

    def learn(self, words: set[bytes]) -> None:
        """Have all ``words``; if that is too many, forget others."""
        if len(self) > self.limit:
            self.clear()
            self.several.clear()
        new = [w for w in words if w not in self]
        each = [[xxhash.xxh3_64_intdigest(f.encode("utf-8", "surrogatepass")) for f in word_features(w)] for w in new]
        got = np.array([f for e in each for f in e], np.uint64)
        places = np.full(len(got), len(self.names))
        if len(self.names):
            at = np.minimum(np.searchsorted(self.names, got), len(self.names) - 1)
            places = np.where(self.names[at] == got, at, places)
        lo = 0
        for w, e, first in zip(new, each, places[np.cumsum([0, *map(len, each)])[:-1]].tolist() if new else [], strict=True):
            self[w] = first if len(e) == 1 else -1
            if len(e) > 1:
                self.several[w] = places[lo : lo + len(e)].tolist()
            lo += len(e)


class Sparse:
    """Rows of (column, value), with products for a fit."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, shape: tuple[int, int]) -> None:
        self.row, self.col, self.value, self.shape = row, col, value.astype(np.float32), shape

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], self.shape[0])

    def turned(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * g[self.row], self.shape[1])


def likelihood(x: Sparse, y: np.ndarray, theta: np.ndarray, grades: int, balance: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Weighed log-likelihood less the ridge, and its gradient. ``theta``: weights,
    the first cut, logarithms of the steps to the next, so cuts stay ordered."""
    k = x.shape[1]
    steps = np.exp(theta[k + 1 :])
    cuts = theta[k] + np.concatenate([[0], np.cumsum(steps)])
    s = x.times(theta[:k])
    upper, lower = np.concatenate([cuts, [np.inf]])[y], np.concatenate([[-np.inf], cuts])[y]
    fu, fl = (1 / (1 + np.exp(-np.clip(b - s, -40, 40))) for b in (upper, lower))  # P(y) = fu - fl
    fu, fl = np.where(np.isinf(upper), 1, fu), np.where(np.isinf(lower), 0, fl)
    p = np.maximum(fu - fl, 1e-9)
    du, dl = fu * (1 - fu) / p * balance, fl * (1 - fl) / p * balance
    at = np.array([du[y == j].sum() - dl[y == j + 1].sum() for j in range(grades)])
    grad = np.concatenate([x.turned(dl - du) - l2 * theta[:k], [at.sum()], [at[j + 1 :].sum() * steps[j] for j in range(grades - 1)]])
    return float((balance * np.log(p)).sum() - l2 / 2 * (theta[:k] ** 2).sum()), grad


def fit_ordinal(x: Sparse, y: np.ndarray, grades: int = GRADES, rounds: int = 200, rate: float = 0.1, l2: float = 2e-6):
    """Weights and cuts by Adam; both labels weigh the same in sum."""
    theta = np.concatenate([np.zeros(x.shape[1]), [1.0], np.zeros(grades - 1)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    balance = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    for t in range(1, rounds + 1):
        _, g = likelihood(x, y, theta, grades, balance, l2)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    k = x.shape[1]
    return theta[:k], theta[k] + np.concatenate([[0], np.cumsum(np.exp(theta[k + 1 :]))])


def held_out_severity(row: np.ndarray, col: np.ndarray, toxic: np.ndarray, half: np.ndarray, words: int) -> np.ndarray:
    """Of each document the sum of the log-odds of its distinct words, as the other
    half of the documents has them, of those words that toxic ones hold more often,
    by more than chance."""
    out = np.zeros(len(toxic))
    for side in (0, 1):
        other = half[row] != side
        size = [max(1, int(((toxic == y) & (half != side)).sum())) for y in (0, 1)]
        n = [np.bincount(col[other & (toxic[row] == y)], minlength=words) for y in (0, 1)]
        odds = np.log((n[1] + 0.5) / (size[1] + 1)) - np.log((n[0] + 0.5) / (size[0] + 1))
        sure = odds > 2 / np.sqrt(np.minimum(n[0], n[1]) + 0.5)
        mine = ~other
        out += np.bincount(row[mine], np.where(sure, odds, 0.0)[col[mine]], len(toxic))
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal | None:
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("_y"))
    rates = known.groupBy("_y").count().select("_y", F.least(F.lit(1.0), sample / 2 / F.col("count")).alias("_rate"))
    spot = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) / (1 << 20)
    chosen = known.join(F.broadcast(rates), "_y").where(spot < F.col("_rate")).select("doc_id", "_y")
    # Only what is read, so that no other column clashes; one text an id, so that the
    # sample bounds rows too.
    one = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("_y").alias("_y"), F.min("text").alias("text"))
    rows = one.select(
        F.col("_y").cast("int"), F.col("doc_id").cast("long"), F.col("text").cast("string"), F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")
    )

    def vectors(batches):
        for part in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
            n, owner, names, count = counted(part.column(2).to_pylist())
            cut = np.searchsorted(owner, np.arange(len(n) + 1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(3), pa.array(n, pa.int64()),
                 pa.array([names[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                 pa.array([count[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                names=["y", "d", "half", "n", "f", "c"],
            )

    got = rows.mapInArrow(vectors, "y int, d long, half int, n long, f binary, c binary").toArrow().to_pylist()  # the sample
    got.sort(key=lambda r: (r["d"], r["n"], r["f"]))
    toxic = np.array([r["y"] for r in got], np.int64)
    if set(toxic.tolist()) != {0, 1}:
        return None
    half, n = np.array([r["half"] for r in got]), np.array([r["n"] for r in got])
    each = [np.frombuffer(r["f"], np.uint64) for r in got]
    count = np.concatenate([np.frombuffer(r["c"], np.int32) for r in got])
    row = np.repeat(np.arange(len(got)), [len(f) for f in each])
    m, every = len(got), np.concatenate(each)
    del got, each
    names, col = np.unique(every, return_inverse=True)
    # How far from chance, in standard deviations; words that say too little shrink.
    share = toxic.mean()
    expected = np.bincount(col, minlength=len(names)) * share
    z = (np.bincount(col[toxic[row] == 1], minlength=len(names)) - expected) / np.sqrt(expected * (1 - share) + 1)
    scale = z**4 / (z**4 + 4.0**4)
    # Words scaled below ``LEAST_SCALE`` can't move a score: they keep weight 0.
    used = np.flatnonzero(scale >= LEAST_SCALE)
    place = np.full(len(names), -1)
    place[used] = np.arange(len(used))
    at = place[col] >= 0
    x = Sparse(
        np.concatenate([row[at], np.arange(m)]), np.concatenate([place[col[at]], np.full(m, len(used))]),
        np.concatenate([np.log1p(count[at]) * scale[col[at]], length_feature(n)]), (m, len(used) + 1),
    )
    severity = held_out_severity(row, col, toxic, half, len(names))
    y = toxic.copy()
    cuts = np.quantile(severity[toxic == 1], np.arange(1, GRADES) / GRADES)
    y[toxic == 1] = 1 + np.searchsorted(cuts, severity[toxic == 1], side="left")
    weights, cuts = fit_ordinal(x, y)
    return Ordinal(names[used], weights[:-1] * scale[used], float(weights[-1]), cuts)


def score(docs: DataFrame, model: Ordinal | None, limit: float = LIMIT) -> DataFrame:
    """doc_id, n_words, n_hits (words of weight), p_toxic, severity, grade, toxic for
    every row."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    used = model or Ordinal(np.zeros(0, np.uint64), np.zeros(0), 0.0, np.full(GRADES, 30.0))

    def run(batches):
        for part in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
            n, hits, p = used.scores(part.column(1).to_pylist())
            if model is None:
                p = np.zeros_like(p)
            cols = (pa.array(n, pa.int64()), pa.array(hits), pa.array(p[:, 0]), pa.array(p.sum(axis=1)), pa.array((p >= 0.5).sum(axis=1), pa.int32()), pa.array(p[:, 0] >= limit))
            yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't toxic, with their columns."""
    arrow_bounds(docs.sparkSession)
    model = fit(docs, labels)
    if model is None:
        return docs
    names, at = docs.columns, docs.columns.index("text")

    def keep(batches):
        for b in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
            part = pa.RecordBatch.from_arrays(b.column(0).flatten(), names=names)
            yield part.filter(pa.array(model.scores(part.column(at).to_pylist())[2][:, 0] < LIMIT))

    return docs.select(packed_row(docs)).mapInArrow(keep, docs.schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))
