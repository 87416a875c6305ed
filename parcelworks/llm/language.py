"""Language identification by hyperdimensional profiles.

Every letter symbol has a random +1/-1 vector. An n-gram's vector binds its
letters' vectors by componentwise product after rotating each by its place. A
document's vector bundles (sums) the vectors of all its n-grams; a language's
prototype bundles those of its training documents. A document gets the language
with the largest cosine.

Text is lower-cased; runs of other characters than letters become one boundary
symbol. Letters are any Unicode letters; each is hashed to one of ``SYMBOLS``
symbols, a to z and the boundary having their own.

Bounds: prototypes are fitted on about ``PER_LANGUAGE`` documents a language (all
if fewer), chosen by a hash of doc_id; prediction covers every whole text.

Defined results: null text or no letters gives ``und`` with score 0; without any
training document every text is ``und``; ties go to the language first in order;
a null doc_id counts as not held out and is not trained on; repeated rows are
predicted alike; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, read

DIM = 1024
ORDER = 3
SYMBOLS = 96
PER_LANGUAGE = 1500
SCORE_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
#: Characters scored together: bounds memory for long texts.
BLOCK = 1_000_000


def letter_table() -> np.ndarray:
    """Symbol of each code point of the Basic Multilingual Plane: 0 boundary, 1 to
    26 a to z, the rest by hash. Upper case maps as its lower case."""
    table = np.zeros(0x10000, np.uint8)
    low = np.array([ord(chr(c).lower()[0]) for c in range(0x10000)], np.uint64)
    letter = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x10000)])
    hashed = mix64(low + np.uint64(1)) % np.uint64(SYMBOLS - 27) + np.uint64(27)
    latin = (low >= 97) & (low <= 122)
    table[:] = np.where(letter, np.where(latin, low - np.uint64(96), hashed), 0)
    return table


class Space:
    """The random vectors, and documents' vectors."""

    def __init__(self, dim: int = DIM, seed: int = 7) -> None:
        self.dim = dim
        self.letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (SYMBOLS, dim))
        self.rolled = [np.roll(self.letters, ORDER - 1 - k, axis=1) for k in range(ORDER)]
        self.table = letter_table()
        #: n-gram vectors met so far, by n-gram; at most ``kept`` of them.
        self.kept, self.at, self.vectors, self.n = 12_000, np.full(SYMBOLS**ORDER, -1, np.int32), None, 0

    def symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        found = self.table[np.minimum(points, 0xFFFF)]
        if (points > 0xFFFF).any():
            far = [i for i in np.flatnonzero(points > 0xFFFF) if chr(points[i]).isalpha()]
            found[far] = 27 + points[far] % (SYMBOLS - 27)
        keep = found > 0
        keep[1:] |= found[:-1] > 0  # the first of each run of other characters
        return np.concatenate([np.zeros(1, np.uint8), found[keep], np.zeros(1, np.uint8)])

    def grams(self, text: str) -> np.ndarray:
        s = self.symbols(text).astype(np.int32)
        code = s[: len(s) - ORDER + 1]
        for k in range(1, ORDER):
            code = code * SYMBOLS + s[k : len(s) - ORDER + 1 + k]
        return code[code > 0]

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """Rows of ``vectors`` for distinct n-grams; new ones are bound."""
        new = grams[self.at[grams] < 0]
        if self.vectors is None:
            self.vectors = np.empty((self.kept, self.dim), np.float32)
        if self.n + len(new) > self.kept:
            self.at[:] = -1
            self.n, new = 0, grams
            if len(new) > self.kept:
                raise OverflowError
        bound = None
        for k in range(ORDER):
            digit = new // SYMBOLS ** (ORDER - 1 - k) % SYMBOLS
            bound = self.rolled[k][digit] if bound is None else bound * self.rolled[k][digit]
        if len(new):
            self.vectors[self.n : self.n + len(new)] = bound
            self.at[new] = np.arange(self.n, self.n + len(new))
            self.n += len(new)
        return self.at[grams]

    def bundle(self, lists: list[np.ndarray]) -> np.ndarray:
        """A vector per list of n-grams."""
        out = np.zeros((len(lists), self.dim), np.float32)
        if not lists:
            return out
        joined = np.concatenate(lists)
        seen = np.zeros(SYMBOLS**ORDER, bool)
        seen[joined] = True
        distinct = np.flatnonzero(seen)
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        local = np.empty(SYMBOLS**ORDER, np.int32)
        for at in range(0, len(distinct), self.kept):
            part = distinct[at : at + self.kept]
            local.fill(-1)
            local[part] = np.arange(len(part))
            col = local[joined]
            mine = col >= 0
            counts = np.bincount(owner[mine] * len(part) + col[mine], minlength=len(lists) * len(part))
            rows = self.rows(part)
            out += counts.reshape(len(lists), -1).astype(np.float32) @ self.vectors[rows]
        return out


_space: dict[tuple[int, int], Space] = {}


def space(dim: int = DIM, seed: int = 7) -> Space:
    if (dim, seed) not in _space:
        _space[dim, seed] = Space(dim, seed)
    return _space[dim, seed]


def _blocks(texts: list[str | None], most_rows: int = 256):
    """Runs of texts of at most BLOCK characters (one text if it is longer)."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > at and (size + n > BLOCK or i - at >= most_rows):
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def held_out(doc_id="doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def prototypes(docs: DataFrame, per_language: int = PER_LANGUAGE, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, unit vectors around their mean.
    ``docs``: the training documents (doc_id, text, lang)."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    rates = known.groupBy("lang").count().select("lang", F.least(F.lit(1.0), per_language / F.col("count")).alias("_rate"))
    spot = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) / (1 << 20)
    sample = known.select("lang", "text", spot.alias("_spot")).join(F.broadcast(rates), "lang").where("_spot < _rate")

    def fit(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in _blocks(texts):
                got = space(dim).bundle([space(dim).grams(t) for t in texts[lo:hi]]).astype(np.float64)
                norm = np.linalg.norm(got, axis=1, keepdims=True)
                got /= np.where(norm > 0, norm, 1)
                for lang, v in zip(langs[lo:hi], got, strict=True):
                    total[lang] = total.get(lang, 0) + v
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))],
            names=["lang", "v"],
        )

    # One row a task and language, of ``dim`` numbers.
    parts = sample.select("lang", "text").mapInArrow(fit, "lang string, v array<double>").collect()
    total: dict[str, np.ndarray] = {}
    for r in sorted(parts, key=lambda r: (r["lang"], r["v"])):
        total[r["lang"]] = total.get(r["lang"], 0) + np.array(r["v"])
    langs = sorted(total)
    if not langs:
        return [], np.zeros((0, dim))
    got = np.array([total[x] for x in langs])
    got /= np.maximum(np.linalg.norm(got, axis=1, keepdims=True), 1e-12)
    return langs, got


def identify(docs: DataFrame, langs: list[str], profiles: np.ndarray, dim: int = DIM) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the cosine, 0 to 1) for every row."""
    centre = profiles.mean(axis=0) if len(langs) > 1 else np.zeros(dim)
    shifted = profiles - centre
    shifted /= np.maximum(np.linalg.norm(shifted, axis=1, keepdims=True), 1e-12)
    profiles32, centre32 = shifted.astype(np.float32), centre.astype(np.float32)

    def score(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            pred, value = ["und"] * len(texts), np.zeros(len(texts))
            for lo, hi in _blocks(texts) if langs else ():
                lists = [space(dim).grams(t or "") for t in texts[lo:hi]]
                got = space(dim).bundle(lists)
                norm = np.linalg.norm(got, axis=1, keepdims=True)
                got = got / np.where(norm > 0, norm, 1) - centre32
                cosine = got @ profiles32.T / np.maximum(np.linalg.norm(got, axis=1, keepdims=True), 1e-12)
                best = cosine.argmax(axis=1)
                for i, k in enumerate(best):
                    if len(lists[i]):
                        pred[lo + i], value[lo + i] = langs[k], (1 + float(cosine[i, k])) / 2
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(np.clip(value, 0, 1))],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(score, SCORE_SCHEMA)


def op1_language(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    langs, profiles = prototypes(docs.where(~held_out()))
    return identify(docs, langs, profiles)
