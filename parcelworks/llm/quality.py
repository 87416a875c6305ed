"""Quality rules: line labels by a linear-chain conditional random field.

Every line with a word becomes a set of binary features (length, letter case,
symbols, repeats, place). A two-state chain (content, boilerplate) scores the
lines; Viterbi decoding labels them, and the share of words in content lines
decides whether a document stays. Plain counts (symbols, repeated lines, repeated
words) are returned beside it and have their own limits.

Training: the ``labels`` table has a quality of 0 or 1 for documents, not lines, so
the lines' states are hidden: those of documents of quality 1 are content, those of
documents of quality 0 may be either, but one at least is boilerplate. The chain is
fitted by gradient ascent on its log-likelihood (forward-backward) and the states
are guessed from it, in turns, over about ``SAMPLE`` documents chosen by a hash of
doc_id: the bound. Decoding covers all texts.

Defined results: null, empty or wordless text has zero counts and fails the base
rules; without labels of both kinds the chain keeps all that passes the base
rules; a null doc_id teaches nothing and its row is judged like others; repeated
rows get equal results; of two states with equal scores a line has content; extra
columns are ignored; lines and texts may be of any length.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, text_bytes, window_hashes, word_names

SAMPLE = 3000
#: Turns in which the hidden states of lines are guessed and the chain is taught anew.
TURNS = 3
WINDOW = 8
#: A document stays if at least this share of its words is in content lines.
CONTENT_SHARE = 0.5
SYMBOLS = b"#*$%&|<>"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, content_share double"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_CONTINUED = np.zeros(256, bool)
_CONTINUED[0x80:0xC0] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b"!?=\"{}[]()/\\_~^`@+:;")] = True

#: Limits of the share features: a feature each for exceeding a limit.
SHARES = (0.02, 0.08, 0.2, 0.4)
N_FEATURES = 40


def base_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = data.split()
    raw = np.frombuffer(data, np.uint8)
    chars = int(np.count_nonzero(~(_SPACE | _CONTINUED)[raw]))
    symbols = int(np.count_nonzero(_SYMBOL[raw]))
    seen, dup = set(), 0
    for line in data.split(b"\n"):
        if line and not line.isspace():
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    h = window_hashes(word_names(words), WINDOW)
    repeat = 0
    if len(h) > 1:
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = s[1:] == s[:-1]
        if same.any():
            twice = np.zeros(len(h) + 1, bool)
            twice[1:-1] |= same
            hit = np.zeros(len(h), bool)
            hit[order] = twice[:-1] | np.concatenate([same, [False]])
            # words covered by a repeated window: a running count of open windows
            edge = np.zeros(len(words) + 1, np.int32)
            at = np.flatnonzero(hit)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            repeat = int(np.count_nonzero(np.cumsum(edge[:-1]) > 0))
    return len(words), chars, symbols, dup, repeat


def line_features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For the lines with a word: binary features, and words per line."""
    raw = np.frombuffer(data + b"\n", np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    gap = _SPACE[raw]
    begins = ~gap
    begins[1:] &= gap[:-1]

    def total(mask: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(mask)])
        return (run[ends] - run[starts]).astype(np.float64)

    words = total(begins)
    keep = words > 0
    if not keep.any():
        return np.zeros((0, N_FEATURES), np.float32), np.zeros(0)
    chars = np.maximum(total(~gap), 1)
    shares = [total(t[raw]) / chars for t in (_SYMBOL, _UPPER, _DIGIT, _PUNCT)]
    mean = chars / np.maximum(words, 1)
    lines, first = {}, np.zeros(len(ends), bool)
    for i in np.flatnonzero(keep):
        line = data[starts[i] : ends[i]]
        first[i] = lines.setdefault(line, i) == i
    lower = total(_LOWER[raw]) / chars
    last = raw[np.maximum(ends - 1, 0)]
    cols = [np.ones(len(ends), bool), ~first, lower < 0.2, lower < 0.5]
    cols += [s > limit for s in shares for limit in SHARES]
    cols += [words <= n for n in (1, 2, 4, 8)] + [words > n for n in (40, 120)]
    cols += [mean < 3, mean > 9, mean > 14]
    cols += [np.isin(last, list(b".!?")), last == ord(","), np.isin(last, list(SYMBOLS))]
    n = np.arange(len(ends))
    cols += [n == 0, n == len(ends) - 1, np.full(len(ends), keep.sum() == 1)]
    found = np.zeros((int(keep.sum()), N_FEATURES), np.float32)
    for k, c in enumerate(cols):
        found[:, k] = c[keep]
    return found, words[keep]


class Chain:
    """Two-state linear chain: state 0 content, state 1 boilerplate."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves  # [features, 2], [2, 2]

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        score = x @ self.weights
        n = len(score)
        if n == 0:
            return np.zeros(0, int)
        m = self.moves
        back = np.zeros((n, 2), np.int8)
        a, b = score[0]
        emit = score.tolist()
        m00, m01, m10, m11 = m[0, 0], m[0, 1], m[1, 0], m[1, 1]
        for t in range(1, n):
            to0, to1 = (a + m00, b + m10), (a + m01, b + m11)
            back[t] = to0[1] > to0[0], to1[1] > to1[0]
            a, b = max(to0) + emit[t][0], max(to1) + emit[t][1]
        path = np.zeros(n, int)
        path[-1] = int(b > a)
        for t in range(n - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path

    def chances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of stacked documents of one length: the state's odds at each line, the moves
        expected in each document, and the log of the sum of all paths."""
        n, m = x.shape[1], self.moves
        s = x @ self.weights
        up, down = np.zeros_like(s), np.zeros_like(s)
        up[:, 0] = s[:, 0]
        for t in range(1, n):
            up[:, t] = s[:, t] + np.logaddexp(up[:, t - 1, 0, None] + m[0], up[:, t - 1, 1, None] + m[1])
        for t in range(n - 2, -1, -1):
            ahead = s[:, t + 1] + down[:, t + 1]
            down[:, t] = np.logaddexp(ahead[:, 0, None] + m[:, 0], ahead[:, 1, None] + m[:, 1])
        z = np.logaddexp(up[:, -1, 0], up[:, -1, 1])
        p = np.exp(up + down - z[:, None, None])
        pair = np.exp(up[:, :-1, :, None] + m + (s[:, 1:] + down[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum(axis=1)
        return p, pair, z

    @classmethod
    def fit(cls, docs: list[np.ndarray], labels: list[np.ndarray], rounds: int = 60, rate: float = 0.5, l2: float = 1e-3, start: Chain | None = None) -> Chain:
        """Gradient ascent on the log-likelihood of the labels, a label a line; lines of
        both labels weigh the same in sum, and documents of equal line count go
        together."""
        groups: dict[int, list[int]] = {}
        for i, x in enumerate(docs):
            if len(x):
                groups.setdefault(len(x), []).append(i)
        whole = {y: max(1e-9, sum(float((v == y).mean()) for v in labels if len(v))) for y in (0, 1)}
        stacked = []
        for n, at in sorted(groups.items()):
            for lo in range(0, len(at), max(1, 200_000 // n)):  # bounded arrays, however many documents
                some = at[lo : lo + max(1, 200_000 // n)]
                y = np.stack([labels[i] for i in some])
                share = (y == 1).mean(axis=1)
                stacked.append((np.stack([docs[i] for i in some]).astype(np.float32), y, (0.5 * (1 - share) / whole[0] + 0.5 * share / whole[1]) / n))
        w, m = (np.zeros((N_FEATURES, 2)), np.zeros((2, 2))) if start is None else (start.weights.copy(), start.moves.copy())
        gw2, gm2 = np.full_like(w, 1e-8), np.full_like(m, 1e-8)
        for _ in range(rounds):
            gw, gm = -l2 * w, -l2 * m
            now = cls(w, m)
            for x, y, weight in stacked:
                p, pair, _ = now.chances(x)
                real = np.stack([y == 0, y == 1], axis=2).astype(np.float64)
                gap = (real - p) * weight[:, None, None]
                gw += x.reshape(-1, N_FEATURES).T @ gap.reshape(-1, 2)
                gm += np.einsum("d,dij->ij", weight, np.einsum("dti,dtj->dij", real[:, :-1], real[:, 1:]) - pair)
            gw2 += gw * gw
            gm2 += gm * gm
            w, m = w + rate * gw / np.sqrt(gw2), m + rate * gm / np.sqrt(gm2)
        return cls(w, m)

    @classmethod
    def fit_documents(cls, docs: list[np.ndarray], labels: list[int], turns: int = TURNS) -> Chain:
        """A chain from labels of documents, whose lines' states are hidden. At first
        each line has its document's label. Then, in turns, a line of a boilerplate
        document that looks like content by its own features and its neighbours is
        taken for content, but for the one that looks it least (a boilerplate
        document has at least one such line); lines of content documents stay content."""
        lines = [np.full(len(x), y) for x, y in zip(docs, labels, strict=True)]
        chain = cls.fit(docs, lines)
        for _ in range(turns):
            # Moves learned from documents of one label alone would hold any chain in
            # one state; lines are judged with them halved.
            free = cls(chain.weights, chain.moves / 2)
            for i, (x, y) in enumerate(zip(docs, labels, strict=True)):
                if y == 1 and len(x) > 1:
                    p = free.chances(x[None].astype(np.float32))[0][0, :, 1]
                    lines[i] = (p >= 0.5).astype(int)
                    lines[i][np.argmax(p)] = 1
            chain = cls.fit(docs, lines, rounds=30)
        return chain


def fit_chain(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain | None:
    """The chain taught by labelled documents, or None without both labels. Each
    label has at most about half the sample."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_y"))
    rates = known.groupBy("_y").count().select("_y", F.least(F.lit(1.0), sample / 2 / F.col("count")).alias("_rate"))
    spot = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20)) / (1 << 20)
    chosen = known.join(F.broadcast(rates), "_y").where(spot < F.col("_rate")).select("doc_id", "_y")
    # Only what is read, so that no other column clashes; one text an id, so that the
    # sample bounds rows too.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("_y").alias("_y"), F.min("text").alias("text"))

    def features(batches):
        for b in batches:
            x = [line_features(text_bytes(t))[0] for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int32()), b.column(1), pa.array([np.packbits(v > 0, axis=1).tobytes() for v in x], pa.binary())],
                names=["y", "d", "x"],
            )

    got = rows.select(F.col("_y").cast("int"), F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(features, "y int, d long, x binary").collect()
    got.sort(key=lambda r: (r["d"], bytes(r["x"])))
    wide = (N_FEATURES + 7) // 8
    xs = [np.unpackbits(np.frombuffer(bytes(r["x"]), np.uint8).reshape(-1, wide), axis=1)[:, :N_FEATURES] for r in got]
    ys = [1 - r["y"] for r in got]
    return Chain.fit_documents(xs, ys) if len(set(ys)) == 2 else None


def judge(docs: DataFrame, chain: Chain | None, share: float = CONTENT_SHARE) -> DataFrame:
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                cols: list[list] = [[] for _ in range(8)]
                for text in part.column(1).to_pylist():
                    data = text_bytes(text)
                    n, chars, symbols, dup, repeat = base_counts(data)
                    failed = n < 20 or 100 * repeat > 30 * n
                    content = 1.0
                    if chain is not None and n:
                        x, words = line_features(data)
                        content = float(words[chain.viterbi(x) == 0].sum() / words.sum())
                    row = (n, chars, symbols, dup, repeat, failed, not failed and content >= share, content)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *map(pa.array, cols)],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return judge(docs, fit_chain(docs, read(spark, sf_dir, "labels")))
