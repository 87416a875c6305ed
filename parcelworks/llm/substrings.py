"""Exact substring deduplication by recompression.

A text's words are symbols. A round names runs of one symbol, then pairs of a
symbol of the left class with one of the right class, the class being a bit of
the name. Names are 64-bit hashes of what they stand for, hence the same in every
document and task, and a round needs no table. Inside equal substrings all
symbols are equal but for those at the edges, where the text around may join in:
the first and last run, and a symbol that could pair outwards. What remains of a
window after each round is known from the window alone. The widest symbol of the
last round that leaves one is the window's anchor, so equal windows have equal
anchors (a window of too few runs is its own).

Documents deal their anchors to fragments; anchors that another document has are
candidates. Only windows with such an anchor are compared, by the hash of their
words; a window that starts in a smaller document too is removed.

Defined results: null text has no words; with a null doc_id nothing is removed;
rows that share a doc_id are one document, so neither removes from the other;
ties can't arise; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _COEF, mix64, read, text_bytes, window_hashes
from .fragments import DEALT, deal, fragment_count, names_of, repeated

WINDOW, ROUNDS = 13, 2
#: Documents whose words are worked on together.
SLICE = 128
_A, _B, _RUN = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_BITS = np.uint64(63)


def _times(k: int, x: np.uint64) -> np.uint64:
    return np.uint64(k * int(x) & 0xFFFFFFFFFFFFFFFF)


def _right(names: np.ndarray, level: int) -> np.ndarray:
    """Whether a symbol is of the right class in this round."""
    return (mix64(names + _times(level, _RUN)) >> _BITS).astype(bool)


def _widest(names: np.ndarray, width: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The widest symbol of each names[lo:hi], by hash on ties: its width with 48 bits of
    its name. A span is covered by two of the largest power of two that fits."""
    best = [(np.minimum(width, 0xFFFF).astype(np.uint64) << np.uint64(48)) | (names >> np.uint64(16))]
    size = hi - lo
    for step in 1 << np.arange(int(size.max(initial=1)).bit_length() - 1):
        wide = best[-1].copy()
        np.maximum(wide[:-step], wide[step:], out=wide[:-step])
        best.append(wide)
    power = np.frexp(size.astype(np.float32))[1] - 1
    row = power * np.int64(len(names))
    best = np.concatenate(best)
    return np.maximum(best[row + lo], best[row + hi - (1 << power.astype(np.int64))])


def _hashes_at(names: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """``window_hashes`` of the windows at some places."""
    out = np.zeros(len(at), np.uint64)
    for j in range(window):
        out += names[at + j] * _COEF[j]
    return mix64(out)


def anchors(names: np.ndarray, width: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> np.ndarray:
    """The anchor of the window at each place. ``width``: characters of a word."""
    n = len(names) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words, out = names, np.zeros(n, np.uint64)
    live, lo, hi = np.arange(n), np.arange(n), np.arange(window, n + window)
    for level in range(rounds):
        # runs
        begin = np.concatenate([[True], names[1:] != names[:-1]])
        starts = np.flatnonzero(begin)
        size = np.diff(np.append(starts, len(names)))
        joined = names[starts]
        more = np.flatnonzero(size > 1)
        joined[more] = mix64(joined[more] * _A + size[more].astype(np.uint64) * _RUN)
        wide = np.add.reduceat(width, starts)
        # pairs
        right = _right(joined, level)
        head = np.flatnonzero(~right[:-1] & right[1:])
        keep = np.ones(len(joined), bool)
        keep[head + 1] = False
        place = np.cumsum(keep) - 1
        pairs = joined.copy()
        pairs[head] = mix64(joined[head] * _A + joined[head + 1] * _B + np.uint64(level + 1))
        wide[head] += wide[head + 1]
        # What remains of a window by its first and its last run: without these, and without
        # a right symbol that is first or a left one that is last then.
        place = np.append(place, place[-1] + 1)
        right = np.append(right, False).astype(np.int64)
        k = np.arange(len(joined))
        first = place[np.minimum(k + 1 + right[1:], len(joined))]
        last = place[np.maximum(k - 2 + right[k - 1], 0)] + 1
        last[:2] = [0, right[0]][: len(last)]
        run = np.cumsum(begin) - 1
        to_lo, to_hi = first[run][lo], last[run][hi - 1]
        ok = to_hi > to_lo
        gone = ~ok
        if level:
            out[live[gone]] = mix64(_widest(names, width, lo[gone], hi[gone]) + _times(level, _B))
        else:
            out[gone] = _hashes_at(words, np.flatnonzero(gone), window)
        live, lo, hi = live[ok], to_lo[ok], to_hi[ok]
        names, width = pairs[keep], wide[keep]
        if not len(live):
            return out
    out[live] = mix64(_widest(names, width, lo, hi) + _times(rounds, _B))
    return out


def word_names(words: list[bytes]) -> np.ndarray:
    """As ``common.word_names``: to name a word again is faster than to look it up."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
    """Names and widths of all texts' words with a separator of its own after each
    text, the text of each, and the words."""
    split = [text_bytes(t).split() for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(w) + 1 for w in split])
    names = np.empty(len(owner), np.uint64)
    width = np.ones(len(owner), np.int64)
    at = 0
    for i, words in enumerate(split):
        n = len(words)
        names[at : at + n] = word_names(words)
        width[at : at + n] = np.fromiter(map(len, words), np.int64, n)
        names[at + n] = mix64(np.array([i + 1], np.uint64) * _RUN)[0]
        at += n + 1
    return names, width, owner, split


def _inside(owner: np.ndarray, window: int) -> np.ndarray:
    """Windows that lie in one text, without its separator."""
    n = len(owner) - window
    ok = np.zeros(max(0, n + 1), bool)
    if n <= 0:  # at most one window, and it would hold the last separator
        return ok
    ok[:n] = owner[:n] == owner[window : window + n]
    return ok


def slices(batches, rows: int = SLICE):
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fragments = fragment_count(rows)

    def first(batches):
        for part in slices(batches):
            names, width, owner, _ = joined(part.column(1).to_pylist())
            found = anchors(names, width, window)
            ok = _inside(owner, window)
            ok[1:] &= (found[1:] != found[:-1]) | ~ok[:-1]
            at = np.flatnonzero(ok)
            yield deal(part.column(0).to_numpy(), owner[at], found[at], fragments)

    known = rows.where("doc_id IS NOT NULL AND text IS NOT NULL")
    shared = repeated(known.mapInArrow(first, DEALT), fragments, tell_first=True)
    shared = shared.groupBy("doc_id").agg(F.collect_list("names").alias("names"))

    def second(batches):
        for part in slices(batches):
            names, width, owner, _ = joined(part.column(1).to_pylist())
            found = anchors(names, width, window)
            at = np.flatnonzero(_inside(owner, window))
            wanted = [b"".join(v) for v in part.column(2).to_pylist()]
            number = np.repeat(np.arange(1, len(wanted) + 1, dtype=np.uint64), [len(w) // 8 for w in wanted])
            mine = mix64(names_of(b"".join(wanted)) ^ mix64(number))
            ask = mix64(found[at] ^ mix64((owner[at] + 1).astype(np.uint64)))
            # Windows side by side often have one anchor: it is sought once.
            new = np.concatenate([[True], ask[1:] != ask[:-1]])[: len(ask)]
            at = at[np.isin(ask[new], mine)[np.cumsum(new) - 1]]
            yield deal(part.column(0).to_numpy(), owner[at], _hashes_at(names, at, window), fragments)

    candidates = known.join(shared, "doc_id").select("doc_id", "text", "names")
    again = repeated(candidates.mapInArrow(second, DEALT), fragments, tell_first=False)
    again = again.groupBy("doc_id").agg(F.collect_list("names").alias("names"))

    def last(batches):
        for part in slices(batches):
            n_words, n_removed, sha = [], [], []
            for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                words = text_bytes(text).split()
                n_words.append(len(words))
                if found:
                    bad = np.isin(window_hashes(word_names(words), window), np.concatenate([names_of(x) for x in found]))
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = np.flatnonzero(bad)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    words = [w for w, g in zip(words, gone, strict=True) if not g]
                n_removed.append(n_words[-1] - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    # Both joins deal out the same texts by doc_id: one exchange serves them.
    every = known.join(again, "doc_id", "left").select("doc_id", "text", "names")
    rest = rows.where("doc_id IS NULL OR text IS NULL").withColumn("names", F.lit(None).cast("array<binary>"))
    kept = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return every.mapInArrow(last, kept).unionByName(rest.mapInArrow(last, kept))


def op10_substrings(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))
