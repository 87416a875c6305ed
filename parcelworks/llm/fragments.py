"""Rows of packed 64-bit names, dealt to fragments and read in document order.

A document sends each fragment one row with its names there as bytes, so a shuffle
moves 8 bytes a name. A fragment is read sorted by doc_id: a name met before, in
a smaller document, is repeated. Memory holds a fragment's distinct names, never
a name's occurrences, whatever share of documents has it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text to a fragment; its names take a fraction of that.
FRAGMENT_BYTES = 32_000_000
LEAST_FRAGMENTS = 24
DEALT = "frag int, doc_id long, names binary"
FOUND = "doc_id long, names binary"


def fragment_count(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LEAST_FRAGMENTS, math.ceil(size / FRAGMENT_BYTES))


def binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary array of runs of 8-byte values; ``starts`` with the end appended."""
    return pa.Array.from_buffers(
        pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))]
    )


def deal(doc_ids: np.ndarray, owner: np.ndarray, names: np.ndarray, fragments: int) -> pa.RecordBatch:
    """(frag, doc_id, names): ``owner`` is the place in doc_ids of each name."""
    frag = (names % np.uint64(fragments)).astype(np.int64)
    key = owner.astype(np.int64) * fragments + frag
    order = np.argsort(key, kind="stable")
    key, names = key[order], names[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array((key[starts] % fragments).astype(np.int32)), pa.array(doc_ids[key[starts] // fragments]), binary(names, np.append(starts, len(names)))],
        names=["frag", "doc_id", "names"],
    )


def group(docs: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
    """(doc_id, names) from pairs."""
    order = np.argsort(docs, kind="stable")
    docs, names = docs[order], names[order]
    starts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(docs[starts]), binary(names, np.append(starts, len(names)))], names=["doc_id", "names"])


def names_of(value: bytes) -> np.ndarray:
    return np.frombuffer(value, np.uint64)


class Seen:
    """Names of a fragment met so far, with the first document of each."""

    def __init__(self) -> None:
        self.names, self.first, self.told = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, docs: np.ndarray, names: np.ndarray, tell_first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (document, name) of names that a smaller document has; with
        ``tell_first`` also the first document's, once. Documents don't fall."""
        order = np.argsort(names, kind="stable")
        names, docs = names[order], docs[order]
        new = np.concatenate([[True], names[1:] != names[:-1]])
        distinct, group = names[new], np.cumsum(new) - 1
        at = np.searchsorted(self.names, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.names)
        known[inside] = self.names[at[inside]] == distinct[inside]
        first = docs[new].copy()
        first[known] = self.first[at[known]]
        later = docs > first[group]
        out_docs, out_names = docs[later], names[later]
        told = np.zeros(len(distinct), bool)
        told[known] = self.told[at[known]]
        if tell_first:
            repeated = np.zeros(len(distinct), bool)
            repeated[group[later]] = True
            fresh = repeated & ~told
            out_docs, out_names = np.concatenate([out_docs, first[fresh]]), np.concatenate([out_names, distinct[fresh]])
            told |= repeated
            self.told[at[known]] = told[known]
        put = np.searchsorted(self.names, distinct[~known])
        self.names = np.insert(self.names, put, distinct[~known])
        self.first = np.insert(self.first, put, first[~known])
        self.told = np.insert(self.told, put, told[~known])
        return out_docs, out_names


def repeated(dealt: DataFrame, fragments: int, tell_first: bool, chunk: int = 300_000) -> DataFrame:
    """(doc_id, names) of the names that a smaller document also has; with
    ``tell_first`` the smallest document gets its row too."""

    def run(batches):
        seen, frag, docs, names, held = Seen(), None, [], [], 0

        def flush():
            nonlocal docs, names, held
            if docs:
                got = seen.add(np.concatenate(docs), np.concatenate(names), tell_first)
                docs, names, held = [], [], 0
                if len(got[0]):
                    yield group(*got)

        for b in batches:
            frags, ids, values = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1] // 8
            flat = np.frombuffer(values.buffers()[2], np.uint64) if ends[-1] else np.zeros(0, np.uint64)
            cuts = np.flatnonzero(np.concatenate([[True], frags[1:] != frags[:-1]])) if len(frags) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(frags)], strict=True):
                if frags[lo] != frag:
                    yield from flush()
                    seen, frag = Seen(), frags[lo]
                docs.append(np.repeat(ids[lo:hi], np.diff(ends[lo : hi + 1])))
                names.append(flat[ends[lo] : ends[hi]])
                held += len(names[-1])
                if held >= chunk:
                    yield from flush()
        yield from flush()

    put = dealt.repartition(fragments, "frag").sortWithinPartitions("frag", "doc_id")
    return put.mapInArrow(run, FOUND)
