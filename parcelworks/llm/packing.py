"""Best-fit packing by minimum bin slack.

Documents become token ids; each gets id 0 at its end and is cut into pieces of
``width`` tokens only if longer. Pieces are packed by length alone: the table of
lengths has at most ``width`` rows whatever the corpus, so one process plans the
bins. Per bin, a bitset subset-sum dynamic programme over the lengths still
available finds the fullest combination with the longest piece; it is used as
often as the counts allow, then removed. A plan is a list of rank ranges per
length; pieces find their place by rank within their length, and ranks come from
salted counts, so that one frequent length is spread over many tasks.

Defined results: null or empty text is the single id 0; repeated rows and
repeated doc_ids are separate documents; an empty table gives an empty result;
extra columns are ignored; texts of any length are tokenised whole.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, materialise, read, text_bytes

WIDTH = 2048
SALTS = 256
TOKENIZER = "word_bpe_49k.json"


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character: itself
    where printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in plain):
        out[chr(256 + n)] = b
    return out


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes. The tokenizer drops white
    space and never joins over it, so the ids of a text are those of its words in
    turn; the ids of short words are kept until ``limit`` words are held.

    A new word of plain letters and signs is cut as the tokenizer's pattern does
    and merged by the same ranks in a second, faster library: a byte that no text
    has stands for the end of a word. All others go through the tokenizer."""

    limit, longest = 150_000, 48
    end = b"\xff"

    def __init__(self, path: str) -> None:
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        suffix, byte = spec["model"]["end_of_word_suffix"], _byte_of_char()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {}
        for token, rank in spec["model"]["vocab"].items():
            if token not in special:
                last = bool(suffix) and token.endswith(suffix)
                plain = token[: -len(suffix)] if last else token
                ranks[bytes(byte[c] for c in plain) + self.end * last] = rank
        ranks[self.end] = len(spec["model"]["vocab"])
        found = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.cut = regex.compile(found).findall
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def slow(self, word: bytes) -> bytes:
        got = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False)
        return array("I", got.ids).tobytes()

    def word(self, word: bytes) -> bytes:
        """Below U+0180 normalisation changes nothing and lower case is plain, but
        for U+0130."""
        if len(word) > 2000 or b"<|" in word:
            return self.slow(word)
        text = word.decode("utf-8", "replace")
        if max(text) >= "\u0180" or "\u0130" in text:
            return self.slow(word)
        text = text.lower()
        if text.isalpha():
            return array("I", self.merge(text.encode() + self.end)).tobytes()
        ids = array("I")
        for part in self.cut(text):
            ids.extend(self.merge(part.encode() + self.end))
        return ids.tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        known, one, longest, out = self.known, self.word, self.longest, []
        for text in texts:
            words = text_bytes(text).split()
            if len(known) > self.limit:
                known.clear()
            long = {}
            for w in set(words).difference(known):
                if len(w) > longest:
                    long[w] = one(w)
                else:
                    known[w] = one(w)
            if long:
                out.append(b"".join([long[w] if w in long else known[w] for w in words]))
            else:
                out.append(b"".join(map(known.__getitem__, words)))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str | None = None, width: int = WIDTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32. ``path``: the tokenizer's file on
    every executor; by default each finds it in the installed package."""

    def cut(part: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc_id, ids in zip(part["doc_id"], encoder(path or tokenizer_path()).encode(part["text"]), strict=True):
            ids += b"\0\0\0\0"
            for k, at in enumerate(range(0, len(ids), 4 * width)):
                one = ids[at : at + 4 * width]
                for key, value in zip(out, (doc_id, k, at // 4, len(one) // 4, zlib.crc32(one)), strict=True):
                    out[key].append(value)
        return out

    return map_rows(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), cut,
        "doc_id long, piece int, start long, length long, ids_crc32 long",
    )


def fullest(counts: dict[int, int], lengths: list[int], width: int) -> dict[int, int]:
    """The fullest combination that holds the longest available length.
    ``lengths``: those with a count, longest first."""
    first = lengths[0]
    room = width - first
    if not room:
        return {first: 1}
    reach, steps, goal = 1, [], 1 << room
    mask = (goal << 1) - 1
    for length in lengths:
        if length > room:
            continue
        left = min(counts[length] - (length == first), room // length)
        many = 1
        while left > 0:
            take = min(many, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            many *= 2
        if reach & goal:
            break
    at = reach.bit_length() - 1
    used = {first: 1}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def plan(histogram: Iterable[tuple[int, int]], width: int = WIDTH) -> dict[str, np.ndarray]:
    """Rank ranges: pieces of ``length`` with ranks from ``rank`` on go, ``mult``
    to a bin, to bins from ``bin`` on, at ``offset``."""
    counts = {int(k): int(n) for k, n in histogram if n}
    lengths = sorted(counts, reverse=True)
    used, bins, rows = dict.fromkeys(counts, 0), 0, []
    while lengths:
        one = fullest(counts, lengths, width)
        times = min(counts[k] // n for k, n in one.items())
        offset = 0
        for k, n in one.items():
            rows.append((k, used[k], n, bins, offset))
            used[k] += n * times
            counts[k] -= n * times
            offset += n * k
        bins += times
        lengths = [k for k in lengths if counts[k]]
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "mult", "bin", "offset"), table.T, strict=True))


def pack(table: DataFrame, width: int = WIDTH) -> DataFrame:
    """``table`` (materialised pieces with a ``length``) with sequence_id, offset."""
    salted = table.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    per = materialise(salted.groupBy("length", "_salt").count(), "lengths")
    histogram = per.groupBy("length").agg(F.sum("count").alias("n")).collect()  # at most ``width`` rows
    where = plan([(r["length"], r["n"]) for r in histogram], width)
    ahead = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("length", "_salt", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_in", F.row_number().over(within) - 1).join(per, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_in") + F.col("_ahead"))
    cols = table.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema) + ", sequence_id long, offset long"
    wide = np.int64(1) << np.int64(44)
    keys = where["length"] * wide + where["rank"]

    def place(batches):
        for b in batches:
            length, rank = (b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "_rank"))
            i = np.searchsorted(keys, length * wide + rank, side="right") - 1
            over = rank - where["rank"][i]
            seq = where["bin"][i] + over // where["mult"][i]
            off = where["offset"][i] + over % where["mult"][i] * length
            names = [*cols, "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(seq), pa.array(off)], names=names)

    return ranked.select(*cols, "_rank").mapInArrow(place, schema)


def packed(docs: DataFrame, path: str | None = None, width: int = WIDTH) -> DataFrame:
    return pack(materialise(pieces(docs, path, width), "pieces"), width)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))
