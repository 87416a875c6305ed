"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is split into pre-tokens by a pattern, and each pre-token is merged by rank
on its own. Where a match starts depends only on the text from there on: two
pre-tokenisations that share one boundary agree ever after. So long texts are cut
into chunks that overlap; tasks pre-tokenise the chunks in parallel, each from its
own start; two neighbours are stitched at the first boundary that both have in
their overlap. The text between two stitches is a piece, which is encoded like a text,
also in parallel, and a text's ids are its pieces' ids in order. A short text is
one chunk and needs no stitch.

A text with an overlap that holds no common boundary (one pre-token reaches over
it) goes through another turn with chunks and overlaps ``GROWTH`` times as long, until
its boundaries meet or it is one chunk: nothing is approximate.

Decoding concatenates the raw bytes of the ids.

Defined results: a null text is the empty text, which has no ids; repeated rows and
repeated doc_ids are separate texts; null ids are kept; an empty table gives an
empty one; extra columns are ignored; texts of any length are encoded whole, as far
as their ids fit one value (2 GB); runs of white space too long for the library's
matcher are pre-tokenised by this module. Special tokens' strings are ordinary text.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, materialise, read

RANKS = "byte_bpe_50k.tiktoken"
#: Characters of a chunk before its overlap with the next, and of the overlap.
WIDTH, OVERLAP, GROWTH = 16_384, 1024, 8
#: Characters that a match may have looked at beyond its end ('re, a blank run's end).
AHEAD = 4
#: White space in one run that the library's matcher takes without recursing too deep.
BLANKS = 10_000


class Codec:
    """Ids of texts and bytes of ids for one file of ranks and one pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        import base64

        import regex
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.blank_run = regex.compile(rf"\s{{{BLANKS}}}").search
        self.merge = self.library._core_bpe.encode_single_piece

    def ids(self, text: str) -> list[int]:
        if len(text) >= BLANKS and self.blank_run(text):
            return [i for token in self.pattern.findall(text) for i in self.merge(token.encode())]
        return self.library.encode_ordinary(text)

    def bytes(self, ids: Iterable[int]) -> bytes:
        return self.library.decode_bytes(ids)

    def starts(self, text: str) -> list[int]:
        """Where matches start, by a run over ``text`` from its first character."""
        return [m.start() for m in self.pattern.finditer(text)]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    """One a process; by default of the installed package's file and pattern."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def little_endian(ids: list[int]) -> bytes:
    out = array("I", ids)
    if array("I", [1]).tobytes()[0] != 1:
        out.byteswap()
    return out.tobytes()


def from_little_endian(ids: bytes) -> list[int]:
    out = array("I", ids)
    if array("I", [1]).tobytes()[0] != 1:
        out.byteswap()
    return out.tolist()


def chunks(texts: DataFrame, width: int, overlap: int) -> DataFrame:
    """row, k, last, part: ``texts`` (row, text) cut every ``width`` characters, each
    chunk with ``overlap`` characters of the next."""

    def run(batches):
        for b in batches:
            for row, text in zip(b.column("row"), b.column("text"), strict=True):
                text = text.as_py()
                n = max(1, -(-(len(text) - overlap) // width))
                for k in range(n):
                    part = text[k * width : (k + 1) * width + overlap]
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()], pa.int64()), pa.array([k], pa.int32()), pa.array([k == n - 1]), pa.array([part], pa.string())], names=["row", "k", "last", "part"])

    return texts.select("row", "text").mapInArrow(run, "row long, k int, last boolean, part string")


def overlap_boundaries(parts: DataFrame, width: int, overlap: int, path: str | None, pattern: str | None) -> DataFrame:
    """row, k, heads, tails: each chunk's boundaries within its overlaps with the
    chunk before (from its own start) and after (from that one's start). Matches
    that may have looked beyond the chunk's end are left out."""

    def run(part: dict[str, list]) -> dict[str, list]:
        found = [codec(path, pattern).starts(t) for t in part["part"]]
        sure = [len(t) if last else len(t) - AHEAD for t, last in zip(part["part"], part["last"], strict=True)]
        heads = [[s for s in at if s < overlap and s <= end] for at, end in zip(found, sure, strict=True)]
        tails = [[s - width for s in at if width <= s <= end] for at, end in zip(found, sure, strict=True)]
        return {"row": part["row"], "k": part["k"], "heads": heads, "tails": tails}

    return map_rows(parts, run, "row long, k int, heads array<int>, tails array<int>", rows=64)


def stitches(found: DataFrame, width: int) -> DataFrame:
    """row, k, start, stop, fine: the piece that each chunk owns, counted from the
    chunk's start; ``fine`` is false for all of a text with a missing stitch."""
    chain, text = Window.partitionBy("row").orderBy("k"), Window.partitionBy("row")
    common = F.array_min(F.array_intersect(F.lag("tails").over(chain), "heads"))
    cut = found.select("row", "k", F.when(F.col("k") == 0, F.lit(0)).otherwise(common).alias("start"))
    stop = F.lead("start").over(chain) + F.lit(width)
    return cut.select("row", "k", "start", stop.alias("stop"), F.min(F.col("start").isNotNull()).over(text).alias("fine"))


def _encode_short(texts: DataFrame, path: str | None, pattern: str | None) -> DataFrame:
    def run(part: dict[str, list]) -> dict[str, list]:
        ids = list(map(codec(path, pattern).ids, part["text"]))
        return {"doc_id": part["doc_id"], "n_tokens": list(map(len, ids)), "ids": list(map(little_endian, ids))}

    return map_rows(texts.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids binary")


def _encode_pieces(parts: DataFrame, where: DataFrame, path: str | None, pattern: str | None) -> DataFrame:
    def run(part: dict[str, list]) -> dict[str, list]:
        own = [t[a:b] for t, a, b in zip(part["part"], part["start"], part["stop"], strict=True)]
        return {"row": part["row"], "k": part["k"], "ids": [little_endian(codec(path, pattern).ids(t)) for t in own]}

    return map_rows(parts.join(where, ["row", "k"]).select("row", "k", "part", "start", "stop"), run, "row long, k int, ids binary", rows=64)


def _in_order(pieces: DataFrame) -> DataFrame:
    """One row a text; a group is the ids of one text."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("k")
        ids = b"".join(x.as_py() for x in group.column("ids"))
        return pa.table({"row": group.column("row")[:1], "n_tokens": pa.array([len(ids) // 4], pa.int64()), "ids": pa.array([ids], pa.binary())})

    return pieces.groupBy("row").applyInArrow(run, "row long, n_tokens long, ids binary")


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, width: int = WIDTH, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit). ``docs``: doc_id, text;
    ``path``: the file of ranks on every executor."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    is_long = F.char_length("text") > width + overlap
    out = _encode_short(texts.where(~is_long), path, pattern)
    # Written once, so that the rows' numbers are fixed.
    left = materialise(texts.where(is_long).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    todo = left
    while not todo.isEmpty():
        parts = chunks(todo, width, overlap)
        spread = parts.repartition("row", "k")
        where = materialise(stitches(overlap_boundaries(spread, width, overlap, path, pattern), width), "stitches")
        done = _in_order(_encode_pieces(parts, where.where("fine"), path, pattern))
        out = out.unionByName(left.select("row", "doc_id").join(done, "row").select("doc_id", "n_tokens", "ids"))
        todo = left.join(where.where("k = 0 AND NOT fine").select("row"), "row", "left_semi")
        width, overlap = width * GROWTH, overlap * GROWTH
    return out


def decode(tokens: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``tokens`` (doc_id, n_tokens, ids) with ``bytes``: the ids' raw bytes."""

    def run(part: dict[str, list]) -> dict[str, list]:
        return part | {"bytes": [codec(path, pattern).bytes(from_little_endian(x)) for x in part["ids"]]}

    return map_rows(tokens.select("doc_id", "n_tokens", "ids"), run, "doc_id long, n_tokens long, ids binary, bytes binary")


def op12_bytepair(spark, sf_dir: str) -> DataFrame:
    got = decode(encode(read(spark, sf_dir, "documents")))
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
