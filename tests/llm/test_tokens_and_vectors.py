"""Centroids, byte-pair encoding and vector codes against brute force."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelworks.llm import bytepair, centroids, codes

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_nearest(points, centres):
    d = ((points[:, None, :] - centres[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


def floor_means(points, label, centres):
    out = centres.copy()
    for c in set(label.tolist()):
        mine = points[label == c]
        out[c] = [int(s) // len(mine) for s in mine.sum(0)]
    return out


def odd_rows(dim):
    nan, inf = float("nan"), float("inf")
    return [(900, None, 1), (901, [nan] * dim, 1), (902, [inf] + [0.0] * (dim - 1), 1), (903, [None] * dim, 2), (904, [], 2)]


# --- 11 -------------------------------------------------------------------------------------

def test_sort_means_is_exact_and_skips_distances():
    rng = np.random.default_rng(3)
    middle = rng.integers(-200, 200, (9, 8))
    points = (middle[rng.integers(0, 9, 600)] + rng.integers(-12, 12, (600, 8))).astype(np.float64)
    centres = np.concatenate([middle, middle[:2], middle[3:4] + 2]).astype(np.float64)  # ties: equal centroids
    last, near = rng.integers(0, 12, 600), brute_nearest(points, centres)[0]
    for start in (last, near):
        label, far, taken = centroids.sort_means(points, centres, start)
        want = brute_nearest(points, centres)
        assert np.array_equal(label, want[0]) and np.array_equal(far, want[1])
    assert taken < 600 * 12 / 2


@pytest.mark.parametrize("kind", [np.float64, np.int64])
def test_a_centroid_exactly_twice_as_far_is_still_scanned(kind):
    points, centres = np.array([[0, 0]], kind), np.array([[2, 0], [-2, 0], [0, 2]], kind)
    assert centroids.sort_means(points, centres, np.array([2]))[:2] == (np.array([0]), np.array([4]))


def test_centroids(spark):
    rng = np.random.default_rng(5)
    v = (rng.standard_normal((200, 64)) / 4).astype(np.float32)
    v[20:60] = v[20]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + odd_rows(64) + [(905, [1.0] * 63, 0)]
    rows += rows[:30] + [(None, v[3].tolist(), 0)]
    table = spark.createDataFrame(rows, VECTORS).repartition(3).withColumns({"cluster": F.lit("x"), "v": F.lit(1), "distance": F.lit(2)})
    kept = [(i, e) for i, e, _ in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    points = np.array([[math.floor(256 * float(np.float32(x))) for x in e] for _, e in kept])
    place = [(i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest(), p.tolist()) for (i, _), p in zip(kept, points, strict=True)]
    centres = points[sorted(range(len(kept)), key=place.__getitem__)[:40]]
    for _ in range(5):
        centres = floor_means(points, brute_nearest(points, centres)[0], centres)
    label, far = brute_nearest(points, centres)
    want = sorted((-1 if i is None else i, int(c), int(d), int(far[label == c].sum()), int(far.sum()), centres[c].tolist()) for (i, _), c, d in zip(kept, label, far, strict=True))
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in centroids.cluster(table).collect())
    assert got == want
    assert centroids.cluster(table.limit(0)).count() == 0
    few = centroids.cluster(table.where("vec_id IN (1, 2)")).collect()
    assert {r["distance"] for r in few} == {0} and len({r["cluster"] for r in few}) == 2


def test_components_too_large_for_a_long(spark):
    table = spark.createDataFrame([(1, [1e30] * 64, 0)], VECTORS)
    with pytest.raises(ValueError, match="too large"):
        centroids.cluster(table)
    exact = spark.createDataFrame([(i, [float(i * 100_000)] * 64, 0) for i in range(3)], VECTORS)
    assert {r["distance"] for r in centroids.cluster(exact, k=3).collect()} == {0}


# --- 12 -------------------------------------------------------------------------------------

def odd_texts():
    rng = random.Random(8)
    signs = ["a", "é", "Ж", "漢", "\U0001f600", " ", "  ", "\n", "\t ", "'ll", "'re", "'s", "'", "1", "٣", "!", "…", "̀", " ", "\x1c"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 400))) for _ in range(40)]
    texts += ["x" * 3000, " " * 3000, "don't " * 300, ("'" * 7 + "ll") * 200, "ab  \n " * 300 + "end", "word " * 100 + "y" * 900 + " word" * 100, "<|endoftext|> a"]
    return texts


def test_bytepair(spark):
    texts = [*odd_texts(), "", None, "\n", "a"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] * 2 + [(None, "no id " * 200, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3).withColumns({"row": F.lit(1), "k": F.lit("x"), "bytes": F.lit(2)})
    library = bytepair.codec().library
    want = sorted((-1 if i is None else i, ids := library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows)
    for width, overlap in ((64, 8), (128, 128), (bytepair.WIDTH, bytepair.OVERLAP)):
        got = bytepair.decode(bytepair.encode(table, width=width, overlap=overlap)).collect()
        assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in got)
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], bytepair.from_little_endian(bytes(r["ids"])), bytes(r["bytes"])) for r in got) == want
    assert bytepair.decode(bytepair.encode(table.limit(0))).count() == 0


def test_runs_that_the_library_cannot_match():
    codec = bytepair.codec()
    blank = " " * 1_200_000
    ids = codec.ids(f"a{blank}b")
    assert codec.bytes(ids) == f"a{blank}b".encode() and ids[-1:] == codec.ids(" b")
    run = "a" + " \n" * bytepair.BLANKS + "b"
    assert codec.ids(run) == codec.library.encode_ordinary(run)


def test_pattern_has_the_library_s_classes():
    """Each character beside a letter, a digit, a sign and blanks."""
    codec = bytepair.codec()
    for at in range(0, 0x110000, 1):
        if at % 7 == 0 and not 0xD800 <= at < 0xE000 or at < 0x3000:
            s = f"x{chr(at)}1{chr(at)}!{chr(at)}  y"
            assert [i for token in codec.pattern.findall(s) for i in codec.merge(token.encode())] == codec.library.encode_ordinary(s), hex(at)


# --- 13 -------------------------------------------------------------------------------------

def test_partial_distance_is_exact_and_skips_terms():
    rng = np.random.default_rng(6)
    middle = rng.integers(-300, 300, (32, 16))
    points = (middle[rng.integers(0, 32, 500)] + rng.integers(-9, 9, (500, 16))).astype(np.int32)
    book = np.concatenate([middle, middle[:3]]).astype(np.int32)
    entry, far, taken = codes.partial_distance(points, book, rng.integers(0, 35, 500))
    want = brute_nearest(points.astype(np.int64), book.astype(np.int64))
    assert np.array_equal(entry, want[0]) and np.array_equal(far, want[1]) and taken < 500 * 35 * 16 / 2  # each has one near entry
    near = np.array([[1, 1, 1, 1]], np.int32)  # all four are equally far
    corners = np.array([[2, 1, 1, 1], [1, 2, 1, 1], [1, 1, 1, 2], [1, 1, 1, 0]], np.int32)
    assert codes.partial_distance(near, corners, np.array([3]))[0].tolist() == [0]
    assert codes.partial_distance(points[:0], book, np.zeros(0, int))[0].size == 0


def test_codes(spark):
    rng = np.random.default_rng(7)
    v = (rng.standard_normal((420, 16)) / 4).astype(np.float32)
    v[50:90] = v[50]
    rows = [(i, x.tolist(), None if i % 5 == 0 else i % 3) for i, x in enumerate(v)] + odd_rows(16)[:4] + [(904, [1.0, 2.0], 9)]
    rows += rows[:20] + [(None, v[3].tolist(), 1)]
    table = spark.createDataFrame(rows, VECTORS).repartition(3).withColumns({"code": F.lit("x"), "error": F.lit(1), "of": F.lit(2)})
    kept = [(i, e, n) for i, e, n in rows if e is not None and len(e) == 16 and all(x is not None and math.isfinite(x) for x in e)]
    points = np.array([[math.floor(1024 * float(np.float32(x))) for x in e] for _, e, _ in kept])
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, points[k].tolist()))[:256]
    books = [points[first, p * 4 : p * 4 + 4] for p in range(4)]
    for turn in range(5):
        found = [brute_nearest(points[:, p * 4 : p * 4 + 4], books[p]) for p in range(4)]
        if turn < 4:
            books = [floor_means(points[:, p * 4 : p * 4 + 4], found[p][0], books[p]) for p in range(4)]
    code, error = np.stack([f[0] for f in found], 1), sum(f[1] for f in found)
    coded, got_books = codes.compress(table)
    assert all(np.array_equal(a, b) for a, b in zip(got_books, books, strict=True))
    want = sorted([(-1 if i is None else i, c.tolist(), int(d)) for (i, _, _), c, d in zip(kept, code, error, strict=True)] + [(904, None, None)], key=str)
    assert sorted([(-1 if r["vec_id"] is None else r["vec_id"], r["code"], r["error"]) for r in coded.collect()], key=str) == want
    back = {r["vec_id"]: r["embedding"] for r in codes.decompress(coded, got_books).collect()}
    assert back[7] == [x / 1024 for p in range(4) for x in books[p][code[7, p]].tolist()] and back[904] is None
    nothing, none = codes.compress(table.limit(0))
    assert nothing.count() == 0 and none == []


def test_codes_of_a_length_that_parts_do_not_divide(spark):
    table = spark.createDataFrame([(i, [float(i), 0.5, -0.5, 1.0, 2.0, float(-i)], 0) for i in range(6)], VECTORS)
    coded, books = codes.compress(table)
    assert [b.shape for b in books] == [(6, 1), (6, 2), (6, 1), (6, 2)] and {r["error"] for r in coded.collect()} == {0}
