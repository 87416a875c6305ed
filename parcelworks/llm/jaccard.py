"""N-gram Jaccard join by vertical partitioning.

A document is the set of its word 5-grams, as 64-bit names in one global order:
grams that many documents hold last, the rest by name. The order is cut into
fragments; a set sends each fragment the part of itself that falls there. A set has
a 64-bit name of its own, and all work is on sets: equal texts are one.

1. A survey names every set, counts grams, and signs each set with a parity bitmap
   of its grams; two sets differ in at least as many grams as their bitmaps in bits.
2. Two sets that link share a gram within their prefixes (the first grams of the
   order, as many as may differ). Prefixes go to fragments by gram; there, sets
   that share a prefix gram, may reach the threshold by their sizes and by the
   places of that gram, become candidate pairs. A gram's list of few sets gives
   all pairs; of a longer one each set is paired with its next ``NEAR`` in order
   of size and with the ``CENTRAL`` sets of its size class that have the fewest
   rarer grams, so a large group of near copies gives a number of pairs in
   proportion to its size. Pairs whose bitmaps differ too much can't link and go.
3. Candidates' whole sets go to fragments; each counts the overlap of its part of
   every pair, and the counts are summed per pair: the exact intersection. Fragments
   are ``PARTS`` parts of the order times groups of pairs, so a pair is sent ``PARTS``
   times, however large the corpus.
4. Linked pairs give components. In long lists, pairs of sets that are now in one
   component need no test; all others are compared by bitmap, in blocks of bounded
   size, and what passes is counted in a second turn, which makes the components
   exact. Lists, links and components stay distributed.

The frequency part of the order comes from counts over all documents, of which the
``HEAVY`` most frequent grams are kept: the order decides speed only, not results.
The ``COPIED`` sets of most copies are known to every task, which deals such a set
once only; copies of any other set meet in its fragments.

Defined results: a null, empty or wordless text has an empty set and is its own
component; rows that share a doc_id are one document with the union of the links
of their sets; a null doc_id takes no part and gets a null component; extra
columns are ignored; texts of any length are used whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bounds, discard, materialise, mix64, read, text_bytes, window_hashes, word_names
from .fragments import fragment_count

SHINGLE = 5
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Frequent grams that the order knows: at most 8 bytes each go to every task.
HEAVY, HEAVY_DOCS = 400_000, 8
#: Sets of most copies that every task knows, 16 bytes each.
COPIED, COPIES = 4096, 4
NEAR, CENTRAL = 8, 3
#: Parts of the order in which overlaps are counted, and grams of a part of a group.
PARTS, PART_GRAMS = 8, 1_000_000
#: Sets of a block of a long list in the second turn.
BLOCK = 1024
#: Up to so many grams of many pairs (16 bytes each) are broadcast.
BROADCAST_HOT = 20_000
#: Grams that a task holds before it passes on its counts.
HELD = 1_500_000
LEAST_BITS = 7
_C1, _C2, _LEN = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The set's names, ascending: of ``k``-word windows, or of all words if there
    are fewer."""
    words = text_bytes(text).lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    names = word_names(words)
    if len(names) < k:
        return mix64(window_hashes(names, len(names)) ^ np.uint64(len(names)))
    h = window_hashes(names, k)
    h.sort()
    if len(h) > 1:
        h = h[np.concatenate([[True], h[1:] != h[:-1]])]
    return h


def set_name(grams: np.ndarray, doc_id: int) -> int:
    """A name of the set; an empty one is its document's own."""
    with np.errstate(over="ignore"):
        if not len(grams):
            return int(mix64(np.array([doc_id], np.int64).view(np.uint64) * _LEN + _C1)[0].view(np.int64))
        got = mix64(grams + _C1).sum(dtype=np.uint64) ^ mix64(mix64(grams ^ _C2).sum(dtype=np.uint64)[None] + np.uint64(len(grams)) * _LEN)[0]
    return int(got.view(np.int64))


def signature(grams: np.ndarray) -> bytes:
    """Parities of the grams' hashes, about a bit a gram: the bitmaps of two sets
    differ in no more bits than the sets in grams."""
    width = 1 << max(LEAST_BITS, int(max(1, len(grams)) - 1).bit_length())
    odd = np.bincount((grams >> np.uint64(7) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def folded(sig: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of bytes) of fewer bytes; the halves' parities add up."""
    while sig.shape[-1] > width:
        half = sig.shape[-1] // 2
        sig = sig[..., :half] ^ sig[..., half:]
    return sig


def near_signatures(sigs: list[bytes], n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether the pairs (i, j) of the sets may link by their bitmaps."""
    size = np.array([len(s) for s in sigs], np.int64)
    ok = np.zeros(len(i), bool)
    place = np.empty(len(sigs), np.int64)
    table = {}
    for w in np.unique(size):
        of = np.flatnonzero(size == w)
        place[of] = np.arange(len(of))
        table[int(w)] = np.frombuffer(b"".join(sigs[k] for k in of), np.uint8).reshape(len(of), w)
    pair = np.minimum(size[i], size[j]) * (1 << 32) + np.maximum(size[i], size[j])
    for key in np.unique(pair):
        at = np.flatnonzero(pair == key)
        low, high = int(key >> 32), int(key & 0xFFFFFFFF)
        for lo in range(0, len(at), 1 << 16):
            k = at[lo : lo + (1 << 16)]
            a, b = np.where(size[i[k]] <= size[j[k]], i[k], j[k]), np.where(size[i[k]] <= size[j[k]], j[k], i[k])
            apart = np.bitwise_count(table[low][place[a]] ^ folded(table[high][place[b]], low)).sum(axis=1, dtype=np.int64)
            ok[k] = (100 + percent) * apart <= (100 - percent) * (n[a] + n[b])
    return ok


def least_overlap(a, b, percent: int = PERCENT):
    """The smallest intersection of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


SURVEY = "doc_id long, n long, s long, sig binary, grams array<long>, counts array<long>"


def survey(rows: DataFrame) -> DataFrame:
    """A row per document (its set's size, name and bitmap), and counts of the grams
    that a task met twice."""
    whole = pa.list_(pa.int64())
    names = [x.split()[0] for x in SURVEY.split(", ")]

    def counted(held: list[np.ndarray]):
        flat = np.concatenate(held)
        flat.sort()
        start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        n = np.diff(np.append(start, len(flat)))
        twice = n > 1
        g, n = flat[start[twice]].view(np.int64), n[twice]
        for lo in range(0, len(g), 5_000):
            none = [pa.nulls(1, pa.int64())] * 3 + [pa.nulls(1, pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([g[lo : lo + 5_000]], whole), pa.array([n[lo : lo + 5_000]], whole)], names=names)

    def run(batches):
        held, size = [], 0
        for part in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
            ids = part.column(0).to_numpy()
            sets = [shingles(t) for t in part.column(1).to_pylist()]
            m = len(sets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_name(s, d) for s, d in zip(sets, ids, strict=True)], pa.int64()),
                 pa.array([signature(s) for s in sets], pa.binary()), pa.nulls(m, whole), pa.nulls(m, whole)],
                names=names,
            )
            held += [s for s in sets if len(s)]
            size += sum(map(len, sets))
            if size > HELD:
                yield from counted(held)
                held, size = [], 0
        if held:
            yield from counted(held)

    return rows.mapInArrow(run, SURVEY)


def heavy_grams(surveyed: DataFrame, most: int = HEAVY) -> np.ndarray:
    """The most frequent grams, rarest first."""
    one = surveyed.where("grams IS NOT NULL").select(F.explode(F.arrays_zip("grams", "counts")).alias("x"))
    total = one.groupBy(F.col("x.grams").alias("g")).agg(F.sum("x.counts").alias("n"))
    kept = total.where(F.col("n") >= HEAVY_DOCS).orderBy(F.desc("n"), "g").limit(most)
    got = kept.select("g", "n").toArrow()  # at most ``most`` rows
    grams, n = got.column("g").to_numpy().view(np.uint64), got.column("n").to_numpy()
    return grams[np.lexsort((grams, n))]


class Order:
    """The global order: unlisted grams by name, then listed ones by place."""

    def __init__(self, heavy: np.ndarray) -> None:
        self.sorted = np.sort(heavy)
        self.place = np.argsort(heavy, kind="stable")  # sorted[i] stands at place[i]

    def arrange(self, grams: np.ndarray) -> np.ndarray:
        """Ascending names into the order."""
        if not len(self.sorted) or not len(grams):
            return grams
        at = np.minimum(np.searchsorted(self.sorted, grams), len(self.sorted) - 1)
        listed = self.sorted[at] == grams
        if not listed.any():
            return grams
        last = grams[listed][np.argsort(self.place[at[listed]], kind="stable")]
        return np.concatenate([grams[~listed], last])


# A packed block holds parts of many sets: their number and that of their grams, then
# names of the sets, sizes, grams of each, places of the grams, and the grams.

def pack(sets: np.ndarray, n: np.ndarray, count: np.ndarray, places: np.ndarray, grams: np.ndarray) -> bytes:
    head = np.array([len(sets), len(grams)], np.int64)
    return b"".join(np.ascontiguousarray(x).tobytes() for x in (head, sets.astype(np.int64), n.astype(np.int64), count.astype(np.int64), grams.astype(np.uint64), places.astype(np.int32)))


def unpack(blocks: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The parts of all blocks, of a set that comes twice the first only."""
    got = [[], [], [], [], []]
    for buf in blocks:
        m, k = np.frombuffer(buf, np.int64, 2)
        three = np.frombuffer(buf, np.int64, 3 * m, 16).reshape(3, m)
        for out, v in zip(got, (*three, np.frombuffer(buf, np.int32, k, 16 + 24 * m + 8 * k), np.frombuffer(buf, np.uint64, k, 16 + 24 * m)), strict=True):
            out.append(v)
    kinds = (np.int64, np.int64, np.int64, np.int32, np.uint64)
    sets, n, count, places, grams = (np.concatenate(v) if v else np.zeros(0, t) for v, t in zip(got, kinds, strict=True))
    first = np.zeros(len(sets), bool)
    first[np.unique(sets, return_index=True)[1]] = True
    if not first.all():
        keep = np.repeat(first, count)
        sets, n, count, places, grams = sets[first], n[first], count[first], places[keep], grams[keep]
    return sets, n, count, places, grams


def split(key: np.ndarray, sets: np.ndarray, n: np.ndarray, owner: np.ndarray, places: np.ndarray, grams: np.ndarray) -> pa.RecordBatch:
    """(key, block): the grams of each key with the sets that hold them."""
    by = np.lexsort((owner, key))
    key, owner, places, grams = key[by], owner[by], places[by], grams[by]
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    keys, out = [], []
    for lo, hi in zip(cuts, np.append(cuts[1:], len(key)), strict=True):
        of = owner[lo:hi]
        start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        who = of[start]
        keys.append(int(key[lo]))
        out.append(pack(sets[who], n[who], np.diff(np.append(start, hi - lo)), places[lo:hi], grams[lo:hi]))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], names=["key", "block"])


def prefixes(rows: DataFrame, order: Order, fragments: int, copied: dict[int, int]) -> DataFrame:
    """(key, block): fragments of the prefixes. ``copied``: the smallest document of
    sets of many copies."""

    def run(batches):
        for part in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
            ids, heads, sets, size = part.column(0).to_pylist(), [], [], []
            for d, t in zip(ids, part.column(1).to_pylist(), strict=True):
                s = shingles(t)
                name = set_name(s, d)
                if len(s) and copied.get(name, d) == d:
                    heads.append(order.arrange(s)[: prefix_length(len(s))])
                    sets.append(name)
                    size.append(len(s))
            if not heads:
                continue
            count = [len(h) for h in heads]
            grams = np.concatenate(heads)
            places = np.concatenate([np.arange(c) for c in count])
            yield split((grams % np.uint64(fragments)).astype(np.int64), np.array(sets, np.int64), np.array(size, np.int64), np.repeat(np.arange(len(heads)), count), places, grams)

    return rows.mapInArrow(run, "key long, block binary")


def _may_link(na, pa_, nb, pb) -> np.ndarray:
    """Sizes allow a link, and so do the places of a shared gram if it is the first
    of the order that is shared: a linked pair passes at that one."""
    return np.minimum(na - pa_, nb - pb) >= least_overlap(na, nb)


def _lists(sets, n, count, places, grams):
    """Flat (gram, n, set, place) of grams that two sets hold, by gram, n, set."""
    rank = np.lexsort((sets, n))  # place of each set in order of size
    order_of = np.empty(len(rank), np.int64)
    order_of[rank] = np.arange(len(rank))
    owner = np.repeat(order_of, count)
    by = np.lexsort((owner, grams))
    grams, owner, places = grams[by], owner[by], places[by].astype(np.int64)
    same = grams[1:] == grams[:-1] if len(grams) else np.zeros(0, bool)
    held = np.zeros(len(grams), bool)
    held[1:] |= same
    held[:-1] |= same
    grams, owner, places = grams[held], owner[held], places[held]
    return grams, n[rank][owner], sets[rank][owner], places


def near_pairs(grams, n, sets, places, near: int = NEAR, central: int = CENTRAL) -> tuple[np.ndarray, ...]:
    """Candidates (a, b, size of a, size of b, gram) of sorted lists."""
    found = []
    start = np.concatenate([[True], grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, bool)
    for step in range(1, near + 1):
        i = np.flatnonzero(grams[step:] == grams[:-step])
        if not len(i):
            break
        found.append((i, i + step))
    # The most central sets of each size class of a list (sizes within a factor of
    # about 1.12): those with the fewest grams before this one, hence the likeliest
    # to link with any other of the class, and of the next.
    level = (np.log(np.maximum(n, 1)) / math.log(1.12)).astype(np.int64)
    by = np.lexsort((sets, places, level, grams))
    first = np.concatenate([[True], (grams[by][1:] != grams[by][:-1]) | (level[by][1:] != level[by][:-1])]) if len(by) else start
    starts = np.flatnonzero(first)
    of, ends = np.cumsum(first) - 1, np.append(starts[1:], len(by))
    ahead = np.append((grams[by][starts[1:]] == grams[by][starts[:-1]]) & (level[by][starts[1:]] == level[by][starts[:-1]] + 1), False) if len(by) else start
    for k in range(central):
        lead = starts[of] + k
        i = np.flatnonzero((lead < ends[of]) & (lead != np.arange(len(by))))
        found.append((by[lead[i]], by[i]))
        i = np.flatnonzero(ahead[of])
        lead = starts[of[i] + 1] + k
        ok = lead < ends[of[i] + 1]
        found.append((by[lead[ok]], by[i[ok]]))
    pairs = [np.zeros((5, 0), np.int64)]
    for i, j in found:
        ok = _may_link(n[i], places[i], n[j], places[j]) & (sets[i] != sets[j])
        pairs.append(np.stack([sets[i[ok]], sets[j[ok]], n[i[ok]], n[j[ok]], grams[i[ok]].view(np.int64)]))
    return _distinct(np.concatenate(pairs, axis=1))


def _distinct(p: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each pair once, smaller name first, with its smallest gram."""
    turn = p[0] > p[1]
    a, b = np.where(turn, p[1], p[0]), np.where(turn, p[0], p[1])
    na, nb = np.where(turn, p[3], p[2]), np.where(turn, p[2], p[3])
    by = np.lexsort((p[4], b, a))
    a, b, na, nb, g = a[by], b[by], na[by], nb[by], p[4][by]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    return a[new], b[new], na[new], nb[new], g[new]


PAIR = "a long, b long, na long, nb long, g long"
#: A pair, or (with ``b`` null) a set ``a`` of a long list and its place there.
MET = PAIR + ", place long"


def meet(prefix: DataFrame, near: int = NEAR, central: int = CENTRAL) -> DataFrame:
    """First-turn pairs of every fragment, and the members of its long lists: those
    of more than ``near`` + 1 sets, whose pairs weren't all made."""

    def run(table: pa.Table) -> pa.Table:
        grams, n, sets, places = _lists(*unpack([v.as_buffer() for v in table.column("block")]))
        pairs = near_pairs(grams, n, sets, places, near, central)
        # Sets too far into their order at a gram to reach any other there are left
        # out: a partner has at most as many grams after it.
        start = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
        long = np.repeat(np.diff(np.append(start, len(grams))) > near + 1, np.diff(np.append(start, len(grams))))
        at = np.flatnonzero(long & ((n - places) * 100 >= PERCENT * n))
        k, m = len(pairs[0]), len(at)
        a, na, g = (np.concatenate(x) for x in ((pairs[0], sets[at]), (pairs[2], n[at]), (pairs[4], grams[at].view(np.int64))))
        b, nb, place = (pa.chunked_array(x, pa.int64()) for x in ([pa.array(pairs[1]), pa.nulls(m, pa.int64())], [pa.array(pairs[3]), pa.nulls(m, pa.int64())], [pa.nulls(k, pa.int64()), pa.array(places[at])]))
        return pa.table({"a": a, "b": b, "na": na, "nb": nb, "g": g, "place": place})

    return prefix.groupBy("key").applyInArrow(run, MET)


def _once(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.min("g").alias("g"))


def signed(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs that may link by their bitmaps. ``sigs``: s, sig."""
    one = pairs.join(sigs.select(F.col("s").alias("a"), F.col("sig").alias("sa")), "a")
    both = one.join(sigs.select(F.col("s").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "na", "nb", "g", "sa", "sb")

    def run(batches):
        for b in batches:
            m = b.num_rows
            n = np.concatenate([b.column(2).to_numpy(), b.column(3).to_numpy()])
            ok = near_signatures(b.column(5).to_pylist() + b.column(6).to_pylist(), n, np.arange(m), np.arange(m, 2 * m))
            yield b.filter(pa.array(ok)).select(["a", "b", "na", "nb", "g"])

    return both.mapInArrow(run, PAIR)


#: Bits of the sieve of candidates' ids: 1 MB, whatever the corpus.
SIEVE_BITS = 23


def sieve(ids: DataFrame) -> np.ndarray:
    """A bit per hash of the ids in ``d``. It holds at most 2 ** (SIEVE_BITS - 6)
    numbers; full, it lets all through, and the join after it decides anyway."""
    h = F.pmod(F.xxhash64("d"), F.lit(1 << SIEVE_BITS))
    bits = ids.select(h.alias("h")).selectExpr("CAST(h DIV 64 AS INT) AS w", "shiftleft(1L, CAST(h % 64 AS INT)) AS b")
    out = np.zeros(1 << (SIEVE_BITS - 6), np.uint64)
    got = bits.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return out


def sifted(rows: DataFrame, words: np.ndarray) -> DataFrame:
    """The rows whose doc_id may be in the sieve, so that a join by doc_id doesn't
    deal out the texts of all others."""
    keyed = rows.withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << SIEVE_BITS)))

    def run(batches):
        for b in batches:
            h = b.column(2).to_numpy()
            keep = words[h // 64] >> (h % 64).astype(np.uint64) & np.uint64(1)
            yield b.filter(pa.array(keep.astype(bool))).select(["doc_id", "text"])

    return keyed.select("doc_id", "text", "_h").mapInArrow(run, "doc_id long, text string")


def grouped(pairs: DataFrame) -> DataFrame:
    """``pairs`` with the group each is counted in. Pairs
    met at one gram, whose sets mostly are the same, are one group's; those of a
    gram of many pairs are spread."""
    sets = pairs.select(F.col("a").alias("s"), F.col("na").alias("n")).union(pairs.select("b", "nb")).groupBy("s").agg(F.max("n").alias("n"))
    total = pairs.count()
    groups = max(1, math.ceil((sets.agg(F.sum("n")).first()[0] or 0) / (PARTS * PART_GRAMS)))
    limit = max(1000, total // (4 * groups))
    # Fewer than 4 * groups grams can have more pairs than the limit.
    hot = pairs.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / limit).alias("k")).where("k > 1")
    hot = F.broadcast(hot) if 4 * groups <= BROADCAST_HOT else hot
    salt = F.pmod(F.xxhash64("b"), F.coalesce("k", F.lit(1)))
    return pairs.join(hot, "g", "left").withColumn("h", F.pmod(F.xxhash64("g", salt), F.lit(groups))).drop("k")


def overlaps(rows: DataFrame, pairs: DataFrame, leads: DataFrame) -> DataFrame:
    """``pairs`` with the exact intersection ``common``: partial counts of fragments,
    summed. ``leads``: s, doc_id, a document of each set."""
    pairs = materialise(grouped(pairs), "candidates")
    need = pairs.select(F.col("a").alias("s"), "h").union(pairs.select("b", "h")).groupBy("s").agg(F.collect_set("h").alias("hs"))
    need = materialise(need.join(leads, "s").select(F.col("doc_id").alias("d"), "s", "hs"), "needed")
    held = sifted(rows, sieve(need)).join(need, F.col("doc_id") == F.col("d")).select("doc_id", "text", "s", "hs")

    def cut(batches):
        for part in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
            sets, size, keys, owners, every = [], [], [], [], []
            for d, t, s, hs in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                grams = shingles(t)
                if set_name(grams, d) != s:
                    continue  # another text of this document
                v = (grams % np.uint64(PARTS)).astype(np.int64)
                for h in hs:
                    keys.append(v + h * PARTS)
                    owners.append(np.full(len(grams), len(sets)))
                    every.append(grams)
                sets.append(s)
                size.append(len(grams))
            if sets:
                grams = np.concatenate(every)
                yield split(np.concatenate(keys), np.array(sets, np.int64), np.array(size, np.int64), np.concatenate(owners), np.zeros(len(grams), np.int32), grams)

    def count(table: pa.Table) -> pa.Table:
        known = table.column("block").is_valid()
        sets, _, size, _, grams = unpack([v.as_buffer() for v in table.column("block").filter(known)])
        asked = table.filter(pc.invert(known))
        a, b = asked.column("a").to_numpy(), asked.column("b").to_numpy()
        by = np.argsort(sets)
        starts = np.concatenate([[0], np.cumsum(size)])

        def place(x):
            at = np.minimum(np.searchsorted(sets[by], x), max(0, len(sets) - 1))
            return (by[at], sets[by[at]] == x) if len(sets) else (at, np.zeros(len(x), bool))

        (ia, oka), (ib, okb) = place(a), place(b)
        ok = oka & okb
        a, b, ia, ib = a[ok], b[ok], ia[ok], ib[ok]
        salt = mix64(np.arange(1, len(sets) + 1, dtype=np.uint64) * _C1)
        there = np.sort(mix64(grams ^ np.repeat(salt, size)))
        swap = size[ia] > size[ib]
        small, large = np.where(swap, ib, ia), np.where(swap, ia, ib)
        part = np.zeros(len(a), np.int64)
        ends = np.cumsum(size[small])
        lo = 0
        while lo < len(a):  # about HELD grams at a time
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + HELD)))
            k = size[small[lo:hi]]
            offset = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            ask = mix64(grams[np.repeat(starts[small[lo:hi]], k) + offset] ^ np.repeat(salt[large[lo:hi]], k))
            hit = there[np.minimum(np.searchsorted(there, ask), len(there) - 1)] == ask
            part[lo:hi] = np.add.reduceat(np.append(hit, False).astype(np.int64), np.cumsum(k) - k) * (k > 0)
            lo = hi
        keep = part > 0
        return pa.table({"a": a[keep], "b": b[keep], "part": part[keep]})

    dealt = held.mapInArrow(cut, "key long, block binary")
    nothing = F.lit(None)
    every = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("v")
    asked = pairs.select("h", "a", "b", every).select((F.col("h") * PARTS + F.col("v")).alias("key"), nothing.cast("binary").alias("block"), "a", "b")
    both = dealt.select("key", "block", nothing.cast("long").alias("a"), nothing.cast("long").alias("b")).union(asked)
    parts = both.groupBy("key").applyInArrow(count, "a long, b long, part long")
    whole = parts.groupBy("a", "b").agg(F.sum("part").alias("common"))
    return pairs.join(whole, ["a", "b"]).select("a", "b", "na", "nb", "common")


def components(links: DataFrame, most: int = 100) -> DataFrame:
    """(d, component) of every set in a link: the smallest name reachable.
    Large-star and small-star turns, until no edge changes; the number of turns grows
    with the logarithm of the longest path, and not to end in ``most`` is an error."""
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(most):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = large.where("u <> v")
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        joined = star.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        old, edges = edges, materialise(small.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        discard(old)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most} turns")
    both = edges.union(edges.select(F.col("v").alias("u"), "v"))
    return materialise(both.groupBy(F.col("u").alias("d")).agg(F.min("v").alias("component")), "components")


def _linked(pairs: DataFrame) -> DataFrame:
    return pairs.where(100 * F.col("common") >= PERCENT * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id for every row."""
    arrow_bounds(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = rows.where("doc_id IS NOT NULL")
    seen = materialise(survey(known), "survey")
    heads = seen.where("doc_id IS NOT NULL").select("doc_id", "n", "s")
    sigs = seen.where("n > 0").groupBy("s").agg(F.any_value("sig").alias("sig"))
    leads = materialise(heads.groupBy("s").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")), "sets")
    copied = {r["s"]: r["doc_id"] for r in leads.where(F.col("copies") > COPIES).orderBy(F.desc("copies"), "s").limit(COPIED).collect()}
    prefix = prefixes(known, Order(heavy_grams(seen)), fragment_count(rows), copied)
    met = materialise(meet(prefix), "met")

    tested = _once(met.where("b IS NOT NULL"))
    pairs = materialise(signed(tested, sigs), "pairs")
    links = materialise(_linked(overlaps(known, pairs, leads)), "links")
    # Sets that share a document are linked too.
    shared = heads.groupBy("doc_id").agg(F.min("s").alias("a"), F.max("s").alias("z")).where("a <> z")
    links = links.union(heads.join(shared, "doc_id").where("s <> a").select("a", F.col("s").alias("b")))
    label = components(links)
    more = materialise(_second_turn(met.where("b IS NULL"), label, tested, sigs), "pairs")
    if more.limit(1).count():
        found = materialise(_linked(overlaps(known, more, leads)), "links")
        # What is already joined enters as stars about each component's smallest name.
        stars = label.select(F.col("d").alias("a"), F.col("component").alias("b"))
        label = components(stars.union(found))

    own = leads.select("s", F.col("doc_id").alias("class_id")).join(label, F.col("s") == F.col("d")).select("s", "class_id", "component")
    least = own.groupBy("component").agg(F.min("class_id").alias("component_id"))
    whole = own.join(least, "component").select("s", F.col("component_id"))
    out = heads.join(leads.select("s", F.col("doc_id").alias("class_id")), "s").join(whole, "s", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    unnamed = rows.where("doc_id IS NULL")
    nothing = F.lit(None).cast("long")
    return out.unionByName(_sized(unnamed).select(nothing.alias("doc_id"), "n_shingles", nothing.alias("class_id"), nothing.alias("component_id")))


def _sized(rows: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(shingles(t)) for t in b.column(0).to_pylist()], pa.int64())], names=["n_shingles"])

    return rows.select("text").mapInArrow(run, "n_shingles long")


def _second_turn(members: DataFrame, label: DataFrame, tested: DataFrame, sigs: DataFrame) -> DataFrame:
    """Untested pairs of long lists whose sets are in different components and that
    may link. Lists that hold one component end here, as counted by ``min`` and
    ``max``. A list is cut into blocks; each two blocks meet in a task of their own,
    and only pairs that pass their bitmaps leave it."""
    member = members.select("g", F.col("a").alias("s"), F.col("na").alias("n"), "place").join(label, F.col("s") == F.col("d"), "left")
    member = materialise(member.select("g", "s", "n", "place", F.coalesce("component", "s").alias("c")), "members")
    mixed = member.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("k")).where("lo <> hi")
    mixed = mixed.select("g", F.ceil(F.col("k") / BLOCK).cast("int").alias("k"))
    every = member.join(mixed, "g").join(sigs, "s").withColumn("i", F.pmod(F.xxhash64("s"), F.col("k")).cast("int"))
    every = every.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = every.select("g", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "i", "s", "n", "place", "c", "sig")

    def run(table: pa.Table) -> pa.Table:
        s, n, place, c, i = (table.column(k).to_numpy() for k in ("s", "n", "place", "c", "i"))
        x, y, g = (table.column(k)[0].as_py() for k in ("x", "y", "g"))
        sig = table.column("sig").to_pylist()
        left, right = np.flatnonzero(i == x), np.flatnonzero(i == y)
        found = [np.zeros((5, 0), np.int64)]
        for at in left:
            to = right[s[right] > s[at]] if x == y else right
            to = to[(c[to] != c[at]) & _may_link(n[at], place[at], n[to], place[to])]
            if len(to):
                to = to[_near_one(sig, n, at, to)]
                found.append(np.stack([np.full(len(to), s[at]), s[to], np.full(len(to), n[at]), n[to], np.full(len(to), g)]))
        return pa.table(dict(zip(("a", "b", "na", "nb", "g"), _distinct(np.concatenate(found, axis=1)), strict=True)))

    again = _once(dealt.groupBy("g", "x", "y").applyInArrow(run, PAIR))
    return again.join(tested.select("a", "b"), ["a", "b"], "left_anti")


def _near_one(sig: list[bytes], n: np.ndarray, at: int, to: np.ndarray) -> np.ndarray:
    """``near_signatures`` of one set with some others."""
    some = [sig[at], *(sig[k] for k in to)]
    return near_signatures(some, np.concatenate([n[[at]], n[to]]), np.zeros(len(to), np.int64), np.arange(1, len(to) + 1))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, of each component the one of the smallest doc_id. Rows of a
    null doc_id stay; rows that share the kept doc_id are one document and stay."""
    found = classes(docs).where("doc_id IS NOT NULL AND doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(found, "doc_id", "left_semi").select(*["`" + c.replace("`", "``") + "`" for c in docs.columns])
    return kept.unionByName(docs.where("doc_id IS NULL"))


def op2_jaccard(spark, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents"))
