"""Personal data: fixed patterns, and bootstrapped contextual extraction.

Four kinds (email, ip, card, phone) have fixed patterns; their matches are the
seeds. The method then looks at identifier-like strings (without blanks, or up to
four number-like words in a row) that touch no match, each with the words around it.
A lexical pattern is the kind of a seed with a context, in lower case: the word
before, the word after and the shape of the string; or the word before and after,
the two words before, the word before, or the word after, each with the string's form
only (what it is made of, and about how many digits it has); or the classes of both
neighbours, or no neighbour at all, with the string's measured shape (lengths of its
runs of digits, whether its check digit or its parts hold). Spark scores the
bipartite graph of patterns and instances in rounds: a pattern's confidence is the
mean score of its instances, shrunk by ``PRIOR`` unseen failures, ``PRIOR_ONE`` if
its context is one word or none; an instance's score is 1 for a seed of the kind, 0
for a seed of another, else the noisy-or of its patterns. Patterns of a form, which
are wide, count there only from ``CONFIDENCE`` on, else they would lift each other.
Unseen instances of patterns with enough confidence and seeds become spans: numbers
that the fixed patterns lose since a match ran on into the next number, or that
stand where identifiers stand. ``hidden_recall`` tells how many seeds that were kept
from the learning the patterns find.

Offsets are code points, end exclusive. Added spans never touch a base span, and
none lies in another.

Defined results: null text counts as empty (no spans, the digest of the empty
string); null and repeated doc_ids count for nothing, a row's spans are its own;
repeated rows get equal results; an empty table gives an empty result; extra columns
are ignored, and stay in redacted documents. Every pattern runs in time linear in the
text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import arrow_bounds, materialise, packed_row, read

# The kinds in the order of the digest, and their patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Rounds of scoring, unseen failures a pattern starts with, and what it needs.
ROUNDS, PRIOR, CONFIDENCE, SEEDS = 3, 2.0, 0.8, 5
#: Unseen failures of a pattern of one word or none, which says less than two.
PRIOR_ONE = 4.0
#: Up to so many patterns (under 200 bytes each) go to every task.
BROADCAST_PATTERNS = 50_000

#: And up to so many rows with added spans (about 50 bytes a span).
BROADCAST_ROWS = 100_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does: a later digit of the run
# would match no less from the run's first.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(PHONE)
_DIGITS = re.compile(r"[0-9]{4}|[0-9][ .-][0-9]")
# Begins only where such a string does, so that each is tried once.
_PART = r"[^\s,;:<>\"'(){}\[\]|=#$&*!?]"
_CANDIDATE = re.compile(rf"(?<!{_PART}){_PART}*?[0-9@]{_PART}*")
# Digits joined by blanks, brackets and the like, as seeds hold them.
_NUMBERS = re.compile(r"(?<![^\s,;:<>\"'{}\[\]|=#$&*!?])[+(]{0,2}[0-9][0-9()./+-]*+(?:\x20[+(]{0,2}[0-9][0-9()./+-]*+)*+")
#: Number-like words that one identifier may span.
MOST_WORDS = 4
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_EDGES = " .,;:!?\"'()[]{}<>*#&%$=-"
# First signs of patterns: of exact shape, of two words, of one word, of none.
EXACT, TWO, ONE, OPEN = "x", "2", "1", "0"
_BEFORE = re.compile(r"(\S+)\s*$")
_AFTER = re.compile(r"\s*(\S+)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of EMAIL, each found from its ``@``: a match begins where
    the run of local characters before the sign does."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                found["phone"].append(m.span())
    if _DIGITS.search(text):
        if "." in text:
            # parts have few digits if small enough; int() of a very long one isn't tried
            for m in _IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                    found["ip"].append(m.span())
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
    return found


def digest(spans: list[tuple[str, int, int]]) -> str:
    order = sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


def shape(s: str) -> str:
    """Digits as 9, letters as a, runs shortened to one sign."""
    out = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", s))
    return out[:24]


def form(s: str) -> str:
    """What a string is made of, and about how many digits it has."""
    if "@" in s:
        return "@"
    if any(c.isalpha() for c in s):
        return "a"
    if _DOTTED.fullmatch(s):
        return "9.9.9.9"
    n = sum(c in "0123456789" for c in s)
    return "few" if n < 7 else "some" if n < 16 else "many"


def measured(s: str) -> str:
    """The shape with the lengths of its runs of digits, and whether the numbers of a
    dotted four are small enough, or the digits of a long number pass Luhn."""
    if "@" in s:
        return re.sub(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$", "a.a", re.sub(r".*@", "a@", s, count=1, flags=re.S))[:40]
    out = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: f"<{min(len(m[0]), 20)}>", s))
    if _DOTTED.fullmatch(s):
        return "quad " + ("fits" if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in s.split(".")) else "no")
    digits = re.sub(r"[ -]", "", s)
    if digits.isascii() and digits.isdigit() and 16 <= len(digits) <= 19:
        out += " luhn" if luhn(digits) else " no"
    return out[:60]


def word_class(w: str) -> str:
    """What a neighbour is like: none, a number, a capital, a word, or signs."""
    if w in ("^", "$"):
        return w
    return "9" if any(c.isdigit() for c in w) else "A" if w[:1].isupper() else "a" if any(c.isalpha() for c in w) else "."


def patterns_of(text: str, a: int, b: int, whole: bool = True) -> list[str]:
    """The patterns of the string text[a:b]; a part of a run has its neighbours within
    the run, so only its measured shape tells."""
    m = _BEFORE.search(text[max(0, a - 40) : a])
    n = _AFTER.match(text, b, min(len(text), b + 40))
    before, after = (m[1][-24:].lower() if m else "^"), (n[1][:24].lower() if n else "$")
    one, made = text[a:b], form(text[a:b])
    known = measured(one)
    around = word_class(m[1] if m else "^") + word_class(n[1] if n else "$")
    left = [w.strip(_EDGES) or w for w in (before, *(w[-24:].lower() for w in text[max(0, a - 80) : a].split()[-2:-1]))]
    right = after.strip(_EDGES) or after
    rows = [
        (EXACT, before, after, shape(one)), (TWO + "a", left[0], right, made), (TWO + "b", left[1] if len(left) > 1 else "^", left[0], made),
        (ONE + "b", left[0], made), (ONE + "a", right, made),
        (ONE + "c", around, known), (OPEN, known),
    ]
    return ["\t".join(r) for r in (rows if whole else rows[-1:])]


def candidates(text: str) -> dict[tuple[int, int], bool]:
    """Spans of identifier-like strings: those without blanks, runs of number-like
    words, and up to ``MOST_WORDS`` words of a run, which are parts (False)."""
    found = {m.span(): True for m in _CANDIDATE.finditer(text) if 6 <= m.end() - m.start() <= 80}
    for m in _NUMBERS.finditer(text):
        words = [(w.start() + m.start(), w.end() + m.start()) for w in re.finditer(r"[^ ]+", m[0])]
        for i, (a, _) in enumerate(words):
            for _, b in words[i : i + MOST_WORDS]:
                one = text[a:b].rstrip("()./+-")
                if 7 <= sum(map(str.isdigit, one)) <= 19 and not text[a + len(one) : a + len(one) + 1].isalnum():
                    found.setdefault((a, a + len(one)), (a, b) == m.span())
    return found


def contexts(text: str, found: dict[str, list[tuple[int, int]]]) -> list[tuple]:
    """(instance, patterns, kind or '', start, end): seeds and other
    identifier-like strings with the patterns they are in."""
    taken = sorted((a, b, k) for k, spans in found.items() for a, b in spans)
    if not taken and not _DIGITS.search(text) and "@" not in text and not _NUMBERS.search(text):
        return []
    starts, most, ends = [a for a, _, _ in taken], 0, []
    for _, b, _ in taken:  # the furthest end so far
        ends.append(most := max(most, b))

    def free(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return not i or ends[i - 1] <= a

    spans = [(a, b, k, True) for a, b, k in taken] + [(a, b, "", whole) for (a, b), whole in sorted(candidates(text).items()) if free(a, b)]

    def key(a: int, b: int) -> str:
        return hashlib.blake2b(text[a:b].encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()

    return [(key(a, b), patterns_of(text, a, b, whole), k, a, b) for a, b, k, whole in spans]


EDGE = "array<struct<inst:string,pats:array<string>,kind:string,start:long,end:long>>"


def scan(docs: DataFrame, text: str = "text", *keep: F.Column) -> DataFrame:
    """Base results of every row, and its contexts; written once, with a number
    ``_row`` and the columns ``keep``."""
    kind = pa.list_(pa.struct([("inst", pa.string()), ("pats", pa.list_(pa.string())), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    rows = docs.select(F.col(text).cast("string").alias("_text"), *keep)
    kept = rows.schema.fields[1:]
    schema = StructType([*kept, *StructType.fromDDL(f"n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, edges {EDGE}").fields])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                cols: list[list] = [[] for _ in range(7)]
                for text in part.column(0).to_pylist():
                    text = text or ""
                    found = base_spans(text)
                    base = digest([(k, x, y) for k, spans in found.items() for x, y in spans])
                    edges = [dict(zip(("inst", "pats", "kind", "start", "end"), e, strict=True)) for e in contexts(text, found)]
                    row = (*(len(found[k]) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), base, edges)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string()), pa.array(cols[6], kind)],
                    names=schema.names,
                )

    return materialise(rows.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()), "pii")


def learn(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Accepted patterns: kind, pattern, confidence. ``edges``: inst, pats, kind
    ('' where no fixed pattern took it); a row a place."""
    # A pattern and an instance meet once, whatever the number of copies.
    pairs = edges.select("inst", "kind", F.explode("pats").alias("pattern")).groupBy("inst", "pattern").agg(F.max("kind").alias("kind"))
    seeds = pairs.where("kind <> ''").groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("_s")).where(F.col("_s") >= SEEDS)
    seeds = materialise(seeds, "pattern-seeds")
    # A frequent word is in many pairs: they stay where they are, if possible.
    near = F.broadcast if seeds.count() <= BROADCAST_PATTERNS else lambda x: x
    # Only patterns with enough seeds can be accepted; the graph is theirs.
    graph = pairs.withColumnRenamed("kind", "own").join(near(seeds), "pattern")
    graph = materialise(graph, "pattern-graph")
    score = F.when(F.col("own") == F.col("kind"), 1.0).when(F.col("own") != "", 0.0)
    prior = F.when(F.col("pattern").startswith(ONE) | F.col("pattern").startswith(OPEN), PRIOR_ONE).otherwise(PRIOR)

    def confidence(now: DataFrame, name: str) -> DataFrame:
        sums = now.groupBy("kind", "pattern").agg(F.sum("_v").alias("_t"), F.count(F.lit(1)).alias("_n"))
        return sums.select("kind", "pattern", (F.col("_t") / (F.col("_n") + prior)).alias(name))

    now = graph.withColumn("_v", F.coalesce(score, F.lit(0.0)))
    for _ in range(rounds):
        held = graph.join(near(confidence(now, "_c")), ["kind", "pattern"])
        told = F.col("pattern").startswith(EXACT) | (F.col("_c") >= CONFIDENCE)
        miss = F.sum(F.when(told, F.log1p(-F.least(F.col("_c"), F.lit(0.999)))).otherwise(0.0))
        inst = held.where("own = ''").groupBy("kind", "inst").agg((1 - F.exp(miss)).alias("_i"))
        now = held.join(inst, ["kind", "inst"], "left").withColumn("_v", F.coalesce(score, "_i", F.lit(0.0))).drop("_i", "_c")
    return confidence(now, "confidence").where(F.col("confidence") >= CONFIDENCE)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (the base's and
    the method's) for every row."""
    out = merged(scan(docs, "text", F.col("doc_id").cast("long").alias("doc_id")))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def merged(found: DataFrame) -> DataFrame:
    """What ``scan`` found, with ``spans``: the base's and the method's."""
    edges = found.select("_row", F.inline("edges"))
    patterns = learn(edges.select("inst", "pats", "kind"))
    fresh = edges.where("kind = ''").select("_row", "start", "end", F.explode("pats").alias("pattern")).join(patterns, "pattern")
    best = fresh.groupBy("_row", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    added = best.groupBy("_row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("_new"))
    rank = F.lit(",".join(KINDS))

    def keyed(kind, start, end):
        return F.struct(F.instr(rank, kind).alias("o"), start.alias("a"), end.alias("b"), kind.alias("k"))

    parsed = F.transform(
        F.filter(F.split("base", ","), lambda x: x != ""),
        lambda x: keyed(F.split_part(x, F.lit(":"), F.lit(1)), F.split_part(x, F.lit(":"), F.lit(2)).cast("long"), F.split_part(x, F.lit(":"), F.lit(3)).cast("long")),
    )
    whole = F.filter("_new", lambda x: ~F.exists("_new", lambda y: (y["start"] <= x["start"]) & (y["end"] >= x["end"]) & (y["end"] - y["start"] > x["end"] - x["start"])))
    new = F.transform(whole, lambda x: keyed(x["kind"], x["start"], x["end"]))
    every = F.array_sort(F.concat(parsed, new))
    text = F.array_join(F.transform(every, lambda x: F.concat_ws(":", x["k"], x["a"].cast("string"), x["b"].cast("string"))), ",")
    added = materialise(added, "pii-added")
    if added.count() <= BROADCAST_ROWS:  # else both sides are dealt by row
        added = F.broadcast(added)
    out = found.drop("edges").join(added, "_row", "left")
    return out.withColumn("spans", F.when(F.col("_new").isNull(), F.col("base")).otherwise(text)).drop("_new")


def hidden_recall(docs: DataFrame, part: int = 4) -> DataFrame:
    """kind, hidden, found: one in ``part`` seeds, by a hash of the string, is kept from
    the learning; how many of them do the learned patterns give their kind?"""
    edges = scan(docs).select(F.inline("edges"))
    hide = (F.col("kind") != "") & (F.pmod(F.xxhash64("inst"), F.lit(part)) == 0)
    patterns = learn(edges.where(~hide).select("inst", "pats", "kind"))
    hidden = edges.where(hide).select("inst", F.col("kind").alias("true"), F.explode("pats").alias("pattern"))
    told = hidden.join(patterns, "pattern", "left").groupBy("true", "inst").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    return told.groupBy(F.col("true").alias("kind")).agg(F.count(F.lit(1)).alias("hidden"), F.count_if(F.col("kind") == F.col("true")).alias("found"))


def redact_text(text: str, spans: str) -> str:
    """The text with each span as ``<KIND>``; of spans that overlap the first in
    place, the longer on ties, gives its name to their union."""
    parts = sorted((int(a), -int(b), k) for k, a, b in (x.split(":") for x in spans.split(",") if x))
    out, at, i = [], 0, 0
    while i < len(parts):
        a, b, k = parts[i][0], -parts[i][1], parts[i][2]
        i += 1
        while i < len(parts) and parts[i][0] < b:
            b = max(b, -parts[i][1])
            i += 1
        out += [text[at:a], f"<{k.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def redacted_documents(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced; n_chars follows the text. A row
    carries its spans with it, so null and repeated ids change nothing."""
    arrow_bounds(docs.sparkSession)
    schema = docs.schema
    mine = scan(docs.select(packed_row(docs)), "_doc.text", F.col("_doc"))
    spans = merged(mine).select("_doc", "spans")

    def replaced(batches):
        for b in (x.slice(lo, 256) for x in batches for lo in range(0, x.num_rows, 256)):
            cols = dict(zip(schema.names, b.column(0).flatten(), strict=True))
            old = cols["text"].to_pylist()
            texts = [redact_text(t, s) if t and s else t for t, s in zip(old, b.column(1).to_pylist(), strict=True)]
            cols["text"] = pa.array(texts, cols["text"].type)
            if "n_chars" in cols:
                size = [v if v is None or t is None else len(t) for v, t in zip(cols["n_chars"].to_pylist(), texts, strict=True)]
                cols["n_chars"] = pa.array(size, cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return spans.mapInArrow(replaced, schema)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"))
