"""Secret scan: base patterns, and sliding-window entropy over candidate strings.

Spans come from two built-ins that cut a text at the same matches: ``split`` gives the gaps
and ``regexp_extract_all`` the hits, and running sums of their lengths give code-point
offsets.  Candidate strings are maximal runs of ``[A-Za-z0-9+/_=-]``, cut at base spans and at known
strings, of at least one window.
A window of ``WINDOW`` characters slides over a candidate; the counts of its characters and
the sum of c*log2(c) change by one entering and one leaving character a step, and
H = log2(W) - sum/W.  A candidate whose best window reaches the threshold of its character
class is a secret unless the allow-list knows it.

All work is DataFrame expressions on one row at a time; nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CHUNK = 256

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: 20 and 24 characters at least; equal to dropping shorter runs, since a run holds one match.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW


@dataclass(frozen=True)
class Entropy:
    """Bits a window must reach by character class, and what is never reported: whole
    candidates that match a pattern of ``allowed``, and known strings."""

    hex: float = 3.0
    alnum: float = 3.7
    base64: float = 3.7
    allowed: tuple = (r"[A-Za-z_=/+-]+", r"[0-9_=/+-]+", r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r"[A-Za-z]*(-[A-Za-z]+)*[-_]?[0-9]{1,8}")
    known: tuple = field(default=("EXAMPLE", "0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnop", "ABCDEFGHIJKLMNOP"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(a: Column) -> Column:
    """Sums of all elements before each element, chunk by chunk (linear for long arrays)."""
    def total(x):
        return F.aggregate(x, F.lit(0), lambda s, v: s + v)

    def small(x, first):
        return F.aggregate(x, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")),
                           lambda s, v: F.struct((s.at + v).alias("at"), F.concat(s.out, F.array(s.at)).alias("out")), lambda s: s.out)

    def by_chunk(x):
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda k: F.slice(x, k * CHUNK + 1, F.lit(CHUNK)))
        return let(parts, lambda p: let(small(F.transform(p, total), F.lit(0)), lambda firsts: F.flatten(F.zip_with(p, firsts, small))))

    return let(a, lambda x: F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(by_chunk(x)))


SPAN = "array<struct<start:int,end:int,hit:string,value:string>>"


def spans_of(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start,end,hit,value>> of the leftmost non-overlapping matches (code points,
    end exclusive); ``value`` is the given group."""
    def build(gaps, hits, values):
        step = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))
        return let(running(step), lambda before: F.transform(hits, lambda h, i: F.struct(
            (F.get(before, i) + F.length(F.get(gaps, i))).alias("start"), (F.get(before, i) + F.length(F.get(gaps, i)) + F.length(h)).alias("end"),
            h.alias("hit"), F.get(values, i).alias("value"))))

    all_of = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    found = let(F.split(text, pattern, -1), lambda gaps: let(all_of(0), lambda hits: let(all_of(group), lambda values: build(gaps, hits, values))))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def best_window(value: Column) -> Column:
    """Highest Shannon entropy (bits) of any ``WINDOW`` characters in a row of ``value``, by
    incremental counts; null if it is shorter."""
    clog = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)])

    def index(chars):
        return F.transform(chars, lambda c: F.call_function("locate", c, F.lit(ALPHABET)) - 1)

    def step(s, at, ids):
        new, old = F.get(ids, at), F.get(ids, at - WINDOW)
        less = F.when(old.isNull(), s.counts).otherwise(F.transform(s.counts, lambda c, j: F.when(j == old, c - 1).otherwise(c)))
        down = F.when(old.isNull(), F.lit(0.0)).otherwise(F.get(clog, F.get(s.counts, old) - 1) - F.get(clog, F.get(s.counts, old)))
        return let(less, lambda held: let(s.sum + down + F.get(clog, F.get(held, new) + 1) - F.get(clog, F.get(held, new)), lambda total: F.struct(
            F.transform(held, lambda c, j: F.when(j == new, c + 1).otherwise(c)).alias("counts"), total.alias("sum"),
            F.when(at >= WINDOW - 1, F.greatest(s.best, F.lit(math.log2(WINDOW)) - total / WINDOW)).otherwise(s.best).alias("best"))))

    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1.0).alias("best"))
    scan = let(index(F.split(value, "")), lambda ids: F.aggregate(F.sequence(F.lit(0), F.size(ids) - 1), start, lambda s, at: step(s, at, ids), lambda s: s.best))
    return F.when(F.length(value) >= WINDOW, F.round(scan, 9))


def secret_like(value: Column, e: Entropy) -> Column:
    """Whether a candidate's best window reaches its class's threshold and no allow-list entry fits."""
    need = F.when(value.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit(e.hex)).when(value.rlike("^[A-Za-z0-9]+$"), F.lit(e.alnum)).otherwise(F.lit(e.base64))
    open_ = F.lit(True)
    for p in e.allowed:
        open_ = open_ & ~value.rlike(f"^(?:{p})$")
    return F.when(open_, best_window(value) >= need).otherwise(F.lit(False))


def pieces(c: Column, base: Column, known: tuple) -> Column:
    """The parts of candidate ``c`` of at least one window that lie between base spans and known strings."""
    def place(s, by):
        return F.struct((s.start + by).alias("start"), (s.end + by).alias("end"))

    cuts = F.transform(F.filter(base, lambda b: (b.start < c.end) & (c.start < b.end)), lambda b: place(b, 0))
    if known:
        cuts = F.concat(cuts, F.transform(spans_of(c.value, "|".join(map(re.escape, known))), lambda k: place(k, c.start)))

    def part(start, end):
        value = F.substring(c.value, start - c.start + 1, end - start)
        return F.when(end - start >= WINDOW, F.array(F.struct(start.alias("start"), end.alias("end"), value.alias("hit"), value.alias("value")))).otherwise(F.array().cast(SPAN))

    def step(s, x):
        return F.struct(F.greatest(s.pos, x.end).alias("pos"), F.concat(s.out, part(s.pos, x.start)).alias("out"))

    def cut(found):
        start = F.struct(c.start.alias("pos"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(F.sort_array(found), start, step, lambda s: F.concat(s.out, part(s.pos, c.end)))

    return let(cuts, lambda found: F.when(F.size(found) == 0, F.array(c)).otherwise(cut(found)))


KINDS = ("assign", "access", "hex", "entropy")


def scan(docs: DataFrame, entropy: Entropy = Entropy(), *, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as struct ``doc`` plus ``found``: array of (start, end, rank, kind)
    sorted by start, then kind as listed in ``KINDS``.

    Base kinds keep all their matches; an ``entropy`` span never overlaps one: candidates are cut at
    the base spans and every piece is scanned.  A null text counts as empty; an empty text has no spans; repeated rows are
    scanned alike; an empty table gives an empty result."""
    text = F.col("_text")

    def kind(spans, rank):
        return F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.lit(rank).alias("rank"), F.lit(KINDS[rank]).alias("kind")))

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.coalesce(docs[text_col], F.lit("")).alias("_text"))
    assign = F.filter(spans_of(text, ASSIGN, 2), lambda s: F.length(s.value) >= 6)
    access = spans_of(text, ACCESS)
    hexes = spans_of(text, HEX)
    rows = rows.withColumn("_base", F.concat(kind(assign, 0), kind(access, 1), kind(hexes, 2)))
    rows = rows.withColumn("_cand", spans_of(text, CANDIDATE))
    rows = rows.withColumn("_fresh", F.flatten(F.transform("_cand", lambda c: pieces(c, F.col("_base"), entropy.known))))
    more = kind(F.filter("_fresh", lambda c: secret_like(c.value, entropy)), 3)
    order = F.transform(F.concat("_base", more), lambda s: F.struct(s.start.alias("start"), s.rank.alias("rank"), s.end.alias("end"), s.kind.alias("kind")))
    return rows.select("doc", F.sort_array(order).alias("found"))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def report(docs: DataFrame, entropy: Entropy = Entropy(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy) per row."""
    rows = scan(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), entropy)
    base = F.filter("found", lambda s: s.rank < 3)
    count = lambda r: F.size(F.filter("found", lambda s: s.rank == r)).cast("long")
    return rows.select("doc.doc_id", *[count(r).alias(f"n_{KINDS[r]}") for r in range(3)], F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("found")).alias("spans"), count(3).alias("n_entropy"))


def redact(docs: DataFrame, entropy: Entropy = Entropy(), *, text_col: str = "text", chars_col: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span (overlaps merged) replaced by ``mark`` and ``chars_col``
    set to the new length; rows without a span are unchanged.  All columns are kept."""
    rows = scan(docs, entropy, text_col=text_col)
    text = F.col("doc").getField(text_col)

    def step(s, x):
        cut = F.substring(text, s.pos + 1, x.start - s.pos)
        return F.when(x.start >= s.pos, F.struct(x.end.alias("pos"), F.concat(s.out, F.array(cut, F.lit(mark))).alias("out"))).otherwise(
            F.struct(F.greatest(s.pos, x.end).alias("pos"), s.out.alias("out")))

    parts = F.aggregate("found", F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out")), step,
                        lambda s: F.concat(s.out, F.array(F.substring(text, s.pos + 1, F.length(text)))))
    rows = rows.withColumn("_new", F.when(F.size("found") > 0, F.array_join(parts, "")).otherwise(text))
    changed = F.size("found") > 0

    def column(c):
        old = F.col("doc").getField(c)
        if c == text_col:
            return F.col("_new").alias(c)
        return (F.when(changed, F.length("_new").cast(docs.schema[c].dataType)).otherwise(old) if c == chars_col else old).alias(c)

    return rows.select(*[column(c) for c in docs.columns])
