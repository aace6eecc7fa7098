"""URL filter: a blocked Bloom filter in front of an exact join.

The listed canonical URLs are hashed once (``xxhash64``).  The hash picks one 256-bit
block of the filter and one bit in each of the block's eight 32-bit lanes.  A block is a row
(block, four longs) built with ``bit_or``; pages join the blocks on the block number, so a
probe reads one row, and only pages whose eight bits are all set go on to the exact join
with the list, which removes the false positives.

The filter has at most ``max_blocks`` rows whatever the list's length, which bounds what is
broadcast (32 bytes of bits a block; the default of 2**17 blocks is 4 MiB).  A longer list
only raises the share of false hits, which the exact join removes; the result is the same.

All work is DataFrame expressions.  The exact join is salted, so a URL that holds a third of
all pages is spread over ``SALTS`` tasks; pages that the filter clears are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 16
LANES = 8


@dataclass(frozen=True)
class Rule:
    """``verdict`` for every URL of ``host`` or its subdomains whose path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' if null or none."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; '' if null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Listed form of a URL: host without ``www.`` and default ports, path without trailing
    slashes; scheme, query and fragment are dropped.  An empty host has no listed form (null)."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, "/+$", "")))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule text, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def bits(key: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    """Block number and four long masks (two lanes of 32 bits in each) of a key."""
    block = F.pmod(F.shiftrightunsigned(F.xxhash64(key), 32), F.lit(n_blocks)).cast("int")
    second = F.xxhash64(key, F.lit("lanes"))  # eight independent groups of five bits
    masks = []
    for pair in range(LANES // 2):
        low = F.shiftrightunsigned(second, 10 * pair).bitwiseAND(F.lit(31)).cast("int")
        high = F.shiftrightunsigned(second, 10 * pair + 5).bitwiseAND(F.lit(31)).cast("int") + F.lit(32)
        one = F.lit(1).cast("bigint")
        masks.append(F.call_function("shiftleft", one, low).bitwiseOR(F.call_function("shiftleft", one, high)))
    return block, masks


def build_filter(listed: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """(block, w0..w3): one row per block that any key of ``listed`` touches; null keys set nothing."""
    block, masks = bits(F.col(key), n_blocks)
    rows = listed.where(F.col(key).isNotNull()).select(block.alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(len(masks))])


def blocks_for(n_keys: int, bits_per_key: int, max_blocks: int) -> int:
    """Power of two of blocks for ``bits_per_key``, held to ``max_blocks``."""
    need, n = max(1, n_keys * bits_per_key // 256), 1
    while n < need and n < max_blocks:
        n *= 2
    return min(n, max_blocks)


def in_list(rows: DataFrame, key: str, listed: DataFrame, listed_key: str, *, salt: str, bits_per_key: int = 16, max_blocks: int = 1 << 17) -> DataFrame:
    """``rows`` plus boolean ``listed``: whether ``key`` is among ``listed_key`` of ``listed``.

    ``salt`` names a column that varies between rows of equal key.  Null keys are not listed;
    repeated rows stay repeated, repeated or null list entries change nothing; either input may
    be empty.  ``rows`` must not have columns ``listed``, ``maybe`` or ``_s``."""
    keys = listed.select(F.col(listed_key).alias("_k")).where("_k is not null")
    n_blocks = blocks_for(keys.count(), bits_per_key, max_blocks)
    flt = build_filter(keys, "_k", n_blocks).select(F.col("block").alias("_b"), *[f"w{i}" for i in range(LANES // 2)])
    block, masks = bits(F.col(key), n_blocks)
    hit = F.lit(True)
    for i, m in enumerate(masks):
        hit = hit & (F.col(f"w{i}").bitwiseAND(m) == m)
    probed = rows.join(F.broadcast(flt), block == F.col("_b"), "left").withColumn("maybe", F.coalesce(hit & F.col(key).isNotNull(), F.lit(False))).select(*rows.columns, "maybe")
    possible = probed.where("maybe").drop("maybe")
    clear = probed.where("not maybe").drop("maybe").withColumn("listed", F.lit(False))
    confirmed = keys.join(possible.select(F.col(key).alias("_k")).distinct(), "_k", "left_semi").distinct()
    confirmed = confirmed.select("_k", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"), F.lit(True).alias("_in"))
    salted = possible.withColumn("_s", F.pmod(F.xxhash64(F.lit(7), F.col(salt)), F.lit(SALTS)).cast("int"))
    exact = salted.join(confirmed, (salted[key] == confirmed["_k"]) & (salted["_s"] == confirmed["_s"]), "left")
    exact = exact.select(*[salted[c] for c in rows.columns], F.coalesce("_in", F.lit(False)).alias("listed"))
    return clear.unionByName(exact)


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url", listed_col: str = "canonical", **options) -> DataFrame:
    """(page_id, host, path, rule, verdict, canonical, listed) for every row of ``pages``.

    The longest fitting rule decides; without one, a page is blocked when its canonical URL is
    listed and allowed otherwise.  Null URLs and URLs without ``://`` have empty host and path,
    fit no rule and are allowed.  Other columns of ``pages``, whatever their names, are not read.
    Repeated rows give repeated rows; an empty table gives an empty result."""
    at = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    at = at.withColumn("canonical", canonical(F.col("host"), F.col("path")))
    known = in_list(at, "canonical", listed, listed_col, salt="page_id", **options)
    rule = rule_of(F.col("host"), F.col("path"), rules)
    out = known.withColumn("_r", rule)
    verdict = F.coalesce(F.col("_r.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), "canonical", "listed")


def referral_list(pages: DataFrame, *, url_col: str = "url") -> DataFrame:
    """The list used by the query: canonical URLs that some page carries with a ``ref=``
    referral parameter.  One column ``canonical``, repeats included."""
    url = F.col(url_col)
    return pages.where(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1).rlike(r"(^|&)ref=")).select(canonical(host_of(url), path_of(url)).alias("canonical"))
