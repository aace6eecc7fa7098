"""Vocabulary operators: corpus vocabulary, dense positions, permutations, token remapping."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotlab.functions.hashing import hnum
from shotlab.functions.text import WORD_PATTERN, pieces
from shotlab.operators.sampling import with_reps


def corpus_vocab(docs: DataFrame, text_col: str = "text", pattern: str = WORD_PATTERN) -> DataFrame:
    """Distinct tokens ``(token)`` of a corpus (case kept): word tokens, or any other pattern's.

    A distributed ``distinct`` (partial aggregation before the shuffle).
    """
    return docs.select(F.explode(F.array_distinct(pieces(F.col(text_col), pattern))).alias("token")).distinct()


def user_vocab(words: DataFrame, col: str = "token", pattern: str = WORD_PATTERN) -> DataFrame:
    """Distinct entries of a user's vocabulary that are exactly one token; the others and
    nulls are left out."""
    return words.select(F.col(col).alias("token")).filter(single_token("token", pattern)).distinct()


def single_token(col: str = "token", pattern: str = WORD_PATTERN):
    """Entry survives a re-tokenisation as exactly one token (B9)."""
    return F.coalesce(pieces(F.col(col), pattern) == F.array(F.col(col)), F.lit(False))


def dense_index(df: DataFrame, by: list[str], order: list, out: str = "idx", keep: list | None = None) -> DataFrame:
    """0-based position of each row in ``order`` within its ``by`` group, for groups of any size.

    A global range-partitioned sort, then ``monotonically_increasing_id`` gives
    (partition, offset-in-partition); per (partition, group) counts — one row
    per partition and group — are turned into start offsets with a window over
    that small table and broadcast back. No group is ever collected into one
    task (unlike ``row_number`` over ``partitionBy(by)``).
    """
    s = df.orderBy(*by, *order).withColumn("_mid", F.monotonically_increasing_id())
    s = s.withColumn("_pid", F.shiftright("_mid", 33)).withColumn("_rec", F.col("_mid").bitwiseAND((1 << 33) - 1))
    # Both branches below must see one execution of the sort (AQE could coalesce two
    # executions differently). A lost cached block is recomputed from that same
    # execution's shuffle, so ids stay consistent under executor loss.
    s = s.persist(StorageLevel.MEMORY_AND_DISK)
    if keep is not None:
        keep.append(s)      # the caller unpersists it
    parts = s.groupBy("_pid", *by).agg(F.min("_rec").alias("_first"), F.count("*").alias("_cnt"))
    w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("_pid") \
        .rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_start", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    # The partition table has (#partitions x #groups) rows: Spark broadcasts it when it is small.
    s = s.join(parts.select("_pid", *by, "_first", "_start"), ["_pid", *by])
    return (s.withColumn(out, F.col("_start") + F.col("_rec") - F.col("_first"))
            .drop("_mid", "_pid", "_rec", "_first", "_start"))


#: Rounds of the keyed bijection, and steps back into its range.
ROUNDS, WALK = 6, 16
#: Tokens of a text that share one map of images.
PIECES = 256


def sides(n: int) -> tuple[int, int]:
    """(a, b) with a * b >= n and fewer than a places too many."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def network(x, n: int, seed: int, rep="rep"):
    """Column: one pass of the replicate's keyed bijection of the a x b places."""
    a, b = sides(n)
    start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))

    def turn(s, i):
        left = F.struct(F.pmod(s["l"] + hnum(seed, "permute", rep, i, s["r"]), F.lit(a)).cast("long").alias("l"), s["r"].alias("r"))
        right = F.struct(s["l"].alias("l"), F.pmod(s["r"] + hnum(seed, "permute", rep, i, s["l"]), F.lit(b)).cast("long").alias("r"))
        return F.when(i % 2 == 0, left).otherwise(right)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * b + s["r"])


def walked(x, n: int, seed: int, rep="rep"):
    """Column: ``x`` sent on by ``network`` until it falls below ``n``."""
    to = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), x, lambda x, _: F.when(x >= n, network(x, n, seed, rep)).otherwise(x))
    return F.when(to < n, to).otherwise(F.raise_error(F.lit("no image within the walk")).cast("long"))


def image_place(place, n: int, seed: int, rep="rep"):
    """Column: image of ``place`` in 0 .. n - 1 under the replicate's keyed bijection.

    A Feistel network on a x b places (x = l * b + r): rounds add a keyed hash of one part to the
    other, modulo its size, so each round is a bijection. The few images beyond n are sent on
    until they fall below it (cycle walking), which leaves a bijection of 0 .. n - 1."""
    return walked(network(place.cast("long"), n, seed, rep), n, seed, rep)


def indexed(vocab: DataFrame, keep: list | None = None) -> tuple[DataFrame, int]:
    """``(token, q)`` with dense places in token order, and the number of tokens (V rows, once for all
    replicates; persisted, the caller unpersists)."""
    rows = dense_index(vocab.select("token"), [], [F.col("token")], "q", keep).persist(StorageLevel.MEMORY_AND_DISK)
    if keep is not None:
        keep.append(rows)
    return rows, rows.count()


def images(wanted: DataFrame, vocab: DataFrame, n: int, seed: int) -> DataFrame:
    """``(rep, token, new_token)`` of the wanted ``(rep, token)`` pairs; ``vocab`` and ``n`` as ``indexed``
    gives them. Two joins by key; nothing is sorted and no row is made for other pairs."""
    return placed_images(wanted.select("rep", "token").join(vocab, "token"), vocab, n, seed)


def placed_images(at: DataFrame, vocab: DataFrame, n: int, seed: int) -> DataFrame:
    """``images`` of pairs that have their places, ``(rep, token, q)``: the images by arithmetic, one join for
    their tokens. The rounds of the first network are columns one after the other, compiled by
    Spark; only places beyond ``n`` walk on."""
    a, b = sides(n)
    at = at.select("rep", "token", F.floor(F.col("q") / b).cast("long").alias("_l"), F.pmod(F.col("q"), F.lit(b)).cast("long").alias("_r"))
    for i in range(ROUNDS):
        to, by, size = ("_l", "_r", a) if i % 2 == 0 else ("_r", "_l", b)
        at = at.withColumn(to, F.pmod(F.col(to) + hnum(seed, "permute", "rep", F.lit(i), by), F.lit(size)).cast("long"))
    at = at.select("rep", "token", (F.col("_l") * b + F.col("_r")).alias("_x"))
    at = at.select("rep", "token", F.when(F.col("_x") < n, F.col("_x")).otherwise(walked(F.col("_x"), n, seed)).alias("_to"))
    return at.join(vocab.select(F.col("q").alias("_to"), F.col("token").alias("new_token")), "_to").select("rep", "token", "new_token")


def permutation(vocab: DataFrame, repeats: int, seed: int, keep: list | None = None) -> DataFrame:
    """Random bijection of the vocabulary per replicate: ``(rep, token, new_token)`` for all of it."""
    rows, n = indexed(vocab, keep)
    every = with_reps(rows, repeats).withColumn("rep", F.col("rep").cast("int"))
    return placed_images(every, rows, n, seed)


def permute_tokens(df: DataFrame, tokens_col: str, token_map: DataFrame, protected: DataFrame,
                   out: str = "permuted", key=("rep", "test_id")) -> DataFrame:
    """Replace every unprotected token by its image under the replicate's permutation.

    ``df`` has ``(*key, tokens_col ARRAY<STRING>)``, keys unique; ``protected`` is ``(rep, token)``
    (label and template tokens). Texts are cut into runs of ``PIECES`` tokens. The distinct tokens
    of a run are joined to the map (shuffle join: the map grows with the vocabulary; a
    frequent token repeats on the left side only, which a skew join splits), and come back
    as one map for the run: looking a token up scans at most ``PIECES`` entries, so the work is
    linear in the text.
    """
    key = list(key)
    last = F.greatest(F.floor((F.size(tokens_col) - 1) / PIECES), F.lit(0)).cast("int")
    runs = df.select(*key, F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        i.alias("i"), F.slice(F.col(tokens_col), i * PIECES + 1, F.lit(PIECES)).alias("t")))).alias("_r")).select(*key, F.col("_r.i").alias("_i"), F.col("_r.t").alias("_t"))
    ex = runs.select(*key, "_i", F.explode(F.array_distinct("_t")).alias("token"))
    m = token_map.join(protected.select("rep", "token").distinct(), ["rep", "token"], "left_anti")
    maps = (ex.join(m, ["rep", "token"]).groupBy(*key, "_i")
            .agg(F.map_from_entries(F.collect_list(F.struct("token", "new_token"))).alias("_m")))
    j = runs.join(maps, [*key, "_i"], "left")
    image = F.transform("_t", lambda t: F.coalesce(F.element_at("_m", t), t))
    j = j.select(*key, "_i", F.when(F.col("_m").isNull(), F.col("_t")).otherwise(image).alias("_p"))
    return j.groupBy(*key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_p"))), lambda r: r["_p"])).alias(out))
