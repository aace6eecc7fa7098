"""Seeded, partition-independent sampling operators.

All draws are ``md5`` keys (``shotlab.functions.hashing``), so a replicate's
sample is the k rows with the smallest key: a uniform sample without
replacement that is the same on 1 or 1000 executors and in plain SQL.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotlab.functions.hashing import hkey, hnum


def replicates(spark: SparkSession, repeats: int, seed: int) -> DataFrame:
    """``repeats`` replicate ids with a derived seed in [1, 99999] (drawn with replacement)."""
    return (spark.range(repeats).select(F.col("id").cast("int").alias("rep"))
            .withColumn("rep_seed", (hnum(seed, "rep", "rep") % 99999 + 1).cast("int")))


def with_reps(df: DataFrame, repeats: int) -> DataFrame:
    """Attach a ``rep`` column (0..R-1): each row once per replicate, no join."""
    if repeats < 1:
        raise ValueError(f"repeats={repeats}: at least one replicate is needed")
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))


def candidates(base: DataFrame, share: float, repeats: int, seed: int, salt: str, id_col: str = "doc_id") -> DataFrame:
    """``base`` with ``rep`` for the replicates in which a row's key lies in the lowest ``share``
    of all keys. A row is hashed once per replicate inside one expression and explodes to the
    few replicates that may take it."""
    if share >= 1:
        return with_reps(base, repeats)
    below = F.lit(f"{int(share * 16 ** 15):015x}")
    reps = F.filter(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda r: hkey(seed, salt, r, id_col) < below)
    return base.withColumn("rep", F.explode(reps))


def sample_k(base: DataFrame, k: int, repeats: int, seed: int, salt: str, id_col: str = "doc_id", *,
             rows: int | None = None, keep: list | None = None) -> DataFrame:
    """Per replicate, the ``k`` rows of ``base`` with the smallest key; adds ``rep`` and ``pos``.

    ``pos`` (0-based) is the draw order. Only keys below a share of the key space are ranked:
    the share expects some more than k rows a replicate of ``rows`` (counted if not given), and
    grows fourfold until every replicate has k candidates or all rows (repeated ids share a key,
    so no share is sure at once). About R*k candidates are ranked instead of R*N rows. They are
    persisted and appended to ``keep`` for the caller to free; without ``keep`` they are hashed
    again after the count.
    """
    if repeats < 1:
        raise ValueError(f"repeats={repeats}: at least one replicate is needed")
    n = base.count() if rows is None else rows
    need, share = min(k, n), (k + 12 * math.sqrt(k) + 60) / max(n, 1)
    while True:
        found = candidates(base, share, repeats, seed, salt, id_col)
        if share >= 1 or not need:
            break
        if keep is not None:
            found = found.persist(StorageLevel.MEMORY_AND_DISK)
        reps, least = found.groupBy("rep").count().agg(F.count("*"), F.min("count")).first()
        if reps == repeats and least >= need:
            if keep is not None:
                keep.append(found)
            break
        if keep is not None:
            found.unpersist()
        share *= 4
    w = Window.partitionBy("rep").orderBy(hkey(seed, salt, "rep", id_col), F.col(id_col))
    return (found.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= k)
            .withColumn("pos", (F.col("_rn") - 1).cast("int")).drop("_rn"))


def sample_replicates(labelled: DataFrame, test_num: int, repeats: int, seed: int, with_text: bool = False, *,
                      sizes: dict | None = None, keep: list | None = None) -> DataFrame:
    """Replicate samples: 2T train rows (the demonstration pool) and T test rows.

    Output ``(rep, split, pos, doc_id, label_idx[, text])``. Text stays out of
    the sampling shuffle and is joined back by id only when asked for. ``sizes`` are the
    splits' row counts, if known; ``keep`` as in ``sample_k``.
    """
    lab = labelled.select("doc_id", "label_idx", "split")
    parts = [sample_k(lab.filter(F.col("split") == split), k, repeats, seed, "sample", rows=(sizes or {}).get(split), keep=keep)
             for split, k in (("train", 2 * test_num), ("test", test_num))]
    out = parts[0].unionByName(parts[1]).select("rep", "split", "pos", "doc_id", "label_idx")
    if with_text:
        out = out.join(labelled.select("doc_id", "text"), "doc_id")
    return out


def pick_from_lists(spark: SparkSession, lists, repeats: int, seed: int, salt: str = "label_word") -> DataFrame:
    """One word per (rep, class) out of the class's list, independently per class.

    ``lists`` is a small fixed Python list of lists; output ``(rep, label_idx, label_word)``.
    """
    rows = [(ci, wi, w) for ci, ws in enumerate(lists) for wi, w in enumerate(ws)]
    words = spark.createDataFrame(rows, "label_idx INT, word_pos INT, word STRING")
    words = with_reps(words, repeats)
    key = hkey(seed, salt, "rep", "label_idx", "word_pos")
    return (words.groupBy("rep", "label_idx")
            .agg(F.min_by("word", F.struct(key, F.col("word_pos"))).alias("label_word")))


def pick_tokens(vocab: DataFrame, n_labels: int, repeats: int, seed: int,
                salt: str = "label_token", distinct: bool = False) -> DataFrame:
    """One vocabulary token per (rep, class), uniform, with replacement across classes.

    The token with the smallest key ``(rep, class, token)`` wins: an aggregate
    with map-side partial ``min_by``, so only R*L rows per partition shuffle and
    no dense vocabulary positions are needed. ``distinct=True`` forbids two
    classes of one replicate sharing a token (the reference allows it).
    """
    v = vocab.select("token")
    cls = F.explode(F.sequence(F.lit(0), F.lit(n_labels - 1)))
    x = with_reps(v, repeats).withColumn("label_idx", cls)
    key = hkey(seed, salt, "rep", "label_idx", "token")
    if not distinct:
        return (x.groupBy("rep", "label_idx")
                .agg(F.min_by("token", F.struct(key, F.col("token"))).alias("label_word")))
    # Without replacement: classes pick in order among their L smallest keys.
    w = Window.partitionBy("rep", "label_idx").orderBy(key, F.col("token"))
    top = x.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n_labels)
    cand = top.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("label_idx", "_r", "token"))).alias("c"))

    def choose(acc, c):
        taken = F.transform(acc, lambda s: s["token"])
        ok = (~F.array_contains(taken, c["token"])) & \
             (~F.exists(acc, lambda s: s["label_idx"] == c["label_idx"]))
        return F.when(ok, F.concat(acc, F.array(F.struct(c["label_idx"].alias("label_idx"),
                                                        c["token"].alias("token"))))).otherwise(acc)
    init = F.array().cast("array<struct<label_idx:int,token:string>>")
    picked = cand.select("rep", F.explode(F.aggregate("c", init, choose)).alias("p"))
    return picked.select("rep", F.col("p.label_idx").alias("label_idx"), F.col("p.token").alias("label_word"))


def floyd_draw(n_col, k: int, seed: int, salt: str, *key_cols):
    """Column: ``k`` distinct positions in [0, n) by Floyd's algorithm (exactly k draws).

    For j = n-k..n-1: t = hash mod (j+1); take t unless already taken, else j.
    Gives a uniform k-subset with no rejection loop and no cross product.
    """
    n = n_col

    def step(acc, j):
        t = (hnum(seed, salt, *key_cols, j) % (j + 1)).cast("int")
        return F.when(F.array_contains(acc, t), F.concat(acc, F.array(j.cast("int")))) \
                .otherwise(F.concat(acc, F.array(t)))
    return F.aggregate(F.sequence(n - F.lit(k), n - F.lit(1)), F.array().cast("array<int>"), step)


def draw_demos(test: DataFrame, pool_size: int, k: int, seed: int) -> DataFrame:
    """For every test row, ``k`` distinct pool positions in random order.

    ``test`` has ``(rep, doc_id)``; output ``(rep, test_id, ord, train_pos)``.
    One row-local higher-order expression (no join, no window): O(T*k).
    """
    if not 0 <= k <= pool_size:
        raise ValueError(f"k={k} demonstrations from a pool of {pool_size}")
    t = test.select("rep", F.col("doc_id").alias("test_id"))
    if k == 0:      # zero-shot: no demonstrations (sequence(n, n - 1) would count down)
        return t.select("rep", "test_id", F.lit(0).alias("ord"), F.lit(0).alias("train_pos")).limit(0)
    drawn = t.withColumn("_d", floyd_draw(F.lit(pool_size), k, seed, "demo", "rep", "test_id"))
    # C4: order of the demonstrations = order of a second key (a uniform shuffle).
    keyed = F.transform("_d", lambda p: F.struct(hkey(seed, "demo_order", "rep", "test_id", p).alias("h"),
                                                  p.alias("p")))
    return (drawn.select("rep", "test_id", F.posexplode(F.array_sort(keyed)).alias("ord", "_s"))
            .select("rep", "test_id", F.col("ord").cast("int"), F.col("_s.p").alias("train_pos")))


def _attempts(pool: DataFrame, k: int, attempts, seed: int) -> DataFrame:
    """First ``k`` rows of each attempt's order; ``attempts`` is a column (array of attempt ids)."""
    att = pool.select("rep", "pos", "doc_id", "label_idx", F.explode(attempts).alias("attempt"))
    key = F.when(F.col("attempt") == 0, F.format_string("%08d", F.col("pos"))) \
           .otherwise(hkey(seed, "coverage", "rep", "attempt", "pos"))
    w = Window.partitionBy("rep", "attempt").orderBy(key, F.col("pos"))
    return att.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def covering_attempts(pool: DataFrame, k: int, n_needed: DataFrame, seed: int) -> dict[int, int]:
    """Per replicate, the first attempt whose k rows hold as many classes as needed.

    Attempts run in doubling batches over the replicates still uncovered, until
    all are: R numbers reach the driver in each round. A replicate whose pool
    lacks the classes can never be covered and is an error; one with fewer
    rows than classes keeps attempt 0 (the baseline then guesses).
    """
    need = {r["rep"]: r["n_classes"] for r in n_needed.collect()}
    have = {r["rep"]: r["n"] for r in pool.groupBy("rep").agg(F.countDistinct("label_idx").alias("n")).collect()}
    lacking = sorted(r for r, n in need.items() if k >= n and have.get(r, 0) < n)
    if lacking:
        raise ValueError(f"the train pools of replicates {lacking} hold fewer classes than their test sets")
    found = {r: 0 for r, n in need.items() if k < n}
    low, size = 0, 1
    while len(found) < len(need):
        open_ = [r for r in need if r not in found]
        some = pool.filter(F.col("rep").isin(open_))
        drawn = _attempts(some, k, F.sequence(F.lit(low), F.lit(low + size - 1)), seed)
        classes = drawn.groupBy("rep", "attempt").agg(F.countDistinct("label_idx").alias("n"))
        enough = F.coalesce(*[F.when(F.col("rep") == r, F.col("n") >= need[r]) for r in open_])
        found |= {r["rep"]: r["a"] for r in classes.filter(enough).groupBy("rep").agg(F.min("attempt").alias("a")).collect()}
        low, size = low + size, size * 2
    return found


def coverage_sample(pool: DataFrame, k: int, n_needed: DataFrame, seed: int) -> DataFrame:
    """Baseline train set: k pool rows holding at least as many classes as the test set.

    Attempt 0 is the first k rows of the pool (draw order); attempt a > 0 is a
    fresh k-sample. The first covering attempt per replicate wins
    (``covering_attempts``); there is no bound on their number.
    ``n_needed`` is ``(rep, n_classes)``. Output ``(rep, pos, doc_id, label_idx, attempt)``.
    """
    found = covering_attempts(pool, k, n_needed, seed)
    chosen = F.coalesce(*[F.when(F.col("rep") == r, F.lit(a)) for r, a in sorted(found.items())], F.lit(-1)) if found else F.lit(-1)
    return _attempts(pool.filter(chosen >= 0), k, F.array(chosen), seed)
