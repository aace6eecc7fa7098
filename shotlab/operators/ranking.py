"""Per-prompt candidate operators: softmax, argmax, gold rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def softmax(scores: DataFrame, by=("rep", "test_id"), col: str = "score", out: str = "prob") -> DataFrame:
    """exp(s - max) / sum(exp(s - max)) over each prompt's candidates (groups of L rows)."""
    w = Window.partitionBy(*by)
    z = F.exp(F.col(col) - F.max(col).over(w))
    return scores.withColumn(out, z / F.sum(z).over(w))


def vocab_softmax(logits: DataFrame, candidates: DataFrame, n_vocab: int, rest: float = 0.0, by=("rep", "test_id"), token: str = "token",
                  col: str = "logit", out: str = "prob") -> DataFrame:
    """Softmax over a whole vocabulary of ``n_vocab`` tokens, sliced to ``candidates`` and not renormalised.

    ``logits`` has ``(*by, token, logit)`` in long form, tokens of a prompt unique; tokens it does not
    list have the logit ``rest``. ``candidates`` has ``(*by, token, ...)``, all its columns are kept.
    Exponentials are summed per (prompt, whole part of the logit), relative to that part: a
    mergeable sum that neither overflows nor needs the maximum first, one exchange with partial
    sums before it. A prompt then has one row per distinct whole part. Prompts without a listed
    token spread evenly; null logits count as unlisted."""
    by = list(by)
    known = logits.filter(F.col(col).isNotNull())
    part = F.floor(F.col(col)).alias("_part")
    sums = known.groupBy(*by, part).agg(F.sum(F.exp(F.col(col) - F.floor(F.col(col)))).alias("_sum"), F.count("*").alias("_n"))
    per = sums.groupBy(*by).agg(F.max("_part").alias("_top"), F.sum("_n").alias("_listed"), F.collect_list(F.struct("_part", "_sum")).alias("_parts"))
    j = candidates.join(known.select(*by, token, F.col(col).alias("_logit")), [*by, token], "left").join(per, by, "left")
    top = F.greatest(F.coalesce("_top", F.lit(rest)), F.lit(rest)).cast("double")
    unlisted = (F.lit(n_vocab) - F.coalesce("_listed", F.lit(0))) * F.exp(F.lit(rest) - F.col("_max"))
    total = F.aggregate(F.coalesce("_parts", F.array().cast("array<struct<_part:bigint,_sum:double>>")), F.lit(0.0), lambda a, x: a + x["_sum"] * F.exp(x["_part"] - F.col("_max")))
    j = j.withColumn("_max", top).withColumn("_total", total + unlisted)
    return j.select(*candidates.columns, (F.exp(F.coalesce("_logit", F.lit(rest)) - F.col("_max")) / F.col("_total")).alias(out))


def predict_and_rank(scores: DataFrame, gold: DataFrame, score_col: str = "score", n_labels: int | None = None) -> DataFrame:
    """``(rep, test_id, gold_idx, pred_idx, gold_rank)``.

    pred = argmax with ties to the lowest class id; rank = 1 + number of
    candidates scoring strictly higher than the gold class (ties take the best
    rank). One aggregation per prompt over its L candidates.
    ``gold`` has ``(rep, test_id, gold_idx)``; a prompt without scores, or with
    another number of candidates than ``n_labels``, is an error.
    """
    g = (scores.groupBy("rep", "test_id")
         .agg(F.max_by("label_idx", F.struct(F.col(score_col), -F.col("label_idx"))).alias("pred_idx"),
              F.collect_list(F.struct(F.col("label_idx"), F.col(score_col).alias("s"))).alias("_c")))
    j = gold.join(g, ["rep", "test_id"], "left")
    whole = F.col("_c").isNotNull() & (F.lit(True) if n_labels is None else F.size("_c") == n_labels)
    short = F.raise_error(F.concat(F.lit("prompt without a score for every candidate: "), F.col("rep"), F.lit("/"), F.col("test_id")))
    j = j.withColumn("pred_idx", F.when(F.coalesce(whole, F.lit(False)), F.col("pred_idx")).otherwise(short.cast("int")))
    gold_score = F.aggregate(F.filter("_c", lambda c: c["label_idx"] == F.col("gold_idx")),
                             F.lit(None).cast("double"), lambda acc, c: c["s"])
    rank = F.size(F.filter("_c", lambda c: c["s"] > gold_score)) + 1
    return j.select("rep", "test_id", "gold_idx", "pred_idx", rank.cast("int").alias("gold_rank"))


def predict(scores: DataFrame, score_col: str = "score") -> DataFrame:
    return (scores.groupBy("rep", "test_id")
            .agg(F.max_by("label_idx", F.struct(F.col(score_col), -F.col("label_idx"))).alias("pred_idx")))
