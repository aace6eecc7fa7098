"""Classification metrics as aggregations (one shuffle each, groups by replicate)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Column
from pyspark.sql import functions as F


def mean0(col) -> Column:
    """Mean that is 0 for an empty input."""
    return F.coalesce(F.avg(col), F.lit(0.0))


def class_counts(preds: DataFrame, by, gold: str, pred: str) -> DataFrame:
    """``(*by, _cls, n_gold, n_pred, tp)`` over the classes in gold ∪ pred: each prediction row
    contributes to its gold class and its predicted class, one aggregation."""
    e = preds.select(*by, F.explode(F.array(
        F.struct(F.col(gold).alias("_cls"), F.lit(1).alias("_g"), F.lit(0).alias("_p"),
                 (F.col(gold) == F.col(pred)).cast("int").alias("_tp")),
        F.struct(F.col(pred).alias("_cls"), F.lit(0).alias("_g"), F.lit(1).alias("_p"), F.lit(0).alias("_tp")),
    )).alias("_e")).select(*by, "_e.*")
    return e.groupBy(*by, "_cls").agg(F.sum("_g").alias("n_gold"), F.sum("_p").alias("n_pred"), F.sum("_tp").alias("tp"))


def class_report(preds: DataFrame, by=("rep",), gold: str = "gold_idx", pred: str = "pred_idx") -> DataFrame:
    """``(*by, row, precision, recall, f1, support)``: a row per class (its id as text) and the rows
    ``macro`` (mean over classes), ``weighted`` (by support) and ``micro`` (pooled counts).

    The totals come from the same aggregate by grouping sets. Precision of a class never predicted
    and recall of one that never occurs are 0."""
    by = list(by)
    per = class_counts(preds, by, gold, pred)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, np_, ng = F.col("tp"), F.col("n_pred"), F.col("n_gold")
    per = per.withColumns({"precision": share(tp, np_), "recall": share(tp, ng), "f1": share(2.0 * tp, np_ + ng)})
    keys = [F.col(c) for c in by]
    kinds = ("precision", "recall", "f1")
    sets = per.groupingSets([[*keys, F.col("_cls")], keys], *keys, F.col("_cls")).agg(
        F.grouping("_cls").alias("_all"), F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred"), F.sum("n_gold").alias("n_gold"),
        *[F.avg(k).alias(f"_a_{k}") for k in kinds], *[F.sum(F.col(k) * F.col("n_gold")).alias(f"_w_{k}") for k in kinds])
    row = lambda name, *x: F.struct(name.alias("row"), *[v.alias(k) for v, k in zip(x, kinds, strict=True)], ng.cast("long").alias("support"))
    mean = [F.col(f"_a_{k}") for k in kinds]
    totals = F.array(row(F.lit("macro"), *mean), row(F.lit("weighted"), *[share(F.col(f"_w_{k}"), ng) for k in kinds]),
                     row(F.lit("micro"), share(tp, np_), share(tp, ng), share(2.0 * tp, np_ + ng)))
    rows = F.when(F.col("_all") == 1, totals).otherwise(F.array(row(F.col("_cls").cast("string"), *mean)))
    return sets.select(*by, F.explode(rows).alias("_r")).select(*by, "_r.*")


def macro_f1(preds: DataFrame, by=("rep",), gold: str = "gold_idx", pred: str = "pred_idx",
             out: str = "macro_f1") -> DataFrame:
    """Unweighted mean over classes in gold ∪ pred of 2tp / (2tp + fp + fn).

    One aggregation per (group, class), then a mean per group.
    """
    by = list(by)
    per = class_counts(preds, by, gold, pred)
    f1 = F.when(F.col("tp") == 0, F.lit(0.0)).otherwise(2.0 * F.col("tp") / (F.col("n_gold") + F.col("n_pred")))
    return per.groupBy(*by).agg(F.avg(f1).alias(out))


def accuracy(preds: DataFrame, by=("rep",), gold: str = "gold_idx", pred: str = "pred_idx") -> DataFrame:
    return preds.groupBy(*by).agg(F.avg((F.col(gold) == F.col(pred)).cast("double")).alias("accuracy"))


def confusion(preds: DataFrame, by=("rep",), gold: str = "gold_idx", pred: str = "pred_idx") -> DataFrame:
    return preds.groupBy(*by, gold, pred).agg(F.count("*").alias("n"))


def grid_best(grid: DataFrame, by=("rep",), metric: str = "f1") -> DataFrame:
    """Best grid point per replicate (selected on the test metric, as the reference does)."""
    cfg = F.struct("c", "solver", "ngc_max", "ngw_max")
    # Ties (to 9 decimals) go to the smallest (c, solver, ngc_max, ngw_max).
    order = F.struct(-F.round(metric, 9), F.col("c"), F.col("solver"), F.col("ngc_max"), F.col("ngw_max"))
    return grid.groupBy(*by).agg(F.max(metric).alias("best_f1"), F.min_by(cfg, order).alias("best"))


def replicate_summary(f1: DataFrame, ranks: DataFrame | None = None, f1_col: str = "macro_f1") -> DataFrame:
    """Mean F1 over replicates (0 if none) and micro-averaged gold rank over all prompts."""
    if ranks is None:
        return f1.agg(mean0(f1_col).alias("mean_f1"), F.count("*").alias("n_reps"))
    r = ranks.groupBy("rep").agg(F.sum("gold_rank").alias("_sr"), F.count("*").alias("_n"))
    j = f1.join(r, "rep", "left")
    return j.agg(mean0(f1_col).alias("mean_f1"), F.count("*").alias("n_reps"),
                 F.coalesce(F.sum("_sr") / F.sum("_n"), F.lit(0.0)).alias("mean_rank"),
                 F.coalesce(F.sum("_n"), F.lit(0)).alias("n_prompts"))
