"""Prompt assembly: demonstrations joined to their pool rows, ordered string aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def present(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` whose null values in ``cols`` raise when they are read."""
    return df.withColumns({c: F.coalesce(F.col(c), F.raise_error(F.lit(f"null {c} in the sample")).cast("string")) for c in cols})


def demo_rows(demos: DataFrame, pool: DataFrame, cols=("doc_id", "label_word", "text")) -> DataFrame:
    """Join drawn positions ``(rep, test_id, ord, train_pos)`` to the pool rows ``(rep, pos, ...)``."""
    p = pool.select("rep", F.col("pos").alias("train_pos"), *cols)
    return demos.join(p, ["rep", "train_pos"])


def build_prompts(test: DataFrame, demos: DataFrame, pool: DataFrame,
                  prompt_x: str, prompt_y: str) -> DataFrame:
    """``(rep, test_id, gold_word, prompt)``.

    prompt = concat over demonstrations in ``ord`` of (x + text + y + label)
    followed by x + query + y; no separator, no truncation. The pieces are
    aggregated per (rep, test_id) — at most k per group — with an
    ``array_sort`` of ``(ord, piece)`` structs, never a bare ``collect_list``.
    ``test`` has ``(rep, doc_id, text, label_word)``. A null text or label word
    is an error, never a prompt with a piece missing.
    """
    px, py = F.lit(prompt_x), F.lit(prompt_y)
    pool, test = present(pool, "text", "label_word"), present(test, "text", "label_word")
    pieces = demo_rows(demos, pool, ("label_word", "text")).select(
        "rep", "test_id", "ord", F.concat(px, "text", py, "label_word").alias("piece"))
    demo_text = (pieces.groupBy("rep", "test_id")
                 .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "piece"))),
                                               lambda s: s["piece"]), "").alias("demo_text")))
    q = test.select("rep", F.col("doc_id").alias("test_id"), "text", F.col("label_word").alias("gold_word"))
    return (q.join(demo_text, ["rep", "test_id"], "left")
            .select("rep", "test_id", "gold_word",
                    F.concat(F.coalesce("demo_text", F.lit("")), px, "text", py).alias("prompt")))
