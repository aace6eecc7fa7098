"""Label operators: label maps, verbalising, inverse lookup, memo text, dev/test split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotlab.operators.sampling import pick_from_lists, pick_tokens, with_reps
from shotlab.sources.registry import Task, word_lists


def label_map(spark: SparkSession, task: Task, pattern: str, repeats: int, seed: int,
              vocab: DataFrame | None = None, strict: bool = True,
              distinct_tokens: bool = False) -> DataFrame:
    """``(rep, task, label_idx, label_word, label_org)`` for a task pattern.

    ``label_org`` is always the original word. Size R*L rows: always broadcast.
    """
    org = spark.createDataFrame([(i, w) for i, w in enumerate(task.labels)],
                                "label_idx INT, label_org STRING")
    org = with_reps(org, repeats).withColumn("rep", F.col("rep").cast("int"))
    kind, lists = word_lists(task, pattern, strict)
    if kind == "original":
        words = org.select("rep", "label_idx", F.col("label_org").alias("label_word"))
    elif kind in ("fixed", "lists"):
        words = pick_from_lists(spark, lists, repeats, seed)
    else:
        if vocab is None:
            raise ValueError(f"pattern {pattern!r} on {task.key!r} draws random tokens: pass vocab=")
        words = pick_tokens(vocab, task.n_labels, repeats, seed, distinct=distinct_tokens)
    return (org.join(words, ["rep", "label_idx"])
            .select(F.col("rep").cast("int"), F.lit(task.key).alias("task"),
                    F.col("label_idx").cast("int"), "label_word", "label_org"))


def verbalize(df: DataFrame, lmap: DataFrame) -> DataFrame:
    """Attach ``label_word`` by class id. An id without a word is an error, never a lost row
    (``unmatched`` counts them)."""
    words = lmap.select("rep", "label_idx", F.col("label_word").alias("_word"))
    missing = F.raise_error(F.concat(F.lit("no label word for class id "), F.coalesce(F.col("label_idx").cast("string"), F.lit("null"))))
    return (df.join(F.broadcast(words), ["rep", "label_idx"], "left")       # R*L rows
            .withColumn("label_word", F.coalesce("_word", missing.cast("string"))).drop("_word"))


def unmatched(df: DataFrame, n_labels: int) -> DataFrame:
    """``(label_idx, n)``: rows whose class id is null or outside 0..n_labels-1."""
    ok = F.coalesce((F.col("label_idx") >= 0) & (F.col("label_idx") < n_labels), F.lit(False))
    return df.filter(~ok).groupBy("label_idx").agg(F.count("*").alias("n"))


def merged_index(lmap: DataFrame) -> DataFrame:
    """``(rep, label_word, merged_idx)``: first class carrying each word.

    The reference looks classes up by word (``list.index``), so two classes
    sharing a word merge into the first.
    """
    return lmap.groupBy("rep", "label_word").agg(F.min("label_idx").alias("merged_idx"))


def label_merge(df: DataFrame, lmap: DataFrame, word_col: str = "label_word") -> DataFrame:
    """Attach ``merged_idx`` = index of the first class with the row's word."""
    m = merged_index(lmap).withColumnRenamed("label_word", word_col)
    return df.join(F.broadcast(m), ["rep", word_col])


def memo_text(df: DataFrame, lmap: DataFrame) -> DataFrame:
    """Memo patterns: each row's text becomes its class's original label word.

    The class is looked up through the (possibly merged) label word, as the
    reference does.
    """
    m = merged_index(lmap)
    org = lmap.select("rep", F.col("label_idx").alias("merged_idx"), F.col("label_org").alias("_org"))
    lk = F.broadcast(m.join(org, ["rep", "merged_idx"]))
    return (df.join(lk, ["rep", "label_word"]).drop("text", "merged_idx")
            .withColumnRenamed("_org", "text"))


def dev_test_split(test: DataFrame, test_num: int) -> DataFrame:
    """Positions ``< floor(T/2)`` are test; later rows whose text is not among those are dev.

    ``test`` has ``(rep, pos, doc_id, text)``; output adds ``part`` and drops
    later rows that repeat a first-half text (left anti join on text).
    """
    half = test_num // 2
    first = test.filter(F.col("pos") < half)
    rest = test.filter(F.col("pos") >= half)
    dev = rest.join(first.select("rep", "text"), ["rep", "text"], "left_anti")
    return (first.withColumn("part", F.lit("test"))
            .unionByName(dev.withColumn("part", F.lit("dev"))))
