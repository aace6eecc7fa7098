"""Candidate scoring: the user's model hook and a built-in stand-in scorer."""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlab.functions.text import token_set
from shotlab.operators.partitioning import sampled_docs
from shotlab.shared import held

SCORE_SCHEMA = "rep INT, test_id BIGINT, label_idx INT, score DOUBLE"


def score_with(prompts: DataFrame, lmap: DataFrame,
               fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
               schema: str = SCORE_SCHEMA) -> DataFrame:
    """Score every candidate label of every prompt with a user batch function.

    ``fn`` receives Arrow batches of ``(rep, test_id, prompt, labels)`` —
    ``labels`` is the replicate's ordered label words — and yields
    ``(rep, test_id, label_idx, score)``; it loads its model once per
    partition (``mapInPandas``). Scores may be probabilities or logits.
    """
    labels = (lmap.groupBy("rep")
              .agg(F.transform(F.array_sort(F.collect_list(F.struct("label_idx", "label_word"))),
                               lambda s: s["label_word"]).alias("labels")))
    inp = prompts.select("rep", "test_id", "prompt").join(F.broadcast(labels), "rep")
    return inp.mapInPandas(fn, schema)


def jaccard(a, b):
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.when(union == 0, F.lit(0.0)).otherwise(inter / union)


def overlap_scores(test: DataFrame, demo_docs: DataFrame, lmap: DataFrame, docs: DataFrame,
                   digits: int = 9, rows: int | None = None, keep: list | None = None) -> DataFrame:
    """Stand-in scorer (not a language model; its F1 is no ICL quality).

    score(class) = sum over the prompt's demonstrations labelled with the
    class's word of Jaccard(token set of query, token set of demonstration).
    ``test``: ``(rep, doc_id)``; ``demo_docs``: ``(rep, test_id, doc_id, label_word)``;
    ``docs``: ``(doc_id, text)``. Token sets are computed once per distinct
    document (semi-join to the sampled ids). Every class gets a score (0 if no
    demonstration carries its word). Rounded to ``digits`` so float summation
    order cannot break ties differently.
    """
    keys = ["rep", "doc_id"] if "rep" in docs.columns else ["doc_id"]
    ids = (test.select(*keys).unionByName(demo_docs.select(*keys))).distinct()
    sel = sampled_docs(docs, ids, rows) if keys == ["doc_id"] else docs.join(ids, keys, "left_semi")
    # read twice below; ``keep`` collects what the caller unpersists
    toks = held(sel.select(*keys, token_set("text").alias("toks")), keep)
    # Rows carry whole token arrays: join by shuffle, never broadcast (measured ~3x
    # slower when AQE broadcasts them, and their size grows with document length).
    qt = toks.withColumnRenamed("doc_id", "test_id").withColumnRenamed("toks", "q").hint("merge")
    dt = toks.withColumnRenamed("toks", "d").hint("merge")
    pairs = demo_docs.join(qt, [k if k != "doc_id" else "test_id" for k in keys]).join(dt, keys)
    sums = (pairs.groupBy("rep", "test_id", "label_word")
            .agg(F.sum(jaccard("q", "d")).alias("s")))
    cand = test.select("rep", F.col("doc_id").alias("test_id")).join(
        F.broadcast(lmap.select("rep", "label_idx", "label_word")), "rep")
    return (cand.join(sums, ["rep", "test_id", "label_word"], "left")
            .select("rep", "test_id", "label_idx",
                    F.round(F.coalesce("s", F.lit(0.0)), digits).alias("score")))


def overlap_fn(docs_tokens_col: str = "prompt"):
    """A toy ``score_with`` function: the share of the prompt's lower-cased ASCII words that
    equal each lower-cased label word. Used to exercise the hook."""
    def fn(batches):
        for pdf in batches:
            words = pdf[docs_tokens_col].str.lower().str.findall("[a-z0-9_]+")
            each = pdf[["rep", "test_id"]].assign(words=words, n=words.str.len().clip(lower=1), label=pdf["labels"].map(lambda x: [*enumerate(x)])).explode("label")
            hits = [w.count(label[1].lower()) for w, label in zip(each["words"], each["label"], strict=True)]
            yield pd.DataFrame({"rep": each["rep"], "test_id": each["test_id"], "label_idx": [x[0] for x in each["label"]], "score": hits / each["n"]})
    return fn
