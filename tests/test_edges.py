"""Bad input is an error or counted, never a silently lost row; user tables; long documents."""

import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotlab.config import Params
from shotlab.functions.text import PIECE_PATTERN, pieces, strip_accents
from shotlab.operators import features, labels, vocab
from shotlab.operators.newton import fit_predict
from shotlab.operators.prompts import build_prompts
from shotlab.operators.ranking import predict_and_rank
from shotlab.plans import experiment as X
from shotlab.sources.labelled import read_labelled
from shotlab.sources.registry import custom_task, word_lists
from tests.conftest import SF

TASK = custom_task("fruit", ["apple", "pear", "plum"], "In: ", "\nOut: ", {"kw": [["core"], ["stem"], ["stone"]]})
P = Params(k=4, test_num=6, repeats=2)


def table(spark, n=90, label=lambda i: i % 3, text=lambda i: f"text number {i}, kind {'abc'[i % 3]}!"):
    return read_labelled(spark, spark.createDataFrame([(i, text(i), label(i), "train" if i % 3 != 1 or i % 2 else "test") for i in range(n)], "doc_id long, content string, label int, split string"))


def test_user_table_runs_prompts_scores_and_grid(spark):
    lab = table(spark)
    for pattern in ("none", "token", "memo_label_kw"):
        pr = X.prepare(spark, None, P.with_(pattern=pattern), labelled=lab, task=TASK)
        prompts = X.prompts(pr).collect()
        assert len(prompts) == 12 and all(r["prompt"].count("In: ") == 5 for r in prompts)
        assert X.overlap_eval(pr)[1].count() == 12
        pr.release()
    grid, _, _ = X.linear_baseline(spark, X.prepare(spark, None, P, labelled=lab, task=TASK))
    assert grid.count() == 480
    with pytest.raises(ValueError):
        word_lists(TASK, "memo_label_syn")
    with pytest.raises(ValueError):
        custom_task("x", ["a", "b"], lists={"kw": [["one"], []]})


@pytest.mark.parametrize("bad", ["label", "null label", "id", "short"])
def test_bad_tables_are_errors(spark, bad):
    lab = table(spark, n=9 if bad == "short" else 90, label=lambda i: 7 if bad == "label" and i == 3 else None if bad == "null label" and i == 3 else i % 3)
    if bad == "id":
        lab = lab.withColumn("doc_id", F.when(F.col("doc_id") == 5, 6).otherwise(F.col("doc_id")))
    with pytest.raises(ValueError):
        X.prepare(spark, None, P, labelled=lab, task=TASK)


def test_unmatched_ids_are_counted_and_null_texts_raise(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (0, 9), (0, None), (0, 9)], "rep int, label_idx int")
    assert {(r.label_idx, r.n) for r in labels.unmatched(df, 3).collect()} == {(9, 2), (None, 1)}
    lmap = spark.createDataFrame([(0, i, w) for i, w in enumerate("abc")], "rep int, label_idx int, label_word string")
    with pytest.raises(Exception, match="no label word"):
        labels.verbalize(df, lmap).collect()
    test = spark.createDataFrame([(0, 1, "q", "a")], "rep int, doc_id long, text string, label_word string")
    pool = spark.createDataFrame([(0, 0, "a", None), (0, 1, "b", "t")], "rep int, pos int, label_word string, text string")
    demos = spark.createDataFrame([(0, 1, 0, 0), (0, 1, 1, 1)], "rep int, test_id long, ord int, train_pos int")
    with pytest.raises(Exception, match="null text"):
        build_prompts(test, demos, pool, "", "").collect()


def test_short_hook_output_is_an_error(spark):
    gold = spark.createDataFrame([(0, 1, 0), (0, 2, 1)], "rep int, test_id long, gold_idx int")
    full = [(0, t, i, 0.1 * i) for t in (1, 2) for i in range(3)]
    schema = "rep int, test_id long, label_idx int, score double"
    assert predict_and_rank(spark.createDataFrame(full, schema), gold, n_labels=3).count() == 2
    for rows in (full[:-1], full[:3]):
        with pytest.raises(Exception, match="every candidate"):
            predict_and_rank(spark.createDataFrame(rows, schema), gold, n_labels=3).collect()


def test_accents_over_scripts(spark):
    texts = ["ά ϋ Ώ", "й ё Ї", "が パ ㌀", "ﻻ أ ﷺ", "한국어 각 가", "Ǆ ﬁ ½ œ é", "ạ́", "𝔄𝟘", "x" * 2000, ""]
    want = ["".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in texts]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(strip_accents("t").alias("x")).collect()
    assert [r.x for r in got] == want


def test_tokens_join_to_the_text_and_the_inverse_map_restores_it(spark):
    pr = X.prepare(spark, SF, P.with_(pattern="token"))
    d = pr.docs.select("text", F.array_join(pieces("text"), "").alias("again"))
    assert d.where("text <> again").count() == 0
    perm = vocab.permutation(vocab.corpus_vocab(pr.docs, pattern=PIECE_PATTERN), P.repeats, P.seed).persist()
    toks = X.doc_texts(pr).join(pr.sample.select("rep", "doc_id"), "doc_id").select("rep", "doc_id", pieces("text").alias("tokens"))
    none = spark.createDataFrame([], "rep int, token string")
    there = vocab.permute_tokens(toks, "tokens", perm, none, "p", key=("rep", "doc_id"))
    back = vocab.permute_tokens(there, "p", perm.select("rep", F.col("new_token").alias("token"), F.col("token").alias("new_token")), none, "b", key=("rep", "doc_id"))
    assert back.join(toks, ["rep", "doc_id"]).where("b <> tokens").count() == 0 and back.count() == toks.count()
    prompt = X.scoring_prompts(pr).first()["prompt"]
    assert prompt.count(pr.task.prompt_x) >= P.k + 1 and "\n" in prompt


def test_user_vocabulary_keeps_single_tokens(spark):
    words = spark.createDataFrame([("ok",), ("two words",), ("a-b",), ("",), (None,), ("ok",), ("é1_",)], "token string")
    assert {r.token for r in vocab.user_vocab(words).collect()} == {"ok", "é1_"}


def test_grams_of_a_long_document_and_no_pair_exchange(spark):
    text = "".join("abcde"[(i * i + i // 7) % 5] + (" " if i % 6 == 0 else "") for i in range(300_000))
    docs = spark.createDataFrame([(1, text), (2, "ab"), (3, "")], "doc_id long, text string")
    got = {(r.block, r.n, r.term): r.cnt for r in features.doc_grams(docs, 3, 2, stop_words=[]).where("doc_id = 1").collect()}
    words = text.split()
    want = Counter({("char", n, t): c for n in (1, 2, 3) for t, c in Counter(text[i:i + n] for i in range(len(text) - n + 1)).items()})
    want.update({("word", n, t): c for n in (1, 2) for t, c in Counter(" ".join(words[i:i + n]) for i in range(len(words) - n + 1)).items()})
    assert got == dict(want)
    plan = features.corpus_grams(docs, 2, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2     # the documents, then the terms


def test_vocabulary_caps_bind_in_some_groups(spark):
    rows = [(0, 1, "char", 1, f"t{i}", i + 1) for i in range(5)] + [(1, 2, "char", 1, "only", 1)]
    voc = features.fit_vocab(spark.createDataFrame(rows, "rep int, doc_id long, block string, n int, term string, cnt long"), 1, 1, char_cap=3, word_cap=3)
    assert {(r.rep, r.term) for r in voc.collect()} == {(0, "t4"), (0, "t3"), (0, "t2"), (1, "only")}


def test_multinomial_kernel_fit_equals_one_large_fit(spark):
    from shotlab.operators.linear import linear_model
    rnd = np.random.default_rng(0)
    words = ["ant", "bee", "cat", "dog", "elk", "fox"]
    texts = [" ".join(rnd.choice(words, size=6, p=np.roll([.4, .3, .1, .1, .05, .05], 2 * (i % 3)))) for i in range(45)]
    y = np.array([i % 3 for i in range(45)])
    train = spark.createDataFrame([(i, t, int(c)) for i, (t, c) in enumerate(zip(texts, y))], "doc_id long, text string, label_idx int")
    model = linear_model(train, 0.5, 2, 1, tol=1e-9)
    at = {(r["block"], r["term"]): r["idx"] for r in model.voc.collect()}
    X_ = np.zeros((45, model.n_terms))
    for r in features.doc_grams(train.select("doc_id", "text"), 2, 1).collect():
        X_[r["doc_id"], at[r["block"], r["term"]]] = r["cnt"]
    z = X_ @ model.fitted.w.T + model.fitted.b
    assert (z.argmax(axis=1) == fit_predict(X_ @ X_.T, y, X_ @ X_.T, 0.5)).all()
    proba = np.exp(z - z.max(axis=1, keepdims=True))
    proba /= proba.sum(axis=1, keepdims=True)
    gradient = model.fitted.w + 0.5 * (proba - np.eye(3)[y]).T @ X_
    assert np.abs(gradient).max() < 1e-5 and np.abs((proba - np.eye(3)[y]).sum(axis=0)).max() < 1e-5
    model.release()


def test_a_fit_that_does_not_converge_is_an_error(spark):
    from shotlab.operators.linear import linear_model
    train = spark.createDataFrame([(i, f"w{i % 5} x{i % 3}", i % 2) for i in range(20)], "doc_id long, text string, label_idx int")
    with pytest.raises(RuntimeError):
        linear_model(train, 100.0, 2, 1, max_steps=1)
