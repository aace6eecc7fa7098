import pytest
from pyspark.sql import functions as F

from shotlab.operators.labels import dev_test_split, label_merge, memo_text
from shotlab.operators.metrics import macro_f1, mean0
from shotlab.operators.prompts import build_prompts
from shotlab.operators.ranking import predict_and_rank, softmax


def test_prompt_golden_k1(spark):
    test = spark.createDataFrame([(0, 10, "dull", "negative")], "rep INT, doc_id BIGINT, text STRING, label_word STRING")
    pool = spark.createDataFrame([(0, 0, "good film", "positive")], "rep INT, pos INT, text STRING, label_word STRING")
    demos = spark.createDataFrame([(0, 10, 0, 0)], "rep INT, test_id BIGINT, ord INT, train_pos INT")
    got = build_prompts(test, demos, pool, "\nReview: ", "\nSentiment: ").first()["prompt"]
    assert got == "\nReview: good film\nSentiment: positive\nReview: dull\nSentiment: "


def test_prompt_golden_k0(spark):
    test = spark.createDataFrame([(0, 10, "dull", "negative")], "rep INT, doc_id BIGINT, text STRING, label_word STRING")
    pool = spark.createDataFrame([], "rep INT, pos INT, text STRING, label_word STRING")
    demos = spark.createDataFrame([], "rep INT, test_id BIGINT, ord INT, train_pos INT")
    got = build_prompts(test, demos, pool, "\nReview: ", "\nSentiment: ").first()["prompt"]
    assert got == "\nReview: dull\nSentiment: "


def test_prompt_order_follows_ord(spark):
    test = spark.createDataFrame([(0, 1, "q", "b")], "rep INT, doc_id BIGINT, text STRING, label_word STRING")
    pool = spark.createDataFrame([(0, i, f"t{i}", "a") for i in range(5)], "rep INT, pos INT, text STRING, label_word STRING")
    demos = spark.createDataFrame([(0, 1, o, p) for o, p in enumerate([3, 0, 4])], "rep INT, test_id BIGINT, ord INT, train_pos INT")
    got = build_prompts(test.repartition(3), demos.repartition(3), pool, "<", ">").first()["prompt"]
    assert got == "<t3>a<t0>a<t4>a<q>"


def _scores(spark, vals, gold):
    s = spark.createDataFrame([(0, 1, i, v) for i, v in enumerate(vals)], "rep INT, test_id BIGINT, label_idx INT, score DOUBLE")
    g = spark.createDataFrame([(0, 1, gold)], "rep INT, test_id BIGINT, gold_idx INT")
    return predict_and_rank(s, g).first()


def test_rank_ties_take_best(spark):
    r = _scores(spark, [.3, .3, .2], 1)
    assert r["gold_rank"] == 1 and r["pred_idx"] == 0
    assert _scores(spark, [.5, .2, .2], 2)["gold_rank"] == 2


def test_softmax_sums_to_one(spark):
    s = spark.createDataFrame([(0, 1, i, v) for i, v in enumerate([1.0, 2.0, 3.0])],
                              "rep INT, test_id BIGINT, label_idx INT, score DOUBLE")
    assert softmax(s).agg(F.sum("prob")).first()[0] == pytest.approx(1.0)


def test_macro_f1_golden(spark):
    df = spark.createDataFrame([(0, g, p) for g, p in [(0, 0), (0, 1), (1, 1), (1, 2)]], "rep INT, gold_idx INT, pred_idx INT")
    assert macro_f1(df).first()["macro_f1"] == pytest.approx((2 / 3 + 1 / 2 + 0) / 3)


def test_macro_f1_perfect(spark):
    df = spark.createDataFrame([(0, g, g) for g in [0, 1, 2, 2]], "rep INT, gold_idx INT, pred_idx INT")
    assert macro_f1(df).first()["macro_f1"] == pytest.approx(1.0)


def test_mean_of_nothing(spark):
    df = spark.createDataFrame([], "x DOUBLE")
    assert df.agg(mean0("x")).first()[0] == 0.0


@pytest.mark.parametrize("texts,test_pos,dev_pos", [
    ("abcadb", [0, 1, 2], [4]),
    ("abcde", [0, 1], [2, 3, 4]),
])
def test_dev_test_split_golden(spark, texts, test_pos, dev_pos):
    df = spark.createDataFrame([(0, i, i, t) for i, t in enumerate(texts)], "rep INT, pos INT, doc_id BIGINT, text STRING")
    out = dev_test_split(df, len(texts)).collect()
    assert sorted(r["pos"] for r in out if r["part"] == "test") == test_pos
    assert sorted(r["pos"] for r in out if r["part"] == "dev") == dev_pos


def _lmap(spark, words, org):
    return spark.createDataFrame([(0, "t", i, w, o) for i, (w, o) in enumerate(zip(words, org))],
                                 "rep INT, task STRING, label_idx INT, label_word STRING, label_org STRING")


def test_label_merge_first_class(spark):
    lm = _lmap(spark, ["x", "species", "species"], ["a", "animal", "nature"])
    rows = spark.createDataFrame([(0, 2, "species")], "rep INT, label_idx INT, label_word STRING")
    assert label_merge(rows, lm).first()["merged_idx"] == 1


def test_memo_golden(spark):
    lm = _lmap(spark, ["Ne", "por"], ["negative", "positive"])
    rows = spark.createDataFrame([(0, 1, "por", "any")], "rep INT, label_idx INT, label_word STRING, text STRING")
    assert memo_text(rows, lm).first()["text"] == "positive"


def test_class_report_by_hand(spark):
    from shotlab.operators.metrics import class_report
    rows = [(0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 1), (0, 2, 0), (1, 3, 3)]
    got = {(r["rep"], r["row"]): tuple(round(x, 6) for x in (r["precision"], r["recall"], r["f1"])) + (r["support"],)
           for r in class_report(spark.createDataFrame(rows, "rep int, gold_idx int, pred_idx int")).collect()}
    assert got == {(0, "0"): (.5, .5, .5, 2), (0, "1"): (.666667, 1, .8, 2), (0, "2"): (0, 0, 0, 1), (0, "macro"): (.388889, .5, .433333, 5),
                   (0, "weighted"): (.466667, .6, .52, 5), (0, "micro"): (.6, .6, .6, 5),
                   **{(1, r): (1, 1, 1, 1) for r in ("3", "macro", "weighted", "micro")}}


def test_vocab_softmax_is_stable_and_not_renormalised(spark):
    import math
    from shotlab.operators.ranking import vocab_softmax
    logits = spark.createDataFrame([(0, 1, "a", 1000.0), (0, 1, "b", 999.5), (0, 1, "c", -5000.0), (0, 2, "a", -3.0), (0, 2, "z", None)], "rep int, test_id long, token string, logit double")
    cand = spark.createDataFrame([(0, t, w, i) for t in (1, 2, 3) for i, w in enumerate("abz")], "rep int, test_id long, token string, label_idx int")
    got = {(r["test_id"], r["token"]): r["prob"] for r in vocab_softmax(logits, cand, 50).collect()}
    s1 = 1 + math.exp(-.5)
    s2 = math.exp(-3) + 49
    want = {(1, "a"): 1 / s1, (1, "b"): math.exp(-.5) / s1, (1, "z"): 0.0, (2, "a"): math.exp(-3) / s2, (2, "b"): 1 / s2, (2, "z"): 1 / s2, **{(3, w): 1 / 50 for w in "abz"}}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12, abs_tol=1e-300) for k in want)
