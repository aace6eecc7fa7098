import unicodedata

from pyspark.sql import functions as F

from shotlab.functions.text import (char_ngrams_col, coarsen, collapse_spaces, drop_stop_words, normalize_text,
                                    split_chars, split_words, tokenize, word_ngrams_col)


def _one(spark, col, value, schema="s STRING"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("o")).first()["o"]


def test_coarsen_golden(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "l INT")
    assert [r["c"] for r in df.select(coarsen("l").alias("c")).orderBy("l").collect()] == [0, 0, 1, 2, 2]


def test_strip_accents_matches_unicodedata(spark):
    s = "Ça élève àèìòù ÄÖÜ ñ ß ½ ĳ naïve"
    expect = "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))
    assert _one(spark, normalize_text("s"), s) == expect


def test_tokenize_unicode_words(spark):
    assert _one(spark, tokenize(F.col("s")), "héllo, wörld_1 x") == ["héllo", "wörld_1", "x"]


def test_stop_words_keep_order_and_repeats(spark):
    got = _one(spark, drop_stop_words(F.split("s", " ")), "the cat and the cat")
    assert got == ["cat", "cat"]


def test_word_ngrams(spark):
    t = F.split("s", " ")
    assert _one(spark, word_ngrams_col(t, 2), "a b c") == ["a b", "b c"]
    assert _one(spark, word_ngrams_col(t, 2), "a") == []


def test_char_ngrams_linear_regex(spark):
    assert _one(spark, char_ngrams_col(F.col("s"), 3), "abcd") == ["abc", "bcd"]
    assert _one(spark, char_ngrams_col(F.col("s"), 5), "abcd") == []
    assert _one(spark, char_ngrams_col(F.col("s"), 2), "a\nb") == ["a\n", "\nb"]


def test_whitespace_collapse_only_runs(spark):
    assert _one(spark, collapse_spaces("s"), "a  b\n\nc\nd") == "a b c\nd"


def test_split_keeps_empty_words(spark):
    assert _one(spark, split_words("s"), "a  b") == ["a", "", "b"]
    assert _one(spark, split_chars("s"), "ab") == ["a", "b"]
