"""Small fixtures with the awkward cases: nulls, empty and very long texts, ties, repeated
rows, clashing column names, empty tables."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("id", T.StringType()), T.StructField("fp", T.IntegerType())])

PROSE = "the quick brown fox jumps over the lazy dog and runs to the river with a friend it was that is for in of"


def rows():
    base = [(1, PROSE, "en"), (2, PROSE + " x", "en"), (2, PROSE + " x", "en"), (3, "", "en"), (4, None, None), (None, "no id here", "fr"), (5, "one", "xx"),
            (6, "ÀÉ naïve œuvre " * 40, "fr"), (7, " ".join(f"w{i}" for i in range(60_000)), "en"), (8, PROSE, "en"), (9, "日本語 テキスト ١٢٣ \x1c\x85 İ <|endoftext|> é", "ja"),
            (10, "a b c d e a b c d e a b c d e", "en"), (11, "line\nline\n\n  \nline two\nline", "en"), (12, "*** $$$ ### " * 100, "en"), (13, "\t\n \r", "de")]
    return [(i, t, lang, "s", None if t is None else len(t), f"k{n}", n) for n, (i, t, lang) in enumerate(base)]


def docs(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)
