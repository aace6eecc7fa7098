"""Bag-of-n-grams and TF-IDF features in long form ``(…, block, term, value)``.

Gram counts are computed once per distinct document and exact n; the
per-replicate vocabularies (one per block and n-gram range) are windows over
the replicate's fit documents; features and dot products are joins on the
term. Nothing is materialised as a dense or per-document vector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from shotlab.functions.stopwords import ENGLISH
from shotlab.operators.partitioning import by_document
from shotlab.functions.text import (char_ngrams_col, collapse_spaces, drop_stop_words, normalize_text,
                                    smooth_idf, sublinear_tf, tokenize, word_ngrams_col)

CHAR_CAP = 50_000
WORD_CAP = 10_000


def gram_array(chars, toks, ngc_max: int, ngw_max: int):
    """Array of ``struct(block, n, term)`` for char n-grams (1..ngc_max) of ``chars`` and
    word n-grams (1..ngw_max) of ``toks``. Both must be plain column references:
    the lambdas read them once per position."""
    def tag(block, n):
        # one-argument lambda: a second argument would be bound to the element index
        return lambda t: F.struct(F.lit(block).alias("block"), F.lit(n).alias("n"), t.alias("term"))

    parts = [F.transform(char_ngrams_col(chars, n), tag("char", n)) for n in range(1, ngc_max + 1)]
    parts += [F.transform(word_ngrams_col(toks, n), tag("word", n)) for n in range(1, ngw_max + 1)]
    return F.flatten(F.array(*parts))


def analysed(docs: DataFrame, stop_words=ENGLISH, key=("doc_id",)) -> DataFrame:
    """``(*key, _chars, _toks)``: the char analyser's text (normalised, whitespace runs
    collapsed) and the word analyser's tokens (normalised, stop words dropped)."""
    norm = docs.select(*key, normalize_text(F.col("text")).alias("_norm"))
    toks = tokenize(F.col("_norm"))
    if stop_words:
        toks = drop_stop_words(toks, stop_words)
    return norm.select(*key, collapse_spaces(F.col("_norm")).alias("_chars"), toks.alias("_toks"))


def doc_grams(docs: DataFrame, ngc_max: int = 4, ngw_max: int = 2, stop_words=ENGLISH,
              key=("doc_id",)) -> DataFrame:
    """``(*key, block, n, term, cnt)``: exact-n gram counts per document.

    Documents are hash-partitioned by ``key`` and sorted by it, so the counts need no
    exchange of (document, term) pairs. Tasks count runs of documents of bounded size as
    sorted integers (``operators.gramcounts``); a document of any length, or a
    key with any number of rows, is counted in pieces, no gram lost or counted twice.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa

        from shotlab.operators.gramcounts import runs

        for keys, _, counts in runs(batches, len(key), ngc_max, ngw_max, True):
            cols = [pa.array([k[i] for k in keys], f.type) for i, f in enumerate(fields)]
            for block, n, term, whose, cnt, _ in counts:
                for at in range(0, len(cnt), OUT_ROWS):
                    cut = slice(at, at + OUT_ROWS)
                    yield _counts(block, n, term[cut], [c.take(pa.array(whose[cut])) for c in cols], list(key), {"cnt": cnt[cut].astype(np.int64)})

    a = analysed_runs(by_document(docs, *key), ngc_max, ngw_max, stop_words, key)
    fields = _arrow_fields(a, key)
    return a.mapInArrow(run, StructType([*[a.schema[k] for k in key], *_GRAM, StructField("cnt", LongType())]))


#: Rows of a batch that goes back to Spark.
OUT_ROWS = 1 << 16
_GRAM = [StructField("block", StringType()), StructField("n", IntegerType()), StructField("term", StringType())]


def _arrow_fields(df: DataFrame, key):
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(df.select(*key).schema))


def analysed_runs(docs: DataFrame, ngc_max: int, ngw_max: int, stop_words, key, others=()) -> DataFrame:
    """Rows of ``gramcounts.runs``, sorted by key within the partitions ``docs`` has: what the ranges do not need is empty."""
    a = analysed(docs.sortWithinPartitions(*key), stop_words, (*key, *others))
    none = F.lit("")
    return a.select(*key, (F.col("_chars") if ngc_max else none).alias("_chars"),
                    (F.array_join("_toks", " ") if ngw_max else none).alias("_toks"), *others)


def _counts(block, n, term, keys, names, numbers):
    import numpy as np
    import pyarrow as pa

    size = len(term)
    return pa.RecordBatch.from_arrays([*keys, pa.array([block]).take(pa.array(np.zeros(size, np.int32))), pa.array(np.full(size, n, np.int32)), term, *map(pa.array, numbers.values())],
                                      names=[*names, "block", "n", "term", *numbers])


def text_parts(docs: DataFrame) -> int:
    """Partitions of ``PART_BYTES`` of text each, a task for every core at least."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-int(size) // PART_BYTES))


#: Bytes of text whose grams one task holds.
PART_BYTES = 8 << 20


def corpus_grams(docs: DataFrame, ngc_max: int, ngw_max: int, stop_words=ENGLISH) -> DataFrame:
    """Corpus-level ``(block, n, term, cf, df)`` over whole documents.

    A task adds up the documents of a run, so what is exchanged is a row per run and term. Both
    exchanges have partitions in proportion to the text: a task's memory does not grow with it."""
    def run(batches):
        import numpy as np

        from shotlab.operators.gramcounts import runs

        for _, _, counts in runs(batches, 1, ngc_max, ngw_max, False):
            for block, n, term, _, cnt, df in counts:
                for at in range(0, len(cnt), OUT_ROWS):
                    cut = slice(at, at + OUT_ROWS)
                    yield _counts(block, n, term[cut], [], [], {"cf": cnt[cut].astype(np.int64), "df": df[cut].astype(np.int64)})

    parts = text_parts(docs)
    a = analysed_runs(docs.select("doc_id", "text").repartition(parts, "doc_id"), ngc_max, ngw_max, stop_words, ("doc_id",))
    of_runs = a.mapInArrow(run, StructType([*_GRAM, StructField("cf", LongType()), StructField("df", LongType())]))
    return of_runs.repartition(parts, "block", "n", "term").groupBy("block", "n", "term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def expand_ranges(grams: DataFrame, ngc_max: int, ngw_max: int) -> DataFrame:
    """Attach ``n_max``: a gram of size n belongs to every range 1..n_max with n_max >= n."""
    top = F.when(F.col("block") == "char", F.lit(ngc_max)).otherwise(F.lit(ngw_max))
    return grams.withColumn("n_max", F.explode(F.sequence(F.col("n"), top)))


def fit_vocab(fit_grams: DataFrame, ngc_max: int, ngw_max: int,
              char_cap: int = CHAR_CAP, word_cap: int = WORD_CAP) -> DataFrame:
    """Per (rep, block, n_max): the ``cap`` terms with highest corpus count in the fit documents.

    ``fit_grams`` is ``(rep, doc_id, block, n, term, cnt)``. Ties: term
    ascending. Also returns ``df`` (fit documents containing the term).
    Output ``(rep, block, n_max, term, cf, df)``.
    """
    per = fit_grams.groupBy("rep", "block", "n", "term").agg(F.sum("cnt").alias("cf"),
                                                             F.count("*").alias("df"))
    per = expand_ranges(per, ngc_max, ngw_max)
    cap = F.when(F.col("block") == "char", F.lit(char_cap)).otherwise(F.lit(word_cap))
    # Only groups with more distinct terms than the cap need ranking; the others
    # keep every term without a per-group sort. (R x blocks x ranges rows: broadcast.)
    sizes = per.groupBy("rep", "block", "n_max").agg(F.count("*").alias("_size"))
    per = per.join(F.broadcast(sizes), ["rep", "block", "n_max"])
    keep_all = per.filter(F.col("_size") <= cap)
    ranked = per.filter(F.col("_size") > cap)
    w = Window.partitionBy("rep", "block", "n_max").orderBy(F.desc("cf"), F.col("term"))
    ranked = ranked.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap)
    cols = ["rep", "block", "n_max", "term", "cf", "df"]
    return keep_all.select(*cols).unionByName(ranked.select(*cols))


def membership(vocab: DataFrame) -> DataFrame:
    """``(rep, block, term, mask, df)``: bit n_max set if the term is in that range's vocabulary."""
    return (vocab.groupBy("rep", "block", "term")
            .agg(F.sum(F.expr("shiftleft(1, n_max)")).alias("mask"), F.first("df").alias("df")))


def weights(doc_terms: DataFrame, mem: DataFrame, tfidf: bool, n_fit: int, keep=()) -> DataFrame:
    """``(rep, doc_id, block, term, mask, w)``: in-vocabulary terms of each document.

    Out-of-vocabulary terms drop out of the inner join. ``w`` is the count, or
    sublinear tf x smooth idf (idf from the fit documents only).
    """
    j = doc_terms.join(mem, ["rep", "block", "term"])
    w = (sublinear_tf("cnt") * smooth_idf(F.lit(float(n_fit)), F.col("df"))) if tfidf else F.col("cnt").cast("double")
    return j.select("rep", "doc_id", *keep, "block", "term", "mask", w.alias("w"))


def features(doc_terms: DataFrame, vocab: DataFrame, ngc: int, ngw: int, tfidf: bool, n_fit: int) -> DataFrame:
    """Feature rows ``(rep, doc_id, block, term, value)`` of one configuration (char 1..ngc ‖ word 1..ngw).

    TF-IDF rows are L2-normalised per document and block, as two separate
    vectorisers would.
    """
    mem = membership(vocab)
    wt = weights(doc_terms, mem, tfidf, n_fit)
    bit = F.when(F.col("block") == "char", F.lit(1 << ngc)).otherwise(F.lit(1 << ngw))
    wt = wt.filter(F.col("mask").bitwiseAND(bit) != 0)
    if tfidf:
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("rep", "doc_id", "block")))
        wt = wt.withColumn("w", F.col("w") / norm)
    return wt.select("rep", "doc_id", "block", "term", F.col("w").alias("value"))


def kernels(train_w: DataFrame, all_w: DataFrame, ngc_max: int, ngw_max: int, tfidf: bool) -> DataFrame:
    """Dot products per range: ``(rep, i, j, c1..c{ngc_max}, w1..w{ngw_max})``.

    One join on (rep, block, term) between the fit documents (i) and all
    documents (j); the products are summed into one column per n-gram range
    by the range mask, so the nested ranges cost a single join. TF-IDF
    products are divided by both documents' per-range L2 norms. Pairs with no
    shared term are absent (dot product 0). The dual form has R*k*(k+T) rows:
    bounded by the parameters, not by the corpus.
    """
    a = train_w.select("rep", "block", "term", "mask", F.col("doc_id").alias("i"), F.col("w").alias("wi")).hint("merge")
    b = all_w.select("rep", "block", "term", F.col("doc_id").alias("j"), F.col("w").alias("wj"))
    prod = a.join(b, ["rep", "block", "term"]).withColumn("p", F.col("wi") * F.col("wj"))
    cols = []
    for blk, top, tag in (("char", ngc_max, "c"), ("word", ngw_max, "w")):
        for nm in range(1, top + 1):
            hit = (F.col("block") == blk) & (F.col("mask").bitwiseAND(F.lit(1 << nm)) != 0)
            cols.append(F.sum(F.when(hit, F.col("p")).otherwise(F.lit(0.0))).alias(f"{tag}{nm}"))
    k = prod.groupBy("rep", "i", "j").agg(*cols)
    if not tfidf:
        return k
    nc = []
    for blk, top, tag in (("char", ngc_max, "c"), ("word", ngw_max, "w")):
        for nm in range(1, top + 1):
            hit = (F.col("block") == blk) & (F.col("mask").bitwiseAND(F.lit(1 << nm)) != 0)
            nc.append(F.sqrt(F.sum(F.when(hit, F.col("w") * F.col("w")).otherwise(F.lit(0.0)))).alias(f"{tag}{nm}"))
    norms = all_w.groupBy("rep", "doc_id").agg(*nc)
    ni = norms.select("rep", F.col("doc_id").alias("i"), *[F.col(c).alias("ni_" + c) for c in norms.columns[2:]])
    nj = norms.select("rep", F.col("doc_id").alias("j"), *[F.col(c).alias("nj_" + c) for c in norms.columns[2:]])
    k = k.join(ni, ["rep", "i"]).join(nj, ["rep", "j"])
    out = []
    for c in norms.columns[2:]:
        d = F.col("ni_" + c) * F.col("nj_" + c)
        out.append(F.when(d > 0, F.col(c) / d).otherwise(F.lit(0.0)).alias(c))
    return k.select("rep", "i", "j", *out)


def vocab_coverage(train_text: DataFrame, test_text: DataFrame) -> DataFrame:
    """Distinct words (split on ' ') and characters of train and test texts, pooled over replicates.

    ``(unit, n_train, n_test, n_common, share)`` with share = |train ∩ test| / |test|.
    """
    def units(df):
        w = df.select(F.explode(F.split("text", " ")).alias("u")).distinct()
        c = w.select(F.explode(F.split("u", "")).alias("u")).filter(F.col("u") != "").distinct()
        return w.withColumn("unit", F.lit("word")), c.withColumn("unit", F.lit("char"))
    trw, trc = units(train_text)
    tew, tec = units(test_text)
    tr = trw.unionByName(trc).withColumn("in_train", F.lit(1))
    te = tew.unionByName(tec).withColumn("in_test", F.lit(1))
    j = tr.join(te, ["unit", "u"], "full")
    return j.groupBy("unit").agg(
        F.count("in_train").alias("n_train"), F.count("in_test").alias("n_test"),
        F.count(F.when(F.col("in_train").isNotNull() & F.col("in_test").isNotNull(), 1)).alias("n_common"),
    ).withColumn("share", F.when(F.col("n_test") > 0, F.col("n_common") / F.col("n_test")).otherwise(F.lit(0.0)))
