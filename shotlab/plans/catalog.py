"""Query catalog: one DataFrame query per operator, each with its DuckDB oracle.

``QUERIES[name] = (spark_fn(spark, sf_dir) -> DataFrame, sql or None)``.
Computed columns carry the same alias on both sides; doubles are rounded to
6 decimals on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlab.config import CHECK, Params
from shotlab.operators import labels as L
from shotlab.operators.metrics import macro_f1
from shotlab.operators.prompts import build_prompts
from shotlab.operators.ranking import predict_and_rank
from shotlab.plans import experiment as X
from shotlab.plans import sqlparts as S
from shotlab.sources.checked import checked_scan
from shotlab.sources.labelled import read_labelled, task_rows
from shotlab.sources.registry import custom_task

QUERIES: dict[str, tuple] = {}


def register(name: str, sql=None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def _prep(spark, sf_dir, p: Params = CHECK) -> X.Prepared:
    return X.prepare(spark, sf_dir, p)


# ---------------------------------------------------------------- scans / labels
def _sql_labelled_scan():
    return f"SELECT doc_id, text, label_idx, split FROM ({S.lab_sql(CHECK.task)})"


@register("labelled_scan", _sql_labelled_scan)
def q_labelled_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return task_rows(spark, sf_dir, CHECK.task)


P_LMAP = CHECK.with_(task="dbpedia_14", pattern="memo_label_kw")


def _sql_label_map():
    p = P_LMAP
    return (f"WITH lab AS ({S.lab_sql(p.task)}),\nreps AS ({S.reps_sql(p)}),\n{S.lmap_ctes(p)},\n"
            f"cnt AS (SELECT label_idx, count(*) AS n FROM lab GROUP BY label_idx)\n"
            f"SELECT m.rep, m.task, m.label_idx, m.label_word, m.label_org, CAST(coalesce(c.n, 0) AS BIGINT) AS n_rows "
            f"FROM lmap m LEFT JOIN cnt c ON c.label_idx = m.label_idx")


@register("label_map", _sql_label_map)
def q_label_map(spark, sf_dir):
    """Label map of a pattern (dbpedia keywords) with the class sizes of the task table."""
    from shotlab.sources.registry import task
    p = P_LMAP
    lm = L.label_map(spark, task(p.task), p.pattern, p.repeats, p.seed)
    cnt = task_rows(spark, sf_dir, p.task).groupBy("label_idx").agg(F.count("*").alias("n"))
    return (lm.join(F.broadcast(cnt), "label_idx", "left")
            .select("rep", "task", "label_idx", "label_word", "label_org",
                    F.coalesce("n", F.lit(0)).cast("long").alias("n_rows")))


def _sql_label_coarsen():
    return (f"WITH a AS ({S.lab_sql('sst3')}), b AS ({S.lab_sql('SetFit/sst5')})\n"
            f"SELECT a.doc_id, a.split, a.label_idx, b.label_idx AS label5 FROM a JOIN b ON a.doc_id = b.doc_id")


@register("label_coarsen", _sql_label_coarsen)
def q_label_coarsen(spark, sf_dir):
    a = task_rows(spark, sf_dir, "sst3")
    b = task_rows(spark, sf_dir, "SetFit/sst5").select("doc_id", F.col("label_idx").alias("label5"))
    return a.join(b, "doc_id").select("doc_id", "split", "label_idx", "label5")


def _sql_replicate_sample():
    seed = f"CAST({S.sql_hnum(CHECK.seed, 'rep', 'rep')} % 99999 + 1 AS INTEGER)"
    return f"{S.base_ctes(CHECK)}\nSELECT rep, {seed} AS rep_seed, split, pos, doc_id, label_idx FROM smp"


@register("replicate_sample", _sql_replicate_sample)
def q_replicate_sample(spark, sf_dir):
    """Per replicate (with its derived seed in [1, 99999]): 2T pool rows and T test rows."""
    from shotlab.operators.sampling import replicates
    s = _prep(spark, sf_dir).sample
    return (s.join(F.broadcast(replicates(spark, CHECK.repeats, CHECK.seed)), "rep")
            .select("rep", "rep_seed", "split", "pos", "doc_id", "label_idx"))


def _sql_label_verbalize():
    return f"{S.base_ctes(CHECK)}\nSELECT rep, split, pos, doc_id, label_idx, label_word FROM vs"


@register("label_verbalize", _sql_label_verbalize)
def q_label_verbalize(spark, sf_dir):
    return _prep(spark, sf_dir).sample.select("rep", "split", "pos", "doc_id", "label_idx", "label_word")


P_MERGE = CHECK.with_(task="dbpedia_14", pattern="memo_label_kw", repeats=8)


def _sql_label_merge():
    return (f"{S.base_ctes(P_MERGE)}\nSELECT v.rep, v.split, v.pos, v.doc_id, v.label_idx, v.label_word, mi.merged_idx "
            f"FROM vs v JOIN mi ON mi.rep = v.rep AND mi.label_word = v.label_word")


@register("label_merge", _sql_label_merge)
def q_label_merge(spark, sf_dir):
    """Keyword labels on the 14-class task: classes drawing the same word merge into the first."""
    pr = _prep(spark, sf_dir, P_MERGE)
    return L.label_merge(pr.sample, pr.lmap).select("rep", "split", "pos", "doc_id", "label_idx",
                                                   "label_word", "merged_idx")


P_MEMO = CHECK.with_(pattern="memo_label_syn")


def _sql_memo_substitute():
    return (f"{S.base_ctes(P_MEMO)},\n{S.texts_ctes(P_MEMO)}\n"
            f"SELECT rep, split, pos, doc_id, label_word, text FROM vt")


@register("memo_substitute", _sql_memo_substitute)
def q_memo_substitute(spark, sf_dir):
    pr = _prep(spark, sf_dir, P_MEMO)
    return L.memo_text(pr.sample, pr.lmap).select("rep", "split", "pos", "doc_id", "label_word", "text")


def _sql_dev_test_split():
    half = CHECK.test_num // 2
    return (f"{S.base_ctes(CHECK)},\n{S.texts_ctes(CHECK)}\n"
            f"SELECT rep, pos, doc_id, 'test' AS part FROM tst WHERE pos < {half}\nUNION ALL\n"
            f"SELECT t.rep, t.pos, t.doc_id, 'dev' AS part FROM tst t WHERE t.pos >= {half} AND NOT EXISTS "
            f"(SELECT 1 FROM tst f WHERE f.rep = t.rep AND f.pos < {half} AND f.text = t.text)")


@register("dev_test_split", _sql_dev_test_split)
def q_dev_test_split(spark, sf_dir):
    pr = _prep(spark, sf_dir)
    return L.dev_test_split(X.sample_texts(pr, "test"), CHECK.test_num).select("rep", "pos", "doc_id", "part")


# ---------------------------------------------------------------- demonstrations / prompts
def _sql_demo_draw():
    return (f"{S.base_ctes(CHECK)},\n{S.demos_cte(CHECK)}\n"
            f"SELECT m.rep, m.test_id, m.ord, m.train_pos, s.doc_id AS train_id FROM dem m "
            f"JOIN vs s ON s.rep = m.rep AND s.split = 'train' AND s.pos = m.train_pos")


@register("demo_draw", _sql_demo_draw)
def q_demo_draw(spark, sf_dir):
    pr = _prep(spark, sf_dir)
    pool = pr.sample.filter("split = 'train'").select("rep", F.col("pos").alias("train_pos"),
                                                     F.col("doc_id").alias("train_id"))
    return X.demonstrations(pr).join(pool, ["rep", "train_pos"]).select("rep", "test_id", "ord", "train_pos", "train_id")


def _sql_prompt_build():
    return (f"{S.base_ctes(CHECK)},\n{S.texts_ctes(CHECK)},\n{S.demos_cte(CHECK)},\n{S.prompts_ctes(CHECK)}\n"
            f"SELECT rep, test_id, gold_word, prompt FROM prompts")


@register("prompt_build", _sql_prompt_build)
def q_prompt_build(spark, sf_dir):
    return X.prompts(_prep(spark, sf_dir))


def _sql_overlap_scores():
    return (f"{S.base_ctes(CHECK)},\n{S.texts_ctes(CHECK)},\n{S.demos_cte(CHECK)},\n{S.scores_ctes(CHECK)}\n"
            f"SELECT rep, test_id, label_idx, round(score, 6) AS score FROM scores")


@register("overlap_scores", _sql_overlap_scores)
def q_overlap_scores(spark, sf_dir):
    scores, _, _ = X.overlap_eval(_prep(spark, sf_dir))
    return scores.select("rep", "test_id", "label_idx", F.round("score", 6).alias("score"))


def _sql_gold_rank():
    return (f"{S.base_ctes(CHECK)},\n{S.texts_ctes(CHECK)},\n{S.demos_cte(CHECK)},\n{S.scores_ctes(CHECK)}\n"
            f"SELECT rep, test_id, gold_idx, pred_idx, gold_rank FROM pr")


@register("gold_rank", _sql_gold_rank)
def q_gold_rank(spark, sf_dir):
    _, preds, _ = X.overlap_eval(_prep(spark, sf_dir))
    return preds.select("rep", "test_id", "gold_idx", "pred_idx", "gold_rank")


def _sql_macro_f1():
    return (f"{S.base_ctes(CHECK)},\n{S.texts_ctes(CHECK)},\n{S.demos_cte(CHECK)},\n{S.scores_ctes(CHECK)},\n"
            f"{S.f1_cte()}\nSELECT rep, round(macro_f1, 6) AS macro_f1 FROM f1")


@register("macro_f1", _sql_macro_f1)
def q_macro_f1(spark, sf_dir):
    _, _, f1 = X.overlap_eval(_prep(spark, sf_dir))
    return f1.select("rep", F.round("macro_f1", 6).alias("macro_f1"))


# ---------------------------------------------------------------- patterns
P_RAND = CHECK.with_(task="SetFit/CR", pattern="label")


def _sql_label_remap_rand():
    p = P_RAND
    return (f"WITH lab AS ({S.lab_sql(p.task)}),\nreps AS ({S.reps_sql(p)}),\n{S.lmap_ctes(p)}\n"
            f"SELECT rep, task, label_idx, label_word, label_org FROM lmap")


@register("label_remap_rand", _sql_label_remap_rand)
def q_label_remap_rand(spark, sf_dir):
    """Random vocabulary tokens as label words (CR-shaped task, "label" pattern)."""
    pr = _prep(spark, sf_dir, P_RAND)
    return pr.lmap.select("rep", "task", "label_idx", "label_word", "label_org")


P_WORDS = CHECK.with_(pattern="memo_label_ant", repeats=6)


def _sql_label_remap_words():
    return (f"{S.base_ctes(P_WORDS)}\nSELECT m.rep, m.label_idx, m.label_word, m.label_org, "
            f"CAST(count(v.doc_id) AS BIGINT) AS n_rows FROM lmap m LEFT JOIN vs v ON v.rep = m.rep "
            f"AND v.label_idx = m.label_idx GROUP BY m.rep, m.label_idx, m.label_word, m.label_org")


@register("label_remap_words", _sql_label_remap_words)
def q_label_remap_words(spark, sf_dir):
    """One random antonym per class and replicate, with the sampled rows per class."""
    pr = _prep(spark, sf_dir, P_WORDS)
    n = pr.sample.groupBy("rep", "label_idx").agg(F.count("*").alias("n_rows"))
    return (pr.lmap.join(n, ["rep", "label_idx"], "left")
            .select("rep", "label_idx", "label_word", "label_org",
                    F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows")))


def _sql_vocab_permutation():
    return (f"WITH reps AS ({S.reps_sql(CHECK)}),\n{S.perm_ctes(CHECK)}\n"
            f"SELECT rep, token, new_token FROM perm")


@register("vocab_permutation", _sql_vocab_permutation)
def q_vocab_permutation(spark, sf_dir):
    from shotlab.operators.vocab import corpus_vocab, permutation
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    from shotlab.functions.text import PIECE_PATTERN
    return permutation(corpus_vocab(docs, pattern=PIECE_PATTERN), CHECK.repeats, CHECK.seed)


P_TOKEN = CHECK.with_(pattern="token")


def _sql_token_permute():
    p = P_TOKEN
    return f"{S.base_ctes(p)},\n{S.texts_ctes(p)},\n{S.demos_cte(p)},\n{S.prompts_ctes(p)}\nSELECT rep, test_id, prompt AS permuted FROM prompts"


@register("token_permute", _sql_token_permute)
def q_token_permute(spark, sf_dir):
    """Prompts whose texts went through the replicate's vocabulary permutation; label words,
    template, line ends and the template's punctuation kept."""
    return X.scoring_prompts(_prep(spark, sf_dir, P_TOKEN)).select("rep", "test_id", F.col("prompt").alias("permuted"))


@register("token_scores", lambda: f"{_scored_sql(P_TOKEN)}\nSELECT rep, test_id, label_idx, round(score, 6) AS score FROM scores")
def q_token_scores(spark, sf_dir):
    """Stand-in scores of the permuted texts."""
    scores, _, _ = X.overlap_eval(_prep(spark, sf_dir, P_TOKEN))
    return scores.select("rep", "test_id", "label_idx", F.round("score", 6).alias("score"))


P_MEMO_RAND = CHECK.with_(pattern="memo_label_rand")


@register("memo_label_rand", lambda: f"{_scored_sql(P_MEMO_RAND)}\nSELECT rep, test_id, gold_idx, pred_idx, gold_rank FROM pr")
def q_memo_label_rand(spark, sf_dir):
    """Random vocabulary tokens as label words, original label words as texts."""
    _, preds, _ = X.overlap_eval(_prep(spark, sf_dir, P_MEMO_RAND))
    return preds.select("rep", "test_id", "gold_idx", "pred_idx", "gold_rank")


P_ZERO = CHECK.with_(k=0)


def _sql_zero_shot():
    p = P_ZERO
    return f"{S.base_ctes(p)},\n{S.texts_ctes(p)},\n{S.demos_cte(p)},\n{S.prompts_ctes(p)}\nSELECT rep, test_id, gold_word, prompt FROM prompts"


@register("prompt_build_zero_shot", _sql_zero_shot)
def q_prompt_build_zero_shot(spark, sf_dir):
    return X.prompts(_prep(spark, sf_dir, P_ZERO))


# ---------------------------------------------------------------- text functions / features
def _sql_text_normalize():
    return f"SELECT doc_id, {S.norm_sql('text')} AS norm_text FROM documents"


@register("text_normalize", _sql_text_normalize)
def q_text_normalize(spark, sf_dir):
    from shotlab.functions.text import normalize_text
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", normalize_text("text").alias("norm_text"))


def _sql_tokenize():
    pat = S.WORD_PATTERN
    toks = f"regexp_extract_all({S.norm_sql('text')}, '{pat}')"
    kept = f"list_filter({toks}, lambda x: NOT list_contains({S.stop_list_sql()}, x))"
    return (f"SELECT doc_id, CAST(len({toks}) AS INTEGER) AS n_tokens, array_to_string({kept}, ' ') AS tokens "
            f"FROM documents")


@register("tokenize", _sql_tokenize)
def q_tokenize(spark, sf_dir):
    from shotlab.functions.text import drop_stop_words, normalize_text, tokenize
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    t = d.select("doc_id", tokenize(normalize_text("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("int").alias("n_tokens"),
                    F.array_join(drop_stop_words("t"), " ").alias("tokens"))


def _sql_tokens_rejoin():
    return (f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{S.WORD_PATTERN}'), ' ') AS rejoined, "
            f"CAST(len(string_split(text, ' ')) AS INTEGER) AS n_space_split FROM documents")


@register("tokens_rejoin", _sql_tokens_rejoin)
def q_tokens_rejoin(spark, sf_dir):
    from shotlab.functions.text import rejoin, split_words, tokenize
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", rejoin(tokenize("text")).alias("rejoined"),
                    F.size(split_words("text")).cast("int").alias("n_space_split"))


def _corpus_grams_sql(ngc, ngw):
    return (f"WITH {S.doc_grams_cte('documents', 'doc_id', ngc, ngw)}\n"
            f"SELECT block, n, term, CAST(sum(cnt) AS BIGINT) AS cf, CAST(count(*) AS BIGINT) AS df "
            f"FROM grams GROUP BY block, n, term")


@register("word_ngrams", lambda: _corpus_grams_sql(0, 2))
def q_word_ngrams(spark, sf_dir):
    """Word 1..2-grams (normalised, stop words removed) of every document: corpus and document counts."""
    from shotlab.operators.features import corpus_grams
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return corpus_grams(d, 0, 2).select("block", F.col("n").cast("int"), "term", "cf", "df")


@register("char_ngrams", lambda: _corpus_grams_sql(4, 0))
def q_char_ngrams(spark, sf_dir):
    """Character 1..4-grams (whitespace runs collapsed) of every document: corpus and document counts."""
    from shotlab.operators.features import corpus_grams
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return corpus_grams(d, 4, 0).select("block", F.col("n").cast("int"), "term", "cf", "df")


def _baseline_inputs(spark, sf_dir, p=CHECK):
    pr = _prep(spark, sf_dir, p)
    fit, test = X.baseline_sets(pr)
    return pr, fit, test


def _sql_coverage_sample():
    return f"{S.base_ctes(CHECK)},\n{S.baseline_ctes(CHECK)}\nSELECT rep, doc_id, y, attempt FROM fit"


@register("coverage_sample", _sql_coverage_sample)
def q_coverage_sample(spark, sf_dir):
    """Baseline train set: first k pool rows, redrawn until they cover the test classes."""
    _, fit, _ = _baseline_inputs(spark, sf_dir)
    return fit.select("rep", "doc_id", "y", F.col("attempt").cast("int"))


P_COVER14 = CHECK.with_(task="dbpedia_14", k=14, test_num=24, seed=45)


@register("coverage_sample_14", lambda: f"{S.base_ctes(P_COVER14)},\n{S.baseline_ctes(P_COVER14, 2048)}\nSELECT rep, doc_id, y, attempt FROM fit")
def q_coverage_sample_14(spark, sf_dir):
    """As many rows as classes: many redraws until a sample covers the test classes."""
    _, fit, _ = _baseline_inputs(spark, sf_dir, P_COVER14)
    return fit.select("rep", "doc_id", "y", F.col("attempt").cast("int"))


def _fit_vocab_df(spark, sf_dir, char_cap, word_cap):
    from shotlab.operators.features import doc_grams, fit_vocab
    pr, fit, test = _baseline_inputs(spark, sf_dir)
    ids = fit.select("doc_id").unionByName(test.select("doc_id")).distinct()
    grams = doc_grams(X.doc_texts(pr).join(F.broadcast(ids), "doc_id", "left_semi"), 4, 2)
    ft = fit.select("rep", "doc_id").join(grams, "doc_id")
    tt = test.select("rep", "doc_id").join(grams, "doc_id")
    return ft, tt, fit_vocab(ft, 4, 2, char_cap, word_cap)


def _sql_vocab_topk():
    return (f"{S.base_ctes(CHECK)},\n{S.baseline_ctes(CHECK)},\n{S.vocab_fit_ctes(CHECK, 4, 2, 200, 100)}\n"
            f"SELECT rep, block, n_max, term, CAST(cf AS BIGINT) AS cf FROM voc")


@register("vocab_topk", _sql_vocab_topk)
def q_vocab_topk(spark, sf_dir):
    """Per replicate, block and n-gram range: the 200 char / 100 word terms with the highest count."""
    _, _, voc = _fit_vocab_df(spark, sf_dir, 200, 100)
    return voc.select("rep", "block", F.col("n_max").cast("int"), "term", F.col("cf").cast("long"))


def _features_q(spark, sf_dir, tfidf):
    from shotlab.operators.features import CHAR_CAP, WORD_CAP, features
    ft, tt, voc = _fit_vocab_df(spark, sf_dir, CHAR_CAP, WORD_CAP)
    f = features(ft.unionByName(tt), voc, 3, 2, tfidf, CHECK.k)
    return f.select("rep", "doc_id", "block", "term", F.round("value", 6).alias("value"))


def _sql_features(tfidf):
    from shotlab.operators.features import CHAR_CAP, WORD_CAP
    return (f"{S.base_ctes(CHECK)},\n{S.baseline_ctes(CHECK)},\n"
            f"{S.vocab_fit_ctes(CHECK, 4, 2, CHAR_CAP, WORD_CAP)}\n{S.features_sql(CHECK, 3, 2, tfidf)}")


@register("bow_features", lambda: _sql_features(False))
def q_bow_features(spark, sf_dir):
    """Count features (char 1..3 ‖ word 1..2) of fit and test documents, vocabulary fitted on the fit set."""
    return _features_q(spark, sf_dir, False)


@register("tfidf_features", lambda: _sql_features(True))
def q_tfidf_features(spark, sf_dir):
    """Sublinear TF x smooth IDF, L2-normalised per block."""
    return _features_q(spark, sf_dir, True)


def _sql_vocab_coverage():
    def units(src, tag):
        return (f"{tag}w AS (SELECT DISTINCT unnest(string_split(d.text, ' ')) AS u FROM {src} s "
                f"JOIN documents d ON d.doc_id = s.doc_id),\n"
                f"{tag}c AS (SELECT DISTINCT unnest(string_split(u, '')) AS u FROM {tag}w WHERE u <> ''),\n"
                f"{tag} AS (SELECT 'word' AS unit, u FROM {tag}w UNION ALL SELECT 'char' AS unit, u FROM {tag}c WHERE u <> '')")
    return (f"{S.base_ctes(CHECK)},\n{S.baseline_ctes(CHECK)},\n{units('fit', 'tr')},\n{units('btest', 'te')}\n"
            f"SELECT unit, CAST(count(tr_u) AS BIGINT) AS n_train, CAST(count(te_u) AS BIGINT) AS n_test, "
            f"CAST(count(CASE WHEN tr_u IS NOT NULL AND te_u IS NOT NULL THEN 1 END) AS BIGINT) AS n_common, "
            f"round(CASE WHEN count(te_u) > 0 THEN count(CASE WHEN tr_u IS NOT NULL AND te_u IS NOT NULL THEN 1 END) "
            f"/ count(te_u) ELSE 0.0 END, 6) AS share FROM (SELECT coalesce(a.unit, b.unit) AS unit, a.u AS tr_u, "
            f"b.u AS te_u FROM tr a FULL OUTER JOIN te b ON a.unit = b.unit AND a.u = b.u) GROUP BY unit")


@register("vocab_coverage", _sql_vocab_coverage)
def q_vocab_coverage(spark, sf_dir):
    """Word / character overlap of baseline train and test texts, pooled over replicates."""
    from shotlab.operators.features import vocab_coverage
    pr, fit, test = _baseline_inputs(spark, sf_dir)
    out = vocab_coverage(pr.docs.join(F.broadcast(fit), "doc_id"), pr.docs.join(F.broadcast(test), "doc_id"))
    return out.select("unit", "n_train", "n_test", "n_common", F.round("share", 6).alias("share"))


# ---------------------------------------------------------------- ranking / metrics views
def _scored_sql(p=CHECK):
    return f"{S.base_ctes(p)},\n{S.texts_ctes(p)},\n{S.demos_cte(p)},\n{S.scores_ctes(p)}"


@register("softmax", lambda: (f"{_scored_sql()}\nSELECT rep, test_id, label_idx, round(z / sum(z) OVER "
                              f"(PARTITION BY rep, test_id), 6) AS prob FROM (SELECT *, exp(score - max(score) OVER "
                              f"(PARTITION BY rep, test_id)) AS z FROM scores)"))
def q_softmax(spark, sf_dir):
    from shotlab.operators.ranking import softmax
    scores, _, _ = X.overlap_eval(_prep(spark, sf_dir))
    return softmax(scores).select("rep", "test_id", "label_idx", F.round("prob", 6).alias("prob"))


@register("predict", lambda: f"{_scored_sql()}\nSELECT rep, test_id, pred_idx FROM pr")
def q_predict(spark, sf_dir):
    from shotlab.operators.ranking import predict
    scores, _, _ = X.overlap_eval(_prep(spark, sf_dir))
    return predict(scores)


@register("accuracy", lambda: (f"{_scored_sql()}\nSELECT rep, round(avg(CAST(gold_idx = pred_idx AS DOUBLE)), 6) "
                               f"AS accuracy FROM pr GROUP BY rep"))
def q_accuracy(spark, sf_dir):
    from shotlab.operators.metrics import accuracy
    _, preds, _ = X.overlap_eval(_prep(spark, sf_dir))
    return accuracy(preds).select("rep", F.round("accuracy", 6).alias("accuracy"))


@register("confusion", lambda: (f"{_scored_sql()}\nSELECT rep, gold_idx, pred_idx, CAST(count(*) AS BIGINT) AS n "
                                f"FROM pr GROUP BY rep, gold_idx, pred_idx"))
def q_confusion(spark, sf_dir):
    from shotlab.operators.metrics import confusion
    _, preds, _ = X.overlap_eval(_prep(spark, sf_dir))
    return confusion(preds)


def _sql_class_report():
    kinds = {"p": "CASE WHEN np > 0 THEN tp / np ELSE 0.0 END", "r": "CASE WHEN ng > 0 THEN tp / ng ELSE 0.0 END", "f": "CASE WHEN np + ng > 0 THEN 2.0 * tp / (np + ng) ELSE 0.0 END"}
    cols = lambda e: ", ".join(f"round({e[k]}, 6) AS {n}" for k, n in (("p", "precision"), ("r", "recall"), ("f", "f1")))
    avg, wtd = {k: f"avg({k})" for k in kinds}, {k: f"sum({k} * ng) / sum(ng)" for k in kinds}
    pooled = {k: v.replace("tp", "sum(tp)").replace("np", "sum(np)").replace("ng", "sum(ng)") for k, v in kinds.items()}
    tail = "CAST(sum(ng) AS BIGINT) AS support FROM c GROUP BY rep"
    return (f"{_scored_sql()},\n{S.f1_cte()},\nc AS (SELECT rep, cls_, ng, np, tp, {', '.join(f'{v} AS {k}' for k, v in kinds.items())} FROM f1_c)\n"
            f"SELECT rep, CAST(cls_ AS VARCHAR) AS row, {cols({k: k for k in kinds})}, CAST(ng AS BIGINT) AS support FROM c\n"
            f"UNION ALL SELECT rep, 'macro', {cols(avg)}, {tail}\nUNION ALL SELECT rep, 'weighted', {cols(wtd)}, {tail}\nUNION ALL SELECT rep, 'micro', {cols(pooled)}, {tail}")


@register("class_report", _sql_class_report)
def q_class_report(spark, sf_dir):
    """Precision, recall, F1 and support per class, with macro, weighted and micro rows."""
    from shotlab.operators.metrics import class_report
    _, preds, _ = X.overlap_eval(_prep(spark, sf_dir))
    return class_report(preds).select("rep", "row", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def _sql_vocab_softmax():
    word = S.WORD_PATTERN
    return (f"{S.base_ctes(CHECK)},\n{S.texts_ctes(CHECK)},\n{S.demos_cte(CHECK)},\n{S.prompts_ctes(CHECK)},\n"
            f"lt AS (SELECT rep, label_idx, regexp_extract(label_word, '{word}') AS token FROM lmap),\n"
            f"vc AS (SELECT token FROM ({S.vocab_sql()}) UNION SELECT token FROM lt),\n"
            f"pt AS (SELECT rep, test_id, token, count(*) AS cnt FROM (SELECT rep, test_id, unnest(regexp_extract_all(prompt, '{word}')) AS token FROM prompts) GROUP BY ALL),\n"
            f"lg AS (SELECT p.rep, p.test_id, v.token, 40 * ln(1 + coalesce(t.cnt, 0)) AS logit FROM prompts p CROSS JOIN vc v LEFT JOIN pt t ON t.rep = p.rep AND t.test_id = p.test_id AND t.token = v.token),\n"
            f"sm AS (SELECT *, exp(logit - max(logit) OVER w) AS z FROM lg WINDOW w AS (PARTITION BY rep, test_id)),\n"
            f"st AS (SELECT rep, test_id, sum(z) AS total FROM sm GROUP BY rep, test_id)\n"
            f"SELECT s.rep, s.test_id, l.label_idx, round(ln(greatest(s.z / t.total, 1e-300)), 6) AS log_prob FROM sm s JOIN lt l ON l.rep = s.rep AND l.token = s.token JOIN st t ON t.rep = s.rep AND t.test_id = s.test_id")


@register("vocab_softmax", _sql_vocab_softmax)
def q_vocab_softmax(spark, sf_dir):
    """Label probabilities under a softmax over the whole vocabulary, not renormalised over the
    labels. The logits are a stand-in: 40 ln(1 + occurrences in the prompt), 0 for all other tokens."""
    from shotlab.functions.text import WORD_PATTERN, tokenize
    from shotlab.operators.ranking import vocab_softmax
    from shotlab.operators.vocab import corpus_vocab
    pr = _prep(spark, sf_dir)
    labels = pr.lmap.select("rep", "label_idx", F.regexp_extract("label_word", WORD_PATTERN, 0).alias("token"))
    vocab = corpus_vocab(pr.docs).union(labels.select("token")).distinct().persist()
    pr.kept.append(vocab)
    prompts = X.prompts(pr)
    counts = prompts.select("rep", "test_id", F.explode(tokenize("prompt")).alias("token")).groupBy("rep", "test_id", "token").agg(F.count("*").alias("cnt"))
    logits = counts.join(vocab, "token", "left_semi").select("rep", "test_id", "token", (40 * F.log(1.0 + F.col("cnt"))).alias("logit"))
    wanted = pr.sample.filter("split = 'test'").select("rep", F.col("doc_id").alias("test_id")).join(F.broadcast(labels), "rep")
    out = vocab_softmax(logits, wanted, vocab.count())
    return out.select("rep", "test_id", "label_idx", F.round(F.log(F.greatest("prob", F.lit(1e-300))), 6).alias("log_prob"))


@register("replicate_summary", lambda: (
    f"{_scored_sql()},\n{S.f1_cte()}\nSELECT round(coalesce(avg(macro_f1), 0.0), 6) AS mean_f1, "
    f"CAST(count(*) AS BIGINT) AS n_reps, round((SELECT avg(gold_rank) FROM pr), 6) AS mean_rank, "
    f"(SELECT CAST(count(*) AS BIGINT) FROM pr) AS n_prompts FROM f1"))
def q_replicate_summary(spark, sf_dir):
    from shotlab.operators.metrics import replicate_summary
    _, preds, f1 = X.overlap_eval(_prep(spark, sf_dir))
    s = replicate_summary(f1, preds)
    return s.select(F.round("mean_f1", 6).alias("mean_f1"), F.col("n_reps").cast("long"),
                    F.round("mean_rank", 6).alias("mean_rank"), F.col("n_prompts").cast("long"))


# ---------------------------------------------------------------- grid / baselines
P_GUESS = CHECK.with_(task="dbpedia_14")


def _sql_random_parts(p):
    hn = S.sql_hnum(p.seed, "guess", "t.rep", "g.grid_id", "t.doc_id")
    return (f"grid AS ({S.grid_values()}),\n"
            f"tcls AS (SELECT rep, list_sort(list_distinct(list(y))) AS cls FROM btest GROUP BY rep),\n"
            f"rg AS (SELECT t.rep, g.c, g.solver, g.ngc_max, g.ngw_max, t.y AS gold_idx, "
            f"c.cls[1 + ({hn} % len(c.cls))] AS pred_idx FROM btest t JOIN tcls c ON c.rep = t.rep CROSS JOIN grid g),\n"
            f"{S.f1_cte('rg', 'rep, c, solver, ngc_max, ngw_max', 'gf')}")


def _sql_random_grid(p=P_GUESS):
    return f"{S.base_ctes(p)},\n{S.baseline_ctes(p)},\n{_sql_random_parts(p)}"


@register("random_baseline", lambda: (f"{_sql_random_grid()}\nSELECT rep, c, solver, ngc_max, ngw_max, "
                                      f"round(macro_f1, 6) AS f1 FROM gf"))
def q_random_baseline(spark, sf_dir):
    """Uniform guesses among each replicate's test classes, a new guess per grid point (14-class task)."""
    from shotlab.operators.linear import grid_space, random_predictions
    pr, _, test = _baseline_inputs(spark, sf_dir, P_GUESS)
    preds = random_predictions(test, grid_space(spark), P_GUESS.seed)
    f1 = macro_f1(preds, by=("rep", "c", "solver", "ngc_max", "ngw_max"), out="f1")
    return f1.select("rep", "c", "solver", "ngc_max", "ngw_max", F.round("f1", 6).alias("f1"))


@register("grid_best", lambda: (
    f"{_sql_random_grid()}\nSELECT rep, round(max(macro_f1), 6) AS best_f1, "
    f"first(c ORDER BY round(macro_f1, 9) DESC, c, solver, ngc_max, ngw_max) AS best_c, "
    f"first(solver ORDER BY round(macro_f1, 9) DESC, c, solver, ngc_max, ngw_max) AS best_solver, "
    f"first(ngc_max ORDER BY round(macro_f1, 9) DESC, c, solver, ngc_max, ngw_max) AS best_ngc_max, "
    f"first(ngw_max ORDER BY round(macro_f1, 9) DESC, c, solver, ngc_max, ngw_max) AS best_ngw_max "
    f"FROM gf GROUP BY rep"))
def q_grid_best(spark, sf_dir):
    """Best grid point per replicate (on the random-guess grid, whose F1s SQL can reproduce)."""
    from shotlab.operators.linear import grid_space, random_predictions
    from shotlab.operators.metrics import grid_best
    pr, _, test = _baseline_inputs(spark, sf_dir, P_GUESS)
    preds = random_predictions(test, grid_space(spark), P_GUESS.seed)
    f1 = macro_f1(preds, by=("rep", "c", "solver", "ngc_max", "ngw_max"), out="f1")
    b = grid_best(f1)
    return b.select("rep", F.round("best_f1", 6).alias("best_f1"), F.col("best.c").alias("best_c"),
                    F.col("best.solver").alias("best_solver"), F.col("best.ngc_max").alias("best_ngc_max"),
                    F.col("best.ngw_max").alias("best_ngw_max"))


@register("grid_space", lambda: (f"{S.base_ctes(CHECK)},\ngrid AS ({S.grid_values()})\n"
                                 f"SELECT r.rep, g.c, g.solver, g.ngc_max, g.ngw_max FROM "
                                 f"(SELECT DISTINCT rep FROM vs) r CROSS JOIN grid g"))
def q_grid_space(spark, sf_dir):
    """The 240-point grid attached to every sampled replicate."""
    from shotlab.operators.linear import grid_space
    pr = _prep(spark, sf_dir)
    g = grid_space(spark)
    n = g.count()
    reps = pr.sample.select("rep").distinct()
    return (reps.withColumn("grid_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            .join(F.broadcast(g), "grid_id").select("rep", "c", "solver", "ngc_max", "ngw_max"))


@register("linear_grid")
def q_linear_grid(spark, sf_dir):
    """Logistic-regression grid (fits: rows-only check): 240 F1 rows per replicate."""
    pr = _prep(spark, sf_dir)
    grid, _, _ = X.linear_baseline(spark, pr)
    return grid.select("rep", "c", "solver", "ngc_max", "ngw_max", F.round("f1", 6).alias("f1"))


@register("linear_fit")
def q_linear_fit(spark, sf_dir):
    """K1: one pyspark.ml logistic regression on the whole train split of the 4-class task (rows-only)."""
    from shotlab.operators.linear import linear_fit
    lab = task_rows(spark, sf_dir, "ag_news")
    return linear_fit(lab.filter("split = 'train'"), lab.filter("split = 'test'"), c=1.0)


def _sql_linear_fit_check():
    from shotlab.operators.features import CHAR_CAP, WORD_CAP
    kept = lambda block, cap: f"(SELECT CAST(least(count(DISTINCT term), {cap}) AS BIGINT) FROM grams WHERE block = '{block}')"
    return (f"WITH lab AS ({S.lab_sql('ag_news')}),\ntr AS (SELECT doc_id, text, label_idx FROM lab WHERE split = 'train'),\n{S.doc_grams_cte('tr', 'doc_id', 4, 2)}\n"
            f"SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(count(DISTINCT label_idx) AS INTEGER) AS n_classes, {kept('char', CHAR_CAP)} AS n_char_terms, "
            f"{kept('word', WORD_CAP)} AS n_word_terms, true AS stationary FROM tr")


@register("linear_fit_check", _sql_linear_fit_check)
def q_linear_fit_check(spark, sf_dir):
    """The large fit on TF-IDF rows: its documents, its whole vocabulary, and that the gradient is zero
    (to a millionth of that at zero coefficients)."""
    from shotlab.operators.linear import linear_model
    m = linear_model(task_rows(spark, sf_dir, "ag_news").filter("split = 'train'"), 1.0, tfidf=True)
    f = m.fitted
    row = (m.n_docs, f.n_classes, m.n_char, m.n_terms - m.n_char, bool(f.gradient <= 1e-6 * f.start_gradient))
    m.release()
    return spark.createDataFrame([row], "n_docs long, n_classes int, n_char_terms long, n_word_terms long, stationary boolean")


def _sql_score_hook():
    p = CHECK
    words = "regexp_extract_all(lower(p.prompt), '[a-z0-9_]+')"
    return (f"{S.base_ctes(p)},\n{S.texts_ctes(p)},\n{S.demos_cte(p)},\n{S.prompts_ctes(p)},\n"
            f"scores AS (SELECT p.rep, p.test_id, l.label_idx, len(list_filter({words}, lambda x: x = lower(l.label_word))) / greatest(len({words}), 1) AS score "
            f"FROM prompts p JOIN lmap l ON l.rep = p.rep),\n"
            f"gold AS (SELECT t.rep, t.doc_id AS test_id, mi.merged_idx AS gold_idx FROM tst t JOIN mi ON mi.rep = t.rep AND mi.label_word = t.label_word)\n"
            f"SELECT s.rep, s.test_id, g.gold_idx, first(s.label_idx ORDER BY s.score DESC, s.label_idx) AS pred_idx, "
            f"CAST(1 + count(*) FILTER (WHERE s.score > gs.score) AS INTEGER) AS gold_rank FROM scores s JOIN gold g ON g.rep = s.rep AND g.test_id = s.test_id "
            f"JOIN scores gs ON gs.rep = s.rep AND gs.test_id = s.test_id AND gs.label_idx = g.gold_idx GROUP BY s.rep, s.test_id, g.gold_idx")


@register("score_hook", _sql_score_hook)
def q_score_hook(spark, sf_dir):
    """Model hook (mapInPandas) with a toy batch scorer; predictions and gold ranks."""
    from shotlab.operators.scoring import overlap_fn, score_with
    pr = _prep(spark, sf_dir)
    scores = score_with(X.scoring_prompts(pr), pr.lmap, overlap_fn())
    return predict_and_rank(scores, X.gold(pr), n_labels=pr.task.n_labels)


def _sql_report():
    from shotlab.sources.registry import PATTERNS
    parts = []
    for pat in PATTERNS:
        p = CHECK.with_(pattern=pat)
        rnd, extra = "CAST(NULL AS DOUBLE)", ""
        if pat in X.BASELINE_PATTERNS:
            extra = f",\n{S.baseline_ctes(p)},\n{_sql_random_parts(p)}"
            rnd = "(SELECT round(avg(b), 6) FROM (SELECT max(macro_f1) AS b FROM gf GROUP BY rep))"
        parts.append(f"SELECT * FROM ({_scored_sql(p)},\n{S.f1_cte()}{extra}\nSELECT {S.q(pat)} AS pattern, round(coalesce(avg(macro_f1), 0.0), 6) AS mean_f1, "
                     f"round((SELECT avg(gold_rank) FROM pr), 6) AS mean_rank, (SELECT CAST(count(*) AS BIGINT) FROM pr) AS n_prompts, {rnd} AS random_f1 FROM f1)")
    return "\nUNION ALL\n".join(parts)


@register("experiment_report", _sql_report)
def q_experiment_report(spark, sf_dir):
    """All seven patterns: stand-in F1 and rank, random baseline (fits: ``linear_grid``)."""
    from shotlab.sources.registry import PATTERNS
    out = X.experiment_report(spark, sf_dir, CHECK, PATTERNS, linear=False)
    return out.select("pattern", F.round("mean_f1", 6).alias("mean_f1"), F.round("mean_rank", 6).alias("mean_rank"), F.col("n_prompts").cast("long"), F.round("random_f1", 6).alias("random_f1"))


@register("experiment_report_linear")
def q_experiment_report_linear(spark, sf_dir):
    """The patterns that have a linear baseline, with its fitted F1 (fits: rows-only; the other columns
    are those of ``experiment_report``)."""
    out = X.experiment_report(spark, sf_dir, CHECK, X.BASELINE_PATTERNS, linear=True)
    return out.select("pattern", *[F.round(c, 6).alias(c) for c in ("mean_f1", "mean_rank", "random_f1", "linear_f1")], F.col("n_prompts").cast("long"))


# ---------------------------------------------------------------- kernels and a user's table
def _sql_kernel(tfidf):
    w = f"(1 + ln(x.cnt)) * (ln((1.0 + {CHECK.k}) / (1.0 + v.df)) + 1)" if tfidf else "CAST(x.cnt AS DOUBLE)"
    unit = "w / sqrt(sum(w * w) OVER (PARTITION BY rep, doc_id, block, n_max))" if tfidf else "w"
    cols = [f"round(coalesce(sum(p) FILTER (block = '{b}' AND n_max = {n}), 0.0), 6) AS {t}{n}" for b, t, top in (("char", "c", 4), ("word", "w", 2)) for n in range(1, top + 1)]
    return (f"{S.base_ctes(CHECK)},\n{S.baseline_ctes(CHECK)},\n{S.vocab_fit_ctes(CHECK, 4, 2, 50000, 10000)},\n"
            f"xs AS (SELECT rep, doc_id, block, term, cnt, true AS fitted FROM ft UNION ALL SELECT rep, doc_id, block, term, cnt, false FROM tt),\n"
            f"wt AS (SELECT x.rep, x.doc_id, x.fitted, x.block, v.n_max, x.term, {w} AS w FROM xs x JOIN voc v ON v.rep = x.rep AND v.block = x.block AND v.term = x.term),\n"
            f"un AS (SELECT rep, doc_id, fitted, block, n_max, term, {unit} AS w FROM wt),\n"
            f"pp AS (SELECT a.rep, a.doc_id AS i, b.doc_id AS j, a.block, a.n_max, a.w * b.w AS p FROM un a JOIN un b ON a.rep = b.rep AND a.block = b.block AND a.n_max = b.n_max AND a.term = b.term WHERE a.fitted)\n"
            f"SELECT rep, i, j, {', '.join(cols)} FROM pp GROUP BY rep, i, j")


def _kernel(spark, sf_dir, tfidf):
    from shotlab.operators.linear import kernel_matrix
    pr, fit, test = _baseline_inputs(spark, sf_dir)
    k = kernel_matrix(fit.select("rep", "doc_id", "y"), test, X.doc_texts(pr), tfidf, CHECK.k, rows=pr.sampled_rows, keep=pr.kept)
    return k.select("rep", "i", "j", *[F.round(c, 6).alias(c) for c in ("c1", "c2", "c3", "c4", "w1", "w2")])


@register("linear_kernel", lambda: _sql_kernel(False))
def q_linear_kernel(spark, sf_dir):
    """Dot products of fit and test documents for every n-gram range (counts)."""
    return _kernel(spark, sf_dir, False)


@register("linear_kernel_tfidf", lambda: _sql_kernel(True))
def q_linear_kernel_tfidf(spark, sf_dir):
    """The same on TF-IDF weights, L2-normalised per block and range."""
    return _kernel(spark, sf_dir, True)


P_GRID_GUESS = CHECK.with_(task="dbpedia_14", k=4)


@register("linear_grid_guess", lambda: f"{_sql_random_grid(P_GRID_GUESS)}\nSELECT rep, c, solver, ngc_max, ngw_max, round(macro_f1, 6) AS f1 FROM gf")
def q_linear_grid_guess(spark, sf_dir):
    """The grid where every replicate's test set has more classes than k: guesses only."""
    grid, _, _ = X.linear_baseline(spark, _prep(spark, sf_dir, P_GRID_GUESS))
    return grid.select("rep", "c", "solver", "ngc_max", "ngw_max", F.round("f1", 6).alias("f1"))


def _sql_custom_task():
    lab = (f"SELECT m.id AS doc_id, m.text, CAST(CASE m.role WHEN 'user' THEN 0 ELSE 1 END AS INTEGER) AS label_idx, {S.split_expr('m.id')} AS split "
           f"FROM (SELECT conv_id * 1000 + turn AS id, role, text FROM conversations) m")
    own = f"({lab}) d"
    p = CHECK
    base = S.base_ctes(p).replace(S.lab_sql(p.task), lab)
    org = ", ".join(f"({i}, {S.q(w)})" for i, w in enumerate(CUSTOM.labels))
    old = S.lmap_ctes(p)
    new = old.replace(old[:old.index(" v(label_idx")], f"lorg AS (SELECT * FROM (VALUES {org})").replace("'sst2' AS task", "'speaker' AS task")
    base = base.replace(old, new)
    texts = S.texts_ctes(p).replace("JOIN documents d", f"JOIN {own}")
    prompts = S.prompts_ctes(p).replace(S.q(S.get_task(p.task).prompt_x), S.q(CUSTOM.prompt_x)).replace(S.q(S.get_task(p.task).prompt_y), S.q(CUSTOM.prompt_y))
    return f"{base},\n{texts},\n{S.demos_cte(p)},\n{prompts}\nSELECT rep, test_id, gold_word, prompt FROM prompts"


CUSTOM = custom_task("speaker", ["question", "answer"], "Turn: ", "\nKind: ")


@register("custom_task", _sql_custom_task)
def q_custom_task(spark, sf_dir):
    """A user's own table and task: who speaks in a turn of ``conversations``."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content"), F.when(F.col("role") == "user", 0).otherwise(1).alias("label"))
    lab = read_labelled(spark, turns, id_col="id", split_col=None)
    return X.prompts(X.prepare(spark, None, CHECK, labelled=lab, task=CUSTOM))


@register("linear_grid_tfidf")
def q_linear_grid_tfidf(spark, sf_dir):
    """The same grid on TF-IDF features (sublinear tf, smooth idf, L2 per block; rows-only)."""
    pr = _prep(spark, sf_dir)
    grid, _, _ = X.linear_baseline(spark, pr, tfidf=True)
    return grid.select("rep", "c", "solver", "ngc_max", "ngw_max", F.round("f1", 6).alias("f1"))


CHECKED_CLASSES = 8


def _sql_checked_scan():
    return f"""WITH r AS (SELECT doc_id, text, CASE WHEN starts_with(source, 'src') THEN substr(source, 4) ELSE source END AS raw FROM documents),
j AS (SELECT doc_id, raw, CASE WHEN doc_id IS NULL THEN 'no id' WHEN text IS NULL THEN 'no text' WHEN trim(coalesce(raw, '')) = '' THEN 'no label'
  WHEN NOT coalesce(TRY_CAST(raw AS INTEGER) BETWEEN 0 AND {CHECKED_CLASSES - 1}, false) THEN 'label unknown' END AS reason FROM r)
SELECT doc_id, raw AS raw_label, reason, CASE WHEN reason IS NULL THEN TRY_CAST(raw AS INTEGER) END AS label_idx FROM j"""


@register("checked_scan", _sql_checked_scan)
def q_checked_scan(spark, sf_dir):
    """Documents labelled by the number of their source, a task of eight classes: kept rows and rejects."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("label", F.regexp_replace("source", "^src", ""))
    judged = checked_scan(spark, docs, CHECKED_CLASSES).judged
    return judged.select("doc_id", "raw_label", "reason", F.when(F.col("reason").isNull(), F.col("label_idx")).alias("label_idx"))


def _sql_user_vocab():
    return r"SELECT DISTINCT token FROM (SELECT unnest(string_split(text, ' ')) AS token FROM documents) WHERE regexp_full_match(token, '[\p{L}\p{N}_]+')"


@register("user_vocab", _sql_user_vocab)
def q_user_vocab(spark, sf_dir):
    """A user's vocabulary (the words between spaces, punctuation and all) without entries of several tokens or none."""
    from shotlab.operators.vocab import user_vocab

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return user_vocab(docs.select(F.explode(F.split("text", " ", -1)).alias("token")))
