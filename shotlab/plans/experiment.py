"""Composed experiment plans: data preparation, prompting, scoring, reporting.

Replicates are a column, so the whole experiment is a handful of Spark jobs
rather than a driver loop. ``prepare`` checks the table with one small job and
``baseline_sets`` finds covering samples; everything else is lazy. Reused
intermediates are persisted and listed in ``Prepared.kept``
(``Prepared.release`` frees them); every draw is a pure function of the seed,
so a lost block is computed again with the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlab.config import Params
from shotlab.functions.text import PIECE_PATTERN, pieces
from shotlab.operators.labels import label_map, memo_text, verbalize, merged_index
from shotlab.operators.metrics import macro_f1, replicate_summary
from shotlab.operators.partitioning import bounded_broadcast
from shotlab.operators.prompts import build_prompts, demo_rows, present
from shotlab.operators.ranking import predict_and_rank
from shotlab.operators.sampling import coverage_sample, draw_demos, sample_replicates
from shotlab.operators.scoring import overlap_scores
from shotlab.operators.vocab import corpus_vocab, images, indexed, permute_tokens
from shotlab.shared import Written, held, settled, step
from shotlab.sources.labelled import task_rows
from shotlab.sources.registry import Task, task as get_task, word_lists


@dataclass
class Prepared:
    """The inputs of one experiment. ``kept`` lists what is persisted; ``release`` frees it."""

    params: Params
    task: Task
    labelled: DataFrame      # (doc_id, text, label_idx, split)
    docs: DataFrame          # (doc_id, text)
    lmap: DataFrame          # (rep, task, label_idx, label_word, label_org)
    sample: DataFrame        # (rep, split, pos, doc_id, label_idx, label_word)
    drawn: DataFrame         # the sample before label words: the same for every pattern
    kept: list
    _texts: DataFrame | None = None
    _permuted: DataFrame | None = None
    _sets: tuple | None = None

    def keep(self, df: DataFrame) -> DataFrame:
        return held(df, self.kept)

    def release(self) -> None:
        while self.kept:
            self.kept.pop().unpersist()

    @property
    def sampled_rows(self) -> int:
        return self.params.repeats * 3 * self.params.test_num


def check_table(labelled: DataFrame, t: Task, p: Params) -> dict[str, int]:
    """One pass over the narrow columns: enough rows per split, class ids with a word, unique ids.
    Returns the splits' row counts."""
    rows = labelled.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"),
                                         F.count(F.when(F.col("label_idx").isNull() | (F.col("label_idx") < 0) | (F.col("label_idx") >= t.n_labels), 1)).alias("bad")).collect()
    sizes = {r["split"]: r for r in rows}
    for split, need in (("train", p.pool_num), ("test", p.test_num)):
        n = sizes[split]["n"] if split in sizes else 0
        if n < need:
            raise ValueError(f"{t.key}: {split} split has {n} rows, sample needs {need}")
    for r in rows:
        if r["bad"]:
            raise ValueError(f"{t.key}: {r['bad']} rows of the {r['split']} split have a class id without a label word")
        if r["ids"] != r["n"]:
            raise ValueError(f"{t.key}: doc_id is null or repeated in {r['n'] - r['ids']} rows of the {r['split']} split")
    return {split: r["n"] for split, r in sizes.items()}


def prepare(spark: SparkSession, sf_dir: str | None, p: Params, vocab: DataFrame | None = None, check: bool = True, *,
            labelled: DataFrame | None = None, task: Task | None = None, docs: DataFrame | None = None,
            like: Prepared | None = None, written: bool = False) -> Prepared:
    """Scan, label map and replicate samples with label words.

    A user's own data comes as ``labelled`` (``sources.labelled.read_labelled``) and ``task``
    (``sources.registry.custom_task``); ``docs`` defaults to its texts. Without them, ``sf_dir``
    and ``p.task`` name the driver tables' task shapes. ``like`` reuses the drawn sample and the
    fetched texts of an experiment that differs in its pattern only. ``written``: as
    ``shared.Written``, for experiments of many queries.
    """
    t = task or (like.task if like else get_task(p.task))
    if like:
        lab, docs = like.labelled, like.docs
    elif labelled is not None:
        lab, docs = labelled, docs if docs is not None else labelled.select("doc_id", "text")
    else:
        lab, docs = task_rows(spark, sf_dir, p.task), spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sizes = check_table(lab, t, p) if check and not like else None
    kind, _ = word_lists(t, p.pattern)
    if kind == "tokens" and vocab is None:
        vocab = corpus_vocab(docs)
    lmap = label_map(spark, t, p.pattern, p.repeats, p.seed, vocab=vocab)
    kept = Written() if written else []
    if written or kind == "tokens":     # R*L rows drawn from the corpus vocabulary, read by every later operator
        lmap = held(lmap, kept)
    # R*3T rows read by every later operator; a lost block is drawn again from the same keys
    drawn = like.drawn if like else held(sample_replicates(lab, p.test_num, p.repeats, p.seed, sizes=sizes, keep=kept), kept)
    prep = Prepared(p, t, lab, docs, lmap, step(verbalize(drawn, lmap), kept), drawn, kept)
    prep._texts = like._texts if like else None
    return prep


def doc_texts(prep: Prepared) -> DataFrame:
    """``(doc_id, text)`` of the distinct sampled documents (original texts).

    The documents table is scanned once per experiment. Up to ``BROADCAST_ROWS`` distinct
    sampled ids (R*3T at most) are broadcast and the documents stream past them, so the text
    column is not shuffled; beyond that Spark joins by its statistics. The matched rows are
    persisted for the later consumers (prompts, scorer, baseline). A null text is an error.
    """
    if prep._texts is None:
        ids = bounded_broadcast(prep.drawn.select("doc_id").distinct(), prep.sampled_rows)
        prep._texts = prep.keep(present(prep.docs.join(ids, "doc_id").select("doc_id", "text"), "text"))
    return prep._texts


def texts(prep: Prepared) -> DataFrame:
    """Sample rows with their text (memo patterns: the original label word; token pattern: the
    permuted text)."""
    if "memo_label" in prep.params.pattern:
        return memo_text(prep.sample, prep.lmap)
    if prep.params.pattern == "token":
        return permuted_texts(prep)
    return doc_texts(prep).join(bounded_broadcast(prep.sample, prep.sampled_rows), "doc_id")


def sample_texts(prep: Prepared, split: str) -> DataFrame:
    """Sample rows of one split with their text."""
    return texts(prep).filter(F.col("split") == split)


def demonstrations(prep: Prepared) -> DataFrame:
    test = prep.sample.filter(F.col("split") == "test")
    return draw_demos(test, prep.params.pool_num, prep.params.k, prep.params.seed)


def prompts(prep: Prepared) -> DataFrame:
    """``(rep, test_id, gold_word, prompt)`` for every test row of every replicate."""
    return build_prompts(sample_texts(prep, "test"), demonstrations(prep), sample_texts(prep, "train"),
                         prep.task.prompt_x, prep.task.prompt_y)


def gold(prep: Prepared) -> DataFrame:
    """``(rep, test_id, gold_idx)``: gold class looked up by word (first class with it)."""
    t = prep.sample.filter(F.col("split") == "test")
    m = merged_index(prep.lmap)
    return (t.join(F.broadcast(m), ["rep", "label_word"])
            .select("rep", F.col("doc_id").alias("test_id"), F.col("merged_idx").alias("gold_idx")))


def overlap_eval(prep: Prepared):
    """Stand-in scorer end to end: scores, predictions with gold rank, F1 per replicate."""
    test = prep.sample.filter(F.col("split") == "test")
    pool = prep.sample.filter(F.col("split") == "train")
    dd = demo_rows(demonstrations(prep), pool, ("doc_id", "label_word"))
    own = "memo_label" in prep.params.pattern or prep.params.pattern == "token"     # a text per replicate
    docs = texts(prep).select("rep", "doc_id", "text") if own else doc_texts(prep)
    scores = step(overlap_scores(test, dd, prep.lmap, docs, rows=prep.sampled_rows, keep=prep.kept), prep.kept)
    preds = step(predict_and_rank(scores, gold(prep), n_labels=prep.task.n_labels), prep.kept)
    f1 = macro_f1(preds)
    return scores, preds, f1


def prompting_report(prep: Prepared) -> DataFrame:
    _, preds, f1 = overlap_eval(prep)
    return replicate_summary(f1, preds)


# ---------------------------------------------------------------- linear baseline
def baseline_sets(prep: Prepared):
    """Fit set (coverage-resampled k train rows) and test set, labels as merged class ids."""
    if prep._sets is None:
        p = prep.params
        m = merged_index(prep.lmap)                                     # R*L rows
        s = prep.sample.join(F.broadcast(m), ["rep", "label_word"])
        pool = s.filter(F.col("split") == "train").select("rep", "pos", "doc_id",
                                                           F.col("merged_idx").alias("label_idx"))
        test = s.filter(F.col("split") == "test").select("rep", "doc_id", F.col("merged_idx").alias("y"))
        need = test.groupBy("rep").agg(F.countDistinct("y").alias("n_classes"))
        fit = coverage_sample(pool, p.k, need, p.seed).select("rep", "doc_id", F.col("label_idx").alias("y"), "attempt")
        # both sets are R*k and R*T rows and are read several times by the grid
        prep._sets = prep.keep(fit), prep.keep(test)
    return prep._sets


def linear_baseline(spark: SparkSession, prep: Prepared, tfidf: bool | None = None):
    """Grid F1 per replicate (240 rows each), best per replicate, and the mean of the bests."""
    from shotlab.operators.linear import grid_space, linear_grid
    from shotlab.operators.metrics import grid_best, mean0
    p = prep.params
    fit, test = baseline_sets(prep)
    grid = linear_grid(fit.select("rep", "doc_id", "y"), test, doc_texts(prep), grid_space(spark), p.k,
                       p.tfidf if tfidf is None else tfidf, p.seed, char_cap=p.char_cap, word_cap=p.word_cap,
                       stop_words=p.stop_words, rows=prep.sampled_rows, keep=prep.kept)
    grid = step(grid, prep.kept)
    best = grid_best(grid)
    summary = best.agg(mean0("best_f1").alias("linear_f1"), F.count("*").alias("n_reps"))
    return grid, best, summary


BASELINE_PATTERNS = ("none", "token", "label")


def experiment_report(spark: SparkSession, sf_dir: str | None, base: Params, patterns, linear: bool = True, **data) -> DataFrame:
    """One row per task pattern: stand-in scorer F1 and rank, random and (``linear``) fitted baselines.

    The baselines run only for none / token / label, as in the reference. The sample and its
    texts are drawn once for all patterns; ``data`` is passed to ``prepare``. Each summary is a
    query of its own over written samples, texts and predictions, and its row is written: no plan
    that the driver holds and reports grows with the patterns.
    """
    from shotlab.operators.linear import grid_space, random_predictions
    from shotlab.operators.metrics import grid_best, mean0
    parts, first = [], None
    settle = lambda summary, pat, *cols: parts.append(settled(summary.select(F.lit(pat).alias("pattern"), *cols), "report"))
    for pat in patterns:
        prep = prepare(spark, sf_dir, base.with_(pattern=pat), like=first, written=True, **({} if first else data))
        if first is None:
            first = prep
            doc_texts(first)
        settle(prompting_report(prep), pat, "mean_f1", "mean_rank", "n_prompts")
        if pat in BASELINE_PATTERNS:
            rnd = random_predictions(baseline_sets(prep)[1], grid_space(spark), base.seed)
            rf1 = grid_best(macro_f1(step(rnd, prep.kept), by=("rep", "c", "solver", "ngc_max", "ngw_max"), out="f1"))
            settle(rf1.agg(mean0("best_f1").alias("random_f1")), pat, "random_f1")
            if linear:
                settle(linear_baseline(spark, prep)[2], pat, "linear_f1")
        if prep is not first:
            prep.release()
    if first:
        first.release()
    # 1-row summaries per pattern: union, then one small aggregation (no joins between them)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    cols = ["mean_f1", "mean_rank", "n_prompts", "random_f1"] + ["linear_f1"] * linear
    for c in cols:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    return out.groupBy("pattern").agg(*[F.max(c).alias(c) for c in cols])


# ---------------------------------------------------------------- token pattern
def protected_tokens(prep: Prepared) -> DataFrame:
    """``(rep, token)``: tokens of the label words and of the template, line ends and
    punctuation included, are never remapped."""
    template = F.explode(F.concat(pieces(F.lit(prep.task.prompt_x)), pieces(F.lit(prep.task.prompt_y))))
    labels = prep.lmap.select("rep", F.explode(pieces(F.col("label_word"))).alias("token"))
    return labels.unionByName(prep.lmap.select("rep").distinct().select("rep", template.alias("token")))


def permuted_texts(prep: Prepared, token_map: DataFrame | None = None) -> DataFrame:
    """Token pattern: the sample rows with every unprotected token of their text replaced by its
    image under the replicate's vocabulary permutation.

    Joining the tokens of a text gives the text back, so prompts, the scorer and the model hook
    take the permuted texts as they take any others, and the inverse map restores them.
    """
    if token_map is not None or prep._permuted is None:
        p = prep.params
        rows = doc_texts(prep).join(bounded_broadcast(prep.sample, prep.sampled_rows), "doc_id")
        toks = rows.select("rep", "doc_id", pieces("text").alias("tokens"))
        m = token_map
        if m is None:
            # images of the tokens that occur, not of the whole vocabulary in every replicate
            vocab, n = indexed(corpus_vocab(prep.docs, pattern=PIECE_PATTERN), prep.kept)
            m = step(images(toks.select("rep", F.explode(F.array_distinct("tokens")).alias("token")).distinct(), vocab, n, p.seed), prep.kept)
        done = permute_tokens(toks, "tokens", m, protected_tokens(prep), "ptoks", key=("rep", "doc_id"))
        out = prep.keep(prep.sample.join(done.select("rep", "doc_id", F.array_join("ptoks", "").alias("text")), ["rep", "doc_id"]))
        if token_map is not None:
            return out
        prep._permuted = out
    return prep._permuted


def scoring_prompts(prep: Prepared) -> DataFrame:
    """What a model scores: ``(rep, test_id, gold_word, prompt)``; under the token pattern the
    demonstrations and the query are permuted, the template and label words are not."""
    return prompts(prep)
