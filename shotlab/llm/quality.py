"""Quality rules: word and line counts, repeated passages, and distribution divergence.

The divergence rule compares two histograms of a document with its language's reference,
by Jensen-Shannon distance (base 2, in 0..1): character classes, and common words of the
language with one bucket for all other words.  The references are pooled over all
documents of the language in the same run.  A rule only counts on texts that are long
enough for its histogram (``min_chars``, ``min_words``).  The limit of the word rule follows the
reference: it stays below the distance of a text without any common word.

All work is DataFrame expressions on one row at a time: arrays of word hashes inside the
row, no explode and no shuffle of words.  Counts and histograms are made in one pass over
the texts and written to the shared folder beside the columns the caller asked for.  The
references are one aggregate of that table with a row per known language and one for all
others, so they are broadcast by a fixed bound.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotlab.llm.common import written

SPACE = r"[\x20\x09-\x0D]+"
#: Punctuation and symbols at the edges of words; each run is tried once, from its start.
EDGES = r"(?:^|(?<=[\x20\x09-\x0D]))[\p{P}\p{S}]++|(?<![\p{P}\p{S}])[\p{P}\p{S}]++(?=[\x20\x09-\x0D]|$)"
GRAM = 5

#: Character classes as Java and RE2 patterns; all other characters form one more class.
CLASSES = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": r"0-9", "space": r"\x20\x09-\x0D", "stop": r".,;:!?'\"()-", "symbol": r"#*$%&|<>"}

#: Frequent function words of each language.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "was", "for", "with"],
    "fr": ["de", "la", "le", "et", "les", "des", "un", "une", "du", "en", "est", "que"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "ist", "nicht", "ein", "mit"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "con"],
}
OTHER = "*"


@dataclass(frozen=True)
class Limits:
    """Divergence above which a document is rejected, and the shortest texts each rule judges.

    The word rule's limit is ``none_share`` of the distance of a text without common words where
    that is below ``word_distance``, so such a text is rejected whatever the reference holds."""

    char_distance: float = 0.3
    word_distance: float = 0.3
    min_chars: int = 200
    min_words: int = 50
    none_share: float = 0.95


def known_lang(lang: Column) -> Column:
    """The language if it has a word list, else the pool of all others (null included)."""
    return F.when(lang.isin(*COMMON), lang).otherwise(F.lit(OTHER))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def class_counts(text: Column, rest: Column) -> Column:
    """array<double> of characters per class, all others last.  ``rest``: the text without its
    lower-case letters, which leaves little for the other classes to scan."""
    counts = [F.length(text) - F.length(rest)]
    for c in list(CLASSES.values())[1:]:
        counts.append(F.length(F.regexp_replace(rest, c.replace(r"\p", r"\P") + "+" if c.startswith(r"\p") else f"[^{c}]+", "")))
    return let(F.transform(F.array(*counts), lambda x: x.cast("double")), lambda a: F.concat(a, F.array(F.length(text) - total(a))))


def common_counts(words: Column, lang: Column, n_words: Column) -> Column:
    """array<double> of occurrences of the language's common words in ``words`` (lower case, without
    edge punctuation), all others of the ``n_words`` last; null for languages without a list."""
    def needle(i):
        out = F.lit(None).cast("string")
        for code, listed in COMMON.items():
            out = F.when(lang == code, F.lit(listed[i])).otherwise(out)
        return out

    counts = F.array(*[(F.size(words) - F.size(F.array_remove(words, needle(i)))).cast("double") for i in range(len(COMMON["en"]))])
    return F.when(lang.isin(*COMMON), let(counts, lambda a: F.concat(a, F.array(n_words - total(a)))))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts of equal length; 0 if either sums to 0."""
    def kl(a, m):
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    def share(a, t):
        return F.transform(a, lambda x: x / t)

    both = F.zip_with(share(p, F.nullif(total(p), F.lit(0.0))), share(q, F.nullif(total(q), F.lit(0.0))), lambda a, b: kl(a, (a + b) / 2) + kl(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.round(total(both) / 2, 12)))


def word_limit(reference: Column, limits: Limits) -> Column:
    """Largest word distance that is kept, from the pooled reference of the language."""
    none = F.array(*[F.lit(0.0)] * len(COMMON["en"]), F.lit(1.0))
    return F.least(F.lit(limits.word_distance), limits.none_share * F.nullif(js_distance(none, reference), F.lit(0.0)))


def histograms(docs: DataFrame) -> DataFrame:
    """``docs`` (with columns ``_text`` not null, ``_lang``) plus ``_words``, ``_chars``, ``_common``."""
    rows = docs.withColumn("_words", F.array_remove(F.split("_text", SPACE), "")).withColumn("_rest", F.regexp_replace("_text", CLASSES["lower"] + "+", ""))
    rows = rows.withColumn("_bare", F.split(F.regexp_replace(F.lower("_text"), EDGES, ""), SPACE))
    return rows.withColumn("_chars", class_counts(F.col("_text"), F.col("_rest"))).withColumn("_common", common_counts(F.col("_bare"), F.col("_lang"), F.size("_words")))


def references(rows: DataFrame) -> DataFrame:
    """(_lang, _ref_chars, _ref_common): histograms pooled over all documents of each known language."""
    def pooled(col, n):
        return F.array(*[F.sum(F.get(col, F.lit(i))) for i in range(n)])

    return rows.groupBy("_lang").agg(pooled("_chars", len(CLASSES) + 1).alias("_ref_chars"), pooled("_common", len(COMMON["en"]) + 1).alias("_ref_common"))


def repeated_words(rows: DataFrame) -> DataFrame:
    """Adds ``_n_words`` and ``_n_repeat``: words inside five-word windows that occur twice or
    more in ``_words``."""
    rows = rows.withColumn("_n_words", F.size("_words"))
    windows = F.transform(F.sequence(F.lit(1), F.col("_n_words") - (GRAM - 1)), lambda i: F.xxhash64(F.slice("_words", i, GRAM)))
    rows = rows.withColumn("_win", F.when(F.col("_n_words") >= GRAM, windows).otherwise(F.array().cast("array<bigint>")))
    twice = F.size(F.array_distinct("_win")) < F.size("_win")
    ordered = F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_ord", F.when(twice, ordered))
    starts = F.filter(F.transform("_ord", lambda s, i: F.when((s.h == F.get("_ord", i - 1).h) | (s.h == F.get("_ord", i + 1).h), s.i)), lambda x: x.isNotNull())
    rows = rows.withColumn("_at", F.sort_array(starts))
    covered = F.aggregate(F.transform("_at", lambda p, i: F.least(F.lit(GRAM), F.coalesce(F.get("_at", i + 1) - p, F.lit(GRAM)))), F.lit(0), lambda s, x: s + x)
    return rows.withColumn("_n_repeat", F.coalesce(covered, F.lit(0)))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def assess(docs: DataFrame, limits: Limits = Limits(), *, text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` as struct ``doc`` (all its columns, whatever their names, or those of
    ``carry``, which are written once beside the counts) plus the counts, ``char_distance``, ``word_distance``, ``base_failed`` and ``kept``.

    Base rules: fewer than 10 words, or over 20 % of the words inside repeated five-word
    windows.  Divergence rules: ``char_distance`` over the limit on texts of ``min_chars`` or
    more, ``word_distance`` over ``word_limit`` on texts of ``min_words`` or more.  A null text counts
    as empty (fails the base rule); a null or unlisted language shares one pooled character
    reference and has no word rule (``word_distance`` null).  Repeated rows are judged alike and
    kept alike; an empty table gives an empty result."""
    base = docs.select(F.struct(*[docs[c] for c in carry or docs.columns]).alias("doc"), F.coalesce(docs[text_col], F.lit("")).alias("_text"), known_lang(docs[lang_col]).alias("_lang"))
    rows = repeated_words(histograms(base)).withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    classes = list(CLASSES)
    count = lambda c: F.get("_chars", F.lit(classes.index(c))).cast("long")
    rows = written(rows.select(
        "doc", "_lang", "_chars", "_common", F.length("_text").alias("_length"), F.col("_n_words").cast("long").alias("n_words"),
        (F.length("_text") - count("space")).alias("word_chars"), count("symbol").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.col("_n_repeat").cast("long").alias("n_repeat_words")), "counts")
    rows = rows.join(F.broadcast(references(rows)), "_lang", "left")
    far_chars, far_words = js_distance(F.col("_chars"), F.col("_ref_chars")), js_distance(F.col("_common"), F.col("_ref_common"))
    out = rows.select("doc", *COUNTS, F.when(F.col("_length") >= limits.min_chars, far_chars).alias("char_distance"),
                      F.when(F.col("n_words") >= limits.min_words, far_words).alias("word_distance"), word_limit(F.col("_ref_common"), limits).alias("word_limit"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    fits = (F.coalesce("char_distance", F.lit(0.0)) <= limits.char_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= F.col("word_limit"))
    return out.withColumn("kept", ~F.col("base_failed") & fits)


def keep_good(docs: DataFrame, limits: Limits = Limits(), **cols) -> DataFrame:
    """Rows of ``docs`` that pass every rule, columns unchanged."""
    return assess(docs, limits, **cols).where("kept").select("doc.*")
