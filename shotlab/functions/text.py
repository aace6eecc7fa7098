"""Text column functions: normalisation, tokenisation, n-grams, weights.

All of them are built-in Spark expressions (regex, ``translate``,
higher-order array functions), so they stay inside whole-stage codegen and
never leave the JVM.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from shotlab.functions.stopwords import ENGLISH

# Unicode word characters: letters, digits, underscore. Java's and RE2's ``\w``
# are ASCII-only, so the classes are spelled out.
WORD_PATTERN = r"[\p{L}\p{N}_]+"
WHITESPACE_RUN = r"\s\s+"
# Prompt tokens: a word or one other character, with the space before it, or one white-space
# character. Every character belongs to a token, so joining the tokens gives the text back.
PIECE_PATTERN = r" ?[\p{L}\p{N}_]+| ?[^\p{L}\p{N}_\x09-\x0D\x20]|[\x09-\x0D\x20]"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# A noncharacter that stands for "this character has an image of several characters".
MANY = "\uffff"


@lru_cache(maxsize=1)
def _accent_tables() -> tuple[str, str, tuple[tuple[str, str], ...], str]:
    """Accent-stripping tables generated from ``unicodedata`` over all code points (NFKD,
    combining marks dropped).

    Source and image characters for ``translate`` — characters with several images go to
    ``MANY``, those beyond the images are deleted —, the one-to-many images (Hangul syllables
    left out: theirs follow from their number), and a class of a few ranges that holds them."""
    one, deleted, multi = {}, [], {}
    for cp in [*range(0xA0, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x110000)]:
        ch = chr(cp)
        img = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if img == ch:
            continue
        if len(img) == 1:
            one[ch] = img
        elif img:
            multi[ch] = img
        else:
            deleted.append(ch)
    several = [*multi, *map(chr, range(HANGUL_FIRST, 0xD7A4))]
    ranges: list[list[int]] = []
    for cp in sorted(map(ord, several)):
        if ranges and cp - ranges[-1][1] <= 256:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    coarse = "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges)
    return "".join([*one, *several, *deleted]), "".join(one.values()) + MANY * len(several), tuple(multi.items()), coarse


# Fixed values of the Unicode standard: Hangul syllables are numbered by lead, vowel, trail.
HANGUL_FIRST, HANGUL_VOWELS, HANGUL_TRAILS = 0xAC00, 21, 28
HANGUL_LEAD, HANGUL_VOWEL, HANGUL_TRAIL = 0x1100, 0x1161, 0x11A7


def _hangul(c: Column) -> Column:
    """The jamo of one Hangul syllable."""
    def jamo(first, n, i):
        return F.substring(F.lit("".join(chr(first + k) for k in range(n))), i.cast("int") + 1, F.lit(1))

    n = F.ascii(c) - HANGUL_FIRST
    per = HANGUL_VOWELS * HANGUL_TRAILS
    trail = F.pmod(n, F.lit(HANGUL_TRAILS))
    return F.concat(jamo(HANGUL_LEAD, 19, F.floor(n / per)), jamo(HANGUL_VOWEL, HANGUL_VOWELS, F.floor(F.pmod(n, F.lit(per)) / HANGUL_TRAILS)),
                    F.when(trail > 0, jamo(HANGUL_TRAIL, HANGUL_TRAILS, trail)).otherwise(F.lit("")))


def strip_accents(col) -> Column:
    """NFKD without combining marks, for all of Unicode.

    One ``translate`` does most texts, and pure-ASCII ones skip it. Only texts in which it
    meets a character with a longer image are taken apart at such characters first."""
    src, dst, multi, coarse = _accent_tables()
    s = _c(col)
    images = F.create_map(*[F.lit(x) for pair in multi for x in pair])
    parts = F.regexp_extract_all(s, F.lit(f"(?s)[{coarse}]|[^{coarse}]+"), 0)
    expanded = F.array_join(F.transform(parts, lambda c: F.when(c.rlike("^[\uac00-\ud7a3]"), _hangul(c)).when(
        c.rlike(f"^[{coarse}]"), F.coalesce(F.element_at(images, c), c)).otherwise(c)), "")
    plain = F.translate(s, src, dst)
    return F.when(~s.rlike("[^\\x00-\\x7F]"), s).when(~F.contains(plain, F.lit(MANY)), plain).otherwise(F.translate(expanded, src, dst))


def normalize_text(col) -> Column:
    """Lower-case, then strip accents (the vectoriser's preprocessing order)."""
    return strip_accents(F.lower(_c(col)))


def tokenize(col) -> Column:
    """Word tokens (Unicode ``\\w+``) of an already normalised string."""
    return F.regexp_extract_all(_c(col), F.lit(WORD_PATTERN), 0)


def pieces(col, pattern: str = PIECE_PATTERN) -> Column:
    """All matches of a token pattern, in order."""
    return F.regexp_extract_all(_c(col), F.lit(pattern), 0)


def drop_stop_words(tokens, words=ENGLISH) -> Column:
    """Remove stop words, keeping order and repeats.

    ``isin`` over many literals is planned as a hash-set lookup (``InSet``),
    not a scan of the list per token.
    """
    words = list(words)
    return F.filter(_c(tokens), lambda t: ~t.isin(words))


def token_set(text) -> Column:
    """Distinct normalised word tokens of a text."""
    return F.array_distinct(tokenize(normalize_text(text)))


def split_words(col) -> Column:
    """Split on a single space; empty strings are kept (``str.split(" ")``)."""
    return F.split(_c(col), " ")


def split_chars(col) -> Column:
    """Characters of a string (empty string gives an empty array)."""
    return F.filter(F.split(_c(col), ""), lambda c: c != F.lit(""))


def collapse_spaces(col) -> Column:
    """Runs of two or more whitespace characters become one space."""
    return F.regexp_replace(_c(col), WHITESPACE_RUN, " ")


def word_ngrams_col(tokens, n: int) -> Column:
    """Word n-grams of exactly ``n`` tokens, joined by one space."""
    t = _c(tokens)
    grams = F.transform(F.sequence(F.lit(1), F.size(t) - F.lit(n - 1)),
                        lambda i: F.array_join(F.slice(t, i, n), " "))
    # sequence(1, 0) would count down: guard short inputs.
    return F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>"))


def char_ngrams_col(text, n: int) -> Column:
    """Character n-grams of exactly ``n`` code points, across word borders.

    One regex pass: a zero-width lookahead at every position captures the next
    n characters, so the cost is linear in the text (``substring`` by code
    point would rescan the string at every position).
    """
    return F.regexp_extract_all(_c(text), F.lit("(?s)(?=(.{%d}))" % n), 1)


def rejoin(tokens) -> Column:
    return F.array_join(_c(tokens), " ")


def coarsen(label, by: float = 1.5) -> Column:
    """Floor division of class ids (5 classes -> 3: 0,1,2,3,4 -> 0,0,1,2,2)."""
    return F.floor(_c(label) / F.lit(by)).cast("int")


def sublinear_tf(count) -> Column:
    return F.lit(1.0) + F.log(_c(count).cast("double"))


def smooth_idf(n_docs, df) -> Column:
    return F.log((F.lit(1.0) + _c(n_docs)) / (F.lit(1.0) + _c(df))) + F.lit(1.0)
