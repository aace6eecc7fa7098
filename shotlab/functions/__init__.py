"""Column-level functions (all JVM-side ``pyspark.sql.functions`` expressions)."""

from shotlab.functions.hashing import hkey, hnum, hfrac
from shotlab.functions.text import (
    normalize_text, tokenize, drop_stop_words, split_words, split_chars,
    word_ngrams_col, char_ngrams_col, collapse_spaces, rejoin, coarsen,
    sublinear_tf, smooth_idf, token_set,
)

__all__ = [
    "hkey", "hnum", "hfrac", "normalize_text", "tokenize", "drop_stop_words",
    "split_words", "split_chars", "word_ngrams_col", "char_ngrams_col",
    "collapse_spaces", "rejoin", "coarsen", "sublinear_tf", "smooth_idf", "token_set",
]
