"""Experiment parameters (defaults follow the reference's command line)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from shotlab.functions.stopwords import ENGLISH


@dataclass(frozen=True)
class Params:
    seed: int = 42          # root seed of every hash key
    k: int = 32             # demonstrations per prompt / rows in the baseline train set
    test_num: int = 256     # T: test rows per replicate; the train pool is 2T
    repeats: int = 20       # R: replicates
    task: str = "SetFit/sst2"
    pattern: str = "none"   # none / token / label / memo_label_{rand,kw,syn,ant}
    tfidf: bool = False     # TF-IDF features instead of counts for the baseline
    char_cap: int = 50_000  # baseline vocabulary: char n-grams kept per replicate and range
    word_cap: int = 10_000  # baseline vocabulary: word n-grams kept per replicate and range
    stop_words: tuple[str, ...] = tuple(ENGLISH)   # dropped by the baseline's word analyser

    def __post_init__(self):
        if self.repeats < 1 or self.test_num < 1 or self.k < 0 or self.k > self.pool_num:
            raise ValueError(f"need repeats >= 1, test_num >= 1 and 0 <= k <= {self.pool_num}: {self}")

    @property
    def pool_num(self) -> int:
        return 2 * self.test_num

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


# Small parameters used by the correctness queries.
CHECK = Params(k=8, test_num=16, repeats=3)
