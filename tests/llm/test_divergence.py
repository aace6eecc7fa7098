"""The divergence audit against plain Python, and the joint walk against all cells."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from shotlab.llm import divergence
from tests.llm.data import DOCS, docs, empty, rows

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(table, min_docs=3, top=200):
    lower = str.maketrans(divergence.UPPER, divergence.LOWER)
    docs_, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in table:
        lang, source = lang or "", source or ""
        words = TERM.findall((text or "").translate(lower))
        groups[lang].add(source)
        docs_[lang].update(set(words))
        n[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in docs_[lang].items() if k >= min_docs]
        both = Counter({t: sum(n[lang, s][t] for s in sources) for t in kept})

        def shares(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10 ** 9 * (c[t] + 1) // total for t in kept}

        p, q = {s: shares(n[lang, s]) for s in sources}, shares(both)
        for s in sources:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            term = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, r) for r, (v, item) in enumerate(found[:limit], 1)]
    return sorted(out)


def run(df, **options):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.audit(df, **options).collect())


def table(n=160, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        lang, source = ["en", "de", None, "x"][rng.integers(4)], [f"s{k}" for k in range(6)] + [None]
        words = [f"W{int(w)}é" if w % 3 else f"word{int(w)}" for w in rng.zipf(1.5, rng.integers(0, 60)) if w < 400]
        out.append((i, " ".join(words).replace("W", rng.choice(["W", "w"])) if i % 11 else None, lang, source[min(6, int(rng.zipf(1.6)) - 1)], 0, "k", 1))
    return out


def test_against_plain_python(spark):
    t = table()
    assert run(spark.createDataFrame(t, DOCS).repartition(5)) == brute(t)


def test_slabs_blocks_and_limits(spark):
    """Several slabs and blocks of sources give the same rows."""
    t = table(200, 8)
    assert run(spark.createDataFrame(t, DOCS), top=3, slab_cells=40, block_rows=4) == brute(t, top=3)


def test_odd_rows_and_empty_table(spark):
    assert run(docs(spark)) == brute(rows())
    assert run(docs(spark), min_docs=1) == brute(rows(), min_docs=1)
    assert run(empty(spark)) == []


def test_language_without_kept_terms(spark):
    t = [(1, "a b", "en", "s1", 0, "", 0), (2, "c", "en", "s2", 0, "", 0), (3, None, "en", None, 0, "", 0)]
    got = run(spark.createDataFrame(t, DOCS))
    assert got == brute(t) and {r[4] for r in got} == {0} and len(got) == 6


@pytest.mark.parametrize("n_a,n_b,n_cols,filled", [(1, 1, 1, 1.0), (3, 11, 70, 0.05), (20, 9, 300, 0.01), (9, 9, 17, 0.9), (5, 4, 100, 0.0), (4, 4, 0, 0.0)])
def test_joint_walk_equals_all_cells(n_a, n_b, n_cols, filled):
    rng = np.random.default_rng(n_a * 100 + n_cols)
    height = max(0, (max(n_cols, n_a, n_b) - 1).bit_length() - divergence.LEAF)
    full, trees = [], []
    for n in (n_a, n_b):
        zero = rng.integers(1, 50, n)
        m = np.repeat(zero[:, None], n_cols, axis=1)
        r, c = np.nonzero(rng.random((n, n_cols)) < filled)
        m[r, c] = rng.integers(50, 10 ** 9, len(r))
        full.append(m)
        trees.append(divergence.Tree(r, c, m[r, c], zero, height))
    want = ((full[0][:, None] - full[1][None]) ** 2 // full[1][None]).sum(axis=2)
    assert (divergence.joint_sums(*trees, n_cols, height)[:n_a, :n_b] == want).all()


def test_share_is_exact_beyond_doubles(spark):
    from pyspark.sql import functions as F

    pairs = [(1, 3), (999_999_999, 1_000_000_007), (10 ** 14 + 1, 8 * 10 ** 15), (5, 5), (8 * 10 ** 15 - 1, 8 * 10 ** 15)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", divergence.share(F.col("a"), F.col("b")).alias("p")).collect()
    assert all(r["p"] == 1 + 10 ** 9 * r["a"] // r["b"] for r in got)
