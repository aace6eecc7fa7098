"""Counting of grams in runs: against plain Python, at any run size, with repeated keys and long texts."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotlab.operators import gramcounts as G
from shotlab.operators.features import corpus_grams, doc_grams

TEXTS = [("a", "xyz xyz a"), ("b", ""), ("b", "q \U0001f600 q\x00\x00"), ("c", "long " * 40), ("c", "tail"), (None, "n n"), (None, "n")]


def plain(rows, ngc, ngw):
    out = {}
    for key, text, toks, *_ in rows:
        c = out.setdefault(key, Counter())
        c.update(("char", n, text[i:i + n]) for n in range(1, ngc + 1) for i in range(len(text) - n + 1))
        t = toks.split(" ") if toks else []
        c.update(("word", n, " ".join(t[i:i + n])) for n in range(1, ngw + 1) for i in range(len(t) - n + 1))
    return out


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("ngc, ngw", [(4, 2), (0, 3), (6, 0)])
def test_runs_against_plain_counts(monkeypatch, size, ngc, ngw):
    import pyarrow as pa
    monkeypatch.setattr(G, "RUN", size)
    monkeypatch.setattr(G, "TOKEN", 1)
    rows = [(k, t, " ".join(t.split()), i) for i, (k, t) in enumerate(TEXTS)]
    cols = list(zip(*rows))
    batches = pa.table({"k": cols[0], "c": cols[1], "t": cols[2], "i": cols[3]}).to_batches(max_chunksize=2)
    want = plain(rows, ngc, ngw)
    got, seen, corpus = {}, [], Counter()
    for keys, others, counts in G.runs(batches, 1, ngc, ngw, True):
        seen += [(keys[o][0], i) for o, (i,) in others]
        for block, n, term, whose, cnt, df in counts:
            for t, o, c in zip(term.to_pylist(), whose, cnt):
                got.setdefault(keys[o][0], Counter())[block, n, t] += int(c)
    assert {k: c for k, c in got.items() if c} == {k: c for k, c in want.items() if c}
    assert sorted(seen, key=lambda r: r[1]) == [(r[0], r[3]) for r in rows]
    docs = Counter()
    for _, _, counts in G.runs(batches, 1, ngc, ngw, False):
        for block, n, term, _, cnt, df in counts:
            for t, c, d in zip(term.to_pylist(), cnt, df):
                corpus[block, n, t] += int(c)
                docs[block, n, t] += int(d)
    assert corpus == sum(want.values(), Counter()) and docs == Counter(g for c in want.values() for g in c)


def test_many_different_characters_are_ranked():
    ids = np.arange(1 << 16) % 60000
    for by_doc in (True, False):
        for n, parts, _, cnt, df in G.numbered_grams(ids, 1 << 20, np.array([len(ids)]), np.array([len(ids)]), np.zeros(1, int), 5, by_doc):
            assert cnt.sum() == len(ids) - n + 1 and len(parts) == 60000 and (df == 1).all()
            assert {tuple(p) for p in parts.tolist()} == {tuple((np.arange(i, i + n) % 60000).tolist()) if i + n <= 60000 else tuple(ids[i:i + n].tolist()) for i in range(60000)}


def test_a_task_makes_no_row_per_gram(spark):
    """The grams of a document are counted before any row is made or exchanged."""
    docs = spark.createDataFrame([(i, "the same few words " * 50) for i in range(40)], "doc_id long, text string")
    plan = corpus_grams(docs, 4, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    assert "Generate" not in doc_grams(docs, 4, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert corpus_grams(docs, 1, 0).agg(F.max("df")).first()[0] == 40
