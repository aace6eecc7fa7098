"""Vector codes against plain Python integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import types as T

from shotlab.llm import codes

VECS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.StringType()), T.StructField("code", T.IntegerType()), T.StructField("error", T.StringType())])


def brute(rows, parts=16, entries=64, rounds=2):
    good = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not good:
        return [], None
    w = len(good[0][1]) // parts
    cut = lambda v, p: v[p * w:(p + 1) * w]
    books = [[cut(v, p) for _, v, _ in good[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            got = {}
            for _, v, _ in good:
                got.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            new.append([[sum(c) // len(got[k]) for c in zip(*got[k])] if k in got else e for k, e in enumerate(books[p])])
        books = new
    out = []
    for i, v, lab in good:
        hits = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append([i, lab, "".join(f"{k:02x}" for _, k in hits), sum(d for d, _ in hits)])
    total = {}
    for r in out:
        total[r[1]] = total.get(r[1], 0) + r[3]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, lab, c, e, total[lab], sha) for i, lab, c, e in out), key=str), sha


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(i, v, lab, 7, "x") for i, v, lab in rows], VECS).repartition(parts)
    return sorted((tuple(r) for r in codes.report(df).collect()), key=str)


def cases():
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(size=32).round(2).tolist(), ["a", "b", None][i % 3] if i % 5 else "a") for i in range(150)]
    rows += [(7, rows[7][1], "a"), (None, rows[9][1], None), (900, None, "a"), (901, [None] * 32, "b"), (902, [float("nan")] + [0.0] * 31, "b"), (903, [float("inf")] * 32, "b"), (904, [-0.001] * 32, "c")]
    return rows


def test_report_against_plain_python(spark):
    assert run(spark, cases()) == brute(cases())[0]


def test_fewer_vectors_than_entries_and_ties(spark):
    rows = [(i, [float(i // 2)] * 16, "t") for i in range(6)]
    got = run(spark, rows, 2)
    assert got == brute(rows)[0]
    assert {r[2] for r in got} == {f"{k:02x}" * 16 for k in (0, 2, 4)}       # of equal entries the lower index


def test_many_labels_and_a_hot_one(spark):
    """Labels beyond the broadcast ones, and one that holds most vectors."""
    rows = [(i, [float(i % 7)] * 16, "hot" if i % 2 else f"l{i}") for i in range(2600)]
    got = run(spark, rows)
    assert got == brute(rows)[0]


def test_empty_and_bad_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, "a")]) == []
    with pytest.raises(Exception, match="16 divides"):
        run(spark, [(1, [0.0] * 15, "a")])
    with pytest.raises(Exception, match="one length"):
        run(spark, [(1, [0.0] * 16, "a"), (2, [0.0] * 32, "a")], 1)
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, [1e12] * 16, "a")], 1)


def test_part_distances_are_gathers_from_the_tables():
    rng = np.random.default_rng(0)
    ints = rng.integers(-300, 300, (500, 32))
    words, at = codes.dictionaries(ints)
    assert all((w[at[:, d]] == ints[:, d]).all() for d, w in enumerate(words))
    books = codes.Codebooks(rng.integers(-300, 300, (9, 32)))
    far = codes.part_distances(words, at, books)
    want = ((ints[:, None, :] - books.values[None]) ** 2).reshape(500, 9, 16, 2).sum(axis=3).transpose(2, 0, 1)
    assert (far == want).all()
