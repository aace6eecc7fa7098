import random

import numpy as np
import pandas as pd
import xxhash

from shotlab.llm import common, simhash
from shotlab.llm.components import components, forest
from tests.conftest import SF01
from tests.llm import data


def brute_fp(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=4):
    near = [[bin(a ^ b).count("1") <= radius for b in fps] for a in fps]
    comp = list(range(len(ids)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if near[i][j]:
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    roots = [find(i) for i in range(len(ids))]
    return [min((ids[j] for j in range(len(ids)) if roots[j] == r and ids[j] is not None), default=None) for r in roots]


def test_edge_cases_against_brute_force(spark):
    docs = [r for r in data.rows() if r[0] != 7]
    fps = [brute_fp(r[1]) for r in docs]
    want = sorted((str(r[0]), f"{f:016x}", str(c)) for r, f, c in zip(docs, fps, brute_components([r[0] for r in docs], fps)))
    got = sorted((str(r[0]), r[1], str(r[2])) for r in simhash.report(data.docs(spark, docs)).collect())
    assert got == want
    assert simhash.report(data.empty(spark)).count() == 0


def test_whole_table_against_brute_force(spark):
    d = common.table(spark, SF01, "documents")
    pdf = d.select("doc_id", "text").toPandas()
    fps = np.array([brute_fp(t) for t in pdf.text.head(300)], np.uint64)
    got = simhash.report(d).toPandas().set_index("doc_id")
    assert [f"{f:016x}" for f in fps.tolist()] == got.loc[pdf.doc_id.head(300)].fingerprint.tolist()
    every = np.array([int(got.fingerprint[i], 16) for i in pdf.doc_id], np.uint64)
    near = np.bitwise_count(every[:, None] ^ every[None, :]) <= 4
    a, b = np.nonzero(near)
    roots = forest(len(every), (a, b))
    ids = pdf.doc_id.to_numpy()
    low = pd.Series(ids).groupby(roots).transform("min")
    assert low.tolist() == [got.component_id[i] for i in ids]


def test_split_shards_lose_no_link(spark):
    rnd = random.Random(1)
    core = [rnd.getrandbits(64) for _ in range(5)]
    fps = {c for c in core}
    for c in core:
        for _ in range(60):
            x = c
            for b in rnd.sample(range(64), rnd.choice([1, 2, 3, 4, 6])):
                x ^= 1 << b
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64)}))
    got = {r.node: r.root for r in components(simhash.links(df, 4, tree_size=40, bucket_rows=100)).collect()}
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    roots = forest(len(fps), (a, b))
    names = [got.get(int(f), int(f)) for f in fps.view(np.int64)]
    assert len(set(zip(names, roots.tolist()))) == len(set(names)) == len(set(roots.tolist()))


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(5, 5), (None, 3)]
    got = dict(components(spark.createDataFrame(path, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(spark):
    kept = simhash.keep_one(data.docs(spark))
    assert kept.columns == data.docs(spark).columns
    comp = {r.doc_id: r.component_id for r in simhash.report(data.docs(spark)).collect()}
    want = sorted([i for i, c in comp.items() if i is not None and i == c])
    got = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in got if i is not None) == want and got.count(None) == 1
