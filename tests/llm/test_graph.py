import numpy as np

from shotlab.llm import common, graph
from shotlab.llm.components import forest
from tests.conftest import SF01

SCHEMA = "vec_id long, embedding array<float>, label int, cid string, n int, near string"


def brute(rows, cosine=0.93):
    ok = [r[2] is not None and r[0] is not None and r[1] is not None and len(r[1]) > 0 and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1]) for r in rows]
    unit = [np.asarray(r[1], np.float32).astype(np.float64) / np.linalg.norm(np.asarray(r[1], np.float32).astype(np.float64)) if o else None for r, o in zip(rows, ok)]
    n, pairs = len(rows), []
    links = [0] * n
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                pairs.append((i, j))
    roots = forest(n, tuple(np.array(pairs, np.int64).reshape(-1, 2).T))
    comp = [min((rows[j][0] for j in range(n) if roots[j] == roots[i] and rows[j][0] is not None), default=None) for i in range(n)]
    return sorted(((r[0], k, c, r[0] == c) for r, k, c in zip(rows, links, comp)), key=str)


def make(seed, groups, size, dim=24, spread=0.12):
    rnd = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        c = rnd.normal(size=dim)
        c /= np.linalg.norm(c)
        for _ in range(size if g else 4 * size):
            out.append((c + spread * rnd.normal(size=dim) / np.sqrt(dim) * rnd.choice([0.1, 1, 2.5])).tolist())
    return out


def test_edge_cases(spark):
    a = [0.6, 0.8, 0.0]
    rows = [(3, a, 1), (7, a, 1), (7, a, 1), (5, [1.2, 1.6, 0.0], 1), (9, a, 2), (10, a, None), (None, a, 1), (11, None, 1), (12, [0.0, 0.0, 0.0], 1), (13, [0.6, None, 0.0], 1),
            (14, [float("nan"), 0.8, 0.0], 1), (15, [float("inf"), 0.0, 0.0], 1), (16, [0.6, 0.8], 1), (17, [], 1), (18, [-0.0, 0.0, 1.0], 1), (19, [0.0, 0.0, 1.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in graph.near_vectors(df).collect() if r[0] is not None), key=str)
    assert got == [r for r in brute(rows) if r[0] is not None]
    assert [tuple(r) for r in graph.near_vectors(df).where("vec_id is null").collect()] == [(None, 0, None, True)]
    assert graph.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shards_and_blocks_equal_brute_force(spark):
    vecs = make(1, 12, 25)
    rows = [(100 + i, v, i % 2) for i, v in enumerate(vecs)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    want = brute(rows)
    assert sum(r[1] for r in want) > 1000
    for options in ({}, {"shard_rows": 60, "overlap": 3}, {"block": 40}, {"shard_rows": 60, "overlap": 3, "block": 30}):
        assert sorted(map(tuple, graph.near_vectors(df, **options).collect()), key=str) == want, options


def test_whole_table(spark):
    e = common.table(spark, SF01, "embeddings")
    rows = [tuple(r) for r in e.select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, graph.near_vectors(e).collect()), key=str) == brute(rows)


def test_search_reaches_every_link_of_a_shard():
    x = graph.units(make(2, 6, 60))
    for alpha in (1.05, 1.2, 1.6):
        lists = graph.prune(x, np.sqrt(2 - 2 * 0.93), alpha, 8, pool=16)
        got = {(int(a), int(b)) for q, f in graph.range_search(x, lists, 0, 0.93, alpha, queries=50) for a, b in zip(q, f)}
        a, b = np.nonzero(np.einsum("ik,jk->ij", x, x) >= 0.93)
        assert got == {(int(i), int(j)) for i, j in zip(a, b) if i != j}
