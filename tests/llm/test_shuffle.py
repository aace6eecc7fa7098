"""The external shuffle: shards, slots, independence of layout, uniformity."""

import zlib
from collections import Counter

import numpy as np

from shotlab.llm import shuffle
from tests.llm.data import DOCS, docs, empty, rows


def collected(df):
    return sorted(((r["shard"], r["slot"], r["doc_id"], r["size"], r["text_crc32"]) for r in df.collect()), key=lambda r: r[:2])


def check_shards(got, n, shards):
    sizes = Counter(r[0] for r in got)
    assert sum(sizes.values()) == n and max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    for s in sizes:
        assert [r[1] for r in got if r[0] == s] == list(range(sizes[s]))


def test_every_row_once_whatever_the_layout(spark):
    got = collected(shuffle.report(docs(spark), bucket_bytes=5000))
    check_shards(got, len(rows()), 16)
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert Counter(r[2:] for r in got) == want
    assert got == collected(shuffle.report(docs(spark).repartition(7), bucket_bytes=5000))
    assert got != collected(shuffle.report(docs(spark), bucket_bytes=5000, seed=1))


def test_many_identical_rows_are_split_over_buckets(spark):
    many = [rows()[0]] * 3000 + rows()
    d = spark.createDataFrame(many, DOCS).repartition(4)
    light, hot, n, buckets = shuffle.look(d, "text", 0, 20_000)
    assert hot.count() == 1 and n == len(many) and buckets > 30
    per = shuffle.scattered(light, hot, ["_size"]).groupBy(shuffle.bucket(buckets).alias("b")).sum("_n").collect()
    assert max(r[1] for r in per) < 4 * n / buckets
    got = collected(shuffle.report(d, bucket_bytes=20_000, shards=5))
    check_shards(got, len(many), 5)
    assert Counter(r[2] for r in got) == Counter(r[0] for r in many)


def test_copies_in_runs(spark, monkeypatch):
    monkeypatch.setattr(shuffle, "RUN", 10)
    out = shuffle.copies(spark.createDataFrame([(1, 25), (2, 10), (3, 1)], "id int, n long"), "n").collect()
    assert sorted((r["id"], r["_copy"]) for r in out) == [(i, c) for i, n in ((1, 25), (2, 10), (3, 1)) for c in range(n)]


def test_columns_of_any_name_are_kept(spark):
    d = spark.createDataFrame([(i, f"t{i}", i, {"k": i}) for i in range(40)], "slot long, text string, shard int, _h map<string,int>")
    got = shuffle.shuffled(d, shards=3).collect()
    assert sorted(r["doc"]["slot"] for r in got) == list(range(40)) and {r["doc"]["_h"]["k"] for r in got} == set(range(40))


def test_empty_and_few(spark):
    assert shuffle.report(empty(spark)).collect() == []
    got = collected(shuffle.report(docs(spark, rows()[:3])))
    assert sorted(r[:2] for r in got) == [(0, 0), (1, 0), (2, 0)]


def test_uniform_over_shards_and_places(spark):
    """Chi-square of (input order third, shard third) over many seeds, and of neighbours kept together."""
    d = spark.createDataFrame([(i, "same text") for i in range(3000)], "doc_id long, text string")
    got = collected(shuffle.report(d, bucket_bytes=6000, shards=3))
    table = Counter((r[2] // 1000, r[0]) for r in got)
    chi = sum((table[a, b] - 1000 / 3) ** 2 / (1000 / 3) for a in range(3) for b in range(3))
    assert chi < 18.5          # 4 degrees of freedom, 0.999
    order = [r[2] for r in got]
    assert sum(b - a == 1 for a, b in zip(order, order[1:])) < 12
    assert abs(np.corrcoef(order, range(3000))[0, 1]) < 0.07


def test_shard_of_is_at_most_one_apart():
    for n in (0, 1, 5, 16, 17, 100):
        shard, slot = shuffle.shard_of(np.arange(n), n, 16)
        sizes = Counter(shard.tolist())
        assert max(sizes.values(), default=0) - min((sizes.get(s, 0) for s in range(16)), default=0) <= 1
        assert all(sorted(slot[shard == s]) == list(range(c)) for s, c in sizes.items())
