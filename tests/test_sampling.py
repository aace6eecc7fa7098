from pyspark.sql import functions as F

from shotlab.operators.linear import grid_space
from shotlab.operators.sampling import draw_demos, pick_tokens, sample_k
from shotlab.operators.vocab import dense_index, permutation, permute_tokens
from tests.conftest import SF


def _base(spark, n=500):
    return spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("int").alias("label_idx"))


def test_sample_k_exact_distinct(spark):
    s = sample_k(_base(spark), 7, 4, 42, "t")
    per = {r["rep"]: (r["n"], r["d"]) for r in s.groupBy("rep").agg(F.count("*").alias("n"),
                                                                  F.countDistinct("doc_id").alias("d")).collect()}
    assert per == {r: (7, 7) for r in range(4)}
    assert sorted(r["pos"] for r in s.filter("rep = 0").collect()) == list(range(7))


def test_sample_independent_of_partitioning(spark):
    a = sample_k(_base(spark).repartition(1), 9, 3, 42, "t").collect()
    b = sample_k(_base(spark).repartition(7, "label_idx"), 9, 3, 42, "t").collect()
    assert sorted(a) == sorted(b)


def test_floyd_draws_distinct_in_range(spark):
    test = spark.range(50).select(F.lit(0).alias("rep"), F.col("id").alias("doc_id"))
    d = draw_demos(test, 40, 32, 42)
    g = d.groupBy("test_id").agg(F.countDistinct("train_pos").alias("n"), F.min("train_pos").alias("lo"),
                                 F.max("train_pos").alias("hi"), F.countDistinct("ord").alias("o")).collect()
    assert all(r["n"] == 32 and r["o"] == 32 and r["lo"] >= 0 and r["hi"] < 40 for r in g)


def test_floyd_full_draw_is_permutation(spark):
    test = spark.range(5).select(F.lit(0).alias("rep"), F.col("id").alias("doc_id"))
    d = draw_demos(test, 6, 6, 1)
    for r in d.groupBy("test_id").agg(F.sort_array(F.collect_list("train_pos")).alias("p")).collect():
        assert r["p"] == list(range(6))


def test_dense_index_is_dense(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.hex(F.col("id") * 7919).alias("k")).repartition(5)
    out = dense_index(df, ["g"], [F.col("k")], "idx")
    for r in out.groupBy("g").agg(F.min("idx").alias("a"), F.max("idx").alias("b"), F.count("*").alias("n"),
                                  F.countDistinct("idx").alias("d")).collect():
        assert r["a"] == 0 and r["b"] == r["n"] - 1 and r["d"] == r["n"]
    w = out.filter("g = 1").orderBy("idx").collect()
    assert [x["k"] for x in w] == sorted(x["k"] for x in w)


def test_permutation_bijection_and_protected(spark):
    vocab = spark.createDataFrame([(f"w{i}",) for i in range(200)], "token STRING")
    perm = permutation(vocab, 2, 42).cache()
    for rep in (0, 1):
        p = perm.filter(F.col("rep") == rep).collect()
        assert len(p) == 200 and len({r["token"] for r in p}) == 200 and len({r["new_token"] for r in p}) == 200
    toks = spark.createDataFrame([(0, 1, ["w1", "w2", "w1", "zz"])], "rep INT, test_id BIGINT, tokens ARRAY<STRING>")
    prot = spark.createDataFrame([(0, "w2")], "rep INT, token STRING")
    out = permute_tokens(toks, "tokens", perm, prot).first()["permuted"]
    m = {r["token"]: r["new_token"] for r in perm.filter("rep = 0").collect()}
    assert out == [m["w1"], "w2", m["w1"], "zz"]
    inv = {v: k for k, v in m.items()}
    assert [inv.get(t, t) if i != 1 else t for i, t in enumerate(out)] == ["w1", "w2", "w1", "zz"]


def test_pick_tokens_distinct_option(spark):
    vocab = spark.createDataFrame([(f"t{i}",) for i in range(6)], "token STRING")
    out = pick_tokens(vocab, 5, 4, 42, distinct=True).collect()
    for rep in range(4):
        words = [r["label_word"] for r in out if r["rep"] == rep]
        assert len(words) == 5 and len(set(words)) == 5


def test_grid_space_size(spark):
    assert grid_space(spark).count() == 240


def test_replicate_sample_sizes(spark):
    from shotlab.config import Params
    from shotlab.plans.experiment import prepare
    pr = prepare(spark, SF, Params(k=4, test_num=8, repeats=2))
    got = {(r["rep"], r["split"]): r["n"] for r in pr.sample.groupBy("rep", "split").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, "train"): 16, (0, "test"): 8, (1, "train"): 16, (1, "test"): 8}


def test_coverage_sample_covers_test_classes(spark):
    from shotlab.config import Params
    from shotlab.plans.experiment import baseline_sets, prepare
    p = Params(task="ag_news", k=6, test_num=12, repeats=4)
    fit, test = baseline_sets(prepare(spark, SF, p))
    got = {r["rep"]: r["n"] for r in fit.groupBy("rep").agg(F.countDistinct("y").alias("n")).collect()}
    need = {r["rep"]: r["n"] for r in test.groupBy("rep").agg(F.countDistinct("y").alias("n")).collect()}
    assert all(got[r] >= min(need[r], p.k) for r in need)
    assert {r["rep"]: r["n"] for r in fit.groupBy("rep").count().withColumnRenamed("count", "n").collect()} == \
        {r: p.k for r in range(p.repeats)}


def test_memo_texts_are_original_labels(spark):
    from shotlab.config import Params
    from shotlab.plans.experiment import prepare, texts
    pr = prepare(spark, SF, Params(k=4, test_num=8, repeats=2, pattern="memo_label_kw"))
    assert {r["text"] for r in texts(pr).collect()} <= set(pr.task.labels)


def test_zero_demonstrations_and_bad_parameters(spark):
    import pytest
    from shotlab.config import Params
    from shotlab.operators.sampling import with_reps
    test = spark.range(5).select(F.lit(0).alias("rep"), F.col("id").alias("doc_id"))
    assert draw_demos(test, 10, 0, 42).count() == 0
    assert draw_demos(test, 10, 0, 42).columns == draw_demos(test, 10, 1, 42).columns
    for bad in ({"repeats": 0}, {"k": -1}, {"test_num": 0}, {"k": 33, "test_num": 16}):
        with pytest.raises(ValueError):
            Params(**bad)
    with pytest.raises(ValueError):
        with_reps(test, 0)
    with pytest.raises(ValueError):
        draw_demos(test, 10, -1, 42)


def test_coverage_needs_many_attempts(spark):
    """14 classes in 14 rows: about one attempt in 10**5 covers; here 6 of 6, one in 65."""
    import pytest
    from shotlab.operators.sampling import coverage_sample, covering_attempts
    pool = spark.range(4 * 60).select((F.col("id") % 4).cast("int").alias("rep"), (F.col("id") / 4).cast("int").alias("pos"),
                                      F.col("id").alias("doc_id"), ((F.col("id") / 4).cast("int") % 6).cast("int").alias("label_idx"))
    need = spark.createDataFrame([(r, 6) for r in range(4)], "rep INT, n_classes BIGINT")
    shuffled = pool.withColumn("label_idx", F.when(F.col("pos") < 6, 0).otherwise(F.col("label_idx")))
    found = covering_attempts(shuffled, 6, need, 42)
    assert sorted(found) == [0, 1, 2, 3] and max(found.values()) > 32
    rows = coverage_sample(shuffled, 6, need, 42).collect()
    for r in range(4):
        mine = [x for x in rows if x["rep"] == r]
        assert {x["attempt"] for x in mine} == {found[r]} and {x["label_idx"] for x in mine} == set(range(6))
    with pytest.raises(ValueError):
        coverage_sample(pool.filter("label_idx < 5"), 6, need, 42)


def test_keyed_bijection_of_any_size(spark):
    """Every place is an image once, for small and odd sizes; replicates differ; no fixed pattern."""
    from pyspark.sql import functions as F
    from shotlab.operators.vocab import image_place, sides
    for n in (1, 2, 3, 5, 10, 97, 1000, 10007):
        a, b = sides(n)
        assert n <= a * b < n + a + 1
        rows = spark.range(n).crossJoin(spark.range(2).select(F.col("id").alias("rep"))).select("rep", "id", image_place(F.col("id"), n, 42).alias("to")).collect()
        per = [sorted((r["id"], r["to"]) for r in rows if r["rep"] == k) for k in (0, 1)]
        assert all(sorted(t for _, t in p) == list(range(n)) for p in per)
        if n > 90:
            assert per[0] != per[1] and sum(i == t for i, t in per[0]) < 9
            assert abs(sum((i - (n - 1) / 2) * (t - (n - 1) / 2) for i, t in per[0])) < 4 * n ** 2.5 / 12


def test_sample_by_candidates_equals_a_full_sort(spark):
    """The k smallest keys by plain sorting, whatever the size, with repeated ids and too few rows too."""
    import hashlib

    from shotlab.operators.sampling import sample_k

    for ids, k in (([*range(3000)], 7), ([*range(3000)], 1), ([*range(40)], 64), ([5] * 2000 + [*range(1000)], 90), ([7] * 1500, 20), ([], 3), ([*range(500)], 0)):
        base = spark.createDataFrame([(i,) for i in ids], "doc_id long").repartition(3)
        want = sorted((r, p, i) for r in range(4) for p, i in enumerate(sorted(ids, key=lambda i: (hashlib.md5(f"9|s|{r}|{i}".encode()).hexdigest(), i))[:k]))  # noqa: B023
        for keep in (None, []):
            got = sample_k(base, k, 4, 9, "s", keep=keep)
            assert sorted((r.rep, r.pos, r.doc_id) for r in got.collect()) == want
            for df in keep or []:
                df.unpersist()


def test_candidates_are_few(spark):
    from shotlab.operators.sampling import candidates

    base = spark.range(20_000).withColumnRenamed("id", "doc_id")
    assert 0 < candidates(base, 0.01, 5, 1, "s").count() < 3000
    plan = candidates(base, 0.01, 5, 1, "s")._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan
