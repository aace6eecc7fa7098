"""The vocabulary permutation: one join for the images, the bijection unchanged."""

from pyspark.sql import functions as F


def test_permutation_joins_the_vocabulary_once(spark):
    from shotlab.operators.vocab import image_place, indexed, permutation
    words = spark.createDataFrame([(f"w{i:03d}",) for i in range(211)], "token string")
    keep: list = []
    got = permutation(words, 3, 7, keep)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
    at, n = indexed(words, keep)
    places = at.select(F.explode(F.array(*map(F.lit, range(3)))).alias("rep"), "token", "q").select("rep", "token", image_place(F.col("q"), n, 7).alias("to"))
    assert {tuple(r) for r in got.collect()} == {(r["rep"], r["token"], f"w{r['to']:03d}") for r in places.collect()}
    assert got.select("rep", "new_token").distinct().count() == 633
    for d in keep:
        d.unpersist()
