"""Results depend on the seed only: 1 vs many shuffle partitions give the same rows."""

from shotlab.config import CHECK
from shotlab.plans import experiment as X
from tests.conftest import SF


def _collect(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        pr = X.prepare(spark, SF, CHECK.with_(pattern="token"))
        prompts = sorted(X.prompts(pr).collect())
        perm = sorted(X.permuted_texts(pr).select("rep", "doc_id", "text").collect())
        scores, preds, f1 = X.overlap_eval(pr)
        return prompts, perm, sorted(preds.collect()), sorted(scores.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_same_rows_for_1_and_13_partitions(spark):
    assert _collect(spark, 1) == _collect(spark, 13)
