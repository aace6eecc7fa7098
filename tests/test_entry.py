import math

import __spark_entry__ as E
from tests.conftest import SF

ROWS_ONLY = {"linear_grid", "linear_grid_tfidf", "linear_fit", "experiment_report_linear"}


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["rep", "macro_f1"]
    assert len(rows) == 3 and all(0.0 <= r["macro_f1"] <= 1.0 for r in rows)


def test_every_query_has_oracle_unless_fit():
    from shotlab.plans.catalog import QUERIES
    q, o = E.queries(), E.oracle_sql()
    assert set(QUERIES) - set(o) == ROWS_ONLY
    assert set(o) <= set(q)


def test_prompting_pipeline_properties(spark):
    from pyspark.sql import functions as F
    from shotlab.config import CHECK
    from shotlab.plans import experiment as X
    pr = X.prepare(spark, SF, CHECK)
    p = X.prompts(pr)
    rows = p.collect()
    assert len(rows) == CHECK.repeats * CHECK.test_num
    assert all(r["prompt"].endswith(pr.task.prompt_y) and r["prompt"].count(pr.task.prompt_x) == CHECK.k + 1
               for r in rows)
    _, preds, f1 = X.overlap_eval(pr)
    pr_rows = preds.collect()
    assert all(1 <= r["gold_rank"] <= len(pr.task.labels) for r in pr_rows)
    assert all(r["gold_rank"] == 1 for r in pr_rows if r["gold_idx"] == r["pred_idx"])
    assert all(0 <= r["macro_f1"] <= 1 and not math.isnan(r["macro_f1"]) for r in f1.collect())


def test_score_hook_with_constant_scorer(spark):
    import pandas as pd
    from shotlab.config import CHECK
    from shotlab.operators.ranking import predict_and_rank
    from shotlab.operators.scoring import score_with
    from shotlab.plans import experiment as X

    def const(batches):
        for pdf in batches:
            rows = [(r, t, i, 0.5) for r, t, labels in zip(pdf["rep"], pdf["test_id"], pdf["labels"])
                    for i in range(len(labels))]
            yield pd.DataFrame(rows, columns=["rep", "test_id", "label_idx", "score"])

    pr = X.prepare(spark, SF, CHECK)
    preds = predict_and_rank(score_with(X.scoring_prompts(pr), pr.lmap, const), X.gold(pr)).collect()
    assert len(preds) == CHECK.repeats * CHECK.test_num
    assert all(r["pred_idx"] == 0 and r["gold_rank"] == 1 for r in preds)
