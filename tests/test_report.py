"""The report is a query per step: what the driver plans, holds and reports does not grow with the patterns."""

from shotlab.config import Params
from shotlab.plans import experiment as X
from shotlab.sources.registry import custom_task

TASK = custom_task("fruit", ["apple", "pear"], "In: ", "\nOut: ")
P = Params(k=4, test_num=8, repeats=2)


def labelled(spark):
    rows = [(i, f"{'red round' if i % 2 else 'green long'} fruit {i % 7} in basket {i}", i % 2, "train" if i < 40 else "test") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, label_idx int, split string")


def nodes(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_report_keeps_no_nested_plans(spark):
    lab = labelled(spark)
    out = X.experiment_report(spark, None, P, ["none"], labelled=lab, task=TASK)
    assert "InMemoryTableScan" not in nodes(out) and nodes(out).count("Exchange") <= 1
    got = out.first()
    pr = X.prepare(spark, None, P, labelled=lab, task=TASK, written=True)
    for df in (pr.lmap, pr.sample, pr.drawn, X.doc_texts(pr), X.overlap_eval(pr)[1]):
        assert "InMemoryTableScan" not in nodes(df) and "Window" not in nodes(df) and "Join" not in nodes(df)
    want = X.prompting_report(pr).first()
    assert all(abs(got[c] - want[c]) < 1e-9 for c in ("mean_f1", "mean_rank", "n_prompts")) and 0 <= got["linear_f1"] <= 1
    pr.release()
