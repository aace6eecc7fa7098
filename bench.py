"""Benchmark: headline plans at the reference's default workload.

Runs on ``local[$BENCH_CPUS]`` against ``$BENCH_SF_DIR`` (default sf0.1) and
prints ONE JSON line. Every plan is executed in full through the ``noop``
sink (nothing is collected to the driver). Per query: median of up to
``$BENCH_REPEATS`` timed runs (default 3) after one untimed warm-up run. A
query is not repeated beyond ``$BENCH_QUERY_SEC`` seconds of its own (default
100); one whose warm-up alone takes longer counts by that run. Each time is
printed to stderr as soon as it is known, and the JSON line holds how many
runs each median has. After ``$BENCH_TOTAL_SEC`` (default 1650) the line is
printed with what is finished; the others are listed as unfinished.
"""

from __future__ import annotations

import json
import os
import signal
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from shotlab.config import Params  # noqa: E402
from shotlab.plans import experiment as X  # noqa: E402
from shotlab.session import get_spark  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
QUERY_SEC = float(os.environ.get("BENCH_QUERY_SEC", "100"))
TOTAL_SEC = float(os.environ.get("BENCH_TOTAL_SEC", "1650"))

# Reference defaults: k=32 demonstrations, T=256 test rows, R=20 replicates.
DEFAULT = Params(task="ag_news", k=32, test_num=256, repeats=20)


def _run(df):
    df.write.format("noop").mode("overwrite").save()


def q_prompts(spark):
    _run(X.prompts(X.prepare(spark, SF_DIR, DEFAULT)))


def q_icl_eval(spark):
    _run(X.prompting_report(X.prepare(spark, SF_DIR, DEFAULT)))


def q_linear_grid(spark):
    pr = X.prepare(spark, SF_DIR, DEFAULT)
    grid, _, _ = X.linear_baseline(spark, pr)
    _run(grid)


def q_token_permute(spark):
    _run(X.prompts(X.prepare(spark, SF_DIR, DEFAULT.with_(pattern="token"))))


def q_corpus_ngrams(spark):
    from shotlab.operators.features import corpus_grams
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    _run(corpus_grams(docs, 4, 2))


def q_memo_label_kw(spark):
    _run(X.prompting_report(X.prepare(spark, SF_DIR, DEFAULT.with_(task="dbpedia_14", pattern="memo_label_kw"))))


def q_linear_fit(spark):
    from shotlab.operators.linear import linear_fit
    from shotlab.sources.labelled import task_rows
    lab = task_rows(spark, SF_DIR, "ag_news")
    _run(linear_fit(lab.filter("split = 'train'"), lab.filter("split = 'test'"), c=1.0))


QUERIES = {
    "prompts": q_prompts,
    "icl_eval": q_icl_eval,
    "memo_label_kw": q_memo_label_kw,
    "token_permute": q_token_permute,
    "linear_grid": q_linear_grid,
    "corpus_ngrams": q_corpus_ngrams,
    "linear_fit": q_linear_fit,
}


def report(times, runs, unfinished):
    sf = SF_DIR.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_median_wall_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": int(CPUS), "repeats": runs, "unfinished": unfinished,
                      "workload": {"k": DEFAULT.k, "test_num": DEFAULT.test_num, "repeats": DEFAULT.repeats}}), flush=True)


def main():
    spark = get_spark(master=f"local[{CPUS}]", app="shotlab-bench")
    only = [a for a in sys.argv[1:] if a in QUERIES]
    names = only or list(QUERIES)
    times, runs = {}, {}

    def out_of_time(*_):
        report(times, runs, [n for n in names if n not in times])
        os._exit(0)

    signal.signal(signal.SIGALRM, out_of_time)
    signal.alarm(int(TOTAL_SEC))
    for n in names:
        ts, warm = [], True
        while len(ts) < REPEATS and (not ts or sum(ts) < QUERY_SEC):
            t = time.perf_counter()
            QUERIES[n](spark)
            ts.append(time.perf_counter() - t)
            spark.catalog.clearCache()     # persisted intermediates of this run (not timed)
            if warm and ts[0] < QUERY_SEC:
                ts.clear()
            warm = False
        times[n], runs[n] = round(statistics.median(ts), 3), len(ts)
        print(f"{n} {times[n]} s, {runs[n]} runs", file=sys.stderr, flush=True)
    signal.alarm(0)
    report(times, runs, [])


if __name__ == "__main__":
    main()
