"""The pipeline's rows against stage-by-stage plain Python on a whole small table."""

from collections import defaultdict

import corpus_pipeline
from shotlab.llm import common, packing, quality, secrets, simhash
from tests.conftest import SF
from tests.llm.test_native import base, entropy_spans
from tests.llm.test_packing import check
from tests.llm.test_simhash import brute_components, brute_fp


def test_stages():
    assert [f.__module__ for _, f in corpus_pipeline.STAGES] == ["corpus_pipeline"] * 4
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_run_against_brute_force(spark):
    docs = common.table(spark, SF, "documents")
    good = quality.assess(docs).where("kept").select("doc.doc_id", "doc.text").collect()
    fps = [brute_fp(r.text) for r in good]
    groups = brute_components([r.doc_id for r in good], fps)
    left = [(r.doc_id, r.text) for r, c in zip(good, groups) if r.doc_id == c]
    clean = []
    for i, t in left:
        out, pos = "", 0
        for a, _, b in sorted(base(t) + entropy_spans(t, base(t))):
            if a >= pos:
                out += t[pos:a] + "[SECRET]"
            pos = max(pos, b)
        clean.append((i, out + t[pos:]))
    got = corpus_pipeline.run(spark, SF).collect()
    bins, total = check(clean, got, 2048)
    assert bins <= 1.01 * total / 2048 + 1
    assert defaultdict(int, {"n": len(clean)})["n"] < docs.count()


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = common.table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[3][1](spark, docs.limit(0), SF).count() == 0
    assert {packing, quality, secrets, simhash}
