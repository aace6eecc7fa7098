"""The registered queries of the operators and their DuckDB oracles.

``QUERIES[name] = (fn(spark, sf_dir) -> DataFrame, sql or None)``.
"""

from __future__ import annotations

from shotlab.llm import bpe, codes, common, divergence, graph, oracles, packing, pfor, pii, quality, secrets, shuffle, simhash, urls, warc

QUERIES: dict[str, tuple] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


#: Rules of the URL filter, by host and path.
RULES = [urls.Rule("net", "/", "block"), urls.Rule("example.net", "/en/", "allow"), urls.Rule("example.com", "/de/", "block"), urls.Rule("org", "/fr/", "allow")]


@register("op1_url_filter", oracles.URL_FILTER)
def op1(spark, sf_dir):
    pages = common.table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.referral_list(pages), RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


@register("op2_embedding_dedup")
def op2(spark, sf_dir):
    return graph.near_vectors(common.table(spark, sf_dir, "embeddings"))


@register("op3_warc_salvage")
def op3(spark, sf_dir):
    return warc.round_trip(common.table(spark, sf_dir, "pages")).drop("url")


@register("op4_quality_rules", oracles.QUALITY)
def op4(spark, sf_dir):
    rows = quality.assess(common.table(spark, sf_dir, "documents"), carry=["doc_id"])
    return rows.select("doc.doc_id", *quality.COUNTS, "base_failed", "kept")


@register("op5_pii_skip_chain")
def op5(spark, sf_dir):
    return pii.find(common.table(spark, sf_dir, "documents"))


@register("op6_bpe_transducer")
def op6(spark, sf_dir):
    return bpe.report(common.table(spark, sf_dir, "documents"))


@register("op7_simhash_dedup")
def op7(spark, sf_dir):
    return simhash.report(common.table(spark, sf_dir, "documents"))


@register("op8_best_fit_packing")
def op8(spark, sf_dir):
    return packing.pack(common.table(spark, sf_dir, "documents"))


@register("op9_token_files")
def op9(spark, sf_dir):
    return pfor.round_trip(common.table(spark, sf_dir, "documents"))


@register("op10_secret_scan", oracles.SECRETS)
def op10(spark, sf_dir):
    return secrets.report(common.table(spark, sf_dir, "documents"))


@register("op11_value_dictionaries", oracles.CODES)
def op11(spark, sf_dir):
    return codes.report(common.table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


@register("op12_external_shuffle")
def op12(spark, sf_dir):
    return shuffle.report(common.table(spark, sf_dir, "documents"))


@register("op13_source_divergence", oracles.DIVERGENCE)
def op13(spark, sf_dir):
    return divergence.audit(common.table(spark, sf_dir, "documents"))
