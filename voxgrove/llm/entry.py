"""Queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, katz, linededup, nndescent, packing, pii, quality, simhash, tokenstore, urlfilter
from .common import table


def op1_nn_descent(spark, d):
    return nndescent.near_duplicates(table(spark, d, "embeddings"))


def op2_byte_bpe(spark, d):
    return bpe.digests(table(spark, d, "documents"))


def op3_quality_rules(spark, d):
    return quality.judge(table(spark, d, "documents"))


def op4_token_store(spark, d):
    return tokenstore.read_digests(spark, tokenstore.write_tokens(table(spark, d, "documents")))


def op5_pii(spark, d):
    return pii.find(table(spark, d, "documents"))


def op6_katz_backoff(spark, d):
    return katz.score(table(spark, d, "documents"))


def op7_simhash(spark, d):
    from pyspark.sql import functions as F

    near = simhash.near_duplicates(table(spark, d, "documents"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_line_dedup(spark, d):
    return linededup.report(table(spark, d, "documents"))


def op9_url_filter(spark, d):
    rows = urlfilter.judge(table(spark, d, "pages"))
    return rows.select("page_id", "host", rows["url_path"].alias("path"), "rule", "verdict", "score")


def op10_best_fit_packing(spark, d):
    return packing.pack_documents(table(spark, d, "documents"))


def queries():
    ops = [op1_nn_descent, op2_byte_bpe, op3_quality_rules, op4_token_store, op5_pii, op6_katz_backoff, op7_simhash, op8_line_dedup, op9_url_filter, op10_best_fit_packing]
    return {f.__name__: f for f in ops}


def oracle_sql():
    return {"op3_quality_rules": quality.SQL}
