"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, PII, packing.

Each stage is (name, function of (spark, docs, sf_dir)) on all that the stage before kept; its
result is written as Parquet in the shared folder and read again as the next one's documents; the
tables a stage made on its way are then deleted, the result of the stage before included. The
near-duplicate stage keeps one document of each group, by five-word shingles and a similarity
of 0.8; PII is masked in the text; the last stage returns the packing's rows.

Rows are told apart by doc_id and text, so rows that share a doc_id, or have none, are documents of
their own; of equal rows one stays. Null texts go with the quality rules. Extra columns pass
through. An empty table gives none.
"""

from __future__ import annotations

from voxgrove.llm import linededup, packing, pii, quality, simhash
from voxgrove.llm.common import made, release_since, saved, table


def quality_rules(spark, docs, sf_dir):
    return quality.keep_good(docs)


def line_dedup(spark, docs, sf_dir):
    return linededup.drop_lines(docs)


def simhash_dedup(spark, docs, sf_dir):
    return simhash.keep_one(docs)


def mask_pii(spark, docs, sf_dir):
    return pii.redact(docs)


def pack(spark, docs, sf_dir):
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mask_pii", mask_pii),
    ("best_fit_packing", pack),
]
#: Packing and PII cannot be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, mark = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release_since(spark, mark, docs)
    return docs
