"""The corpus pipeline: documents to packed token sequences, in five stages.

1. toxicity      documents that the classifier rejects go
2. near_join     of each class of near duplicates the document with the least id stays
3. secret_scan   secrets are replaced by a mark; every document stays
4. mixing        documents are repeated, and at most one a source cut, to the target weights
5. packing       what is left becomes pieces of token sequences

Each stage works on all rows of the one before, which run() writes to the shared folder and
reads back. The last returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id and
offset for each piece. Edge cases are those of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import mixing, near_join, packing, secret_scan, toxicity
from docquarry.llm.common import materialize, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    p = toxicity.Params()
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), p)
    name = "toxicity_score" + "_" * max(map(len, docs.columns))  # longer than any column's name
    return toxicity.score(docs, model, p, name).where(F.col(name) < p.threshold).drop(name)


def near_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_join.keep_one(docs).select(*docs.columns)


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, secret_scan.thresholds(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(docs, packing.default_tokenizer()))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_join", near_join_stage),
    ("secret_scan", secret_scan_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the fitted classifier, the forest or the tokenizer; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
