"""A training-data pipeline over ``documents``: quality, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it decides takes effect:

* quality: documents that the weak-label classifier rejects go;
* near_dedup: of each group of documents linked by a Jaccard similarity of 0.8 or more of their five-word shingles the one
  with the smallest id stays;
* secrets: findings are masked in the text, and n_chars is counted anew; the document stays;
* packing: what is left is packed into sequences of 2048 tokens.

All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnwell.llm import packing, secrets, simhash, weak_labels
from tarnwell.llm.token_ids import bpe_50k
from tarnwell.session import durable, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return weak_labels.keep_good(docs, table(spark, sf_dir, "labels"), sample=4096, labelled_rows=8192)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, bpe_50k, end_id=1, tokens=2048, segments=64, loss=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: SQL cannot express the classifier, the fingerprints or the packing: tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
