"""The registered queries of the training-data operators: thin callables with production parameters, and oracle SQL."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarnwell.llm import chat, class_lm, licenses, packing, piece_codec, repair, secrets, simhash, spelling, tiff, vectors_lsh, weak_labels
from tarnwell.llm.token_counts import token_counts
from tarnwell.llm.token_ids import bpe_50k
from tarnwell.session import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), bpe_50k, end_id=1, tokens=2048, segments=64, loss=2048)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), sample=4096, labelled_rows=8192)


def op8_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.media_features(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_format(table(spark, sf_dir, "conversations"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors_lsh.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95, recall=0.97)


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), kind="bpe")


def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(table(spark, sf_dir, "documents"), frequent=65_000, seeds=512, classes=48, rounds=2)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(table(spark, sf_dir, "conversations"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(licenses.scan(table(spark, sf_dir, "documents")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), least_length=6, least_count=5, drop_every=199, factor=5)


QUERIES = {f.__name__: f for f in (op1_token_counts, op4_simhash_near_dedup, op5_vector_packing, op7_secret_scan, op3_weak_label_quality, op8_tiff_pages, op2_chat_format, op6_embedding_near_dedup, op9_piece_codec, op10_class_lm, op11_conversation_repair, op12_license_scan, op13_spelling_variants)} | {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {"op2_chat_format": chat.ORACLE}
