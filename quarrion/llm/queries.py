"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bitplane, bpe, dartminhash, lattice, mixing, pii, quality, tokencount, toxicity, warc
from .common import table


def _tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_index(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_time")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, _tokenizer_file("byte_bpe_multi_50k.tiktoken"), _pattern())


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), _tokenizer_file("piece_bpe_32k.model"), 4096)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op6_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplane.store_and_read(table(spark, sf_dir, "documents"), _tokenizer_file("word_bpe_49k.json"), 1)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_lattice_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.classes(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc_index, op2_mixing, op3_bpe_round_trip, op4_token_counts, op5_personal_data, op6_bit_planes, op7_toxicity, op8_lattice_near_vectors, op9_quality_rules, op10_dart_minhash)}
