"""A corpus from raw documents to token ids: quality rules, near-duplicates, personal data, mixing, encoding.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that the stage before it kept.  All but the last return
the columns of documents, extra ones included, whatever their names.  Every stage takes an empty table and gives one, treats
repeated rows alike, and takes long texts whole; what it does with nulls and empty texts is said with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrion.llm import bpe, dartminhash, mixing, pii, quality
from quarrion.llm.common import scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or their language's certified cutoff, go: null and empty texts among them.  A null
    language is one of its own; a null id is judged like others."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: that of the smallest id.  Null and empty texts are one text; of
    several rows of an id one stays; rows with a null id all stay."""
    return dartminhash.distinct_documents(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become [KIND]; n_chars follows the text.  A null text stays null, and its n_chars is null."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says; a document that is taken twice has two rows.  A null source is one of
    its own; a null text has no words, and is taken as its source's rate says."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row: doc_id, n_tokens, ids.  A null or empty text has none."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Signatures, votes and byte pair merges are beyond SQL.
ORACLE_SQL = None
