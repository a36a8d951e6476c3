"""Mixing sources to target weights.

Sizes are summed by source, each source gets a target by weight, and the target over the size is its documents' repetition
rate: a document is taken floor(rate) times and once more if a hash of its id falls below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, text_or_empty

#: Up to so many sources (a few MB) their rates are broadcast; beyond it the join shuffles and AQE splits a large source.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, target from source and source_size.

    Sources take the weights in turn, by code point with null last.  Together they get share of all sizes; a target stops
    at most times its size and what is over goes to the others by weight.  So sources fill up in the order of
    most * size / weight, and all others stand at one level per unit of weight.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("n", F.row_number().over(rank)).withColumn(
        "w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("n") - 1) % len(weights) + 1).cast("int")).cast("long")
    )
    everything = Window.partitionBy()
    by_fill = Window.orderBy("fill", "n").rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0).cast("long")
    filled = (
        ranked.withColumn("most", F.col("source_size") * most)
        .withColumn("fill", F.col("most") / F.col("w"))
        .withColumn("budget", F.sum("source_size").over(everything) * share - F.coalesce(F.sum("most").over(by_fill), nothing))
        .withColumn("left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(by_fill), nothing))
        .withColumn("level", F.col("budget") / F.col("left"))
        .withColumn("full", F.col("level") > F.col("fill"))
        .withColumn("open", F.min(F.when(~F.col("full"), F.struct("fill", "n", "level"))).over(everything))
    )
    level = F.col("open.level") * F.col("w")
    return filled.select("source", "source_size", F.when(F.col("full"), F.col("most").cast("double")).otherwise(level).alias("target"))


def copies(rate: Column, doc_id: Column, seed: str = "mix") -> Column:
    """floor(rate), and one more if the hash of the id, as a number in [0, 1), is below the fraction."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13)
    draw = F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def with_copies(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(5, 2, 1), share=1.5, most=2, seed="mix") -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies (columns of these names are replaced).

    The size of a document is its number of words; a null text has none.  A null source is a source.  A source without
    words has rate 0.  Rows of one id share their draw, so repeated rows are taken alike; a null id draws as "null".  An
    empty table gives an empty one.  Reruns agree, as draws depend on ids alone.
    """
    size = word_count(text_or_empty(text_col))
    sizes = docs.select(F.col(source_col).cast("string").alias("source"), size.alias("s")).groupBy("source").agg(F.sum("s").alias("source_size"))
    goals = materialize(targets(sizes, weights, share, most), "targets").select(
        F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target")
    )
    if goals.count() <= BROADCAST_SOURCES:
        goals = F.broadcast(goals)
    made = ("mix_size", "mix_source", "mix_source_size", "mix_target", "mix_copies")
    rows = docs.drop(*made).withColumn("mix_size", size)
    joined = rows.join(goals, rows[source_col].cast("string").eqNullSafe(F.col("mix_source")), "left").drop("mix_source")
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    return joined.withColumn("mix_copies", copies(rate, F.col(id_col), seed))


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as it is taken: the columns of docs, and rows that are not taken are gone."""
    rows = with_copies(docs, **options)
    return rows.withColumn("mix_copies", F.explode(F.array_repeat(F.lit(0), F.col("mix_copies")))).select(*docs.columns)


def mix_report(docs: DataFrame, id_col="doc_id", **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes of each row, repeats counted."""
    rows = with_copies(docs, id_col=id_col, **options)
    return rows.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )
