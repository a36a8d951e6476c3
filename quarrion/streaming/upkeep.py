"""Upkeep of an index table from a stream of changes.

A change is a row with the document's columns, op (insert, update, replace or delete) and at, which orders the changes of a
document.  Each micro-batch becomes a segment: of each document its last change.  A batch that is tried again after a failure
replaces its segment, and the checkpoint resumes after the last whole one, so every change counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quarrion.plans.definition import IndexDefinition
from quarrion.sources.index_table import IndexTable, write_segment


def last_changes(changes: DataFrame, id_column: str) -> DataFrame:
    """Of each document its last change; map-side, so a document that changes very often meets as one row a task."""
    columns = [c for c in changes.columns if c != id_column]
    last = changes.where(F.col(id_column).isNotNull()).groupBy(id_column).agg(F.max_by(F.struct(*columns), "at").alias("last"))
    return last.select(id_column, "last.*")


def apply(changes: DataFrame, definition: IndexDefinition, path: str, folder: str, segment: int) -> None:
    """One batch of changes as a segment."""
    last = last_changes(changes, definition.id_column).persist()
    try:
        gone = F.col("op") == "delete"
        write_segment(last.where(~gone), definition, path, folder, segment, last.where(gone))
    finally:
        last.unpersist()


def maintain(changes: DataFrame, definition: IndexDefinition, path: str, folder: str, checkpoint: str, first: int = 1, **trigger) -> StreamingQuery:
    """Start the upkeep of the index table in a folder; trigger: as of DataStreamWriter.trigger, by default all that is there.

    Segments are numbered from `first` on; the table that was built is segment 0.
    """
    writer = changes.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return writer.foreachBatch(lambda batch, number: apply(batch, definition, path, folder, first + number)).start()


def read_changes(spark: SparkSession, folder: str, schema: T.StructType, files: int = 100) -> DataFrame:
    """Changes from Parquet files as they come, `files` in a batch at most."""
    whole = T.StructType([*schema.fields, T.StructField("op", T.StringType()), T.StructField("at", T.LongType())])
    return spark.readStream.schema(whole).option("maxFilesPerTrigger", files).parquet(folder)


def current(spark: SparkSession, definition: IndexDefinition, path: str, folder: str) -> IndexTable:
    """The table with all segments so far."""
    return IndexTable(spark, folder, definition, path)
