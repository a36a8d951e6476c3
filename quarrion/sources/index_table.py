"""Index tables: the terms of a text column, written once, so that a search reads the rows of its own terms.

postings  segment, term, id, tf, positions, length: files hold the terms of documents dealt by id, sorted by term, so the
          statistics of row groups and pages let a scan pass over the others; a term of very many documents is in all files.
          A document has one row without term besides.
documents segment, id, length: one row for each document, length null where it was deleted.

Changes are written as segments of their own.  Of each document the rows of its latest segment count; `compact` leaves one.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrion.functions import scoring
from quarrion.operators.text import anchored, fuzzy_options, near_word, wildcard_pattern, within
from quarrion.plans.definition import IndexDefinition
from quarrion.plans.scope import Scope

#: Bytes of a row group, so that a file has many to pass over.
ROW_GROUP = 16 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the one of spark.checkpoint.dir, else beside the warehouse; in local mode, a temporary one."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    root = found.get() if found.isDefined() else sc.getConf().get("spark.checkpoint.dir")
    if not root:
        root = tempfile.mkdtemp(prefix="quarrion-") if re.match(r"local(\[|$)", sc.master) else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-scratch"
    return f"{root}/{name}-{uuid.uuid4().hex}"


def analysed_documents(docs: DataFrame, definition: IndexDefinition, path: str) -> DataFrame:
    """id, tokens.  Texts are dealt evenly first, as they are; tokens never move."""
    scope = Scope(definition, docs.schema)
    rows = docs.select(F.col(definition.id_column).alias("id"), scope.column(path).cast("string").alias("text")).repartition("id")
    return rows.select("id", scope.index_analyzer(path)(F.col("text")).alias("tokens"))


def grouped_positions(tokens: pa.ListArray) -> tuple[np.ndarray, pa.Array, pa.ListArray, np.ndarray]:
    """Of lists of tokens: by list and term, the list's number, the term, its places; and each list's length.  Null tokens keep
    their places and have no term."""
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy()
    words = pc.dictionary_encode(tokens.flatten())
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    code = pc.fill_null(words.indices, -1).to_numpy()
    known = np.nonzero(code >= 0)[0]
    code, owner, place = code[known].astype(np.int64), owner[known], place[known].astype(np.int32)
    key = owner * max(1, len(words.dictionary)) + code
    order = np.argsort(key, kind="stable")
    begins = np.nonzero(np.diff(key[order], prepend=-1))[0]
    places = pa.ListArray.from_arrays(pa.array(np.append(begins, len(order)), pa.int32()), pa.array(place[order]))
    first = order[begins]
    return owner[first], words.dictionary.take(pa.array(code[first])), places, np.bincount(owner, minlength=len(sizes)).astype(np.int32)


def postings_of(words: DataFrame) -> DataFrame:
    """term, id, tf, positions, length; and for each document a row without term, with its length."""

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                some = batch.slice(begin, 500)
                owner, terms, places, length = grouped_positions(some.column(1))
                none = pa.nulls(some.num_rows)
                for of, term, tf, at in ((owner, terms, pc.list_value_length(places), places), (np.arange(some.num_rows), none, none, none)):
                    columns = [term.cast(pa.string()), some.column(0).take(pa.array(of)), tf.cast(pa.int32()), at.cast(pa.list_(pa.int32())), pa.array(length[of])]
                    yield pa.RecordBatch.from_arrays(columns, names=["term", "id", "tf", "positions", "length"])

    return words.mapInArrow(run, T.StructType([T.StructField("term", T.StringType()), words.schema["id"], *T._parse_datatype_string("tf int, positions array<int>, length int").fields]))


def write_segment(docs: DataFrame, definition: IndexDefinition, path: str, folder: str, segment: int, deleted: DataFrame | None = None) -> None:
    """Write documents, and ids that are gone, as a segment; one that is there is replaced, so a batch can be tried again.

    Texts are dealt and analysed once.  What comes of a task's documents is sorted there and written, so postings are never
    shuffled; the rows without term, which come first in each file, are read back as the documents."""
    rows = postings_of(analysed_documents(docs, definition, path))
    at = f"{folder}/postings/segment={segment}"
    rows.sortWithinPartitions("term", "id").write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(at)
    documents = docs.sparkSession.read.schema(rows.schema).parquet(at).where("term IS NULL").select("id", "length")
    if deleted is not None:
        documents = documents.unionByName(deleted.select(F.col(definition.id_column).alias("id"), F.lit(None).cast("int").alias("length")))
    documents.write.mode("overwrite").parquet(f"{folder}/documents/segment={segment}")


def near_places(rows: DataFrame, terms: list[int], slop: int) -> DataFrame:
    """id, length, tf: the sum over the places of the first term of 1 / (1 + moves), the nearest place of each further term
    counting, the lower of two as near.  terms: numbers of the columns p0, p1, ... of sorted places."""

    def run(batches):
        for batch in batches:
            # places of all rows on one line, far apart
            line = []
            for k in terms:
                lists = batch.column(2 + k)
                owner = np.repeat(np.arange(batch.num_rows, dtype=np.int64), pc.list_value_length(lists).to_numpy())
                line.append(lists.flatten().to_numpy() + (owner << 33))
            starts, low, high, fits = line[0], 0, 0, True
            for k, at in enumerate(line[1:], 1):
                at = np.concatenate([[-(1 << 33)], at - k, [1 << 62]])
                after = np.searchsorted(at, starts)
                down, up = at[after - 1] - starts, at[after] - starts
                shift = np.where(-down <= up, down, up)
                fits = fits & (np.abs(shift) <= slop)
                low, high = np.minimum(low, shift), np.maximum(high, shift)
            spread = np.where(fits & (high - low <= slop), high - low, 0)
            each = np.where(fits & (high - low <= slop), 1 / (1 + spread), 0.0) * np.ones(len(starts))
            tf = np.bincount(starts >> 33, each, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tf)], names=["id", "length", "tf"])

    schema = T.StructType([rows.schema["id"], rows.schema["length"], T.StructField("tf", T.DoubleType())])
    return rows.select("id", "length", *[f"p{k}" for k in range(max(terms) + 1)]).mapInArrow(run, schema)


@dataclass
class IndexTable:
    """The postings and documents that count."""

    spark: SparkSession
    folder: str
    definition: IndexDefinition
    path: str

    @staticmethod
    def build(docs: DataFrame, definition: IndexDefinition, path: str, folder: str) -> IndexTable:
        write_segment(docs, definition, path, folder, 0)
        return IndexTable(docs.sparkSession, folder, definition, path)

    def __post_init__(self):
        rows = self.spark.read.parquet(f"{self.folder}/documents")
        self.segments = [r.segment for r in rows.select("segment").distinct().orderBy("segment").collect()]  # a row for each segment
        if len(self.segments) > 1:
            latest = rows.groupBy("id").agg(F.max(F.struct("segment", "length")).alias("last")).select("id", "last.segment", "last.length")
        else:
            latest = rows
        self.latest = latest.where("length IS NOT NULL")
        self.totals = None

    def postings(self, condition: Column) -> DataFrame:
        """Rows of the terms that a condition names; it goes down to the scan."""
        rows = self.spark.read.parquet(f"{self.folder}/postings").where(F.col("term").isNotNull() & condition)
        if len(self.segments) > 1:
            rows = rows.join(self.latest.select("id", "segment"), ["id", "segment"], "left_semi")
        return rows

    def statistics(self) -> tuple[float, float]:
        """The number of documents with a token, and their mean length."""
        if self.totals is None:
            row = self.latest.where("length > 0").agg(F.count("*").alias("n"), F.sum("length").alias("total")).first()
            self.totals = (float(row.n), float(row.total or 0) / max(row.n, 1))
        return self.totals

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """Document frequencies: one row for each term asked for."""
        return {r.term: r["count"] for r in self.postings(F.col("term").isin(terms)).groupBy("term").count().collect()}

    def analysed(self, text: str) -> list[str]:
        scope = Scope(self.definition, T.StructType([T.StructField(self.path, T.StringType())]))
        return [t for t in scope.analyzer(self.path).tokens(self.spark, text) if t is not None]

    def _scored(self, weights: dict[str, float], df: dict[str, int]) -> DataFrame:
        """term, id, score of each posting of the terms."""
        n, average = self.statistics()
        rows = self.postings(F.col("term").isin(list(weights)))
        idf = F.element_at(F.create_map(*[F.lit(x) for t, w in weights.items() for x in (t, w * scoring.idf(n, df.get(t, 0)))]), F.col("term"))
        norm = scoring.K1 * (1 - scoring.B + scoring.B * F.col("length") / F.lit(max(average, 1e-9)))
        return rows.select("term", "id", (idf * F.col("tf") / (F.col("tf") + norm)).alias("score"))

    def text(self, query: str, criteria: str = "any", fuzzy: dict | None = None) -> DataFrame:
        """id, score of the documents with any, or all, terms of a query; the rows of these terms alone are read."""
        terms = list(dict.fromkeys(self.analysed(query)))
        if fuzzy is not None:
            if criteria == "all":
                raise ValueError("fuzzy terms are joined by any here")
            found = None
            for t in terms:
                near = self.near(t, fuzzy)
                most = max((r.n for r in near), default=0)
                one = self._scored({r.term: r.w for r in near}, {r.term: most for r in near}) if near else self._scored({t: 0.0}, {})
                found = one if found is None else found.unionByName(one)
            return found.groupBy("id").agg(F.sum("score").alias("score"))
        if not terms:
            return self.postings(F.lit(False)).select("id", F.lit(0.0).alias("score"))
        scored = self._scored(dict.fromkeys(terms, 1.0), self.frequencies(terms)).groupBy("id").agg(F.sum("score").alias("score"), F.count("*").alias("n"))
        return scored.where(F.col("n") == len(terms) if criteria == "all" else F.lit(True)).select("id", "score")

    def phrase(self, query: str, slop: int = 0) -> DataFrame:
        """id, score: the positions of the terms in a document are compared, as `phrase_frequency` counts them."""
        terms = self.analysed(query)
        named = list(dict.fromkeys(terms))
        n, average = self.statistics()
        df = self.frequencies(named)
        rows = self.postings(F.col("term").isin(named)).groupBy("id").agg(*[F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(f"p{k}") for k, t in enumerate(named)], F.first("length").alias("length"), F.count("*").alias("n"))
        rows = rows.where(F.col("n") == len(named))
        places = [F.col(f"p{named.index(t)}") for t in terms]
        if slop == 0:
            shifted, starts = lambda k: F.transform(places[k], lambda x: x - k), places[0]
            for k in range(1, len(terms)):
                starts = F.array_intersect(starts, shifted(k))
            rows = rows.withColumn("tf", F.size(starts).cast("double"))
        else:
            rows = near_places(rows, [named.index(t) for t in terms], slop)
        idf = sum(scoring.idf(n, df.get(t, 0)) for t in named)
        rows = rows.where("tf > 0")
        return rows.select("id", scoring.bm25(F.col("tf"), F.col("length"), idf, average).alias("score"))

    def near(self, word: str, fuzzy: dict) -> list:
        """(term, w, n) of the nearest terms, maxExpansions at most."""
        edits, prefix, most = fuzzy_options(fuzzy)
        head = F.col("term").startswith(word[:prefix]) if prefix else F.lit(True)
        far = within(F.substring("term", F.lit(prefix + 1), F.length("term")), word[prefix:], edits)
        rows = self.postings(head & near_word(word, fuzzy)(F.col("term"))).groupBy("term").agg(F.count("*").alias("n"))
        return rows.select("term", (1 - far / F.least(F.length("term"), F.lit(len(word)))).alias("w"), "n").orderBy(F.desc("w"), "term").limit(most).collect()

    def term(self, query: str, kind: str = "exact") -> DataFrame:
        """id, score of the documents with a term, or with one that fits a prefix, wildcard or regex (score 1)."""
        if kind == "exact":
            return self._scored({query: 1.0}, self.frequencies([query])).select("id", "score")
        if kind == "prefix":
            fits = F.col("term").startswith(query)
        else:
            # the characters before the first special one go down to the scan
            head = re.match(r"[\w]*(?![*?+{|])", query).group() if kind == "wildcard" else ""
            fits = F.col("term").startswith(head) & F.col("term").rlike(wildcard_pattern(query) if kind == "wildcard" else anchored(query))
        return self.postings(fits).select("id").distinct().select("id", F.lit(1.0).alias("score"))

    def compact(self, folder: str) -> IndexTable:
        """What counts, as the only segment of a new folder."""
        rows = self.postings(F.lit(True)).drop("segment").repartition("id").sortWithinPartitions("term", "id")
        rows.write.option("parquet.block.size", ROW_GROUP).parquet(f"{folder}/postings/segment={self.segments[-1]}")
        self.latest.select("id", "length").write.parquet(f"{folder}/documents/segment={self.segments[-1]}")
        return IndexTable(self.spark, folder, self.definition, self.path)
