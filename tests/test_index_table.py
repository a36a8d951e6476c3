"""Index tables against scans, their pruning, and their upkeep by a stream of changes."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrion.plans import search as S
from quarrion.plans.definition import IndexDefinition
from quarrion.sources.index_table import IndexTable, grouped_positions
from quarrion.streaming import upkeep

D = IndexDefinition(id_column="doc_id")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def table(docs, tmp_path_factory):
    return IndexTable.build(docs, D, "text", str(tmp_path_factory.mktemp("index")))


def scored(found, id_column="doc_id"):
    return {r[id_column]: round(r.score, 6) for r in found.select(id_column, "score").collect()}


@pytest.mark.parametrize("query, indexed", [
    ({"text": {"query": "with that from"}}, lambda t: t.text("with that from")),
    ({"text": {"query": "with that from", "matchCriteria": "all"}}, lambda t: t.text("with that from", "all")),
    ({"text": {"query": "htere", "fuzzy": {"maxEdits": 1}}}, lambda t: t.text("htere", fuzzy={"maxEdits": 1})),
    ({"phrase": {"query": "of the"}}, lambda t: t.phrase("of the")),
    ({"phrase": {"query": "of the", "slop": 2}}, lambda t: t.phrase("of the", 2)),
    ({"term": {"query": "with"}}, lambda t: t.term("with")),
    ({"term": {"query": "fro", "prefix": True}}, lambda t: t.term("fro", "prefix")),
    ({"term": {"query": "th?re*", "wildcard": True}}, lambda t: t.term("th?re*", "wildcard")),
    ({"term": {"query": "(un|en)tion.?", "regex": True}}, lambda t: t.term("(un|en)tion.?", "regex")),
])
def test_as_the_scan(docs, table, query, indexed):
    (name, spec), = query.items()
    want = scored(S.hits(docs, {name: {"path": "text", **spec}}, D))
    assert scored(indexed(table), "id") == want and want


def test_a_search_reads_its_own_terms(table):
    plan = table.text("with that")._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [that,with])" in plan.replace("PushedFilters: [", "") or "In(term" in plan


def test_upkeep_by_a_stream(spark, docs, tmp_path):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    folder, changes = str(tmp_path / "index"), str(tmp_path / "changes")
    start = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").orderBy("doc_id").limit(60)
    IndexTable.build(start, D, "text", folder)
    gone = start.orderBy("doc_id").first().doc_id
    made = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, op string, at long").coalesce(1).write.mode("append").parquet(changes)
    made([(900001, "zebra zebra with", "insert", 1), (900002, "zebra", "insert", 2), (900002, "okapi", "update", 3), (gone, None, "delete", 4), (None, "zebra", "insert", 5)])
    run = lambda: upkeep.maintain(upkeep.read_changes(spark, changes, schema), D, "text", folder, str(tmp_path / "checkpoint")).awaitTermination()
    run()
    made([(900001, "okapi", "replace", 6), (900002, None, "delete", 7), (900003, "zebra with", "insert", 8)])
    run()
    run()  # nothing new
    now = start.where(F.col("doc_id") != gone).unionByName(spark.createDataFrame([(900001, "okapi"), (900003, "zebra with")], schema))
    table = upkeep.current(spark, D, "text", folder)
    for query in ("zebra with", "okapi", "that"):
        want = scored(S.hits(now, {"text": {"path": "text", "query": query}}, D))
        assert scored(table.text(query), "id") == want
        assert scored(table.compact(str(tmp_path / f"compact-{query}")).text(query), "id") == want


def test_a_text_of_one_long_phrase(spark, tmp_path):
    """Every place of a term is compared with its nearest ones, not with all."""
    docs = spark.createDataFrame([(1, "of the " * 60_000), (2, "the of"), (3, None)], "doc_id long, text string")
    table = IndexTable.build(docs, D, "text", str(tmp_path / "index"))
    loose, strict = scored(table.phrase("of the", 2), "id"), scored(table.phrase("of the"), "id")
    assert loose[1] == strict[1] and set(loose) == {1, 2} and set(strict) == {1}
    assert {r.id: r.length for r in table.latest.collect()} == {1: 120_000, 2: 2, 3: 0}


def test_places_by_document_and_term():
    import pyarrow as pa

    lists = [["b", "a", None, "b"], None, [], ["a"], [None], ["c", "c", "b"]]
    owner, terms, places, length = grouped_positions(pa.array(lists, pa.list_(pa.string())))
    got = dict(zip(zip(owner.tolist(), terms.to_pylist()), places.to_pylist(), strict=True))
    assert got == {(k, t): [i for i, x in enumerate(row) if x == t] for k, row in enumerate(lists) if row for t in set(row) - {None}}
    assert length.tolist() == [3, 0, 0, 1, 0, 3]
