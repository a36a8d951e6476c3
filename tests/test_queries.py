"""Every registered search against its SQL, and what must be refused."""

import duckdb
import pytest
from conftest import DATA

from quarrion.operators.querystring import parse
from quarrion.plans import search as S
from quarrion.plans.definition import IndexDefinition
from quarrion import queries_structured  # noqa: F401  adds to the registry
from quarrion.queries import ORACLES, REGISTRY

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
BOOKS = IndexDefinition(id_column="id")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def books(spark):
    rows = [(1, "The quick brown fox", ["a", "b"], 3.0), (2, "A lazy dog, a quick nap", ["b"], None), (3, None, None, 7.0), (4, "", [], 1.0)]
    return spark.createDataFrame(rows, "id long, text string, tags array<string>, n double")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    got, want = REGISTRY[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(str, got[cols].itertuples(index=False))) == sorted(map(str, want[cols].itertuples(index=False)))


def ids(found):
    return [r.id for r in found.select("id").collect()]


def test_nulls_and_empty_texts_match_nothing(books):
    assert sorted(ids(S.hits(books, {"text": {"path": "text", "query": "quick"}}, BOOKS))) == [1, 2]
    assert ids(S.hits(books, {"phrase": {"path": "text", "query": "quick brown"}}, BOOKS)) == [1]
    assert ids(S.hits(books, {"text": {"path": "absent", "query": "quick"}}, BOOKS)) == []
    assert ids(S.hits(books.limit(0), {"text": {"path": "text", "query": "quick"}}, BOOKS)) == []


def test_arrays_and_order(books):
    assert ids(S.hits(books, {"equals": {"path": "tags", "value": "a"}}, BOOKS)) == [1]
    assert ids(S.search(books, {"allDocuments": {}}, BOOKS, sort={"n": 1})) == [2, 4, 1, 3]
    assert ids(S.search(books, {"allDocuments": {}}, BOOKS, sort={"n": {"order": 1, "noData": "highest"}})) == [4, 1, 3, 2]
    assert ids(S.search(books, {"allDocuments": {}}, BOOKS, sort={"n": 1}, after=[1.0, 4])) == [1, 3]
    assert ids(S.search(books, {"allDocuments": {}}, BOOKS, sort={"n": 1}, before=[3.0, 1])) == [4, 2]


def test_highlights(books):
    found = S.highlights(books.where("id = 1"), "text", ["quick"]).first().passages
    assert [(p.value, p.type) for p in found[0]] == [("The ", "text"), ("quick", "hit"), (" brown fox", "text")]


@pytest.mark.parametrize("query", [{}, {"text": {"path": "text", "query": "x", "fuzzy": True}}, {"range": {"path": "n"}}, {"compound": {}}, {"nothing": {}}, {"geoWithin": {"path": "n"}}, {"compound": {"should": [{"exists": {"path": "n"}}], "minimumShouldMatch": 2}}])
def test_refused(books, query):
    with pytest.raises(ValueError):
        S.hits(books, query, BOOKS)


def test_query_string_syntax():
    assert parse("*:*", "t") == {"allDocuments": {}}
    assert parse('n:[1 TO 5}', "t") == {"range": {"path": "n", "gte": 1, "lt": 5}}
    assert parse('+a -"b c"~2', "t") == {"compound": {"must": [{"text": {"path": "t", "query": "a"}}], "mustNot": [{"phrase": {"path": "t", "query": "b c", "slop": 2}}]}}
    with pytest.raises(ValueError):
        parse("(a", "t")
