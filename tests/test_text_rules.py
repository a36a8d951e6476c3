"""Edits, synonyms, autocompletion and paths against plain Python."""

import itertools

import pytest
from pyspark.sql import functions as F

from quarrion.operators.text import within
from quarrion.plans import search as S
from quarrion.plans.definition import IndexDefinition

D = IndexDefinition(id_column="id")


def osa(a, b):
    """Optimal string alignment, by its table."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i, j in itertools.product(range(len(a)), range(len(b))):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
        if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


@pytest.mark.parametrize("word", ["the", "abab", "aabc", "acb"])
def test_edits_with_swaps(spark, word):
    texts = ["".join(x) for n in range(6) for x in itertools.product("abc", repeat=n)] if word != "the" else ["the", "hte", "teh", "eth", "het", "tihe", "th", "hote"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for edits in (0, 1, 2):
        got = {r.t: r.d for r in df.select("t", within(F.col("t"), word, edits).alias("d")).collect()}
        want = {t: (n if (n := osa(t, word)) <= edits else None) for t in texts}
        assert got == want


@pytest.fixture(scope="module")
def books(spark):
    rows = [(1, "fast car", "red", {"x": "fast"}), (2, "quick car", "blue", {"x": "a"}), (3, "rapid transit car", "fast", {"x": "b"}), (4, "slow", None, None)]
    return spark.createDataFrame(rows, "id long, text string, color string, sub struct<x: string>")


def found(docs, query, definition=D):
    return {r.id: r.score for r in S.hits(docs, query, definition).collect()}


def test_synonyms_rank_below_what_is_asked(books):
    d = IndexDefinition(id_column="id", synonyms={"s": {"fast": ["fast", "quick", "rapid transit"]}})
    got = found(books, {"text": {"path": "text", "query": "fast", "synonyms": "s"}}, d)
    assert set(got) == {1, 2, 3} and got[1] > max(got[2], got[3])
    assert set(found(books, {"text": {"path": "text", "query": "fast car", "synonyms": "s", "matchCriteria": "all"}}, d)) == {1, 2, 3}
    assert set(found(books, {"phrase": {"path": "text", "query": "fast car", "synonyms": "s"}}, d)) == {1, 2, 3}


def test_wildcard_and_multi_paths(books):
    assert set(found(books, {"text": {"path": {"wildcard": "*"}, "query": "fast"}})) == {1, 3}
    assert set(found(books, {"text": {"path": {"wildcard": "sub.*"}, "query": "fast"}})) == {1}
    d = IndexDefinition(id_column="id", fields={"text": {"type": "string", "multi": {"whole": {"analyzer": "lucene.keyword"}}}})
    assert set(found(books, {"text": {"path": {"value": "text", "multi": "whole"}, "query": "fast car"}}, d)) == {1}
    with pytest.raises(ValueError):
        found(books, {"text": {"path": {"value": "text", "multi": "none"}, "query": "x"}}, d)


def test_autocomplete_grams(books):
    d = IndexDefinition(id_column="id", fields={"text": [{"type": "string"}, {"type": "autocomplete", "minGrams": 3, "maxGrams": 4}]})
    assert found(books, {"autocomplete": {"path": "text", "query": "fa"}}, d) == {}
    assert set(found(books, {"autocomplete": {"path": "text", "query": "quic"}}, d)) == {2}
    assert set(found(books, {"autocomplete": {"path": "text", "query": "quickest"}}, d)) == {2}  # cut to four characters
    assert set(found(books, {"autocomplete": {"path": "text", "query": "car fas"}}, d)) == {1, 2, 3}
    assert set(found(books, {"autocomplete": {"path": "text", "query": "fsat", "fuzzy": {"maxEdits": 1}}}, d)) == {1}


def test_phrases_within_moves(books):
    assert set(found(books, {"phrase": {"path": "text", "query": "car fast", "slop": 1}})) == set()
    assert set(found(books, {"phrase": {"path": "text", "query": "car fast", "slop": 2}})) == {1}
    assert set(found(books, {"phrase": {"path": "text", "query": "rapid car", "slop": 1}})) == {3}


def test_filters_go_down_to_the_scan(spark, tmp_path, books):
    books.write.parquet(str(tmp_path / "b"))
    query = {"compound": {"must": [{"text": {"path": "text", "query": "fast"}}], "filter": [{"equals": {"path": "color", "value": "red"}}]}}
    plan = S.hits(spark.read.parquet(str(tmp_path / "b")), query, D)._jdf.queryExecution().toString()
    assert "EqualTo(color,red)" in plan


def test_analyzers_that_are_not_built_are_refused(books):
    with pytest.raises(NotImplementedError):
        found(books, {"text": {"path": "text", "query": "le"}}, IndexDefinition(id_column="id", analyzer="lucene.french"))
