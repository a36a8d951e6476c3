"""Registered searches over the given tables, each with SQL that returns the same rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrion.functions.analysis import STANDARD
from quarrion.operators.vector import vector_search
from quarrion.plans import search as S
from quarrion.plans.definition import IndexDefinition
from quarrion.sources.index_table import IndexTable, shared_folder

REGISTRY, ORACLES = {}, {}
IDS = {"documents": "doc_id", "part": "p_partkey", "orders": "o_orderkey", "customer": "c_custkey", "supplier": "s_suppkey", "events": "event_id", "pages": "page_id", "embeddings": "vec_id", "nation": "n_nationkey"}
DIGITS = 5


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def index(table: str, **options) -> IndexDefinition:
    return IndexDefinition(name=table, id_column=IDS[table], **options)


def add(name: str, table: str, query: dict, sql: str, limit: int | None = None, sort: dict | None = None, after: list | None = None, prepare=None, columns=(), **options) -> None:
    """A search that returns ids and scores; sql gives the same columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = read(spark, sf_dir, table)
        docs = prepare(spark, sf_dir, docs) if prepare else docs
        definition = index(table, **options)
        if limit is None and sort is None:
            found = S.hits(docs, query, definition, DIGITS)
        else:
            found = S.search(docs, query, definition, limit, sort, after, digits=DIGITS)
        return found.select(IDS[table], *columns, "score")

    REGISTRY[name], ORACLES[name] = run, sql


_indexes: dict[tuple[str, str], IndexTable] = {}


def index_of(spark: SparkSession, sf_dir: str) -> IndexTable:
    """The index table of the documents' texts, built at its first use in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        _indexes[key] = IndexTable.build(read(spark, sf_dir, "documents"), index("documents"), "text", shared_folder(spark, "index"))
    return _indexes[key]


def indexed(name: str, search, limit: int | None = None) -> None:
    """The registered search by the index table; the scan stays under scan_<name>."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = search(index_of(spark, sf_dir)).select(F.col("id").alias("doc_id"), F.round("score", DIGITS).alias("score"))
        return found.orderBy(F.desc("score"), "doc_id").limit(limit) if limit else found

    REGISTRY[f"scan_{name}"], ORACLES[f"scan_{name}"] = REGISTRY[name], ORACLES[name]
    REGISTRY[name] = run


def bm25_sql(terms: list[str], joined: str = "OR", score: str | None = None, path: str = "text", table: str = "documents") -> str:
    """Relevance of terms in SQL: tokens by the same pattern, statistics over all documents."""
    pattern, key = STANDARD.replace("'", "''"), IDS[table]
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{k}" for k, w in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{k} > 0) AS df{k}" for k in range(len(terms)))
    part = " + ".join(f"CASE WHEN tf{k} > 0 THEN ln(1 + (n - df{k} + 0.5) / (df{k} + 0.5)) * tf{k} / (tf{k} + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) ELSE 0 END" for k in range(len(terms)))
    test = f" {joined} ".join(f"tf{k} > 0" for k in range(len(terms)))
    return (
        f"WITH d AS (SELECT {key}, list_transform(regexp_extract_all({path}, '{pattern}'), lambda x: lower(x)) AS t FROM {table}), "
        f"f AS (SELECT {key}, len(t) AS dl, {tf} FROM d), s AS (SELECT count(*) FILTER (dl > 0) AS n, sum(dl) / count(*) FILTER (dl > 0) AS avgdl, {df} FROM f) "
        f"SELECT {key}, round({score.format(part) if score else part}, {DIGITS}) AS score FROM f, s WHERE {test}"
    )


def plain(table: str, where: str, score: str = "1.0", columns: str = "") -> str:
    return f"SELECT {IDS[table]}, {columns + ', ' if columns else ''}round(CAST({score} AS DOUBLE), {DIGITS}) AS score FROM {table} WHERE {where}"


TEXT = {"path": "text"}
# --- full text ---
add("text_bm25", "documents", {"text": {**TEXT, "query": "with that from"}}, bm25_sql(["with", "that", "from"]))
add("text_bm25_top", "documents", {"text": {**TEXT, "query": "with that from"}}, bm25_sql(["with", "that", "from"]) + " ORDER BY score DESC, doc_id LIMIT 20", limit=20)
add("text_all_terms", "documents", {"text": {**TEXT, "query": "with that from", "matchCriteria": "all"}}, bm25_sql(["with", "that", "from"], "AND"))
add("text_boost", "documents", {"text": {**TEXT, "query": "this", "score": {"boost": {"value": 3}}}}, bm25_sql(["this"], score="3 * ({})"))
add("text_function_score", "documents", {"text": {**TEXT, "query": "this", "score": {"function": {"add": [{"score": "relevance"}, {"log1p": {"path": "n_chars"}}]}}}},
    bm25_sql(["this"], score="{} + log10(1 + n_chars)").replace("SELECT doc_id, list_transform", "SELECT doc_id, n_chars, list_transform").replace("SELECT doc_id, len(t)", "SELECT doc_id, n_chars, len(t)"))
add("text_boolean_similarity", "documents", {"text": {**TEXT, "query": "with that"}}, bm25_sql(["with", "that"]).replace("ln(1 + (n - df0 + 0.5) / (df0 + 0.5)) * tf0 / (tf0 + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))", "1.0").replace("ln(1 + (n - df1 + 0.5) / (df1 + 0.5)) * tf1 / (tf1 + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))", "1.0"), similarity="boolean")

_WORDS = f"""list_transform(regexp_extract_all(text, '{STANDARD.replace("'", "''")}'), lambda x: lower(x))"""


def tf_sql(parts: list[tuple[str, list[str]]], where: str | None = None, weights: list[float] | None = None, total: str | None = None) -> str:
    """Relevance from the formulas: parts are (frequency over the tokens t, conditions of the terms whose rarities add up)."""
    names = [f"CAST({tf} AS DOUBLE) AS tf{k}" for k, (tf, _) in enumerate(parts)] + [f"{c} AS r{k}_{j}" for k, (_, cs) in enumerate(parts) for j, c in enumerate(cs)]
    dfs = [f"count(*) FILTER (r{k}_{j}) AS df{k}_{j}" for k, (_, cs) in enumerate(parts) for j in range(len(cs))]
    idf = lambda k, cs: "(" + " + ".join(f"ln(1 + (n - df{k}_{j} + 0.5) / (df{k}_{j} + 0.5))" for j in range(len(cs))) + ")"
    one = [f"CASE WHEN tf{k} > 0 THEN {(weights or [1.0] * len(parts))[k]} * {idf(k, cs)} * tf{k} / (tf{k} + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) ELSE 0 END" for k, (_, cs) in enumerate(parts)]
    score = total.format(*[f"({x})" for x in one]) if total else " + ".join(one)
    return (
        f"WITH d AS (SELECT doc_id, {_WORDS} AS t FROM documents), f AS (SELECT doc_id, len(t) AS dl, {', '.join(names)} FROM d), "
        f"s AS (SELECT count(*) FILTER (dl > 0) AS n, sum(dl) / count(*) FILTER (dl > 0) AS avgdl, {', '.join(dfs)} FROM f) "
        f"SELECT doc_id, round({score}, {DIGITS}) AS score FROM f, s WHERE {where or ' OR '.join(f'tf{k} > 0' for k in range(len(parts)))}"
    )


def on_tokens(name: str, query: dict, parts, where: str | None = None, weights=None, total=None, **options) -> None:
    add(name, "documents", query, tf_sql(parts, where, weights, total), **options)


def constant(name: str, query: dict, test: str, score: str = "1.0", **options) -> None:
    add(name, "documents", query, f"SELECT doc_id, round(CAST({score} AS DOUBLE), {DIGITS}) AS score FROM (SELECT doc_id, {_WORDS} AS t FROM documents) WHERE {test}", **options)


_has = lambda w: f"list_contains(t, '{w}')"
_count = lambda w: f"len(list_filter(t, lambda x: x = '{w}'))"
_starts = lambda a, b, more="": f"list_filter(range(1, len(t)), lambda i: t[i] = '{a}' AND t[i + 1] = '{b}'{more})"


def fuzzy_sql(word: str, near: str, most: int) -> str:
    """The nearest terms of the index, each by its own frequency and the largest document frequency among them."""
    return (
        f"WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS t FROM documents), s AS (SELECT count(*) FILTER (len(t) > 0) AS n, sum(len(t)) / count(*) FILTER (len(t) > 0) AS avgdl FROM d), "
        f"f AS (SELECT r, doc_id, len(t) AS dl, x, count(*) AS tf FROM (SELECT *, unnest(t) AS x FROM d) GROUP BY ALL), "
        f"e AS (SELECT x, count(*) AS df, 1 - ({near}) / least(length(x), {len(word)}) AS w FROM f WHERE ({near}) IS NOT NULL GROUP BY x ORDER BY w DESC, x LIMIT {most}), m AS (SELECT max(df) AS df FROM e) "
        f"SELECT doc_id, round(sum(w * ln(1 + (n - m.df + 0.5) / (m.df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), {DIGITS}) AS score FROM f JOIN e USING (x), m, s GROUP BY r, doc_id"
    )


_swapped = lambda w: "(" + ", ".join(f"'{w[:i] + w[i + 1] + w[i] + w[i + 2:]}'" for i in range(len(w) - 1) if w[i] != w[i + 1]) + ")"
_near1 = lambda w: f"CASE WHEN levenshtein(x, '{w}') <= 1 THEN levenshtein(x, '{w}') WHEN x IN {_swapped(w)} THEN 1 END"
add("text_fuzzy", "documents", {"text": {**TEXT, "query": "there", "fuzzy": {"maxEdits": 1}}}, fuzzy_sql("there", _near1("there"), 50))
add("text_fuzzy_few", "documents", {"text": {**TEXT, "query": "htat", "fuzzy": {"maxEdits": 1, "maxExpansions": 3}}}, fuzzy_sql("htat", _near1("htat"), 3))
add("term_fuzzy", "documents", {"term": {**TEXT, "query": "there", "fuzzy": {"maxEdits": 1, "prefixLength": 2}}},
    fuzzy_sql("there", "CASE WHEN starts_with(x, 'th') AND levenshtein(x[3:], 'ere') <= 1 THEN levenshtein(x[3:], 'ere') WHEN x IN ('theer', 'three') THEN 1 END", 256))
_with = [(_count(w), [_has(w)]) for w in ("with", "avec", "mit", "from")]
on_tokens("text_synonyms", {"text": {**TEXT, "query": "with from", "synonyms": "s"}}, _with, total="greatest(2 * {0}, {1}, {2}) + 0.1 * (2 * {0} + {1} + {2} - greatest(2 * {0}, {1}, {2})) + {3} + 2 * ({0} + {3})", synonyms={"s": {"with": ["with", "avec", "mit"]}})
on_tokens("text_synonyms_explicit", {"text": {**TEXT, "query": "with", "synonyms": "s", "matchCriteria": "all"}}, [(_count("avec"), [_has("avec")]), (f"len({_starts('of', 'the')})", [_has("of"), _has("the")]), (_count("with"), [_has("with")])],
          total="greatest({0}, {1}) + 0.1 * least({0}, {1}) + 2 * {2}", synonyms={"s": {"with": ["avec", "of the"]}})
on_tokens("phrase", {"phrase": {**TEXT, "query": "of the"}}, [(f"len({_starts('of', 'the')})", [_has("of"), _has("the")])])
_moves = "list_min(list_transform(list_filter(range(greatest(1, i - 1), i + 4), lambda j: t[j] = 'the'), lambda j: abs(j - i - 1)))"
on_tokens("phrase_slop", {"phrase": {**TEXT, "query": "of the", "slop": 2}}, [(f"coalesce(list_sum(list_transform(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'of'), lambda i: coalesce(1 / (1 + {_moves}), 0))), 0)", [_has("of"), _has("the")])])
constant("term_prefix", {"term": {**TEXT, "query": "fro", "prefix": True}}, "len(list_filter(t, lambda x: starts_with(x, 'fro'))) > 0")
constant("term_wildcard", {"term": {**TEXT, "query": "th?re*", "wildcard": True}}, "len(list_filter(t, lambda x: regexp_full_match(x, 'th.re.*'))) > 0")
constant("term_regex", {"term": {**TEXT, "query": "(un|en)tion.?", "regex": True}}, "len(list_filter(t, lambda x: regexp_full_match(x, '(un|en)tion.?'))) > 0")
on_tokens("term_exact", {"term": {**TEXT, "query": "with"}}, [(_count("with"), [_has("with")])])
on_tokens("search_terms", {"search": {**TEXT, "query": "with from"}}, [(_count(w), [_has(w)]) for w in ("with", "from")])
on_tokens("search_phrase", {"search": {**TEXT, "phrase": {"query": "of the", "slop": 0}}}, [(f"len({_starts('of', 'the')})", [_has("of"), _has("the")])])
add("search_phrase_prefix", "documents", {"search": {**TEXT, "phrase": {"query": "of th", "prefix": True, "maxExpansions": 3}}},
    f"WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS t FROM documents), s AS (SELECT count(*) FILTER (len(t) > 0) AS n, sum(len(t)) / count(*) FILTER (len(t) > 0) AS avgdl, count(*) FILTER (list_contains(t, 'of')) AS df0 FROM d), "
    f"e AS (SELECT x, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS x FROM d) WHERE starts_with(x, 'th') GROUP BY x ORDER BY x LIMIT 3), f AS (SELECT r, doc_id, len(t) AS dl, df, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = x)) AS tf FROM d, e) "
    f"SELECT doc_id, round(sum((ln(1 + (n - df0 + 0.5) / (df0 + 0.5)) + ln(1 + (n - df + 0.5) / (df + 0.5))) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), {DIGITS}) AS score FROM f, s WHERE tf > 0 GROUP BY r, doc_id")  # fmt: skip
_begin = lambda w: f"len(list_filter(t, lambda x: starts_with(x, '{w}'))) > 0"
on_tokens("autocomplete_any", {"autocomplete": {**TEXT, "query": "fro with"}}, [(_count("fro"), [_has("fro")]), (_count("with"), [_has("with")])], f"b0 OR b1 OR b2", total="{0} + {1} + b0::INT + b1::INT + b2::INT")
ORACLES["autocomplete_any"] = ORACLES["autocomplete_any"].replace("len(t) AS dl,", f"len(t) AS dl, {_begin('fro')} AS b0, {_begin('with')} AS b1, len(list_filter(range(1, len(t)), lambda i: t[i] = 'fro' AND starts_with(t[i + 1], 'with'))) > 0 AS b2,")
on_tokens("autocomplete_sequential", {"autocomplete": {**TEXT, "query": "of th", "tokenOrder": "sequential"}}, [(f"len({_starts('of', 'th')})", [_has("of"), _has("th")])], "b", total="{0} + 1")
ORACLES["autocomplete_sequential"] = ORACLES["autocomplete_sequential"].replace("len(t) AS dl,", "len(t) AS dl, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND starts_with(t[i + 1], 'th'))) > 0 AS b,")
constant("autocomplete_fuzzy", {"autocomplete": {**TEXT, "query": "attent", "fuzzy": {"maxEdits": 1, "prefixLength": 1}}},
         "len(list_filter(t, lambda x: starts_with(x, 'a') AND len(list_filter([4, 5, 6], lambda n: length(x) > n AND (levenshtein(x[2:n + 1], 'ttent') <= 1 OR x[2:n + 1] IN " + _swapped("ttent") + "))) > 0)) > 0 AND NOT list_contains(t, 'attent')")
_term = lambda w: {"term": {**TEXT, "query": w}}
_near = lambda a, b: f"list_transform(list_filter(range(1, len(t) + 1), lambda i: t[i] = '{a}'), lambda i: coalesce(list_sum(list_transform(list_filter(range(i + 1, least(i + 5, len(t) + 1)), lambda j: t[j] = '{b}'), lambda j: 1 / (j - i))), 0))"
on_tokens("span_near", {"span": {"near": {"clauses": [_term("from"), _term("with")], "slop": 3}}}, [(f"coalesce(list_sum({_near('from', 'with')}), 0) + coalesce(list_sum({_near('with', 'from')}), 0)", [_has("from"), _has("with")])])
on_tokens("span_first", {"span": {"first": {"operator": _term("the"), "endPositionLte": 5}}}, [("len(list_filter(t[1:5], lambda x: x = 'the'))", [_has("the")])])
on_tokens("span_or", {"span": {"or": {"clauses": [_term("from"), _term("avec")]}}}, [("len(list_filter(t, lambda x: x IN ('from', 'avec')))", [_has("from"), _has("avec")])])
on_tokens("span_term_boost", {"span": {**_term("from"), "score": {"boost": {"value": 2}}}}, [(_count("from"), [_has("from")])], weights=[2.0])
on_tokens("span_subtract", {"span": {"subtract": {"include": {"near": {"clauses": [_term("of"), _term("the")], "inOrder": True}}, "exclude": {"first": {"operator": _term("the"), "endPositionLte": 50}}}}}, [(f"len({_starts('of', 'the', ' AND i + 1 > 50')})", [_has("of"), _has("the")])])
on_tokens("span_contains", {"span": {"contains": {"big": {"near": {"clauses": [_term("of"), _term("the")], "inOrder": True, "slop": 1}}, "little": _term("that"), "spanToReturn": "inner"}}}, [("len(list_filter(range(1, len(t) - 1), lambda i: t[i] = 'of' AND t[i + 1] = 'that' AND t[i + 2] = 'the'))", [_has("of"), _has("the"), _has("that")])])
on_tokens("query_string", {"queryString": {"defaultPath": "text", "query": '(with OR avec) AND -"of the"'}}, [(_count(w), [_has(w)]) for w in ("with", "avec")], "(tf0 > 0 OR tf1 > 0) AND NOT p")
ORACLES["query_string"] = ORACLES["query_string"].replace("len(t) AS dl,", f"len(t) AS dl, len({_starts('of', 'the')}) > 0 AS p,")
on_tokens("more_like_this", {"moreLikeThis": {"like": {"text": "attention from attention"}}}, [(_count(w), [_has(w)]) for w in ("attention", "from")], "(tf0 > 0 AND df0_0 > 1) OR (tf1 > 0 AND df1_0 > 1)", total="CASE WHEN df0_0 > 1 THEN {0} ELSE 0 END + CASE WHEN df1_0 > 1 THEN {1} ELSE 0 END")
on_tokens("multi_path_wildcard", {"text": {"path": {"wildcard": "te*t"}, "query": "with"}}, [(_count("with"), [_has("with")])])
constant("stable_tfl", {"text": {**TEXT, "query": "with"}}, _has("with"), f"ln(1 + (1 - p + 0.05) / (p + 0.05)) * {_count('with')} / ({_count('with')} + 1.2)", similarity="stableTfl")
ORACLES["stable_tfl"] = ORACLES["stable_tfl"].replace(f"SELECT doc_id, {_WORDS} AS t FROM documents", f"SELECT *, 1 - pow(1 - 0.00781 * pow(2, -0.917 * 4), len(t)) AS p FROM (SELECT doc_id, {_WORDS} AS t FROM documents)")


def _like_document(spark, sf_dir):
    """Texts like the first one that is not blank, the whole of it given."""
    docs = read(spark, sf_dir, "documents")
    given = docs.where("trim(text) <> ''").orderBy("doc_id", "text").first()
    return S.hits(docs, {"moreLikeThis": {"like": {"text": given.text if given else ""}}}, index("documents"), DIGITS).select("doc_id", "score")


REGISTRY["more_like_document"] = _like_document
ORACLES["more_like_document"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, list_transform(regexp_extract_all(text, '{STANDARD.replace("'", "''")}'), lambda x: lower(x)) AS t FROM documents),
s AS (SELECT count(*) AS docs, count(*) FILTER (len(t) > 0) AS n, sum(len(t)) / count(*) FILTER (len(t) > 0) AS avgdl FROM d),
g AS (SELECT w, count(*) AS gf FROM (SELECT unnest(t) AS w FROM (SELECT t FROM d WHERE trim(text) <> '' ORDER BY doc_id, text LIMIT 1)) GROUP BY w),
f AS (SELECT r, doc_id, len(t) AS dl, w, count(*) AS tf FROM (SELECT r, doc_id, t, unnest(t) AS w FROM d) GROUP BY ALL),
k AS (SELECT w, df FROM g JOIN (SELECT w, count(*) AS df FROM f GROUP BY w) USING (w), s WHERE df >= 2 ORDER BY gf * (ln((docs + 1) / (df + 1)) + 1) DESC, w LIMIT 25)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), {DIGITS}) AS score FROM f JOIN k USING (w), s GROUP BY r, doc_id"""
on_tokens("hit_within_clauses", {"compound": {"must": {"text": {**TEXT, "query": "with"}}, "mustNot": {"text": {**TEXT, "query": "from"}}}}, [(_count("with"), [_has("with")])], "tf0 > 0 AND NOT b")
ORACLES["hit_within_clauses"] = ORACLES["hit_within_clauses"].replace("len(t) AS dl,", f"len(t) AS dl, {_has('from')} AS b,")
on_tokens("text_filtered", {"compound": {"must": [{"text": {**TEXT, "query": "with"}}], "filter": [{"equals": {"path": "lang", "value": "en"}}]}}, [(_count("with"), [_has("with")])], "tf0 > 0 AND lang = 'en'")
ORACLES["text_filtered"] = ORACLES["text_filtered"].replace("SELECT doc_id, list_transform", "SELECT doc_id, lang, list_transform").replace("SELECT doc_id, len(t)", "SELECT doc_id, lang, len(t)")

indexed("text_bm25", lambda t: t.text("with that from"))
indexed("text_bm25_top", lambda t: t.text("with that from"), limit=20)
indexed("text_all_terms", lambda t: t.text("with that from", "all"))
indexed("text_fuzzy", lambda t: t.text("there", fuzzy={"maxEdits": 1}))
indexed("phrase", lambda t: t.phrase("of the"))
indexed("phrase_slop", lambda t: t.phrase("of the", 2))
indexed("term_exact", lambda t: t.term("with"))
indexed("term_prefix", lambda t: t.term("fro", "prefix"))
indexed("term_wildcard", lambda t: t.term("th?re*", "wildcard"))
indexed("term_regex", lambda t: t.term("(un|en)tion.?", "regex"))

# --- typed predicates ---
add("all_documents", "nation", {"allDocuments": {}}, plain("nation", "true"))
add("equals_string", "orders", {"equals": {"path": "o_orderstatus", "value": "P"}}, plain("orders", "o_orderstatus = 'P'"))
add("equals_number", "part", {"equals": {"path": "p_size", "value": 7}}, plain("part", "p_size = 7"))
add("equals_type_bracket", "part", {"equals": {"path": "p_size", "value": "7"}}, plain("part", "false"))
add("in_numbers", "customer", {"in": {"path": "c_nationkey", "value": [1, 5, 9]}}, plain("customer", "c_nationkey IN (1, 5, 9)"))
add("range_numbers", "orders", {"range": {"path": "o_totalprice", "gte": 100000, "lt": 150000.5}}, plain("orders", "o_totalprice >= 100000 AND o_totalprice < 150000.5"))
add("range_dates", "orders", {"range": {"path": "o_orderdate", "gt": datetime(1995, 1, 1), "lte": datetime(1996, 6, 30)}}, plain("orders", "o_orderdate > TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-06-30'"))
add("range_strings", "supplier", {"range": {"path": "s_name", "gte": "Supplier#000000003", "lt": "Supplier#000000020"}}, plain("supplier", "s_name >= 'Supplier#000000003' AND s_name < 'Supplier#000000020'"))
add("range_paths", "part", {"range": {"path": ["p_size", "p_partkey"], "lt": 10}}, plain("part", "p_size < 10 OR p_partkey < 10", "(p_size < 10)::INT + (p_partkey < 10)::INT"))
add("path_boost", "part", {"equals": {"path": "p_size", "value": 7, "score": {"boost": {"path": "p_retailprice", "undefined": 1}}}}, plain("part", "p_size = 7", "p_retailprice"))
add("constant_score", "part", {"range": {"path": "p_size", "lt": 7, "score": {"constant": {"value": 4.5}}}}, plain("part", "p_size < 7", "4.5"))
add("exists", "documents", {"exists": {"path": "source"}}, plain("documents", "source IS NOT NULL"))
add("near_number", "customer", {"near": {"path": "c_acctbal", "origin": 500, "pivot": 100}}, plain("customer", "c_acctbal IS NOT NULL", "100 / (100 + abs(c_acctbal - 500))"))
add("near_date", "orders", {"near": {"path": "o_orderdate", "origin": datetime(1995, 6, 1), "pivot": 86400000}}, plain("orders", "o_orderdate IS NOT NULL", "86400000 / (86400000 + abs(epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1995-06-01')))"))
add("wildcard_value", "supplier", {"wildcard": {"path": "s_name", "query": "*#0000000?1"}}, plain("supplier", "regexp_full_match(s_name, '.*#0000000.1')"))
add("regex_value", "part", {"regex": {"path": "p_brand", "query": "Brand.[12][0-4]"}}, plain("part", "regexp_full_match(p_brand, 'Brand.[12][0-4]')"))

# --- composition ---
add("compound_all_clauses", "orders",
    {"compound": {"must": [{"range": {"path": "o_totalprice", "gt": 50000}}], "filter": [{"equals": {"path": "o_orderstatus", "value": "F"}}], "mustNot": [{"equals": {"path": "o_orderpriority", "value": "5-LOW"}}],
                  "should": [{"equals": {"path": "o_orderpriority", "value": "1-URGENT", "score": {"boost": {"value": 2}}}}, {"range": {"path": "o_totalprice", "gt": 300000}}]}},
    plain("orders", "o_totalprice > 50000 AND o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'", "1 + CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 0 END + CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END"))
add("compound_minimum_should", "part",
    {"compound": {"should": [{"range": {"path": "p_size", "gt": 20}}, {"equals": {"path": "p_type", "value": "ECONOMY"}}, {"range": {"path": "p_retailprice", "gt": 950}}], "minimumShouldMatch": 2}},
    plain("part", "(p_size > 20)::INT + (p_type = 'ECONOMY')::INT + (p_retailprice > 950)::INT >= 2", "(p_size > 20)::INT + (p_type = 'ECONOMY')::INT + (p_retailprice > 950)::INT"))
add("compound_dismax", "customer",
    {"compound": {"should": [{"near": {"path": "c_acctbal", "origin": 500, "pivot": 100}}, {"near": {"path": "c_nationkey", "origin": 3, "pivot": 1}}], "score": {"dismax": {"tieBreakerScore": 0.25}}}},
    plain("customer", "c_acctbal IS NOT NULL OR c_nationkey IS NOT NULL", "greatest(100 / (100 + abs(c_acctbal - 500)), 1 / (1 + abs(c_nationkey - 3))) + 0.25 * least(100 / (100 + abs(c_acctbal - 500)), 1 / (1 + abs(c_nationkey - 3)))"))
add("must_not_only", "part", {"compound": {"mustNot": {"equals": {"path": "p_type", "value": "ECONOMY"}}}}, plain("part", "p_type <> 'ECONOMY'", "0"))
add("gauss_score", "customer", {"exists": {"path": "c_acctbal", "score": {"function": {"gauss": {"path": "c_acctbal", "origin": 1000, "scale": 500, "offset": 100, "decay": 0.4}}}}},
    plain("customer", "c_acctbal IS NOT NULL", "exp(greatest(0, abs(c_acctbal - 1000) - 100) ** 2 * ln(0.4) / 500 ** 2)"))


def nested(spark, sf_dir, docs):
    """Orders with their lines as an array."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag")).alias("lines"))
    return docs.join(lines, docs.o_orderkey == lines.l_orderkey, "left")


for how, sql in (("sum", "count(*)"), ("mean", "1")):
    add(f"embedded_{how}", "orders",
        {"embeddedDocument": {"path": "lines", "operator": {"compound": {"filter": [{"equals": {"path": "lines.l_returnflag", "value": "R"}}], "must": [{"range": {"path": "lines.l_quantity", "gt": 40}}]}}, "score": {"embedded": {"aggregate": how}}}},
        f"SELECT l_orderkey AS o_orderkey, CAST({sql} AS DOUBLE) AS score FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND l_quantity > 40 GROUP BY l_orderkey", prepare=nested)

# --- geometry: points from keys ---
_LON, _LAT = "(c_custkey * 37 % 360 - 180)", "(c_custkey * 53 % 180 - 90)"
points = lambda spark, sf_dir, docs: docs.withColumn("at", F.struct(F.expr(_LON).cast("double").alias("lon"), F.expr(_LAT).cast("double").alias("lat")))
_FAR = f"2 * 6371008.7714 * asin(least(1, sqrt(sin((radians(48) - radians({_LAT})) / 2) ** 2 + cos(radians({_LAT})) * cos(radians(48)) * sin(radians(2 - {_LON}) / 2) ** 2)))"
add("geo_box", "customer", {"geoWithin": {"path": "at", "box": {"bottomLeft": {"coordinates": [170, -20]}, "topRight": {"coordinates": [-150, 40]}}}}, plain("customer", f"({_LON} >= 170 OR {_LON} <= -150) AND {_LAT} BETWEEN -20 AND 40"), prepare=points)
add("geo_circle", "customer", {"geoWithin": {"path": "at", "circle": {"center": {"coordinates": [2, 48]}, "radius": 3000000}}}, plain("customer", f"{_FAR} <= 3000000"), prepare=points)
add("geo_near", "customer", {"near": {"path": "at", "origin": {"type": "Point", "coordinates": [2, 48]}, "pivot": 100000}}, plain("customer", "true", f"100000 / (100000 + {_FAR})"), prepare=points)
add("geo_polygon", "customer", {"geoWithin": {"path": "at", "geometry": {"type": "Polygon", "coordinates": [[[-50.5, -30.5], [60.5, -30.5], [60.5, 20.5], [-50.5, 20.5], [-50.5, -30.5]]]}}}, plain("customer", f"{_LON} BETWEEN -50 AND 60 AND {_LAT} BETWEEN -30 AND 20"), prepare=points)

# --- order, pages, counts ---
add("sort_fields", "orders", {"equals": {"path": "o_orderstatus", "value": "O"}}, plain("orders", "o_orderstatus = 'O'") + " ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50", limit=50, sort={"o_orderpriority": 1, "o_totalprice": -1})
add("search_after", "orders", {"allDocuments": {}}, plain("orders", "o_orderpriority > '2-HIGH' OR (o_orderpriority = '2-HIGH' AND o_orderkey > 100)") + " ORDER BY o_orderpriority, o_orderkey LIMIT 25", limit=25, sort={"o_orderpriority": 1}, after=["2-HIGH", 100])


def _count(spark, sf_dir):
    return S.count(read(spark, sf_dir, "orders"), {"range": {"path": "o_totalprice", "gt": 200000}}, index("orders"))


REGISTRY["count_total"], ORACLES["count_total"] = _count, "SELECT count(*) AS count FROM orders WHERE o_totalprice > 200000"

FACETED = {"compound": {"filter": [{"range": {"path": "o_totalprice", "gt": 100000, "doesNotAffect": "price"}}, {"in": {"path": "o_orderstatus", "value": ["F", "O"], "doesNotAffect": ["status"]}}]}}
FACETS = {"status": {"type": "string", "path": "o_orderstatus", "numBuckets": 2}, "price": {"type": "number", "path": "o_totalprice", "boundaries": [0, 100000, 200000], "default": "more"},
          "year": {"type": "date", "path": "o_orderdate", "boundaries": [datetime(1994, 1, 1), datetime(1995, 1, 1), datetime(1996, 1, 1)]}}
REGISTRY["facets_drill_sideways"] = lambda spark, sf_dir: S.facets(read(spark, sf_dir, "orders"), FACETED, index("orders"), FACETS)
ORACLES["facets_drill_sideways"] = """
SELECT * FROM (SELECT 'status' AS facet, o_orderstatus AS bucket, count(*) AS count FROM orders WHERE o_totalprice > 100000 GROUP BY 2 ORDER BY count DESC, bucket LIMIT 2)
UNION ALL SELECT 'price', CASE WHEN o_totalprice >= 0 AND o_totalprice < 100000 THEN '0' WHEN o_totalprice >= 100000 AND o_totalprice < 200000 THEN '100000' ELSE 'more' END AS b, count(*) FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY b
UNION ALL SELECT 'year', CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN '1994-01-01 00:00:00' ELSE '1995-01-01 00:00:00' END AS b, count(*) FROM orders
WHERE o_totalprice > 100000 AND o_orderstatus IN ('F', 'O') AND o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY b"""

# --- vectors ---
QUERY_VECTOR = [((k * 7) % 13 - 6) / 10 for k in range(64)]
_Q = "[" + ", ".join(map(str, QUERY_VECTOR)) + "]::DOUBLE[]"
_E = "embedding::DOUBLE[]"
_NORM = sum(x * x for x in QUERY_VECTOR) ** 0.5
VECTOR_SQL = {
    "cosine": f"(1 + list_dot_product({_E}, {_Q}) / (sqrt(list_dot_product({_E}, {_E})) * {_NORM!r})) / 2",
    "dotProduct": f"(1 + list_dot_product({_E}, {_Q})) / 2",
    "euclidean": f"1 / (1 + list_distance({_E}, {_Q}) ** 2)",
}
for kind, sql in VECTOR_SQL.items():
    REGISTRY[f"vector_{kind}"] = lambda spark, sf_dir, kind=kind: vector_search(
        read(spark, sf_dir, "embeddings"), {"path": "embedding", "queryVector": QUERY_VECTOR, "limit": 25, "exact": True, "filter": {"label": {"$gte": 2}, "$nor": [{"label": {"$in": [3]}}]}}, index("embeddings"), kind, DIGITS
    ).select("vec_id", "score")
    ORACLES[f"vector_{kind}"] = f"SELECT vec_id, round({sql}, {DIGITS}) AS score FROM embeddings WHERE len(embedding) = 64 AND list_dot_product({_E}, {_E}) > 0 AND label >= 2 AND label <> 3 ORDER BY score DESC, vec_id LIMIT 25"
REGISTRY["vector_bits_rescored"] = lambda spark, sf_dir: vector_search(read(spark, sf_dir, "embeddings"), {"path": "embedding", "queryVector": QUERY_VECTOR, "limit": 10, "numCandidates": 200}, index("embeddings"), "cosine", DIGITS).select("vec_id", "score")
