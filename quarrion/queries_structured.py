"""Registered searches over vectors, nested documents and shapes, and of every analysis component, each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrion.functions import vectors
from quarrion.functions.analysis import custom
from quarrion.operators.vector import bit_search, filtered, knn_beta, nested_vector_search, vector_search
from quarrion.plans import search as S
from quarrion.plans.definition import IndexDefinition
from quarrion.queries import _LAT, _LON, DIGITS, IDS, ORACLES, QUERY_VECTOR, REGISTRY, VECTOR_SQL, add, index, nested, plain, read


def both(name: str, run, sql: str) -> None:
    REGISTRY[name], ORACLES[name] = run, sql


# --- vectors ---
BY_OPERATOR = {"compound": {"filter": [{"range": {"path": "label", "gte": 2}}], "mustNot": [{"equals": {"path": "label", "value": 3}}]}}
both("vector_operator_filter", lambda spark, sf_dir: vector_search(read(spark, sf_dir, "embeddings"), {"path": "embedding", "queryVector": QUERY_VECTOR, "limit": 25, "exact": True, "filter": BY_OPERATOR}, index("embeddings"), "cosine", DIGITS).select("vec_id", "score"), ORACLES["vector_cosine"])
both("knn_beta", lambda spark, sf_dir: knn_beta(read(spark, sf_dir, "embeddings"), {"path": ["embedding", "embedding"], "vector": QUERY_VECTOR, "k": 15, "filter": {"label": {"$gte": 2}}}, index("embeddings"), "dotProduct", DIGITS),
     f"SELECT vec_id, round(2 * ({VECTOR_SQL['dotProduct']}), {DIGITS}) AS score FROM embeddings WHERE len(embedding) = 64 AND label >= 2 ORDER BY score DESC, vec_id LIMIT 15")


def families(spark, sf_dir):
    """Vectors by ten as nested documents of one parent."""
    rows = read(spark, sf_dir, "embeddings").withColumn("family", F.floor(F.col("vec_id") / 10).cast("long"))
    return rows.groupBy("family").agg(F.max("label").alias("top"), F.collect_list(F.struct("vec_id", "label", "embedding")).alias("parts"))


NESTED = {"path": "parts.embedding", "queryVector": QUERY_VECTOR, "limit": 20, "filter": {"parts.label": {"$gte": 4}}, "parentFilter": {"top": {"$lt": 9}}}
FAMILY = IndexDefinition(name="families", id_column="family")
SCORED = f"WITH v AS (SELECT vec_id // 10 AS family, label, {VECTOR_SQL['cosine']} AS s, max(label) OVER (PARTITION BY vec_id // 10) AS top FROM embeddings) SELECT family, round({{}}, {DIGITS}) AS score FROM v WHERE top < 9 GROUP BY family HAVING max(label) >= 4 ORDER BY score DESC, family LIMIT 20"
both("nested_vector_max", lambda spark, sf_dir: nested_vector_search(families(spark, sf_dir), NESTED, FAMILY, "cosine", DIGITS).select("family", "score"), SCORED.format("max(s) FILTER (label >= 4)"))
both("nested_vector_avg", lambda spark, sf_dir: nested_vector_search(families(spark, sf_dir), {**NESTED, "nestedOptions": {"scoreMode": "avg"}}, FAMILY, "cosine", DIGITS).select("family", "score"), SCORED.format("avg(s)"))
BITS = [123456789, 3987654321]


def packed(word: int) -> str:
    return f"list_sum(list_transform(range(32), lambda k: CASE WHEN embedding[{32 * word} + k + 1] > 0 THEN (1::BIGINT << (31 - k)::INT) ELSE 0 END))::BIGINT"


both("bit_vectors", lambda spark, sf_dir: bit_search(read(spark, sf_dir, "embeddings").withColumn("bits", vectors.signs(F.col("embedding"))), {"path": "bits", "queryVector": BITS, "dim": 64, "limit": 25, "filter": {"label": {"$ne": 3}}}, index("embeddings"), DIGITS).select("vec_id", "score"),
     f"SELECT vec_id, round((64 - bit_count(xor({packed(0)}, {BITS[0]}::BIGINT)) - bit_count(xor({packed(1)}, {BITS[1]}::BIGINT))) / 64.0::DOUBLE, {DIGITS}) AS score FROM embeddings WHERE label <> 3 ORDER BY score DESC, vec_id LIMIT 25")
BYTES = [(k * 11) % 127 - 63 for k in range(64)]


def byte_scores(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("tinyint")).alias("v"))
    return rows.select("vec_id", F.round(vectors.byte_score(F.col("v"), BYTES, "dotProduct"), DIGITS).alias("score"))


both("byte_vectors", byte_scores, f"SELECT vec_id, round(0.5 + list_dot_product(list_transform(embedding, lambda x: floor(x::DOUBLE * 100)), {BYTES}::DOUBLE[]) / (64 * 32768.0::DOUBLE), {DIGITS}) AS score FROM embeddings")

# --- nested documents, comparisons, details, scopes ---
RETURNED = {"equals": {"path": "lines.l_returnflag", "value": "R"}}
LARGE = {"range": {"path": "o_totalprice", "gt": 150000}}
for how, fold in (("maximum", "max"), ("minimum", "min")):
    add(f"embedded_{how}", "orders", {"embeddedDocument": {"path": "lines", "operator": {"near": {"path": "lines.l_quantity", "origin": 25, "pivot": 5}}, "score": {"embedded": {"aggregate": how}}}},
        f"SELECT l_orderkey AS o_orderkey, round({fold}(5 / (5 + abs(l_quantity - 25))), {DIGITS}) AS score FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey", prepare=nested)
ROOTED = "SELECT l_orderkey AS o_orderkey, CAST({} AS DOUBLE) AS score FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND o_totalprice > 150000 GROUP BY l_orderkey"
add("has_root", "orders", {"embeddedDocument": {"path": "lines", "operator": {"compound": {"must": [RETURNED], "filter": [{"hasRoot": {"operator": LARGE}}]}}}}, ROOTED.format("count(*)"), prepare=nested)
add("has_ancestor", "orders", {"embeddedDocument": {"path": "lines", "operator": {"compound": {"filter": [RETURNED], "must": [{"hasAncestor": {"ancestorPath": "", "operator": LARGE}}]}}}}, ROOTED.format("count(*)"), prepare=nested)
add("embedded_same_root", "orders", {"compound": {"must": [{"embeddedDocument": {"path": "lines", "operator": RETURNED}}, LARGE]}}, ROOTED.format("count(*) + 1"), prepare=nested)
both("return_scope", lambda spark, sf_dir: S.scoped_hits(nested(spark, sf_dir, read(spark, sf_dir, "orders")), {"compound": {"filter": [RETURNED], "must": [{"near": {"path": "lines.l_quantity", "origin": 25, "pivot": 5}}]}}, index("orders"), "lines", DIGITS).select("o_orderkey", F.col("element.l_linenumber").alias("l_linenumber"), "score"),
     f"SELECT o_orderkey, l_linenumber, round(5 / (5 + abs(l_quantity - 25)), {DIGITS}) AS score FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'")
COMPARED = {
    "mql_ne_nin": ({"o_orderstatus": {"$ne": "F"}, "o_orderpriority": {"$nin": ["5-LOW", "1-URGENT"]}}, "o_orderstatus <> 'F' AND o_orderpriority NOT IN ('5-LOW', '1-URGENT')"),
    "mql_not_range": ({"o_totalprice": {"$not": {"$gt": 100000, "$lte": 200000}}}, "NOT (o_totalprice > 100000 AND o_totalprice <= 200000)"),
    "mql_exists_or": ({"$or": [{"o_absent": {"$exists": True}}, {"o_totalprice": {"$lt": 20000}}, {"$and": [{"o_orderstatus": "P"}, {"o_totalprice": {"$gte": 300000}}]}]}, "o_totalprice < 20000 OR (o_orderstatus = 'P' AND o_totalprice >= 300000)"),
}
for name, (conditions, sql) in COMPARED.items():
    both(name, lambda spark, sf_dir, f=conditions: filtered(read(spark, sf_dir, "orders"), f, index("orders")).select("o_orderkey"), f"SELECT o_orderkey FROM orders WHERE {sql}")
CLAUSES = {"compound": {"must": [{"range": {"path": "o_totalprice", "gt": 50000}}], "should": [{"equals": {"path": "o_orderpriority", "value": "1-URGENT", "score": {"boost": {"value": 2}}}}]}}
both("score_details", lambda spark, sf_dir: S.score_details(read(spark, sf_dir, "orders"), CLAUSES, index("orders"), DIGITS).select("o_orderkey", "score", F.array_join(F.transform("scoreDetails", lambda x: F.concat(x["description"], F.lit("="), x["value"].cast("string"))), " ").alias("details")),
     """SELECT o_orderkey, 1.0::DOUBLE + CASE WHEN u THEN 2 ELSE 0 END AS score, 'compound=' || CASE WHEN u THEN '3.0' ELSE '1.0' END || ' compound.must[0].range=1.0' || CASE WHEN u THEN ' compound.should[0].equals=2.0' ELSE '' END AS details
FROM (SELECT *, o_orderpriority = '1-URGENT' AS u FROM orders) WHERE o_totalprice > 50000""")  # fmt: skip
KEPT = index("part", stored_source=("p_name", "p_size"))
both("stored_source", lambda spark, sf_dir: S.stored(S.hits(read(spark, sf_dir, "part"), {"range": {"path": "p_size", "lt": 7}}, KEPT, DIGITS), KEPT), "SELECT p_partkey, p_name, p_size, 1.0::DOUBLE AS score FROM part WHERE p_size < 7")


def boxes(spark, sf_dir, docs):
    west, south = F.expr(_LON).cast("double"), F.expr(_LAT).cast("double")
    return docs.withColumn("area", F.struct(west.alias("west"), south.alias("south"), (west + 20).alias("east"), (south + 10).alias("north")))


ASKED = {"type": "Polygon", "coordinates": [[[-50, -30], [60, -30], [60, 20], [-50, 20], [-50, -30]]]}
MEET = f"{_LON} <= 60 AND {_LON} + 20 >= -50 AND {_LAT} <= 20 AND {_LAT} + 10 >= -30"
for relation, sql in (("intersects", MEET), ("within", f"{_LON} >= -50 AND {_LON} + 20 <= 60 AND {_LAT} >= -30 AND {_LAT} + 10 <= 20"), ("disjoint", f"NOT ({MEET})")):
    add(f"geo_shape_{relation}", "customer", {"geoShape": {"path": "area", "relation": relation, "geometry": ASKED}}, plain("customer", sql), prepare=boxes)
add("geo_shape_contains", "customer", {"geoShape": {"path": "area", "relation": "contains", "geometry": {"type": "Point", "coordinates": [10.5, 5.5]}}}, plain("customer", f"{_LON} <= 10.5 AND {_LON} + 20 >= 10.5 AND {_LAT} <= 5.5 AND {_LAT} + 10 >= 5.5"), prepare=boxes)
add("function_undefined", "part", {"range": {"path": "p_size", "lt": 7, "score": {"function": {"log": {"add": [{"path": {"value": "p_absent", "undefined": 0}}, {"constant": 0}]}}}}}, plain("part", "p_size < 7", "0"))
add("sort_arrays", "orders", {"exists": {"path": "lines"}}, "SELECT o_orderkey, 1.0::DOUBLE AS score FROM orders JOIN (SELECT l_orderkey, max(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey ORDER BY q DESC, o_orderkey LIMIT 40",
    limit=40, sort={"amounts": -1}, prepare=lambda spark, sf_dir, docs: nested(spark, sf_dir, docs).withColumn("amounts", F.transform("lines", lambda x: x["l_quantity"])))


# --- analysis: the tokens of a table's texts, joined; a gap is an empty part ---
def analysis(name: str, table: str, path: str, spec: dict, sql: str) -> None:
    """sql: the list of tokens of the text x."""
    both(f"analysis_{name}", lambda spark, sf_dir: read(spark, sf_dir, table).select(F.col(IDS[table]).alias("id"), F.array_join(custom(spec)(F.col(path)), "|", "").alias("tokens")),
         f"SELECT {IDS[table]} AS id, array_to_string(list_transform({sql}, lambda y: coalesce(y, '')), '|') AS tokens FROM (SELECT {IDS[table]}, {path} AS x FROM {table})")


def grams_sql(y: str, low: int, high: int) -> str:
    return f"list_transform(range({low}, least({high}, length({y})) + 1), lambda n: {y}[1:n])"


WHITE = {"type": "whitespace"}
WORDS = r"list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> '')"
TAGS = r"<(?:script|style)\b.*?</(?:script|style)\s*>|<!--.*?-->|</?[a-zA-Z!][^>]*>"
BARE = f"regexp_replace(x, '{TAGS}', ' ', 'gis')"
for old, new in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&nbsp;", "' '"), ("&amp;", "'&'")):
    BARE = f"replace({BARE}, '{old}', {new})"
analysis("whitespace", "documents", "text", {"tokenizer": WHITE}, WORDS)
analysis("letter", "documents", "text", {"tokenizer": {"type": "letter"}}, r"regexp_extract_all(x, '\p{L}+')")
analysis("keyword", "part", "p_name", {"tokenizer": {"type": "keyword"}, "tokenFilters": [{"type": "uppercase"}]}, "[upper(x)]")
analysis("regex_split", "documents", "source", {"tokenizer": {"type": "regexSplit", "pattern": "[0-9]+"}}, "list_filter(regexp_split_to_array(x, '[0-9]+'), lambda y: y <> '')")
analysis("regex_group", "supplier", "s_name", {"tokenizer": {"type": "regexCaptureGroup", "pattern": "#(0*)([1-9][0-9]*)", "group": 2}}, "regexp_extract_all(x, '#(0*)([1-9][0-9]*)', 2)")
analysis("edge_gram_tokens", "part", "p_name", {"tokenizer": {"type": "edgeGram", "minGram": 2, "maxGram": 6}}, grams_sql("x", 2, 6))
analysis("ngram_tokens", "part", "p_brand", {"tokenizer": {"type": "nGram", "minGram": 3, "maxGram": 4}}, "list_concat(list_transform(range(1, length(x) - 1), lambda i: x[i:i + 2]), list_transform(range(1, length(x) - 2), lambda i: x[i:i + 3]))")
analysis("url_email", "pages", "url", {"tokenizer": {"type": "uaxUrlEmail"}}, "[x]")
analysis("html_strip", "pages", "html", {"charFilters": [{"type": "htmlStrip"}], "tokenizer": WHITE}, WORDS.replace("(x,", f"({BARE},"))
analysis("mapping", "part", "p_name", {"charFilters": [{"type": "mapping", "mappings": {"la": "L", "L": "x", "w": ""}}], "tokenizer": WHITE}, WORDS.replace("(x,", "(replace(replace(x, 'w', ''), 'la', 'L'),"))
for name, spec, sql in (
    ("lowercase", {"type": "lowercase"}, f"list_transform({WORDS}, lambda y: lower(y))"),
    ("reverse", {"type": "reverse"}, f"list_transform({WORDS}, lambda y: reverse(y))"),
    ("stopword", {"type": "stopword", "tokens": ["of", "The"]}, f"list_transform({WORDS}, lambda y: CASE WHEN lower(y) NOT IN ('of', 'the') THEN y END)"),
    ("length", {"type": "length", "min": 3, "max": 6}, f"list_transform({WORDS}, lambda y: CASE WHEN length(y) BETWEEN 3 AND 6 THEN y END)"),
    ("limit", {"type": "limitTokenCount", "maxTokenCount": 7}, f"({WORDS})[1:7]"),
    ("regex_filter", {"type": "regex", "pattern": "[aeiou]", "replacement": "_", "matches": "all"}, f"list_transform({WORDS}, lambda y: regexp_replace(y, '[aeiou]', '_', 'g'))"),
    ("regex_filter_first", {"type": "regex", "pattern": "[aeiou]", "replacement": "_", "matches": "first"}, f"list_transform({WORDS}, lambda y: regexp_replace(y, '[aeiou]', '_'))"),
    ("english_possessive", {"type": "englishPossessive"}, f"list_transform({WORDS}, lambda y: regexp_replace(y, '[''’][sS]$', ''))"),
    ("edge_gram_filter", {"type": "edgeGram", "minGram": 2, "maxGram": 4}, f"flatten(list_transform({WORDS}, lambda y: {grams_sql('y', 2, 4)}))"),
    ("keyword_repeat", {"type": "keywordRepeat"}, f"flatten(list_transform({WORDS}, lambda y: [y, y]))"),
):
    analysis(name, "documents", "text", {"tokenizer": WHITE, "tokenFilters": [spec]}, sql)
analysis("trim", "part", "p_name", {"charFilters": [{"type": "mapping", "mappings": {"e": " "}}], "tokenizer": {"type": "keyword"}, "tokenFilters": [{"type": "trim"}]}, "[trim(replace(x, 'e', ' '))]")
analysis("remove_duplicates", "documents", "lang", {"tokenizer": WHITE, "tokenFilters": [{"type": "keywordRepeat"}, {"type": "removeDuplicates"}]}, WORDS)
analysis("shingle", "part", "p_name", {"tokenizer": WHITE, "tokenFilters": [{"type": "shingle", "minShingleSize": 2, "maxShingleSize": 2}]},
         f"(SELECT flatten(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i < len(w) THEN [w[i], w[i] || ' ' || w[i + 1]] ELSE [w[i]] END)) FROM (SELECT {WORDS} AS w))")
analysis("word_delimiter", "supplier", "s_name", {"tokenizer": WHITE, "tokenFilters": [{"type": "wordDelimiterGraph"}]}, r"regexp_extract_all(x, '\p{Lu}?\p{Ll}+|\p{Lu}+|\p{N}+')")
