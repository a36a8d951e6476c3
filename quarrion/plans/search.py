"""Searches as DataFrame plans: hits with scores, sort and pagination, counts, facets and highlights.

An operator is compiled to two column expressions over a document's row, so a search is one scan with its predicates pushed
down, and a top-k; statistics that relevance needs are one aggregation of one row before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrion.operators.compound import compile_, details, without

from .definition import IndexDefinition
from .scope import Scope


#: Compilations until nothing is lacking: totals, terms, and totals of these terms.
ROUNDS = 4


def compiled(docs: DataFrame, query: dict, definition: IndexDefinition, relevance: bool = True):
    """The compiled query and the scope with the columns that it uses.  Without relevance, statistics are made only where
    matches depend on them."""
    scope = Scope(definition, docs.schema)
    hit = compile_(query, scope)
    for _ in range(ROUNDS):
        if not scope.stats.lacking or not (relevance or scope.stats.selects):
            break
        scope.stats.run(scope.derive(docs))
        hit = compile_(query, scope)
    return hit, scope


def matched(docs: DataFrame, query: dict, definition: IndexDefinition) -> DataFrame:
    """The matching documents."""
    hit, scope = compiled(docs, query, definition, relevance=False)
    return scope.where(docs, hit)


def hits(docs: DataFrame, query: dict, definition: IndexDefinition, digits: int | None = None) -> DataFrame:
    """The matching documents with their column score."""
    if "score" in docs.columns:
        raise ValueError("the documents have a column score, which hits add")
    hit, scope = compiled(docs, query, definition)
    score = hit.score.cast("double")
    return scope.plain(scope.where(docs, hit).withColumn("score", F.round(score, digits) if digits is not None else score))


def score_details(docs: DataFrame, query: dict, definition: IndexDefinition, digits: int | None = None) -> DataFrame:
    """Hits with scoreDetails: (value, description) of the operator and of the scoring clauses within it that match."""
    scope = Scope(definition, docs.schema)
    parts = details(query, scope)
    for _ in range(ROUNDS):
        if not scope.stats.lacking:
            break
        scope.stats.run(scope.derive(docs))
        parts = details(query, scope)
    rounded = lambda x: F.round(x.cast("double"), digits) if digits is not None else x.cast("double")
    each = [F.when(F.coalesce(h.match, F.lit(False)), F.struct(rounded(h.score).alias("value"), F.lit(name).alias("description"))) for name, h in parts]
    found = scope.where(docs, parts[0][1]).withColumns({"score": rounded(parts[0][1].score), "scoreDetails": F.filter(F.array(*each), lambda x: x.isNotNull())})
    return scope.plain(found)


def stored(found: DataFrame, definition: IndexDefinition) -> DataFrame:
    """Hits with the fields of the stored source alone, beside id and score; without one, as they are."""
    if definition.stored_source is None:
        return found
    own = [c for c in (definition.id_column, *definition.stored_source, "score") if c.partition(".")[0] in found.columns]
    return found.select(*[F.col(c).alias(c.replace(".", "_")) if "." in c else F.col(c) for c in dict.fromkeys(own)])


def scoped_hits(docs: DataFrame, query: dict, definition: IndexDefinition, path: str, digits: int | None = None) -> DataFrame:
    """The nested documents at a path that match, as rows: the id, element (the document) and score."""
    scope = Scope(definition, docs.schema)
    rows = docs.select(definition.id_column, F.explode(scope.column(path)).alias("element"))
    hit = compile_(query, scope.inside(path, F.col("element")))
    score = hit.score.cast("double")
    return rows.where(hit.match).withColumn("score", F.round(score, digits) if digits is not None else score)


def sort_key(docs: DataFrame, path: str, order: int) -> Column:
    """Ascending by the least value of an array, descending by the greatest."""
    column, kind = F.col(path), Scope(IndexDefinition(), docs.schema).type_of(path)
    if isinstance(kind, T.ArrayType):
        return F.array_min(column) if order > 0 else F.array_max(column)
    return column


def ordering(docs: DataFrame, sort: dict | None, id_column: str) -> list[tuple[Column, bool, bool]]:
    """(key, ascending, nulls first) with the id last; without a sort by score, highest first."""
    keys = []
    for path, spec in (sort or {"score": -1}).items():
        order, empty = (spec.get("order", 1), spec.get("noData", "lowest")) if isinstance(spec, dict) else (spec, "lowest")
        if order not in (1, -1):
            raise ValueError("an order is 1 or -1")
        keys.append((sort_key(docs, path, order), order > 0, (order > 0) == (empty == "lowest")))
    return keys + [(F.col(id_column), True, True)]


def ordered(df: DataFrame, keys: list[tuple[Column, bool, bool]]) -> DataFrame:
    way = {(True, True): "asc_nulls_first", (True, False): "asc_nulls_last", (False, True): "desc_nulls_first", (False, False): "desc_nulls_last"}
    return df.orderBy(*[getattr(k, way[asc, first])() for k, asc, first in keys])


def beyond(keys: list[tuple[Column, bool, bool]], values: list) -> Column:
    """Rows after the position that the values name."""
    out, equal = F.lit(False), F.lit(True)
    for (key, asc, nulls_first), value in zip(keys, values, strict=True):
        if value is None:
            after = key.isNotNull() if nulls_first else F.lit(False)
        else:
            after = F.coalesce(key > F.lit(value) if asc else key < F.lit(value), F.lit(not nulls_first))
        out = out | (equal & after)
        equal = equal & key.eqNullSafe(F.lit(value))
    return out


def search(docs: DataFrame, query: dict, definition: IndexDefinition, limit: int | None = None, sort: dict | None = None, after: list | None = None, before: list | None = None, digits: int | None = None) -> DataFrame:
    """Hits in order.  after and before are the sort values and the id of a row; rows before it come nearest first."""
    found = hits(docs, query, definition, digits)
    keys = ordering(found, sort, definition.id_column)
    if before is not None:
        keys = [(k, not asc, not first) for k, asc, first in keys]
    if after is not None or before is not None:
        found = found.where(beyond(keys, after if after is not None else before))
    found = ordered(found, keys)
    return found.limit(limit) if limit is not None else found


def count(docs: DataFrame, query: dict, definition: IndexDefinition, threshold: int | None = None) -> DataFrame:
    """All hits, or no more than the threshold where a lower bound will do."""
    found = matched(docs, query, definition).select(F.lit(1))
    if threshold is not None:
        found = found.limit(threshold)
    return found.agg(F.count("*").alias("count"))


def facets(docs: DataFrame, query: dict, definition: IndexDefinition, specs: dict) -> DataFrame:
    """facet, bucket, count: the most frequent values of strings, and the buckets of numbers and dates.

    A facet ignores the operators that name it in doesNotAffect.
    """
    out = None
    for name, spec in specs.items():
        scope = Scope(definition, docs.schema)
        found = matched(docs, without(query, name), definition)
        path = spec["path"]
        value = scope.column(path)
        array = isinstance(scope.type_of(path), T.ArrayType)
        if spec["type"] == "string":
            values = F.explode(F.array_distinct(value)) if array else value
            one = found.select(values.cast("string").alias("bucket")).where("bucket IS NOT NULL AND bucket <> ''").groupBy("bucket").agg(F.count("*").alias("count"))
            one = one.orderBy(F.desc("count"), "bucket").limit(spec.get("numBuckets", 10))
        elif spec["type"] in ("number", "date"):
            bounds = spec["boundaries"]
            if len(bounds) < 2 or any(a >= b for a, b in zip(bounds, bounds[1:])):
                raise ValueError("boundaries must ascend")
            bucket = lambda v: _bucket(v, bounds)
            if array:
                found_in = F.array_distinct(F.filter(F.transform(value, bucket), lambda b: b.isNotNull()))
                named = F.explode(F.when(F.size(found_in) > 0, found_in).otherwise(F.array(F.lit(spec.get("default")).cast("string"))))
            else:
                named = F.coalesce(bucket(value), F.lit(spec.get("default")).cast("string"))
            one = found.select(named.alias("bucket")).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("count"))
        else:
            raise ValueError(f"unknown facet {spec['type']}")
        one = one.select(F.lit(name).alias("facet"), "bucket", "count")
        out = one if out is None else out.unionByName(one)
    return out


def _bucket(value: Column, bounds: list) -> Column:
    out = F.lit(None).cast("string")
    for low, high in reversed(list(zip(bounds, bounds[1:]))):
        out = F.when((value >= F.lit(low)) & (value < F.lit(high)), F.lit(str(low))).otherwise(out)
    return out


def highlights(found: DataFrame, path: str, terms: list[str], around: int = 60) -> DataFrame:
    """passages: stretches of the text around the query's terms, split to matching and other pieces (value, type)."""
    import re

    words = "|".join(re.escape(t) for t in terms)
    passage = rf"(?is).{{0,{around}}}\b(?:{words})\b.{{0,{around}}}"
    pieces = rf"(?is)\b(?:{words})\b|(?:(?!\b(?:{words})\b).)+"
    cut = lambda p: F.transform(F.regexp_extract_all(p, F.lit(pieces), F.lit(0)), lambda x: F.struct(x.alias("value"), F.when(x.rlike(rf"(?is)^(?:{words})$"), "hit").otherwise("text").alias("type")))
    return found.withColumn("passages", F.transform(F.regexp_extract_all(F.col(path), F.lit(passage), F.lit(0)), cut))
