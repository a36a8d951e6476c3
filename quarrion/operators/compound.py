"""Composition: boolean clauses, nested documents, and the dispatch from an operator's name to its compilation."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrion.functions import scoring
from quarrion.plans.scope import Hit, Scope

from . import text, typed
from .querystring import parse


def _list(x) -> list:
    return x if isinstance(x, list) else [x]


def compound(spec: dict, scope: Scope) -> Hit:
    """must and should score; filter and mustNot do not.  With no must or filter, one should clause has to match."""
    must, should, filters, never = (_list(spec.get(k, [])) for k in ("must", "should", "filter", "mustNot"))
    least = spec.get("minimumShouldMatch", 0)
    if not (must or should or filters or never):
        raise ValueError("compound needs a clause")
    if least > len(should):
        raise ValueError("minimumShouldMatch exceeds the should clauses")
    if should and not must and not filters:
        least = max(least, 1)
    musts, shoulds = [compile_(c, scope) for c in must], [compile_(c, scope) for c in should]
    match, plain = F.lit(True), None
    for h in musts + [compile_(c, scope) for c in filters]:
        match = match & h.match
        if h.plain is not None:
            plain = h.plain if plain is None else plain & h.plain
    for c in never:
        match = match & ~compile_(c, scope).match
    if least:
        match = match & (sum((F.when(h.match, 1).otherwise(0) for h in shoulds), F.lit(0)) >= least)
    option = spec.get("score", {}).get("dismax") if isinstance(spec.get("score"), dict) else None
    if option is not None:
        if must or filters or never:
            raise ValueError("dismax takes should clauses only")
        tie = float(option.get("tieBreakerScore", 1))
        each = [F.when(h.match, h.score).otherwise(0.0) for h in shoulds]
        best = F.greatest(*each) if len(each) > 1 else each[0]
        return Hit(match, best + tie * (sum(each[1:], each[0]) - best))
    return Hit(match, sum((F.when(h.match, h.score).otherwise(0.0) for h in musts + shoulds), F.lit(0.0)), plain)


def embedded(spec: dict, scope: Scope) -> Hit:
    """Parents with a matching element; the scores of those elements are summed, or their extreme or mean is taken."""
    path, how = spec["path"], spec.get("score", {}).get("embedded", {}).get("aggregate", "sum")
    if scope.element is None and not isinstance(scope.type_of(path), T.ArrayType):
        raise ValueError(f"{path} is no array of documents")
    if scope.prefix == path:
        return compile_(spec["operator"], scope)
    inner = lambda e: compile_(spec["operator"], scope.inside(path, e))

    def scored(e):
        h = inner(e)
        return F.when(F.coalesce(h.match, F.lit(False)), h.score.cast("double"))

    found = F.filter(F.transform(scope.column(path), scored), lambda s: s.isNotNull())
    n = F.coalesce(F.size(found), F.lit(0))
    total = F.aggregate(found, F.lit(0.0), lambda a, s: a + s)
    if how not in ("sum", "maximum", "minimum", "mean"):
        raise ValueError(f"unknown aggregate {how}")
    score = {"sum": total, "maximum": F.array_max(found), "minimum": F.array_min(found), "mean": total / n}[how]
    return Hit(F.coalesce(F.size(found) > 0, F.lit(False)), F.coalesce(score, F.lit(0.0)))


def ancestor(spec: dict, scope: Scope) -> Hit:
    """Within a nested document: whether an enclosing one matches."""
    at = scope
    while at.parent is not None and at.prefix != spec.get("ancestorPath", ""):
        at = at.parent
    if at.prefix != spec.get("ancestorPath", ""):
        raise ValueError("no such ancestor")
    return compile_(spec["operator"], at)


#: Terms that a given document is known by, and in how many documents each must be.
MOST_TERMS, LEAST_DOCS = 25, 2


def _strings(value, path: str = "") -> list[tuple[str, str]]:
    """(path, text) of every string in a document, at whatever depth."""
    if isinstance(value, str):
        return [(path, value)]
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in _strings(v, f"{path}.{k}" if path else k)]
    return [x for v in value for x in _strings(v, path)] if isinstance(value, list) else []


def more_like(spec: dict, scope: Scope) -> Hit:
    """Texts that share a characteristic term with the given documents: one of the MOST_TERMS of highest frequency in what is
    given times inverse document frequency, of those in LEAST_DOCS documents or more.

    Within nested documents, which have no statistics, all terms count.
    """
    given = Counter((path, term) for doc in _list(spec["like"]) for path, value in _strings(doc) for term in text.analysed(scope, path, value))
    chosen = list(given)
    if scope.element is None and given:
        stats, known = scope.stats, ("documents",) in scope.stats.found
        stats.selects = True
        n = stats.get(("documents",), F.count(F.lit(1)))
        df = {k: stats.get((k[0], "df", k[1]), F.sum(F.when(F.array_contains(scope.tokens(k[0]), k[1]), 1).otherwise(0))) for k in given}
        # the first compilation counts; it needs the totals of each path, but no column for each term
        chosen = [k for k in given if df[k] >= LEAST_DOCS] if known else list({path: (path, term) for path, term in given}.values())
        chosen = sorted(chosen, key=lambda k: (-given[k] * (math.log((n + 1) / (df[k] + 1)) + 1), k))[:MOST_TERMS] if known else chosen
    return text.any_of([text.counted(scope, path, term, lambda t, w=term: t == w) for path, term in chosen])


def everything(spec: dict, scope: Scope) -> Hit:
    return Hit(F.lit(True), F.lit(1.0))


def query_string(spec: dict, scope: Scope) -> Hit:
    return compile_(parse(spec["query"], spec["defaultPath"]), scope)


def search(spec: dict, scope: Scope) -> Hit:
    """The deprecated search operator: any term, or a phrase."""
    if "phrase" in spec and spec["phrase"].get("prefix"):
        return text.phrase_prefix({"path": spec["path"], **spec["phrase"]}, scope)
    if "phrase" in spec:
        return text.phrase({"path": spec["path"], **spec["phrase"]}, scope)
    return text.text(spec, scope)


OPERATORS = {
    "allDocuments": everything, "equals": typed.equals, "in": typed.in_list, "range": typed.range_, "exists": typed.exists, "near": typed.near,
    "geoWithin": typed.geo_within, "geoShape": typed.geo_shape, "text": text.text, "phrase": text.phrase, "wildcard": text.wildcard, "regex": text.regex, "term": text.term,
    "autocomplete": text.autocomplete, "span": text.span, "compound": compound, "embeddedDocument": embedded, "hasAncestor": ancestor,
    "hasRoot": ancestor, "moreLikeThis": more_like, "queryString": query_string, "search": search,
}


def compile_(query: dict, scope: Scope) -> Hit:
    """One operator with its score option."""
    if len(query) != 1:
        raise ValueError("a query is exactly one operator")
    (name, spec), = query.items()
    if name not in OPERATORS:
        raise ValueError(f"unknown operator {name}")
    hit = OPERATORS[name](spec, scope)
    option = spec.get("score") if isinstance(spec, dict) else None
    if option and not ({"dismax", "embedded"} & set(option)):
        if name == "span" and set(option) != {"boost"}:
            raise ValueError("spans take boosts only")
        hit = Hit(hit.match, scoring.apply(option, hit.score, scope.column), hit.plain)
    match = F.coalesce(hit.match, F.lit(False))
    return Hit(match, hit.score, hit.plain if scope.element is None else None)


def details(query: dict, scope: Scope, path: str = "") -> list[tuple[str, Hit]]:
    """The operator and, for a compound one, those of its scoring clauses, each with its place in the query."""
    (name, spec), = query.items()
    here = f"{path}.{name}" if path else name
    out = [(here, compile_(query, scope))]
    if name == "compound":
        for key in ("must", "should"):
            for k, clause in enumerate(_list(spec.get(key, []))):
                out += details(clause, scope, f"{here}.{key}[{k}]")
    return out


def without(query: dict, facet: str) -> dict:
    """The query without the operators that do not affect a facet; what is left empty matches all documents."""
    (name, spec), = query.items()
    if name == "compound":
        out = {}
        for key, clauses in spec.items():
            if key in ("must", "filter", "should", "mustNot"):
                kept = [without(c, facet) for c in _list(clauses) if not _free(c, facet)]
                if kept:
                    out[key] = kept
            else:
                out[key] = clauses
        if not any(k in out for k in ("must", "filter", "should", "mustNot")):
            return {"allDocuments": {}}
        if "minimumShouldMatch" in out:
            out["minimumShouldMatch"] = min(out["minimumShouldMatch"], len(out.get("should", [])))
        return {name: out}
    return {"allDocuments": {}} if _free(query, facet) else query


def _free(query: dict, facet: str) -> bool:
    (_, spec), = query.items()
    return isinstance(spec, dict) and facet in _list(spec.get("doesNotAffect", []))


def matching(query: dict, scope: Scope) -> Column:
    return compile_(query, scope).match
