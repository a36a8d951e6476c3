"""Vector search: exact by a scan, approximate by centroid partitions with a full rescoring, with filters before."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrion.functions import vectors
from quarrion.plans.definition import IndexDefinition
from quarrion.plans.scope import Scope

from .compound import OPERATORS, compile_
from .typed import mql

#: Vectors that centroids are made of, at most; rounds of k-means; rows that recall is measured with.
SAMPLE, ROUNDS, ASKED = 20_000, 8, 100
#: Recall that the probes must have on those.
RECALL = 0.95


@dataclass
class Partitions:
    """Every row with the number of its nearest centroid in __cell, and how many centroids a search probes."""

    rows: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    probes: int
    similarity: str

    def cells(self, query: list[float], least: int) -> list[int]:
        """The cells to probe, nearest first: probes of them, and more until they hold `least` rows."""
        order = np.argsort(-closeness(np.array([query], float), self.centroids, self.similarity)[0], kind="stable")
        n = max(self.probes, int(np.searchsorted(np.cumsum(self.sizes[order]), least)) + 1)
        return order[:n].tolist()


def closeness(x: np.ndarray, y: np.ndarray, similarity: str) -> np.ndarray:
    """(len(x), len(y)): higher is nearer, in the order of the similarity's score."""
    if similarity == "cosine":
        unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        return unit(x) @ unit(y).T
    if similarity == "dotProduct":
        return x @ y.T
    return 2 * x @ y.T - (x * x).sum(axis=1)[:, None] - (y * y).sum(axis=1)[None, :]


def partitioned(found: DataFrame, path: str, id_column: str, dim: int, limit: int, similarity: str) -> Partitions:
    """Partitions of all rows.  The probes are the fewest whose recall of the `limit` nearest against all rows is RECALL or
    more, over ASKED rows as queries and over as many random vectors of the same spread."""
    # cells are of nearest direction or place; only queries are ranked by dot product
    nearest = "cosine" if similarity == "cosine" else "euclidean"
    dealt = found.select(F.xxhash64(F.col(id_column).cast("string")).alias("h"), F.transform(path, lambda v: v.cast("double")).alias("v"))
    n = dealt.count()
    sample = [r.v for r in dealt.orderBy("h").limit(SAMPLE).collect()]
    if not sample:
        return Partitions(found.withColumn("__cell", F.lit(0)), np.zeros((1, dim)), np.zeros(1), 1, similarity)
    x = np.array(sample, float)
    if nearest == "cosine":
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
    k = int(min(1024, max(1, round(n**0.5)), len(x)))
    centroids = x[:k].copy()
    for _ in range(ROUNDS):
        cell = closeness(x, centroids, nearest).argmax(axis=1)
        held = np.bincount(cell, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, x)
        centroids[held > 0] = sums[held > 0] / held[held > 0][:, None]
    own = np.array(sample[-ASKED:], float)
    # queries need not lie where rows do, and such ones spread their neighbours over more cells
    spread = np.random.default_rng(1).normal(size=(ASKED, dim)) * np.sqrt((own * own).mean(axis=0))
    asked = np.concatenate([own, spread])

    @F.pandas_udf("int")
    def cell_of(v):
        return __import__("pandas").Series(closeness(np.array(v.tolist(), float), centroids, nearest).argmax(axis=1).astype("int32"))

    rows = found.withColumn("__cell", cell_of(F.transform(path, lambda v: v.cast("double"))))

    def best(batches):
        """Per query and batch the nearest rows' closeness and cell."""
        import pandas as pd

        for batch in batches:
            if not len(batch):
                continue
            close, cell = closeness(asked, np.array(batch["v"].tolist(), float), similarity), batch["c"].to_numpy()
            top = np.argsort(-close, axis=1, kind="stable")[:, : limit + 1]
            yield pd.DataFrame({"q": np.repeat(np.arange(len(asked)), top.shape[1]), "close": np.take_along_axis(close, top, 1).ravel(), "c": cell[top].ravel()})

    measured = rows.select(F.transform(path, lambda v: v.cast("double")).alias("v"), F.col("__cell").alias("c"))
    tops = measured.mapInPandas(best, "q int, close double, c int").groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("close", "c")), asc=False), 1, limit + 1).alias("t")).collect()
    sizes = np.zeros(k)
    for r in rows.groupBy("__cell").count().collect():
        sizes[r["__cell"]] = r["count"]
    rank = np.argsort(np.argsort(-closeness(asked, centroids, similarity), axis=1, kind="stable"), axis=1)
    probes = 1
    for group in (range(len(own)), range(len(own), len(asked))):
        # a row is its own nearest, which tells nothing
        needed = np.sort([rank[r.q, t.c] + 1 for r in tops if r.q in group for t in r.t[r.q < len(own) :][:limit]])
        if len(needed):
            probes = max(probes, int(needed[int(np.ceil(RECALL * len(needed))) - 1]))
    return Partitions(rows, centroids, sizes, probes, similarity)


def vector_search(docs: DataFrame, spec: dict, definition: IndexDefinition, similarity: str = "cosine", digits: int | None = None, index: Partitions | None = None) -> DataFrame:
    """The `limit` nearest documents with their score.  Vectors of another length or with no direction are passed over.

    Not exact: the rows of the partitions nearest to the query, numCandidates of them at least, are scored in full.  index:
    partitions of the filtered rows, where they are at hand; else they are made.
    """
    path, query, limit = spec["path"], spec["queryVector"], spec["limit"]
    exact, wide = spec.get("exact", False), spec.get("numCandidates")
    if exact and wide is not None:
        raise ValueError("numCandidates goes with approximate search only")
    if not exact and (wide is None or not limit <= wide <= 10_000):
        raise ValueError("numCandidates must be from limit to 10000")
    keep = F.size(path) == len(query)
    if similarity == "cosine":
        keep = keep & (vectors.norm(F.col(path)) > 0)
    found = filtered(docs, spec.get("filter", {}), definition).where(keep)
    if not exact:
        index = index or partitioned(found, path, definition.id_column, len(query), limit, similarity)
        found = index.rows.where(F.col("__cell").isin(index.cells(query, wide))).drop("__cell")
    score = vectors.score(F.col(path), query, similarity)
    found = found.withColumn("score", F.round(score, digits) if digits is not None else score)
    return found.orderBy(F.desc("score"), definition.id_column).limit(limit)


def filtered(docs: DataFrame, spec: dict, definition: IndexDefinition) -> DataFrame:
    """docs that pass a filter in comparison syntax, or one operator."""
    scope = Scope(definition, docs.schema)
    if len(spec) == 1 and next(iter(spec)) in OPERATORS:
        hit = compile_(spec, scope)
        if scope.stats.selects:
            raise ValueError("a filter cannot depend on the terms of the whole index")
        return scope.plain(scope.where(docs, hit))
    return docs.where(mql(spec, scope))


def _top(found: DataFrame, score: Column, definition: IndexDefinition, limit: int, digits: int | None) -> DataFrame:
    found = found.withColumn("score", F.round(score, digits) if digits is not None else score)
    return found.orderBy(F.desc("score"), definition.id_column).limit(limit)


def nested_vector_search(docs: DataFrame, spec: dict, definition: IndexDefinition, similarity: str = "cosine", digits: int | None = None) -> DataFrame:
    """The `limit` nearest parents by the vectors of their nested documents; exact.

    filter is asked of each nested document and says whether a parent has one to offer; parentFilter is asked of the parent.
    nestedOptions.scoreMode max (default) takes the best vector that passes the filter, avg the mean over all vectors of the
    parent, whether they pass or not.
    """
    outer, _, inner = spec["path"].rpartition(".")
    query, mode = spec["queryVector"], spec.get("nestedOptions", {}).get("scoreMode", "max")
    if mode not in ("max", "avg"):
        raise ValueError("scoreMode is max or avg")
    scope = Scope(definition, docs.schema)
    found = filtered(docs, spec.get("parentFilter", {}), definition)

    def usable(e):
        keep = F.size(e[inner]) == len(query)
        return F.coalesce(keep & (vectors.norm(e[inner]) > 0) if similarity == "cosine" else keep, F.lit(False))

    scores = lambda column: F.transform(column, lambda e: vectors.score(e[inner], query, similarity))
    every = F.filter(F.col(outer), usable)
    passing = F.filter(every, lambda e: F.coalesce(mql(spec.get("filter", {}), scope.inside(outer, e)), F.lit(False)))
    found = found.where(F.coalesce(F.size(passing) > 0, F.lit(False)))
    if mode == "max":
        return _top(found, F.array_max(scores(passing)), definition, spec["limit"], digits)
    return _top(found, F.aggregate(scores(every), F.lit(0.0), lambda a, x: a + x) / F.size(every), definition, spec["limit"], digits)


def bit_search(docs: DataFrame, spec: dict, definition: IndexDefinition, digits: int | None = None) -> DataFrame:
    """The `limit` nearest of vectors of bits, packed in arrays of whole numbers of up to 32 bits: (dim - hamming) / dim."""
    path, query = spec["path"], spec["queryVector"]
    found = filtered(docs, spec.get("filter", {}), definition).where(F.size(path) == len(query))
    return _top(found, vectors.bit_score(F.col(path), query, spec["dim"]), definition, spec["limit"], digits)


def knn_beta(docs: DataFrame, spec: dict, definition: IndexDefinition, similarity: str = "cosine", digits: int | None = None) -> DataFrame:
    """The k nearest by each path; a document that is near by several has the sum of the scores."""
    paths, k = spec["path"] if isinstance(spec["path"], list) else [spec["path"]], spec["k"]
    each = [vector_search(docs, {"path": p, "queryVector": spec["vector"], "limit": k, "exact": True, "filter": spec.get("filter", {})}, definition, similarity) for p in paths]
    found = each[0].select(definition.id_column, "score")
    for other in each[1:]:
        found = found.unionByName(other.select(definition.id_column, "score"))
    total = F.sum("score")
    return found.groupBy(definition.id_column).agg((F.round(total, digits) if digits is not None else total).alias("score"))
