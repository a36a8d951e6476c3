"""Approximate vector search against brute force, over many query vectors."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from quarrion.operators.vector import partitioned, vector_search
from quarrion.queries import QUERY_VECTOR, index


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_approximate_search(spark, sf):
    at = f"/root/testdata/{sf}/embeddings.parquet"
    e = pd.read_parquet(at).sort_values("vec_id")
    x = np.stack([np.array(v, float) for v in e.embedding if v is not None and len(v) == 64 and np.any(v)])
    ids = np.array([k for k, v in zip(e.vec_id, e.embedding) if v is not None and len(v) == 64 and np.any(v)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    docs = spark.read.parquet(at).where(F.size("embedding") == 64).where(F.exists("embedding", lambda v: v != 0)).repartition(4)
    made = partitioned(docs, "embedding", "vec_id", 64, 10, "cosine")
    cell = {r.vec_id: r["__cell"] for r in made.rows.select("vec_id", "__cell").collect()}
    assert set(cell) == set(ids.tolist())
    cell = np.array([cell[k] for k in ids.tolist()])
    random = np.random.default_rng(5).normal(size=(50, 64))
    for queries in (x[:: max(1, len(x) // 50)][:50], random):
        hits = []
        for q in queries:
            true = np.argsort(-unit @ q, kind="stable")[:10]
            hits.append(np.isin(cell[true], made.cells(q.tolist(), 200)).mean())
        print(sf, len(x), made.probes, len(made.centroids), np.mean(hits))
        assert np.mean(hits) >= 0.9


def test_search_itself_on_the_larger_table(spark):
    """The rows that the search returns, for the registered vector and some others."""
    docs = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    spec = {"path": "embedding", "limit": 10}
    got = []
    for q in [QUERY_VECTOR, *np.random.default_rng(7).normal(size=(5, 64)).tolist()]:
        near = vector_search(docs, {**spec, "queryVector": q, "numCandidates": 200}, index("embeddings")).toPandas().vec_id
        true = vector_search(docs, {**spec, "queryVector": q, "exact": True}, index("embeddings")).toPandas().vec_id
        got.append(len(set(near) & set(true)) / 10)
    print(got)
    assert np.mean(got) >= 0.9
