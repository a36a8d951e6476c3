"""More like this: characteristic terms alone."""

from quarrion.plans import search as S
from quarrion.plans.definition import IndexDefinition


def test_common_and_lonely_terms_are_left_out(spark):
    common = " ".join(f"c{k}" for k in range(30))
    rare = " ".join(f"r{k}" for k in range(25))
    docs = spark.createDataFrame([(1, f"{common} {rare} lonely"), (2, rare), *[(k, common) for k in range(3, 40)]], "id long, text string")
    query, definition = {"moreLikeThis": {"like": {"text": f"{common} {rare} lonely"}}}, IndexDefinition(id_column="id")
    assert sorted(r.id for r in S.hits(docs, query, definition).collect()) == [1, 2]
    assert S.count(docs, query, definition).first()[0] == 2
    assert S.hits(docs, {"moreLikeThis": {"like": {"text": "lonely"}}}, definition).count() == 0
