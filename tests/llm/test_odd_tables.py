"""Odd pages and vectors, and documents with extra columns whose names the operators use themselves."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarrion.llm import bitplane, bpe, dartminhash, lattice, mixing, pii, quality, tokencount, toxicity, warc
from quarrion.llm.queries import QUERIES

CLASHING = ["node", "key", "digest", "bands", "n", "kept", "class_id", "a", "b", "size", "target", "taken", "rate", "n_words", "spans", "d_id", "label", "score", "h", "copy"]


@pytest.fixture(scope="module")
def clashing(spark):
    data = [(k, t, "en", s, 1) + ("x",) * len(CLASHING) for k, t, s in ((1, "a b c d e f g " * 30, "s"), (2, "a b c d e f g " * 30, None), (3, None, "t"), (4, " ".join(map(str, range(80))) + " me@example.org", "s"))]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING))


def test_op1_odd_pages(spark, tmp_path):
    schema = "page_id long, url string, html string"
    data = [(1, None, None), (2, "", ""), (3, "http://a.b/", "x"), (4, "http://a.b/", "x"), (5, "not a url", "ü" * 50_000)]
    for k, rows in enumerate((data, [])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{k}/pages.parquet")
        got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in QUERIES["op1_warc_index"](spark, f"{tmp_path}/{k}").collect()}
        assert len(got) == len(rows)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in QUERIES["op1_warc_index"](spark, f"{tmp_path}/0").collect()}
    assert got == {1: (0, "response", None), 2: (0, "revisit", 1), 3: (1, "response", None), 4: (1, "revisit", 3), 5: (100_000, "response", None)}


def test_op8_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 1)]
    schema = "vec_id long, embedding array<float>, label int"
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_vectors(spark.createDataFrame(data, schema)).collect()}
    want = {k: (0, k, True) for k, _, _ in data} | {1: (2, 1, True), 2: (2, 1, False), 12: (2, 1, False)}
    assert got == want
    assert lattice.near_vectors(spark.createDataFrame([], schema)).count() == 0


def test_op10_clashing_columns(clashing):
    assert sorted((r.doc_id, r.class_id) for r in dartminhash.classes(clashing).collect()) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    kept = dartminhash.distinct_documents(clashing)
    assert kept.columns == clashing.columns and kept.count() == 3


def test_op9_clashing_columns(spark, clashing):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.report(clashing, labels).count() == 4
    assert quality.keep(clashing, labels).columns == clashing.columns


def test_op5_clashing_columns(clashing):
    assert pii.find(clashing).count() == 4
    clean = pii.redact(clashing)
    assert clean.columns == clashing.columns and "[EMAIL]" in clean.where("doc_id = 4").first().text


def test_op2_clashing_columns(clashing):
    assert mixing.mix_report(clashing).count() == 4
    assert mixing.mix(clashing).columns == clashing.columns


def test_other_operators_leave_clashing_columns_out(spark, clashing):
    tokens, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    assert [r.n_tokens > 0 for r in bpe.round_trip(clashing, tokens, pattern).orderBy("doc_id").collect()] == [True, True, False, True]
    assert [r.n_tokens > 0 for r in bpe.encode(clashing, tokens, pattern).orderBy("doc_id").collect()] == [True, True, False, True]
    assert tokencount.token_counts(clashing, public_tokenizers.path("piece_bpe_32k.model"), 4096).count() == 4
    assert bitplane.store_and_read(clashing, str(public_tokenizers.path("word_bpe_49k.json")), 1).count() == 4
    labels = spark.createDataFrame([(1, 0), (4, 1)], "doc_id long, toxic int").withColumn("score", F.lit("x"))
    scored = toxicity.score(clashing, labels).collect()
    assert len(scored) == 4 and len({r.score for r in scored if r.doc_id in (1, 2)}) == 1
    vectors = spark.createDataFrame([(k, [1.0, 0.1 * k], 1) + ("x",) * 5 for k in range(3)], "vec_id long, embedding array<double>, label int, " + ", ".join(f"{c} string" for c in ("rep", "key", "digest", "n", "point")))
    assert lattice.near_vectors(vectors).count() == 3
    pages = spark.createDataFrame([(k, "http://a.b/", "x" * k) + ("x",) * 4 for k in range(3)], "page_id long, url string, html string, " + ", ".join(f"{c} string" for c in ("digest", "payload", "part", "refers_to")))
    assert warc.archive_and_index(pages).count() == 3


def test_values_of_odd_rows(spark):
    """Null, empty and repeated rows: what each operator makes of them."""
    rows = [(None, None), (1, None), (2, ""), (2, ""), (3, "call me at a@b.co now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by = lambda found, name: sorted(((r.doc_id, r[name]) for r in found.collect()), key=lambda x: (x[0] is not None, x))
    tokens, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids = [None, 1, 2, 2, 3]
    assert by(bpe.round_trip(docs, tokens, pattern), "n_tokens")[:4] == list(zip(ids, [0] * 4))
    assert by(tokencount.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), 4096), "n_tokens")[:4] == list(zip(ids, [0] * 4))
    assert by(bitplane.store_and_read(docs, str(public_tokenizers.path("word_bpe_49k.json")), 1), "n_tokens")[:4] == list(zip(ids, [1] * 4))
    assert by(pii.find(docs), "spans") == list(zip(ids, ["", "", "", "", "email:11:17"]))
    assert by(dartminhash.classes(docs), "class_id") == list(zip(ids, [None, 1, 1, 1, 3]))
    assert by(mixing.mix_report(docs.withColumn("source", F.lit("s"))), "size") == list(zip(ids, [0, 0, 0, 0, 5]))
    assert by(quality.report(docs.withColumn("lang", F.lit(None).cast("string")), spark.createDataFrame([], "doc_id long, quality int")), "kept") == [(i, False) for i in ids]
