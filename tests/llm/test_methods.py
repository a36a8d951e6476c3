"""The parts that the methods name, each against a plain version of itself."""

import hashlib
import io
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarrion.llm import bitplane, dartminhash, pii, quality, tokencount, toxicity, warc


# --- loser tree ---
@pytest.mark.parametrize("seed", range(6))
def test_the_loser_tree_merges_sorted_runs(seed):
    rng = random.Random(seed)
    runs = [sorted(([rng.choice("abc"), str(rng.randint(0, 3)), rng.choice([None, 1, 2]), k] for _ in range(rng.randint(0, 9))), key=warc.order_of) for k in range(rng.randint(0, 9))]
    got = list(warc.loser_tree(runs))
    assert got == sorted((e for r in runs for e in r), key=lambda e: (warc.order_of(e), e[3]))


# --- token counts ---
def test_every_prefix_has_its_count_and_every_budget_its_prefix():
    counter = tokencount.counter(str(public_tokenizers.path("piece_bpe_32k.model")))
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    for text in ("", "one", "The quick  brown fox, and été again.", "a b\tc\n\nddd ff"):
        budget = tokencount.Budget(counter, text)
        counts = [budget.count(n) for n in range(len(text) + 1)]
        assert counts[-1] == len(library.encode(text))
        for most in range(max(counts) + 2):
            n = budget.longest(most)
            assert counts[n] <= most and (n == len(text) or counts[n + 1] > most)


def test_a_budget_asks_for_no_unit_that_the_count_knew():
    counter = tokencount.Counter(str(public_tokenizers.path("piece_bpe_32k.model")))
    text = "The quick brown fox,\nand été again.\n\n and one\n more" * 50
    total, made = counter.count(text), []
    plain = sum(counter._count(u) for u in tokencount.units_of(tokencount.SPACE + text.replace(" ", tokencount.SPACE)))
    counter._count = lambda unit: made.append(unit)
    counter.units.make = counter._count
    budget = tokencount.Budget(counter, text)
    assert not made and budget.bases[-1] == total == plain


# --- planes ---
@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_and_single_blocks(kind):
    rng, ids = np.random.default_rng(2), []
    out = io.BytesIO()
    writer = bitplane.PlaneWriter(out, 64, kind)
    for k in range(40):
        ids.append(rng.integers(0, 2**32 if k % 7 == 0 else 50_000, rng.integers(0, 30), dtype=np.uint64).astype("<u4"))
        writer.add(None if k == 3 else k // 2, ids[-1].tobytes())
    writer.close()
    whole, reader = np.concatenate(ids), bitplane.PlaneReader(io.BytesIO(out.getvalue()))
    for k in reversed(range(-(-len(whole) // 64))):
        assert (reader.block(k) == whole[64 * k : 64 * (k + 1)]).all()
    for (doc_id, place, chunks), k in zip(reader.documents(), range(40), strict=True):
        assert doc_id == (None if k == 3 else k // 2) and place == sum(map(len, ids[:k]))
        assert np.concatenate([*chunks, np.empty(0, "<u4")]).tolist() == ids[k].tolist()


def test_op6_one_id_on_all_rows(spark):
    from tokenizers import Tokenizer

    texts = sorted(f"word{k} Été n°{k}! <|endoftext|> it's" for k in range(60))
    docs = spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string").repartition(4)
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    got = bitplane.store_and_read(docs, path, 1).orderBy("start").collect()
    tok = Tokenizer.from_file(path)
    assert sorted(r.n_tokens for r in got) == sorted(len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in texts)
    assert [r.start for r in got] == list(itertools.accumulate([0, *(r.n_tokens for r in got)]))[:-1]


def test_texts_of_all_kinds_encode_as_the_library_has_them():
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    mine, library, rng = bitplane.BatchTokenizer(path, cache=50), Tokenizer.from_file(path), random.Random(1)
    marks = [*"aAbZ09'’\"éÉßẞÿŸµªº×÷ \t\n\r.,!<|>#İıΣσς漢é́ﬁ‘", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", "　", "\x00", "\x7f", "<|endoftext|>", "'s", "'ll", "'RE", "<|"]
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 40))) for _ in range(2000)]
    assert mine.pieces is not None
    for text, ids in zip(texts, mine.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_pieces_go_to_the_model_alone_and_once():
    """Every byte of a piece is written as the byte-level step writes it, and the whole tokenizer is asked for no plain text."""
    from tokenizers import Tokenizer, pre_tokenizers

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    library, step, mine = Tokenizer.from_file(path), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), bitplane.BatchTokenizer(path)
    plain = "".join(c for c in map(chr, range(0x21, 0x100)) if bitplane.PLAIN(c))
    assert all(bitplane.marked(c) == step.pre_tokenize_str(c)[0][0] for c in plain)
    mine.tool, asked, encode = None, [], mine.pieces.encode
    mine.pieces.encode = lambda pieces: asked.extend(pieces) or encode(pieces)
    texts = [f"Été n°{k % 7}: it's Çà, {plain}" if k % 2 else f"The word{k % 5} again" for k in range(40)]
    texts = [t for t in texts if bitplane.PLAIN(t)] + ["l'été, ÀÉÎ÷×ÿ ß!", "a-b 'll x've"]
    for _ in range(2):
        for text, ids in zip(texts, mine.encode_all(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(asked) == len(set(asked)) > 10


# --- darts ---
def test_weighted_signatures_agree_as_weighted_jaccard():
    rng, errors = np.random.default_rng(4), []
    for _ in range(30):
        elements = np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64))
        a, b = rng.gamma(1.0, 1.5, len(elements)) + 0.05, rng.gamma(1.0, 1.5, len(elements)) + 0.05
        b = np.where(rng.random(len(a)) < 0.6, a, b)
        x, y = dartminhash.darts(elements, a, 2048), dartminhash.darts(elements, b, 2048)
        errors.append((x == y).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert np.abs(errors).max() < 0.06 and abs(np.mean(errors)) < 0.01


def test_whole_weights_are_repeated_shingles():
    found, counts = dartminhash.shingles("a b a b a b c", 2)
    tokens = dartminhash.tokens_of("a b a b a b c", 2, True)
    assert len(tokens) == counts.sum() == 6 and len(dartminhash.tokens_of("a b a b a b c", 2, False)) == len(found) == 3
    other = dartminhash.tokens_of("a b a b c", 2, True)  # ab 2, ba 1, bc 1 of ab 3, ba 2, bc 1
    assert len(np.intersect1d(tokens, other)) == 4


@pytest.mark.parametrize("k", [2, 3, 40])
def test_alike_as_pairs(k):
    rng = np.random.default_rng(k)
    sets = [np.unique(rng.integers(0, 12, 9).astype(np.uint64)) for _ in range(k)]
    i, j = dartminhash.alike(sets, 0.8)
    want = {(a, b) for a, b in itertools.combinations(range(k), 2) if len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))}
    assert set(zip(i.tolist(), j.tolist())) == want


# --- quality ---
def binomial_tail(k, n, p):
    from math import comb

    return sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))


def test_how_many_rejections_the_bound_allows(spark):
    cases = [(n, level) for n in (1, 50, 120, 400, 1000) for level in (0.05, 0.0125)]
    for level in (0.05, 0.0125):
        rows = spark.createDataFrame([(n,) for n, l in cases if l == level], "n long")
        for r in rows.select("n", quality.allowed(F.col("n"), level, 0.03).alias("k")).collect():
            want = max([k for k in range(60) if k <= r.n and binomial_tail(k, r.n, 0.03) <= level], default=-1)
            assert r.k == want, (r.n, level)


def test_the_bound_stops_at_a_middle_cutoff(spark):
    """Bad texts have 20 to 60 words of symbols in 70.  No good one of the first half has any, so a low cutoff is proposed; of
    the second half three have up to 40, and of some 150 good ones the bound lets none go: it stops there."""
    second = lambda k: hashlib.md5(f"half:{k}".encode()).hexdigest()[0] >= "8"
    words = lambda m: " ".join(f"##{k:02d}#" if k < m else f"w{k:04d}" for k in range(70))
    good, bad = range(1000, 1300), range(2000, 2200)
    some = dict(zip([k for k in good if second(k)], (25, 30, 40)))
    many = {**{k: some.get(k, 0) for k in good}, **{k: 20 + k % 41 for k in bad}}
    assert 145 <= sum(map(second, good)) <= 157
    docs = spark.createDataFrame([(k, words(m), "en") for k, m in many.items()], "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(k, int(k in good)) for k in many], "doc_id long, quality int")
    got = {r.q_id: r for r in quality.judge(docs, labels, whole=False).collect()}
    assert 0 < got[1000].q_most < quality.STEPS and got[1000].q_cuts[0] < 200
    assert {k for k, r in got.items() if not r.q_kept} == {k for k in bad if many[k] > 40}
    # a stratum for each document: none has enough labels for a certificate
    assert all(r.q_kept for r in quality.judge(docs.withColumn("lang", F.col("doc_id").cast("string")), labels, whole=False).collect())


# --- personal data ---
def test_expectation_maximisation_finds_the_reliable_labelers():
    rng, counts = random.Random(3), {}
    rates = [(0.9, 0.05), (0.7, 0.1), (0.6, 0.2), (0.5, 0.5)]
    truth: dict[str, list[int]] = {}
    for _ in range(6000):
        real = rng.random() < 0.4
        votes = "".join("1" if rng.random() < (a if real else b) else "0" for a, b in rates)
        counts[votes] = counts.get(votes, 0) + 1
        truth.setdefault(votes, []).append(real)
    got = pii.estimate(counts)
    common = [v for v in counts if counts[v] > 100]
    assert all(abs(got[v] - np.mean(truth[v])) < 0.12 for v in common) and got["1110"] > 0.9 > 0.1 > got["0000"]


def test_the_span_classifier_follows_the_estimates():
    rows = [(f"{a}:{b}", 50.0, 0.9 if a == "s" else 0.1) for a in "sl" for b in "xyz"]
    got = pii.fit(rows)
    assert all((p > 0.5) == (f[0] == "s") for f, p in got.items())


def test_op5_added_spans_on_planted_texts(spark):
    rng, texts, want = random.Random(5), [], []
    for k in range(300):
        number = f"212-555-{rng.randint(1000, 9999)}"
        secret = "AKIA" + "".join(rng.choices("ABCDEFGHJKLMNPQ0123456789", k=15)) + "7"
        date = f"2021-{rng.randint(10, 12)}-{rng.randint(10, 28)}"
        texts += [f"please call {number} today", f"api key: {secret} is mine", f"it was on {date} that we met"]
        want += [("phone", number), ("secret", secret), (None, date)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    for k, (kind, value) in enumerate(want):
        at = texts[k].index(value)
        assert (f"{kind}:{at}:{at + len(value)}" in got[k].split(",")) if kind else got[k] == ""
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert all(value not in clean[k] for k, (kind, value) in enumerate(want) if kind)


# --- toxicity ---
def test_scores_as_a_plain_convolution():
    net = toxicity.Network(3)
    rng = np.random.default_rng(3)
    net.bias, net.offset = rng.normal(0, 0.2, net.bias.shape).astype(np.float32), np.float32(0.3)
    scorer = toxicity.Scorer(net)
    for n in (0, 1, 2, 3, 50, toxicity.PIECE + 1, 2 * toxicity.PIECE + 7):
        text = " ".join(f"w{rng.integers(0, 500)}" for _ in range(n))
        ids = [toxicity.word_bucket(w) for w in text.split()] + [0] * max(0, 3 - n)
        best = []
        for width, f in zip(toxicity.WIDTHS, net.filters):
            values = [sum(net.table[ids[i + k]] @ f[k] for k in range(width)) for i in range(len(ids) - width + 1)]
            best.append(np.max(values, axis=0))
        raw = np.maximum(np.concatenate(best) + net.bias, 0) @ net.out + net.offset
        assert abs(scorer.score(text) - 1 / (1 + np.exp(-raw))) < 1e-4


def test_every_labelled_row_is_learned_from_whole(spark):
    """Far more rows of a label than any sample took, and one text longer than a chunk's share of words."""
    n = 9000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c "), F.when(F.col("id") % 3 == 0, "bad ").otherwise("good "), F.when(F.col("id") == 1, F.repeat(F.lit("long "), 30_000)).otherwise("d")).alias("text"), F.lit("en").alias("lang"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    want = {k for k in range(n) if zlib.crc32(str(k).encode()) % 5}
    known = toxicity.labelled(toxicity.numbered(docs, "doc_id", "text", "lang"), labels)
    assert {r.t_id for r in known.select("t_id").collect()} == want
    rest = known.where("NOT aside")
    chunks = toxicity.chunks_of(rest, rest.count()).collect()
    assert len(chunks) > 1 and sum(len(c.toxic) for c in chunks) == rest.count()
    assert sorted(x for c in chunks for x in c.sizes) == sorted(30_004 if r.t_id == 1 else 5 for r in rest.select("t_id").collect())
    scored = toxicity.score(docs, labels).where("held_out")
    assert scored.where((F.col("doc_id") % 3 == 0) != (F.col("predicted") == 1)).count() == 0


# --- stages of the pipeline ---
ODD = [(None, None, None, None, None, "x"), (1, None, "en", None, 0, "x"), (2, "", None, "s", 0, "x"), (2, "", None, "s", 0, "x"), (3, "a b c d e f g h " * 20, "en", "s", None, "x"), (4, "a b c d e f g h " * 20, None, "s", 1, None), (5, " ".join(map(str, range(90))) + " me@example.org", "en", "s", 5, "x")]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, q_kept string"


@pytest.mark.parametrize("whole", [True, False])
def test_pipeline_stages_on_odd_rows(spark, tmp_path, whole):
    """Nulls, empty texts, repeated rows, near copies, an extra column named as the operators name theirs, an empty table."""
    import corpus_pipeline

    data = ODD if whole else []
    spark.createDataFrame([(3, 1, 0)] if whole else [], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(data, ODD_SCHEMA)
    want = {"quality_rules": 1, "near_duplicates": 4, "personal_data": 7, "encode": 7}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        rows = got.collect()
        if name != "encode":
            assert got.columns == docs.columns
        if not whole:
            assert rows == []
        elif name in want:
            assert len(rows) == want[name], name
    if whole:
        clean = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["personal_data"](spark, docs, str(tmp_path)).collect()}
        assert clean[5].text.endswith("[EMAIL]") and clean[5].n_chars == len(clean[5].text) and clean[1].text is None and clean[2].text == ""
