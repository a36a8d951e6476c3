"""A convolutional text classifier for toxicity, trained in numpy over all labelled rows.

Words are hashed to rows of an embedding table; filters of several widths run over the words and each keeps its largest
value over the whole text; a logistic layer turns these into a score.  Every text is turned to word numbers once and written;
training and scoring read these.  Labelled rows are dealt into chunks; in every epoch each chunk goes on from the network so
far by itself, following the gradient through the places of the largest values alone, and the changes are averaged, those of
an embedding over the chunks that changed it.  For scoring, the product of every embedding with every filter's slice is
tabulated once, so a filter's value at a place is a sum of `width` table rows.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UnitCache, materialize, small_batches, text_or_empty, words_of

#: Numbers of words are kept as unsigned 16-bit integers.
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 12, 12, (1, 2, 3)
#: Rows of a chunk, about, and words of one at most, but for a longer text.
CHUNK, CHUNK_WORDS = 4000, 4_000_000
EPOCHS, BATCH, RATE = 8, 32, 0.02
#: Words of a text that are convolved at once; pieces overlap by the widest filter less one, so no window is lost.
PIECE = 4096
#: Embeddings of one row where the changes of all tasks are added up.
SLICE = 1024


def word_bucket(word: str) -> int:
    """Words are hashed in lower case without punctuation at their ends."""
    plain = word.lower().strip(".,;:!?\"'()[]|*$%&#<>")
    return zlib.crc32((plain or word).encode()) % (BUCKETS - 1) + 1


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


_numbers = UnitCache(word_bucket, 200_000)


def numbers_of(text: str) -> bytes:
    """The numbers of all words of a text."""
    words = words_of(text)
    return np.fromiter(map(_numbers.__getitem__, words), np.uint16, len(words)).tobytes()


def padded(numbers: bytes) -> np.ndarray:
    ids = np.frombuffer(numbers, np.uint16).astype(np.int64)
    return np.concatenate([ids, np.zeros(max(0, max(WIDTHS) - len(ids)), np.int64)])


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        #: Row 0 stands for no word: texts are padded with it to the widest filter.
        self.table = rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
        self.table[0] = 0
        self.filters = [rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.offset = np.float32(0)

        #: Sums of squared gradients, for Adagrad.
        self.slots = [np.full_like(p, 1e-6) for p in (self.table, *self.filters, self.bias, self.out)]
        self.last = 1e-6

    def forward(self, ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest value of each filter, and for each width the words there (filters x width)."""
        best, words = None, None
        reach, of = max(WIDTHS) - 1, np.arange(FILTERS)
        for begin in range(0, max(1, len(ids) - reach), PIECE):
            part = ids[begin : begin + PIECE + reach]
            rows, now, there = self.table[part], [], []
            for w, f in zip(WIDTHS, self.filters):
                n = len(part) - w + 1
                value = rows[:n] @ f[0]
                for k in range(1, w):
                    value += rows[k : k + n] @ f[k]
                at = value.argmax(axis=0)
                there.append(part[at[:, None] + np.arange(w)])
                now.append(value[at, of])
            now = np.concatenate(now)
            if best is None:
                best, words = now, there
                continue
            more = now > best
            best = np.where(more, now, best)
            words = [np.where(m[:, None], new, old) for m, new, old in zip(more.reshape(len(WIDTHS), FILTERS), there, words)]
        return best, words

    def logit(self, ids: np.ndarray) -> float:
        return float(np.maximum(self.forward(ids)[0] + self.bias, 0) @ self.out + self.offset)

    def learn(self, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, order: np.ndarray) -> None:
        """Adagrad on logistic loss, once over the texts in this order."""
        dense = (*self.filters, self.bias, self.out)
        for begin in range(0, len(order), BATCH):
            part = order[begin : begin + BATCH]
            found = [self.forward(texts[n]) for n in part]
            raw = np.stack([best for best, _ in found]) + self.bias
            hidden = np.maximum(raw, 0)
            score = 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.offset, -30, 30)))
            gap = ((score - labels[part]) * weight[part] / len(part)).astype(np.float32)
            back = np.where(raw > 0, gap[:, None] * self.out, 0).astype(np.float32)
            grads, rows, steps = [], [], []
            for v, f in enumerate(self.filters):
                mine = back[:, v * FILTERS : (v + 1) * FILTERS]
                words = np.stack([w[v] for _, w in found])  # texts x filters x width
                grads.append(np.einsum("tf,tfkd->kdf", mine, self.table[words]))
                rows.append(words.reshape(-1))
                steps.append((mine[:, :, None, None] * f.transpose(2, 0, 1)).reshape(-1, DIM))
            grads += [back.sum(axis=0), gap @ hidden]
            rows, steps = np.concatenate(rows), np.concatenate(steps)
            used = (rows > 0) & steps.any(axis=1)
            rows, steps = rows[used], steps[used]
            for p, g, s in zip(dense, grads, self.slots[1:]):
                s += g * g
                p -= RATE * g / np.sqrt(s)
            if len(rows):
                sort = np.argsort(rows, kind="stable")
                rows, first = np.unique(rows[sort], return_index=True)
                g = np.add.reduceat(steps[sort], first, axis=0)
                self.slots[0][rows] += g * g
                self.table[rows] -= 2 * RATE * g / np.sqrt(self.slots[0][rows])
            slope = float(gap.sum())
            self.last += slope * slope
            self.offset -= np.float32(RATE * slope / np.sqrt(self.last))

    def copy(self) -> Network:
        from copy import deepcopy

        return deepcopy(self)

    def dense(self) -> np.ndarray:
        """All numbers but the embeddings and their slots."""
        return np.concatenate([x.ravel() for x in (*self.filters, self.bias, self.out, *self.slots[1:])] + [np.array([self.offset, self.last])])

    def set_dense(self, numbers: np.ndarray) -> None:
        at = 0
        for x in (*self.filters, self.bias, self.out, *self.slots[1:]):
            x[...] = numbers[at : at + x.size].reshape(x.shape)
            at += x.size
        self.offset, self.last = np.float32(numbers[at]), float(numbers[at + 1])

    def tabulated(self) -> list[list[np.ndarray]]:
        """By width and place in the filter: every embedding times the filter's slice."""
        return [[self.table @ f[k] for k in range(len(f))] for f in self.filters]


class Scorer:
    def __init__(self, network: Network):
        self.products = network.tabulated()
        self.bias, self.out, self.offset = network.bias, network.out, network.offset

    def score(self, text: str) -> float:
        return self.of_numbers(padded(numbers_of(text)))

    def of_numbers(self, ids: np.ndarray) -> float:
        best = None
        reach = max(WIDTHS) - 1
        for begin in range(0, max(1, len(ids) - reach), PIECE):
            part = ids[begin : begin + PIECE + reach]
            now = []
            for tables in self.products:
                n = len(part) - len(tables) + 1
                value = tables[0][part[:n]]
                for k in range(1, len(tables)):
                    value = value + tables[k][part[k : k + n]]
                now.append(value.max(axis=0))
            now = np.concatenate(now)
            best = now if best is None else np.maximum(best, now)
        raw = float(np.maximum(best + self.bias, 0) @ self.out + self.offset)
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, raw)))))


def numbered(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """doc_id, held_out, lang, words for every row: the numbers of all words of the whole text, written once."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            words = pa.array([numbers_of(t.as_py()) for t in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], words], names=["doc_id", "held_out", "lang", "words"])

    number = F.col(id_col).cast("long")
    rows = docs.select(number.alias("doc_id"), F.coalesce(held_out(number), F.lit(False)).alias("held_out"), F.col(lang_col).cast("string").alias("lang"), text_or_empty(text_col).alias("text"))
    return materialize(rows.mapInArrow(run, "doc_id long, held_out boolean, lang string, words binary"), "numbered")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """t_id, toxic, words, lang, aside of all rows that are learned from: every id with one label that is not held out.

    aside: of the fifth of them that calibrates."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("t_id"))
    known = known.agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").cast("int").alias("other")).where("toxic = other").select("t_id", "toxic")
    known = known.where(~held_out(F.col("t_id")))
    found = rows.where("NOT held_out").select(F.col("doc_id").alias("t_id"), "words", "lang").join(known, "t_id")
    found = found.groupBy("t_id").agg(F.min("toxic").alias("toxic"), F.min("words").alias("words"), F.min("lang").alias("lang"))
    aside = F.crc32(F.concat(F.lit("aside:"), F.col("t_id").cast("string")).cast("binary")) % 5 == 0
    return materialize(found.withColumn("aside", aside), "labelled")


def chunks_of(rows: DataFrame, total: int) -> DataFrame:
    """chunk, words, sizes, toxic: the rows dealt by a hash of their ids, some thousand as one row."""

    def run(batches):
        import pyarrow as pa

        part, made = TaskContext.get().partitionId(), 0
        words, toxic, size = [], [], 0

        def packed():
            data = [[(part << 32) + made], [b"".join(words)], [[len(w) // 2 for w in words]], [list(toxic)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, (pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())))], names=["chunk", "words", "sizes", "toxic"])

        for batch in batches:
            for w, label in zip(batch.column(0), batch.column(1).to_pylist()):
                w = w.as_py()
                if words and size + len(w) // 2 > CHUNK_WORDS:
                    yield packed()
                    words, toxic, size, made = [], [], 0, made + 1
                words.append(w)
                toxic.append(label)
                size += len(w) // 2
        if words:
            yield packed()

    rank = F.xxhash64(F.lit("chunk"), "t_id")
    dealt = rows.repartition(max(1, -(-total // CHUNK)), rank).sortWithinPartitions(rank, "t_id").select("words", "toxic")
    return materialize(dealt.mapInArrow(run, "chunk long, words binary, sizes array<int>, toxic array<int>"), "chunks")


def changes(chunks: DataFrame, network: Network, weights: tuple[float, float], seed: int, epoch: int) -> DataFrame:
    """slice, n, numbers: what an epoch changes, added up over all chunks.  Slice -1 is of the dense numbers, n the chunks."""
    import pickle

    model = chunks.sparkSession.sparkContext.broadcast(pickle.dumps(network))  # 3.2 MB

    def run(batches):
        import pyarrow as pa

        start, total, dense, seen = pickle.loads(model.value), None, 0.0, 0
        for batch in batches:
            for chunk, words, sizes, toxic in zip(*batch.columns):
                ends = np.cumsum(np.array(sizes.as_py(), np.int64)) * 2
                data, labels = words.as_py(), np.array(toxic.as_py())
                texts = [padded(data[x:y]) for x, y in zip([0, *ends[:-1]], ends)]
                now = start.copy()
                order = np.random.default_rng([seed, epoch, chunk.as_py()]).permutation(len(texts))
                now.learn(texts, labels, np.array(weights)[labels], order)
                if total is None:
                    total = np.zeros((BUCKETS, 2 * DIM + 1))
                moved = (now.slots[0] != start.slots[0]).any(axis=1)
                total[moved, :DIM] += now.table[moved] - start.table[moved]
                total[moved, DIM:-1] += now.slots[0][moved] - start.slots[0][moved]
                total[moved, -1] += 1
                dense, seen = dense + (now.dense().astype(float) - start.dense()), seen + 1
        if seen:
            parts = {-1: dense} | {k: total[k * SLICE : (k + 1) * SLICE] for k in range(BUCKETS // SLICE)}
            yield pa.RecordBatch.from_pydict({"slice": pa.array(parts, pa.int32()), "part": pa.array([TaskContext.get().partitionId()] * len(parts), pa.int32()), "n": pa.array([seen] * len(parts), pa.int64()), "numbers": pa.array([x.astype(np.float32).tobytes() for x in parts.values()], pa.binary())})

    def added(group):
        import pyarrow as pa

        group = group.sort_by("part")
        total = sum(np.frombuffer(x.as_py(), np.float32).astype(float) for x in group.column("numbers"))
        return pa.table({"slice": group.column("slice")[:1], "n": pa.array([sum(group.column("n").to_pylist())], pa.int64()), "numbers": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    each = chunks.mapInArrow(run, "slice int, part int, n long, numbers binary")
    return each.groupBy("slice").applyInArrow(added, "slice int, n long, numbers binary")


def cutoffs(scored: DataFrame) -> DataFrame:
    """lang, cutoff for languages with 20 rows or more: the cutoff with the best F1.  scored: lang, toxic, score."""
    grid = [float(g) for g in np.linspace(0.05, 0.95, 19)]
    count = lambda test: F.sum(test.cast("long"))
    toxic, over = F.col("toxic") == 1, lambda g: F.col("score") >= g
    counts = scored.groupBy("lang").agg(F.count("*").alias("n"), count(toxic).alias("t"), *[c for k, g in enumerate(grid) for c in (count(over(g)).alias(f"p{k}"), count(over(g) & toxic).alias(f"h{k}"))])
    f1 = lambda k: 2 * F.col(f"h{k}") / F.greatest(F.lit(1), F.col(f"p{k}") + F.col("t"))
    best = F.array_max(F.array(*[F.struct(f1(k).alias("f1"), F.lit(-g).alias("g")) for k, g in enumerate(grid)]))
    return counts.where("n >= 20").select("lang", (-best["g"]).alias("cutoff"))


def train(rows: DataFrame, labels: DataFrame, seed: int = 7) -> tuple[Network, DataFrame | None]:
    """The network, and thresholds by language (lang, cutoff) where they are not 0.5.  rows: as of `numbered`.

    All labelled rows that are not held out count: a fifth of them calibrates, the rest is learned from in every epoch.  Only
    one network at a time reaches the driver.  Without labels of both kinds the network is as at its start.
    """
    known = labelled(rows, labels)
    count = {(r.aside, r.toxic): r["count"] for r in known.groupBy("aside", "toxic").count().collect()}
    none, some = count.get((False, 0), 0), count.get((False, 1), 0)
    network, total = Network(seed), none + some
    if not none or not some:
        return network, None
    weights = 0.5 * total / none, 0.5 * total / some  # both labels weigh the same
    chunks = chunks_of(known.where("NOT aside"), total)
    for epoch in range(EPOCHS):
        with small_batches(rows.sparkSession):
            found = changes(chunks, network, weights, seed, epoch).collect()  # BUCKETS / SLICE + 1 rows, 3.3 MB
        for r in found:
            numbers = np.frombuffer(r.numbers, np.float32)
            if r.slice < 0:
                network.set_dense(network.dense() + numbers / r.n)
                continue
            numbers, here = numbers.reshape(SLICE, -1), slice(r.slice * SLICE, (r.slice + 1) * SLICE)
            n = np.maximum(numbers[:, -1:], 1)
            network.table[here] += numbers[:, :DIM] / n
            network.slots[0][here] += numbers[:, DIM:-1] / n
    scored = scores_of(known.where("aside").select("lang", "toxic", "words"), network, "lang string, toxic int")
    return network, materialize(cutoffs(scored), "cutoffs")


_models: dict[str, Scorer] = {}


def _scorer(key: str, packed: bytes) -> Scorer:
    """One scorer for each model and Python worker."""
    import pickle

    if key not in _models:
        _models.clear()
        _models[key] = Scorer(pickle.loads(packed))
    return _models[key]


def scores_of(rows: DataFrame, network: Network, schema: str) -> DataFrame:
    """The other columns of rows, with the score of its last one, words."""
    import pickle
    import uuid

    key = uuid.uuid4().hex
    model = rows.sparkSession.sparkContext.broadcast(pickle.dumps(network))  # 3.2 MB

    def run(batches):
        import pyarrow as pa

        scorer = _scorer(key, model.value)
        for batch in batches:
            scores = pa.array([scorer.of_numbers(padded(w.as_py())) for w in batch.column(batch.num_columns - 1)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=[*batch.schema.names[:-1], "score"])

    return rows.mapInArrow(run, f"{schema}, score double")


def score(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (score >= 0.5), flagged (score >= the language's threshold).

    The score takes the whole text and nothing else.  A null or empty text is scored as one without words; a null id is not
    held out; repeated rows are scored each; other columns are left out; an empty table gives an empty one.
    """
    rows = numbered(docs, id_col, text_col, lang_col)
    network, thresholds = train(rows, labels)
    found = scores_of(rows, network, "doc_id long, held_out boolean, lang string")
    cutoff = F.lit(0.5)
    if thresholds is not None:
        found = found.join(thresholds.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")), "left")
        cutoff = F.coalesce("cutoff", cutoff)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= cutoff).alias("flagged"))
