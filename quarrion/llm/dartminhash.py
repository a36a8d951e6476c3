"""Near-duplicate documents by weighted minwise hashing with darts.

A document is a weighted set of hashed word shingles.  Every element owns a region as wide as its weight, and hashed darts
fall on it in the order of a Poisson process, alike for all documents.  A dart names one of k coordinates; the first dart on
each coordinate is kept.  Two documents agree on a coordinate with the probability of their weighted Jaccard similarity, and
a signature takes time in the number of elements plus k log k.  Bands of coordinates propose pairs, which are verified on
the texts.

Most texts share no bucket and most buckets have one member: these are sifted out by a map of bits before texts or keys are
shuffled for a join.

Buckets with the same members count once.  A bucket of up to WHOLE members is compared whole, in one step: the matrix of
which text has which shingle, times itself.  A larger one is dealt into chunks of that size, and what leaves a chunk are the
edges that span what is linked in it.  Every text is first compared in the largest of its buckets alone, so its shingles are
sent once, and near copies, which share many buckets, are mostly connected after this.  Then come the chunks whose members
are not all connected and were not all in that step, so a large group of near copies is one component by its many buckets,
without its pairs.  Members of a large bucket that are not connected then meet by their rarest shingles (see `rest`), so no
pair that shares a bucket is lost, and a bucket that holds many texts which only share a passage makes few pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import UnitCache, discard, materialize, portions, text_or_empty, transient, words_of
from .graph import components, join_spread, sift

ROWS, BANDS = 8, 48  # finds a pair of similarity 0.8 with probability 1 - (1 - 0.8 ** 8) ** 48 = 0.9999
#: Up to so many members of a bucket are compared with each other in one step, and so many of a side in later ones.
WHOLE, SIDE = 256, 256
#: Up to so many blocks of members outside the largest component of a bucket are compared with all its members.
FEW = 8
#: Similarities are quotients of whole numbers; sums of them that are equal may differ by less than this.
TIE = 1e-9
#: Keys are counted by so many of their bits, as the others don't compress; keys that agree in these alone are told apart later.
KEY_BITS = (1 << 40) - 1
_SHINGLE_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A hash of 64-bit numbers."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Salts of a slice's first darts.
_SALTS = mix(np.arange(64, dtype=np.uint64), 3)


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers between 0 and 1, both excluded."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _word_hash(word: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word)


_words = UnitCache(_word_hash, 100_000)


def shingles(text: str, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of `size` words with their counts; a shorter text is one shingle, one without words has none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        total += h[k : k + n] * (_SHINGLE_MIX[k % 5] + np.uint64(2 * (k // 5)))
    return np.unique(mix(total), return_counts=True)


def darts(elements: np.ndarray, weights: np.ndarray | None, k: int) -> np.ndarray:
    """The signature: per coordinate the earliest dart, as its 64-bit hash.  elements must be distinct and not empty.

    A region is cut into slices of width 1; each slice has its own stream of darts with exponential gaps in time, and the
    dart's place in the slice decides whether a partial slice holds it.  Time runs until every coordinate is hit.
    """
    room = None
    if weights is None or weights.max() == 1 == weights.min():
        slices, total = elements, float(len(elements))
    else:
        parts = np.maximum(np.ceil(weights).astype(np.int64), 1)
        which = np.repeat(np.arange(len(elements)), parts)
        depth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        slices = mix(elements[which] ^ mix(depth.astype(np.uint64), 7) * np.uint64(2) + np.uint64(1))
        slices = np.where(depth == 0, elements[which], slices)
        total = float(weights.sum())
        if total < len(slices):
            room = np.minimum(weights[which] - depth, 1.0)
    until = k * (np.log(k) + 3) / total
    while True:
        ids, times = _throw(slices, room, until)
        order = np.argsort(times)[::-1]
        out, hit = np.zeros(k, np.uint64), np.zeros(k, bool)
        where = (mix(ids, 2) % np.uint64(k)).astype(np.int64)[order]
        out[where] = ids[order]  # of several on a coordinate the last written stays: the earliest
        hit[where] = True
        if hit.all():
            return out
        until *= 2


def _throw(slices: np.ndarray, room: np.ndarray | None, until: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and times of all darts up to a time."""
    ids, times = [], []
    if until > 3:  # few slices, many darts on each
        n = int(until + 6 * np.sqrt(until) + 10)
        while True:
            each = mix(slices[:, None] ^ mix(np.arange(n, dtype=np.uint64), 3)[None, :])
            when = np.cumsum(-np.log(unit(each)), axis=1)
            if (when[:, -1] > until).all():
                break
            n *= 2
        keep = when <= until
        if room is not None:
            keep &= unit(mix(each, 1)) < room[:, None]
        return each[keep], when[keep]
    live, clock, left = slices, np.zeros(len(slices)), room
    j, salts = 0, _SALTS
    while len(live):
        if j == len(salts):
            salts = mix(np.arange(2 * j, dtype=np.uint64), 3)
        each = mix(live ^ salts[j])
        clock = clock - np.log(unit(each))
        keep = clock <= until
        live, clock, each = live[keep], clock[keep], each[keep]
        if left is not None:
            left = left[keep]
            held = unit(mix(each, 1)) < left
            ids.append(each[held])
            times.append(clock[held])
        else:
            ids.append(each)
            times.append(clock)
        j += 1
    return np.concatenate(ids), np.concatenate(times)


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band."""
    table = signature.reshape(-1, rows)
    odd = mix(np.arange(rows, dtype=np.uint64), 12) | np.uint64(1)
    return mix((table * odd).sum(axis=1, dtype=np.uint64) ^ mix(np.arange(len(table), dtype=np.uint64), 11)).view(np.int64)


def tokens_of(text: str, size: int, weighted: bool) -> np.ndarray:
    """A text's shingles as a set of 64-bit numbers, sorted.  weighted: a shingle that comes n times is n tokens, so the
    Jaccard similarity of the sets is the weighted one of the counts."""
    found, counts = shingles(text, size)
    if weighted and len(found) and counts.max() > 1:
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        again = mix(np.repeat(found, counts) ^ mix(nth.astype(np.uint64), 5))
        found = np.unique(np.where(nth == 0, np.repeat(found, counts), again))
    return found


def signed(docs: DataFrame, id_col: str, text_col: str, size: int, weighted: bool, rows: int, n_bands: int) -> DataFrame:
    """doc_id, digest of the text, bands (empty for a text without words)."""

    def run(batches):
        import pyarrow as pa

        for batch in portions(batches, 1024):
            keys = []
            for cell in batch.column(2):
                found, counts = shingles(cell.as_py(), size)
                keys.append(bands(darts(found, counts.astype(float) if weighted else None, rows * n_bands), rows) if len(found) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "digest", "bands"])

    return told_apart(docs, id_col, text_col).mapInArrow(run, "doc_id long, digest binary, bands array<long>")


def told_apart(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, digest, text: of a null text as of an empty one."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "text")


def token_table(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, weighted: bool, more: tuple[str, ...] = ()) -> DataFrame:
    """node, part, tokens for the texts of nodes (node, digest): each text once, whatever rows repeat it.  more: further
    columns of nodes to keep, longs."""

    def run(batches):
        import pyarrow as pa

        for some in portions(batches):
            found = pa.array([tokens_of(t.as_py(), size, weighted).view(np.int64) for t in some.column(2)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), found, *some.columns[3:]], names=["node", "part", "tokens", *more])

    need = materialize(nodes.select(F.col("node").alias("doc_id"), "digest", *more), "needed")
    few = sift(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), need, ["doc_id"])
    # they grow with the documents, so they are merged at every size and small runs tell what large ones do
    own = told_apart(few, "doc_id", "text").join(need.hint("shuffle_merge"), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
    own = own.select(F.col("doc_id").alias("node"), F.xxhash64("digest").alias("part"), "text", *more)
    return materialize(own.mapInArrow(run, ", ".join(["node long, part long, tokens array<long>", *(f"{c} long" for c in more)])), "tokens")


def alike(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """i < j of all pairs of sorted sets with a Jaccard similarity of `least` or more.

    Tokens that two sets or more hold are columns of a matrix of zeros and ones, taken some thousand at a time; its product
    with itself counts what each pair has in common.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    k = len(sets)
    if k == 2:
        if sizes.min() < least * sizes.max() - TIE:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        common = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))], [0, 0]], np.float64)
    else:
        _, token, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = many[token] > 1
        column = (np.cumsum(many > 1) - 1)[token[shared]]
        owner = np.repeat(np.arange(k), sizes)[shared]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        common = np.zeros((k, k))
        n = int(column[-1]) + 1 if len(column) else 0
        width = max(1, min(n, 2_000_000 // k))
        cuts = np.searchsorted(column, np.arange(0, n + width, width))
        for begin, end in zip(cuts[:-1], cuts[1:]):
            part = np.zeros((k, width), np.float32)
            part[owner[begin:end], column[begin:end] % width] = 1
            common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    return np.nonzero(np.triu(common / np.maximum(union, 1) >= least, 1))


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of n members with links i, j: for each the first member that it reaches."""
    label = np.arange(n)
    while len(i):
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def grouped(batches, keys: int):
    """Tables of the rows that agree in the first `keys` columns; the batches come sorted by them."""
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        marks = np.stack([held.column(k).to_numpy() for k in range(keys)])
        begin = 0
        for cut in np.nonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0))[0] + 1:
            yield held.slice(begin, cut - begin)
            begin = int(cut)
        held = held.slice(begin)
    if held is not None:
        yield held


def met(groups: DataFrame, keys: list[str], least: float) -> DataFrame:
    """a, b of edges that span what is linked within each group.  groups: keys, node, side, tokens.

    Members are compared with all others, or where sides differ from 0, those of side 1 with those of side 2 alone.
    """

    def run(batches):
        import pyarrow as pa

        out, size = [], 0
        for g in grouped(batches, len(keys)):
            if g.num_rows < 2:
                continue
            node, side = (g.column(len(keys) + k).to_numpy() for k in (0, 1))
            lists = g.column(len(keys) + 2).combine_chunks()
            flat, at = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            i, j = alike([flat[x:y] for x, y in zip(at[:-1], at[1:])], least)
            fine = (side[i] == 0) | (side[i] != side[j])
            label = spanning(g.num_rows, i[fine], j[fine])
            moved = node != node[label]
            if moved.any():
                out.append((node[moved], node[label][moved]))
                size += int(moved.sum())
            if size > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*out)], names=["a", "b"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*out)], names=["a", "b"])

    rows = groups.select(*keys, "node", "side", "tokens").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(run, "a long, b long")


def buckets_of(rows: DataFrame, total: int, more=()) -> DataFrame:
    """rows (key, node, part, ...) of buckets with two members or more, with the size n; of buckets with the same members
    one stays.  more: aggregates by key that a bucket must have different, as (low, high) columns."""
    short = F.col("key").bitwiseAND(F.lit(KEY_BITS))
    again = materialize(rows.groupBy(short.alias("short")).agg(F.count("*").alias("n")).where("n > 1").select("short"), "again")
    rows = materialize(sift(rows.withColumn("short", short), again, ["short"]).drop("short"), "shared")
    sized = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node", "part")).alias("x"), *more).where("n > 1")
    if more:
        sized = sized.where("low < high")
    one = sized.groupBy("n", "x").agg(F.min("key").alias("key")).select("key", "n")
    one = materialize(one, "sizes")
    # shared buckets grow with the documents, so they are merged at every size and small runs tell what large ones do
    return join_spread(rows, one, "key", "n", total, "shuffle_merge")


def links(nodes: DataFrame, tokens: DataFrame, least: float, whole: int = WHOLE, **blocks) -> DataFrame:
    """a, b of verified links that join all nodes which sharing a bucket and a similarity of `least` would join.

    nodes: node, part, bands; tokens: node, part, tokens of those that share a bucket, a function of these rows that may keep
    their other columns.  See the module's text.
    """
    rows = nodes.select("node", "part", F.explode("bands").alias("key"))
    chunk = F.pmod(F.xxhash64("key", "node", "part"), F.ceil(F.col("n") / whole)).cast("long")
    rows = buckets_of(rows, nodes.count() * BANDS).withColumn("chunk", chunk)
    # a text has BANDS buckets at most
    largest = F.max(F.struct("n", "key")).over(Window.partitionBy("node", "part"))
    rows = materialize(rows.withColumn("first", F.struct("n", "key") == largest), "buckets")
    once = rows.where("first").select("node", "part", "key", "chunk")
    ready = tokens(once)
    met_once = ready if "chunk" in ready.columns else ready.join(once, ["node", "part"])
    found = materialize(met(met_once.withColumn("side", F.lit(0)), ["key", "chunk"], least), "links")
    ready = ready.select("node", "part", "tokens")
    roots = components(found)
    found = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    open_, groups = not_connected(rows, roots)
    if groups:
        need = sift(ready, open_.select("node", "part").distinct(), ["node", "part"])
        again = open_.withColumn("side", F.lit(0)).join(need.hint("shuffle_merge"), ["node", "part"])
        found = found.unionByName(materialize(met(again, ["key", "chunk"], least), "links"))
    large = rows.where(F.col("n") > whole).select("key", "node", "part")
    if not large.head(1):
        return found
    return found.unionByName(rest(large, ready, components(found) if groups else roots, least, **blocks))


def not_connected(rows: DataFrame, roots: DataFrame) -> tuple[DataFrame, int]:
    """The rows (key, chunk, node, part, first) of chunks that hold two roots or more and were not met whole as the first of
    all their members, and how many chunks these are.  Of chunks with the same members one stays."""
    placed = materialize(rows.join(roots, "node", "left").select("key", "chunk", "node", "part", "first", F.coalesce("root", "node").alias("root")), "placed")
    sized = placed.groupBy("key", "chunk").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node", "part")).alias("x"), F.min("root").alias("low"), F.max("root").alias("high"), F.bool_and("first").alias("met"))
    left = materialize(sized.where("low < high AND NOT met").groupBy("n", "x").agg(F.min(F.struct("key", "chunk")).alias("g")).select("g.*"), "open")
    return materialize(placed.join(left, ["key", "chunk"], "left_semi").select("key", "chunk", "node", "part"), "open"), left.count()


def in_blocks(rows: DataFrame, tokens: DataFrame, least: float, side: int, few: int | None = None) -> tuple[DataFrame | None, DataFrame]:
    """Links between a bucket's largest component and the members outside it, and among these, compared in blocks of `side`.

    rows: key, node, part, root.  Buckets with more than `few` blocks of outsiders are left out and come back as rows.
    """
    sized = rows.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.max("m").alias("m"), F.sum("m").alias("n"))
    main = sized.where("m < n").select("key", "main", "n", F.ceil((F.col("n") - F.col("m")) / side).cast("int").alias("strays"), F.ceil(F.col("n") / side).cast("int").alias("pieces"))
    main, total = materialize(main, "main"), rows.count()
    small = main if few is None else main.where(F.col("strays") <= few)
    placed = materialize(join_spread(rows, small, "key", "n", total), "placed")
    tokens = sift(tokens, placed.select("node", "part").distinct(), ["node", "part"])
    hash_ = F.xxhash64("key", "node", "part")
    stray = placed.where("root <> main").select("key", F.pmod(hash_, "strays").cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("p"), "node", "part", F.lit(1).alias("side"))
    each = placed.select("key", F.explode(F.sequence(F.lit(0), F.col("strays") - 1)).alias("q"), F.pmod(hash_, "pieces").cast("int").alias("p"), "node", "part", F.lit(2).alias("side"))
    found = materialize(met(stray.unionByName(each).join(tokens, ["node", "part"]), ["key", "q", "p"], least), "links")
    left = None if few is None else main.where(F.col("strays") > few).select("key", "n")
    return (join_spread(rows, left, "key", "n", total) if left is not None and left.head(1) else None), found


def rest(large: DataFrame, tokens: DataFrame, roots: DataFrame, least: float, side: int = SIDE, few: int = FEW) -> DataFrame:
    """a, b of links between members of large buckets that are not connected yet.  large: key, node, part; roots: node, root.

    Where few are outside a bucket's largest component, they are compared with all members.  Of other buckets, two sets of
    similarity t have one in common of the |x| - ceil(t |x|) + 1 elements of each that come first in any order of all
    elements, the rarest first: every such element is a bucket of its own, for which the same is done.
    """
    rows = large.select("key", "node", "part").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    left, found = in_blocks(materialize(rows, "open"), tokens, least, side, few)
    if left is None:
        return found
    open_ = materialize(left.select("node", "part", "root").distinct(), "open")
    every = materialize(open_.join(tokens, ["node", "part"]), "open").select("node", "part", F.explode("tokens").alias("key"))
    sized = every.groupBy("key").agg(F.count("*").alias("n"))
    ranked = join_spread(every, sized, "key", "n", every.count()).groupBy("node", "part").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("t"))
    taken = F.size("t") - F.ceil(F.size("t") * least - TIE).cast("int") + 1
    first = ranked.select("node", "part", F.explode(F.slice("t", F.lit(1), taken)).alias("t")).where("t.n > 1").select("node", "part", F.col("t.key").alias("key"))
    split = materialize(first.join(open_, ["node", "part"]), "split")
    split = materialize(buckets_of(split, split.count(), (F.min("root").alias("low"), F.max("root").alias("high"))), "split")
    return found.unionByName(in_blocks(split.drop("n"), tokens, least, side)[1])


def classes(docs: DataFrame, least: float = 0.8, size: int = 5, weighted: bool = True, rows: int = ROWS, n_bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, kept for every row: class_id is the smallest id that the document reaches by links.

    Documents are linked if their texts are equal, or if the Jaccard similarity of their shingles of `size` words is
    `least` or more and they share a band.  weighted: a shingle weighs as often as it comes, and the similarity is the sum
    of the lesser weights over that of the greater ones; else every shingle weighs 1.  The two are the same for texts that
    repeat no shingle.  A null text counts as empty; texts without words are linked only if equal; a text shorter than
    `size` words is one shingle; a long one is taken whole.  The texts of one id count as one document.  Rows with a null id
    are in no class (class_id null, kept).  kept: the id is its class's; repeated rows of it are all kept.  Other columns are
    left out, whatever their names.  An empty table gives an empty one.
    """
    with transient(docs.sparkSession) as keep:
        marked = materialize(signed(docs, id_col, text_col, size, weighted, rows, n_bands), "signed")
        all_rows = materialize(marked.select("doc_id", "digest"), "rows")
        ids = all_rows.where("doc_id IS NOT NULL")
        texts_of = ids.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"))
        texts_of = materialize(texts_of.withColumn("part", F.xxhash64("digest")), "texts")
        total = ids.count()
        member = materialize(join_spread(ids, texts_of.select("digest", "node", "n"), "digest", "n", total).select("doc_id", "node").distinct(), "members")
        # texts that come once keep their bands where they are; of others, and a few more, one row stays
        copied = materialize(texts_of.where("n > 1").select("digest"), "copied")
        marked = marked.where("doc_id IS NOT NULL")
        one = sift(marked, copied, ["digest"]).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.any_value("bands").alias("bands"))
        one = sift(marked, copied, ["digest"], "left_anti").unionByName(materialize(one, "signed"))

        def tokens(some: DataFrame) -> DataFrame:
            discard(docs.sparkSession, "signed")  # buckets are written by now
            need = sift(texts_of.select("node", "part", "digest"), some, ["node", "part"]).join(some, ["node", "part"])
            return token_table(need, docs, id_col, text_col, size, weighted, ("key", "chunk"))

        found = links(one.select(F.col("doc_id").alias("node"), F.xxhash64("digest").alias("part"), "bands"), tokens, least)
        discard(docs.sparkSession, "tokens")
        copies = member.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
        # an id with several texts joins their nodes; other copies hang on one node and need no rounds
        several = copies.join(copies.unionByName(member.where("doc_id = node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))).groupBy("a").agg(F.count("*").alias("n")).where("n > 1"), "a", "left_semi")
        roots = components(found.unionByName(several))
        placed = member.groupBy("doc_id").agg(F.min("node").alias("node"))
        named = placed.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("class_id"))
        # one row for each row of docs, repeated ids included
        out = all_rows.select("doc_id").join(named, "doc_id", "left")
        return keep(out.select("doc_id", "class_id", (F.col("class_id").isNull() | (F.col("doc_id") == F.col("class_id"))).alias("kept")), "classes")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that share a class with a smaller id, with all their columns.

    Of several rows of a kept id the one of the least text stays, of equal texts that of the least hash of its columns; rows
    of a null id all stay.  An empty table gives an empty one.
    """
    found = classes(docs, id_col=id_col, text_col=text_col, **options).groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n"))
    name = "d_id"
    while name in docs.columns:
        name = f"d_{name}"
    odd = materialize(found.where("doc_id IS NOT NULL AND (NOT kept OR n > 1)").select(F.col("doc_id").alias(name), F.col("kept").alias("d_kept")), "dropped")
    match = docs[id_col].cast("long") == odd[name]
    single = docs.join(odd, match, "left_anti")
    again = docs.join(odd.where("d_kept").select(name), match, "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = F.struct(text_or_empty(text_col), F.md5(F.to_json(whole)))
    again = again.groupBy(F.col(id_col).cast("long").alias("d_key")).agg(F.min_by(whole, first).alias("d_row")).select("d_row.*")
    return single.unionByName(again).select(*docs.columns)
