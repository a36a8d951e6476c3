"""Near-duplicate vectors by lattice hashing.

In each of several tables a vector is projected at random to blocks of eight dimensions, and each block is decoded to the
nearest point of the lattice E8.  The points of all blocks are the vector's cell; with one block's point replaced by one of
the next nearest they are the neighbouring cells that it probes.  Two vectors meet where the cell of one is the cell of, or
probed by, the other, and their cosine is computed in double precision.

The members of a cell are compared block by block, as matrices; what leaves a comparison are counts and the few edges that
span what is connected, not the pairs.  A pair that meets in several cells counts in the first alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .dartminhash import mix
from .graph import components, join_spread

#: With these, pairs of cosine 0.98 meet in some cell with a probability of 0.98 or more for vectors of 16 to 768 numbers, and
#: less than one in ten thousand pairs of random vectors does (see the tests).
TABLES, BLOCKS, PROBES, SCALE = 12, 2, 2, 4.0
#: Vectors of a cell that one task compares at once.
SIDE = 512


def e8_points(y: np.ndarray, more: int) -> np.ndarray:
    """Twice the coordinates of the nearest point of E8 and of `more` next ones, nearest first: (n, 1 + more, 8) integers.

    E8 is the points with whole coordinates of even sum, and these moved by a half in every coordinate.  In each of the two
    parts the nearest points differ from rounding in the coordinates that rounding changed most.
    """
    found, far = [], []
    for shift in (0.0, 0.5):
        z = y - shift
        r = np.rint(z)
        e = z - r
        worst = np.argsort(-np.abs(e), axis=1, kind="stable")[:, :3]
        step = np.where(np.take_along_axis(e, worst, 1) >= 0, 1.0, -1.0)
        odd = np.mod(r.sum(axis=1), 2) == 1
        for k in range(3):
            p = r.copy()
            at = np.arange(len(y))
            # odd: move one coordinate; even: none, or the worst and another
            one = odd
            p[at[one], worst[one, k]] += step[one, k]
            if k:
                two = ~odd
                p[at[two], worst[two, 0]] += step[two, 0]
                p[at[two], worst[two, k]] += step[two, k]
            p += shift
            found.append(np.rint(2 * p).astype(np.int64))
            far.append(((y - p) ** 2).sum(axis=1))
    order = np.argsort(np.stack(far, 1), axis=1, kind="stable")[:, : 1 + more]
    return np.take_along_axis(np.stack(found, 1), order[:, :, None], 1)


def projections(dim: int, tables: int, blocks: int, seed: int = 8) -> np.ndarray:
    """(tables, blocks, 8, dim), scaled so that a unit vector keeps length 1 on average whatever dim is.

    Rows are orthogonal where dim allows; their squares sum to dim over all rows, as those of one row in each dimension would.
    """
    rng = np.random.default_rng([seed, dim])
    n = blocks * 8
    out = rng.standard_normal((tables, n, dim))
    if dim >= n:
        out = np.stack([np.linalg.qr(m.T)[0].T for m in out]) * np.sqrt(dim / n)
    else:
        out /= np.sqrt(n)
    return out.reshape(tables, blocks, 8, dim)


def cell_keys(units: np.ndarray, salt: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """(n, tables, 1 + blocks * probes) keys of unit vectors: the own cell first, then the probed ones.  salt keeps groups apart."""
    n, dim = units.shape
    out = np.empty((n, tables, 1 + blocks * probes), np.uint64)
    for t, table in enumerate(projections(dim, tables, blocks)):
        codes = []
        for b in range(blocks):
            points = e8_points(scale * units @ table[b].T, probes).astype(np.uint64)
            code = np.full(points.shape[:2], b + 1, np.uint64)
            for k in range(8):
                code = mix(code ^ points[:, :, k], k)
            codes.append(code)
        total = sum(c[:, 0] for c in codes)
        keys = [total]
        for c in codes:
            keys += [total - c[:, 0] + c[:, 1 + p] for p in range(probes)]
        out[:, t] = mix(np.stack(keys, 1) ^ mix(salt + np.uint64(t * 2 + 1))[:, None])
    return out


def keyed(reps: DataFrame, tables: int, blocks: int, probes: int, scale: float) -> DataFrame:
    """rep, label_hash, vec, n → rep, n, vec (unit length), keys (own cell and probed ones, by table)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            vecs, salts = batch.column(2).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            units, keys = [None] * len(vecs), [None] * len(vecs)
            sizes = np.array([len(v) for v in vecs])
            for dim in np.unique(sizes):
                at = np.nonzero(sizes == dim)[0]
                x = np.array([vecs[k] for k in at], np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                found = cell_keys(x, mix(salts[at], int(dim)), tables, blocks, probes, scale).reshape(len(at), -1).view(np.int64)
                for k, u, c in zip(at, x, found):
                    units[k], keys[k] = u, c
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(units, pa.list_(pa.float64())), pa.array(keys, pa.list_(pa.int64()))], names=["rep", "n", "vec", "keys"])

    return reps.select("rep", "label_hash", "vec", "n").mapInArrow(run, "rep long, n long, vec array<double>, keys array<long>")


def first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of key tables (pairs, tables, 1 + probes): the least key in the first table where they meet, whoever owns it."""
    meets = a[:, :, :, None] == b[:, :, None, :]
    table = meets.any(axis=(2, 3)).argmax(axis=1)
    at = np.arange(len(a))
    return np.where(meets[at, table].any(axis=2), a[at, table], np.iinfo(np.int64).max).min(axis=1)


def compare(key: int, one_side: bool, first: np.ndarray, reps: np.ndarray, many: np.ndarray, vecs: np.ndarray, keys: np.ndarray, least: float):
    """Links among vectors of a cell: (reps, links of each that count here), and edges that span the connected ones.

    one_side: all are compared with each other; else those marked `first` with the others.
    """
    if one_side:
        i, j = np.nonzero(np.triu(vecs @ vecs.T >= least, 1))
    else:
        p, q = np.nonzero(first)[0], np.nonzero(~first)[0]
        i, j = np.nonzero(vecs[p] @ vecs[q].T >= least)
        i, j = p[i], q[j]
    own = np.zeros(len(i), bool)
    for at in range(0, len(i), 20_000):
        part = slice(at, at + 20_000)
        own[part] = first_meeting(keys[i[part]], keys[j[part]]) == key
    links = np.zeros(len(reps), np.int64)
    np.add.at(links, i[own], many[j[own]])
    np.add.at(links, j[own], many[i[own]])
    label = np.arange(len(reps))
    while len(i):
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved, some = label != np.arange(len(reps)), links > 0
    return reps[some], links[some], reps[moved], reps[label[moved]]


def cell_links(rows: DataFrame, least: float, shape: tuple[int, int]) -> DataFrame:
    """kind 0: rep a has b links more; kind 1: reps a and b are connected.  rows: key, p, q, blk, rep, n, vec, keys."""

    def run(batches):
        import pyarrow as pa

        def groups():
            held = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table])
                marks = np.stack([held.column(k).to_numpy() for k in range(3)])
                cuts = np.nonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0))[0] + 1
                begin = 0
                for cut in cuts:
                    yield held.slice(begin, cut - begin)
                    begin = int(cut)
                held = held.slice(begin)
            if held is not None:
                yield held

        out, kinds, size = ([], []), [], 0
        for g in groups():
            n = g.num_rows
            if n < 2:
                continue
            matrix = lambda k, kind: g.column(k).combine_chunks().flatten().to_numpy().astype(kind, copy=False).reshape(n, -1)
            blk = g.column(3).to_numpy()
            p, q = int(g.column(1)[0].as_py()), int(g.column(2)[0].as_py())
            a, links, x, y = compare(g.column(0)[0].as_py(), p == q, blk == p, g.column(4).to_numpy(), g.column(5).to_numpy(), matrix(6, np.float64), matrix(7, np.int64).reshape(n, *shape), least)
            for k, (u, v) in enumerate(((a, links), (x, y))):
                if len(u):
                    kinds.append(np.full(len(u), k, np.int32))
                    out[0].append(u)
                    out[1].append(v)
                    size += len(u)
            if size > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in (kinds, *out)], names=["kind", "a", "b"])
                out, kinds, size = ([], []), [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in (kinds, *out)], names=["kind", "a", "b"])

    names = ["key", "p", "q", "blk", "rep", "n", "vec", "keys"]
    return rows.select(*names).repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(run, "kind int, a long, b long")


def near_vectors(vectors: DataFrame, least: float = 0.98, id_col="vec_id", vec_col="embedding", label_col="label", tables=TABLES, blocks=BLOCKS, probes=PROBES, scale=SCALE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors are linked if their labels are equal and not null, their lengths are equal, and their cosine is `least` or more.
    Null, empty and zero vectors and such with a null or non-finite component link with nothing, nor does a row with a null
    id (component_id null, kept).  Equal vectors of a label are one point with a count, so copies are never paired;
    repeated rows count as copies.  Other columns are left out, whatever their names.  An empty table gives an empty one.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).cast("string").alias("label"))
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("vec", sound) & F.exists("vec", lambda x: x != 0), F.lit(False))
    marked = rows.withColumn("digest", F.when(fine, F.md5(F.concat_ws("|", "label", F.col("vec").cast("string")))))
    ids = materialize(marked.select("vec_id", "digest"), "ids")
    groups = marked.where("digest IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.any_value("vec").alias("vec"), F.any_value("label").alias("label"), F.count("*").alias("n"))
    # an id with several vectors: the points are told apart by number, and joined in the end
    groups = materialize(groups.withColumns({"label_hash": F.xxhash64("label"), "point": F.monotonically_increasing_id()}), "points")
    points = materialize(keyed(groups.select(F.col("point").alias("rep"), "label_hash", "vec", "n"), tables, blocks, probes, scale), "cells")
    flat = points.select("rep", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = materialize(flat.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
    met = join_spread(flat, sizes, "key", "m", points.count() * tables * (1 + blocks * probes))
    parts = F.greatest(F.ceil(F.col("m") / SIDE), F.lit(1)).cast("int")
    met = met.withColumn("blk", F.pmod(F.hash("rep"), parts)).withColumn("j", F.explode(F.sequence(F.lit(0), parts - 1)))
    met = met.select("key", "rep", "blk", F.least("blk", "j").alias("p"), F.greatest("blk", "j").alias("q"))
    found = materialize(cell_links(met.join(points, "rep"), least, (tables, 1 + blocks * probes)), "links")
    number = groups.select("rep", "n", "point", "digest")
    counts = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("links"))
    edges = found.where("kind = 1").select("a", "b")
    # from points to their least ids
    least_id = number.select("point", F.col("rep").alias("node"))
    named = edges.join(least_id.select(F.col("point").alias("a"), F.col("node").alias("na")), "a").join(least_id.select(F.col("point").alias("b"), F.col("node").alias("nb")), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    roots = components(named)
    done = number.join(counts, number.point == counts.a, "left").join(roots, number.rep == roots.node, "left")
    done = materialize(done.select("digest", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")), "points")
    good = ids.where("digest IS NOT NULL")
    out = join_spread(good, done, "digest", "n", max(1, good.count())).select("vec_id", "n_links", "component_id")
    alone = ids.where("digest IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").isNull() | (F.col("vec_id") == F.col("component_id")))
