"""E8 lattice hashing: the decoder, recall on planted pairs by width, and whole jobs against all pairs."""

import itertools

import numpy as np
import pytest

from quarrion.llm import lattice
from quarrion.llm.graph import components

BANDS = (0.98, 0.985, 0.99, 0.995, 1.0)


def planted(rng, n, dim, cosine):
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.standard_normal((n, dim)))
    r = rng.standard_normal((n, dim))
    r = unit(r - (r * x).sum(1, keepdims=True) * x)
    return x, cosine[:, None] * x + np.sqrt(1 - cosine**2)[:, None] * r


def test_the_nearest_point_of_the_lattice():
    """Points of E8 to which none of the 240 shortest vectors leads to a nearer one."""
    steps = [s for k, l in itertools.combinations(range(8), 2) for a, b in itertools.product((2, -2), repeat=2) for s in [np.zeros(8)] if not (s.__setitem__(k, a) or s.__setitem__(l, b))]
    steps += [np.array(s) for s in itertools.product((1, -1), repeat=8) if np.prod(s) == 1]
    y = np.random.default_rng(1).normal(0, 2, (300, 8))
    points = lattice.e8_points(y, 2)
    parity = points % 2
    assert (parity == parity[:, :, :1]).all() and (points.sum(axis=2) % 4 == 0).all()
    far = ((2 * y[:, None] - points) ** 2).sum(axis=2)
    assert (np.diff(far, axis=1) >= 0).all() and len(steps) == 240
    for s in steps:
        assert (((2 * y - points[:, 0] - s) ** 2).sum(axis=1) >= far[:, 0] - 1e-9).all()


@pytest.mark.parametrize("dim", [8, 16, 64, 256, 768])
def test_recall_and_chance_meetings_by_width(dim):
    rng, none = np.random.default_rng(dim), np.zeros(400, np.uint64)
    for low, high in zip(BANDS, BANDS[1:]):
        x, y = planted(rng, 400, dim, rng.uniform(low, high, 400))
        a, b = lattice.cell_keys(x, none), lattice.cell_keys(y, none)
        assert (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3)).mean() >= 0.9
    keys = np.concatenate([a, lattice.cell_keys(planted(rng, 400, dim, np.ones(400))[0], none)]).reshape(800, -1)
    _, many = np.unique(keys, return_counts=True)
    if dim > 8:
        assert (many * (many - 1) // 2).sum() < 1e-3 * 800 * 799 / 2


def test_op8_planted_groups_against_all_pairs(spark):
    """Narrow and wide vectors, pairs of each band, a dense group of more than a block, copies, and labels that part them."""
    rng, rows = np.random.default_rng(5), []
    for dim in (16, 96):
        for low, high in zip(BANDS, BANDS[1:]):
            x, y = planted(rng, 30, dim, rng.uniform(low, high, 30))
            rows += [(v, int(k % 3)) for pair in zip(x, y) for k, v in enumerate(pair)] + [(v, 7) for pair in zip(x, y) for v in pair]
        middle = rng.standard_normal(dim)
        rows += [(middle / np.linalg.norm(middle) + rng.normal(0, 0.1 / np.sqrt(dim), dim), 9) for _ in range(lattice.SIDE + 60)]
        rows += [(rows[-1][0], 9)] * 3
    table = [(k, v.tolist(), label) for k, (v, label) in enumerate(rows)]
    got = {r.vec_id: r for r in lattice.near_vectors(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")).collect()}
    links, root = np.zeros(len(table), int), list(range(len(table)))
    find = lambda x: x if root[x] == x else find(root[x])
    for (i, u, p), (j, v, q) in itertools.combinations(table, 2):
        if p == q and len(u) == len(v) and np.dot(u, v) >= 0.98 * np.linalg.norm(u) * np.linalg.norm(v):
            links[i] += 1
            links[j] += 1
            a, b = sorted((find(i), find(j)))
            root[b] = a
    found = np.array([got[k].n_links for k in range(len(table))])
    assert (found <= links).all() and found.sum() >= 0.95 * links.sum() > 0
    assert np.mean([got[k].component_id == find(k) for k in range(len(table))]) >= 0.95


def test_components_of_stars_and_paths(spark):
    """A hub of very many, a long path and what joins them."""
    edges = [(5000, k) for k in range(100, 2600)] + [(k, k + 1) for k in range(6000, 6040)] + [(6040, 5000), (1, 2), (3, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in [5000, *range(100, 2600), *range(6000, 6041)]}, 1: 1, 2: 1}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
