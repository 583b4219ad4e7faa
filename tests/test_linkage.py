"""Average linkage of large blocks: nearest few, horizons, looks dealt to several tasks."""

import numpy as np
import pyarrow as pa
import pytest

from cuespan.operators import linkage


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, grp=None):
    return spark.createDataFrame([(0 if grp is None else int(grp[i]), i, [float(v) for v in r]) for i, r in enumerate(x)], "grp int, id long, vec array<double>")


def plain(x, threshold):
    """One nearest pair at a time over the full matrix; the least id names a cluster."""
    means, sizes, to = unit(x).copy(), np.ones(len(x)), np.arange(len(x))
    d = np.round(1 - means @ means.T, 12)
    d[np.tril_indices(len(d))] = np.inf
    while True:
        i, j = np.unravel_index(d.argmin(), d.shape)
        if d[i, j] >= threshold:
            return to
        means[i] = (means[i] * sizes[i] + means[j] * sizes[j]) / (sizes[i] + sizes[j])
        sizes[i] += sizes[j]
        to[to == j] = i
        d[j], d[:, j] = np.inf, np.inf
        row = np.round(1 - means @ means[i], 12)
        left = np.isin(np.arange(len(x)), to)
        d[i, i + 1 :] = np.where(left, row, np.inf)[i + 1 :]
        d[:i, i] = np.where(left, row, np.inf)[:i]


def block(x, threshold):
    n = len(x)
    table = pa.table({"cid": np.arange(n), "size": np.ones(n, np.int64), "mean": linkage._lists(unit(x)), "settled": np.zeros(n, bool), "other": pa.nulls(n, pa.int64()), "dist": pa.nulls(n, pa.float64())})
    b = linkage.Block(table, np.zeros((0, x.shape[1])), np.zeros(0), threshold)
    b.merge()
    return b


@pytest.mark.parametrize("shape", ["noise", "copies", "alike", "line", "mixed"])
def test_block_equals_one_pair_at_a_time(shape):
    rng = np.random.default_rng(3)
    x = {
        "noise": rng.normal(size=(700, 24)),
        # nearer to each other than single precision tells, and more than are kept
        "alike": rng.normal(size=(1, 16)) + rng.normal(scale=1e-4, size=(900, 16)),
        "copies": np.repeat(rng.normal(size=(4, 16)), 100, axis=0) + rng.normal(scale=1e-7, size=(400, 16)),
        # each is nearest to the one before, so only the last two are mutually nearest
        "line": np.stack([np.cos(a := np.cumsum(0.9 ** np.arange(60) * 0.3)), np.sin(a), np.zeros(60)], axis=1),
        "mixed": rng.normal(size=(30, 16))[rng.integers(30, size=600)] + rng.normal(size=(600, 16)) * rng.choice([0.01, 0.3, 1.0], size=(600, 1)),
    }[shape]
    for threshold in (0.3, 0.65):
        b = block(x, threshold)
        assert (b.roots() == plain(x, threshold)).all()


def test_horizons_spare_looks():
    """Far fewer pairs than one full look for each merged cluster and each that lost its neighbour."""
    rng = np.random.default_rng(8)
    n = 1000
    x = rng.normal(size=(5, 32))[rng.integers(5, size=n)] + rng.normal(scale=0.4, size=(n, 32))
    b = block(x, 0.65)
    assert b.alive.sum() == 5 and b.pairs < 1.3 * n * n


@pytest.mark.parametrize("spread", [1.0, 0.3, 1e-6])
def test_nearest_few(spread, monkeypatch):
    """More columns and rows than one product holds; ties go to the smaller place; the dead and oneself don't count."""
    monkeypatch.setattr(linkage, "_COLUMNS", 64)
    monkeypatch.setattr(linkage, "_ROWS", 32)
    rng = np.random.default_rng(1)
    y = unit(rng.normal(size=(1, 12)) * (spread < 1) + spread * rng.normal(size=(300, 12)))
    y[200:220] = y[5]
    alive = rng.random(300) < 0.8
    own = np.arange(150)
    places, dist = linkage.nearest(y[own], own, y, y.astype(np.float32), alive, 0.8, 4)
    d = linkage.distances(y[own], y)
    d[:, ~alive] = np.inf
    d[own, own] = np.inf
    d[d >= 0.8] = np.inf
    order = np.argsort(d, axis=1, kind="stable")[:, :4]
    want = np.take_along_axis(d, order, 1)
    assert (dist == want).all() and (places == np.where(np.isinf(want), -1, order)).all()


def test_nearest_few_behind_many_dead(monkeypatch):
    """Places that no longer count are not taken for the nearest few, however many are nearer."""
    rng = np.random.default_rng(9)
    y = unit(rng.normal(size=(1, 16)) + rng.normal(size=(900, 16)) * np.repeat([1e-5, 1e-3], 450)[:, None])
    alive = np.arange(900) >= 440
    own = np.arange(440, 900)
    places, dist = linkage.nearest(y[own], own, y, y.astype(np.float32), alive, 0.65, 4)
    d = linkage.distances(y[own], y)
    d[:, ~alive] = d[np.arange(460), own] = np.inf
    order = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert (places == order).all() and (dist == np.take_along_axis(d, order, 1)).all()


def test_unlike_vectors_of_a_few_thousand_are_one_block(spark):
    """No rounds between blocks, and about one comparison of all with all."""
    rng = np.random.default_rng(6)
    n = 2500
    x = rng.normal(size=(n, 32))
    pairs = []
    got = {r.id: r.cluster for r in linkage.clusters(frame(spark, x), pairs=pairs).collect()}
    assert len(pairs) == 1 and pairs[0] < 2 * n * n
    assert [got[i] for i in range(n)] == plain(x, 0.65).tolist()


def test_looks_of_a_large_block_are_dealt_to_tasks(spark, monkeypatch):
    """One crowded group, one small one; also with several blocks, of which each is asked in several tasks."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(150, 8)), rng.normal(size=(1, 8)) + rng.normal(scale=0.01, size=(60, 8)), rng.normal(size=(20, 8))])
    grp = np.repeat([0, 1], [210, 20])
    df = frame(spark, x, grp)
    monkeypatch.setattr(linkage, "_ASKED", 30)
    for size, threshold in ((linkage.BLOCK, 0.65), (80, 0.1)):
        want = [*plain(x[:210], threshold), *(plain(x[210:], threshold) + 210)]
        got = {r.id: r.cluster for r in linkage.clusters(df, threshold, size).collect()}
        assert [got[i] for i in range(len(x))] == want
