"""Clustering and near-duplicates of vectors, against brute force."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm import centroids, common, covertree, gridorder

KIND = "vec_id long, embedding array<float>, label int, cluster string, distance int, name string"


def points(kind, n=600, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    if kind == "copies":
        return np.repeat(rng.integers(-9, 9, (7, dim)), -(-n // 7), 0)[:n]
    if kind == "groups":
        return rng.integers(-(10**6), 10**6, (30, dim))[rng.integers(0, 30, n)] + rng.integers(-40, 40, (n, dim))
    if kind == "one":
        return np.full((1, dim), 3)
    return rng.integers(-30, 30, (n, dim))


@pytest.mark.parametrize("kind", ["copies", "groups", "plain", "one"])
def test_cover_tree(kind):
    x = points(kind).astype(float)
    tree = covertree.build(x)
    assert sorted(tree.order) == list(range(len(x)))
    held = np.zeros(len(x), int)
    for node in range(len(tree.centre)):
        own = tree.order[tree.start[node] : tree.stop[node]]
        assert tree.centre[node] in own and np.sqrt(((x[own] - x[tree.centre[node]]) ** 2).sum(1)).max() <= tree.radius[node] + 1e-6
        if tree.first[node] < 0:
            held[own] += 1
            assert len(own) <= covertree.LEAF or (x[own] == x[own[0]]).all()
        else:
            assert (tree.start[tree.first[node]], tree.stop[tree.last[node] - 1]) == (tree.start[node], tree.stop[node])
    assert (held == 1).all()


@pytest.mark.parametrize(("kind", "of"), [("copies", "copies"), ("groups", "groups"), ("plain", "plain"), ("one", "plain"), ("plain", "one"), ("groups", "copies")])
def test_nearest(kind, of, monkeypatch):
    monkeypatch.setattr(centroids, "PAIRS", 100)
    x, c = points(kind, seed=1), points(of, 90, seed=2)
    tree, over = covertree.build(x.astype(float)), covertree.build(c.astype(float))
    x = x[tree.order]
    tree.centre, over.centre = np.argsort(tree.order)[tree.centre], np.argsort(over.order)[over.centre]
    number, far = centroids.nearest(x, tree, c[over.order], over)
    every = ((x[:, None, :] - c[None]) ** 2).sum(2)
    assert (far == every.min(1)).all() and (number == every.argmin(1)).all()  # argmin: ties to the smaller number


def test_pairs_are_pruned(monkeypatch):
    x, c = points("groups", 1000, seed=3), points("groups", 600, seed=3)
    tree, over = covertree.build(x.astype(float)), covertree.build(c.astype(float))
    tree.centre, over.centre = np.argsort(tree.order)[tree.centre], np.argsort(over.order)[over.centre]
    seen, plain = [], centroids._spread
    monkeypatch.setattr(centroids, "_spread", lambda n: seen.append(int(n.sum())) or plain(n))
    centroids.nearest(x[tree.order], tree, c[over.order], over)
    assert sum(seen) < len(x) * len(c) / 8


def test_few_centroids_are_told_apart_by_the_walk(monkeypatch):
    """Sixteen centroids fill a leaf at most, as do sixteen vectors; the walk has to leave fewer pairs than all."""
    x, c = points("plain", 1000, seed=3), points("plain", 16, seed=4)
    (row,) = centroids._blocks(8, 1.0)(iter([pa.record_batch([pa.array(range(len(x))), pa.array(x.tolist())], ["key", "vector"])]))
    left, plain = [], np.lexsort
    monkeypatch.setattr(centroids.np, "lexsort", lambda keys: (len(keys) == 3 and left.append(len(keys[0]))) or plain(keys))
    ((_, own, number, far),) = centroids._walked(iter([row]), c.astype(np.int64))
    every = ((own.astype(np.int64)[:, None, :] - c[None]) ** 2).sum(2)
    assert (far == every.min(1)).all() and (number == every.argmin(1)).all()
    assert sum(left) < 2 * len(x)  # before: all 16,000


def brute(rows, k, rounds, dim=64):
    kept = [(r[0], [math.floor(64 * float(x)) for x in r[1]]) for r in rows if r[1] is not None and len(r[1]) == dim and all(x is not None and math.isfinite(x) for x in r[1])]
    kept = [x for x in kept if max(map(abs, x[1])) <= centroids.LARGEST]
    starts = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    cs = [x for _, x in starts]
    for turn in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(cs)) for _, x in kept]
        if turn < rounds:
            for j in range(len(cs)):
                own = [x for (_, x), (_, n) in zip(kept, near, strict=True) if n == j]
                cs[j] = [sum(v) // len(own) for v in zip(*own, strict=True)] if own else cs[j]
    inertia = [sum(d for d, n in near if n == j) for j in range(len(cs))]
    return sorted(((i, n, d, inertia[n], sum(inertia), hashlib.sha256(",".join(map(str, cs[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, near, strict=True)), key=repr)


def vectors(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.gauss(0, 0.125) for _ in range(64)]
        rows.append((i, v, rng.choice([0, 1, 2, None]), "x", 1, "y"))
    rows += [(1000 + i, rows[0][1], 0, "x", 1, "y") for i in range(150)]  # a group of copies, a third of all
    rows += rows[:5] + [(None, rows[1][1], 1, None, None, None)] * 2
    for bad in (None, [], [0.5] * 63, [0.5] * 65, [0.5] * 63 + [None], [0.5] * 63 + [math.nan], [0.5] * 63 + [math.inf], [3e38] * 64, [0.0] * 64):
        rows += [(2000 + len(rows), bad, 1, None, None, None)] * 2
    rng.shuffle(rows)
    return rows


def f32(rows):
    return [(r[0], r[1] and [None if x is None else float(np.float32(x)) for x in r[1]], *r[2:]) for r in rows]


@pytest.mark.parametrize(("seed", "k", "rounds"), [(1, 16, 3), (2, 3, 1), (3, 1000, 2)])
def test_clusters(spark, seed, k, rounds):
    rows = f32(vectors(seed, 60 if k == 1000 else 300))
    got = centroids.cluster(spark.createDataFrame(rows, KIND).repartition(3), k=k, rounds=rounds)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, k, rounds)


def test_no_clusters(spark):
    rows = spark.createDataFrame([(1, None, 1, "x", 1, "y"), (2, [math.nan] * 64, 1, "x", 1, "y")], KIND)
    for df in (rows, rows.filter("false")):
        got = centroids.cluster(df)
        assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(ValueError):
        centroids.cluster(rows, k=1 << 20)


# --- near-duplicates ------------------------------------------------------------------------------------------------


def grouped(seed, n, dim, spread=0.35):
    """Vectors around a few directions, some so near to each other that all are linked, some across the bound."""
    rng = np.random.default_rng(seed)
    around = rng.normal(size=(5, dim))
    return around[rng.integers(0, 5, n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, spread], n)[:, None]


def linked(x, least):
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    found = u @ u.T >= least
    np.fill_diagonal(found, False)
    return found


def reached(found):
    least = np.arange(len(found))
    for _ in range(len(found)):
        now = np.where(found, least[None, :], len(found)).min(1, initial=len(found))
        now = np.minimum(least, now)
        if (now == least).all():
            return least
        least = now
    return least


@pytest.mark.parametrize(("n", "m", "leaf"), [(100, 60, 8), (7, 90, 16), (64, 64, 1), (1, 1, 4), (200, 3, 256)])
def test_tiles_meet(n, m, leaf, monkeypatch):
    monkeypatch.setattr(gridorder, "LEAF", leaf)
    x, least = grouped(n, n + m, 12), 0.93
    along, rng = np.linalg.qr(np.random.default_rng(5).normal(size=(12, gridorder.DIMS)))[0], np.random.default_rng(6)
    cells = np.floor(gridorder.leading(gridorder.units(x), along) / (2 - 2 * least) ** 0.5)
    x = x[np.lexsort(cells.T[::-1])]
    counts = rng.integers(1, 4, n + m)
    a = gridorder.Side.of(x[:n].tobytes(), counts[:n].tobytes(), 12, np.float64, along)
    b = gridorder.Side.of(x[n:].tobytes(), counts[n:].tobytes(), 12, np.float64, along)
    width, found = (2 - 2 * least) ** 0.5, linked(x, least)
    own, across = found.copy(), found.copy()
    own[:n, n:] = own[n:, :n] = own[n:, n:] = False
    across[:n, :n] = across[n:, n:] = False
    links, root = gridorder.compare(a, None, least, width)
    assert (links == (own @ counts)[:n]).all() and (root == reached(own)[:n]).all()
    links, root = gridorder.compare(a, b, least, width)
    assert (links == across @ counts).all() and (root == reached(across)).all()


def test_distant_and_near_runs_are_not_compared(monkeypatch):
    monkeypatch.setattr(gridorder, "LEAF", 16)
    seen = []
    monkeypatch.setattr(gridorder, "_linked", lambda a, b, x, y, least, f=gridorder._linked: seen.append((x, y)) or f(a, b, x, y, least))
    x = np.concatenate([np.eye(12)[i] + np.random.default_rng(i).normal(size=(64, 12)) * 0.01 for i in range(8)])
    side = gridorder.Side.of(x.tobytes(), np.ones(len(x), np.int64).tobytes(), 12, np.float64, np.eye(12, gridorder.DIMS))
    links, root = gridorder.compare(side, None, 0.93, 0.14**0.5)
    assert (links == 63).all() and (root == np.arange(512) // 64 * 64).all() and not seen


def near_rows(seed):
    rng = random.Random(seed)
    x = grouped(seed, 160, 64, 0.3).tolist()
    rows = [(i, v, rng.choice([0, 0, 1, None]), "x", 1, "y") for i, v in enumerate(x)]
    rows += [(1000 - i, [2 * y for y in x[0]], 0, "x", 1, "y") for i in range(5)]  # of another length
    rows += [(500 + i, x[3], 1, "x", 1, "y") for i in range(90)]  # a group of copies, a third of all
    rows += rows[:6] + [(None, x[7], 0, None, None, None), (None, x[7], 0, None, None, None), (None, [1.0, 2.0], 5, None, None, None)]
    for bad in (None, [], [0.0] * 64, [-0.0] * 3, [0.5] * 63 + [None], [0.5] * 63 + [math.nan], [0.5] * 63 + [-math.inf]):
        rows += [(2000 + len(rows), bad, 0, None, None, None)] * 2
    rows += [(3000, [1.0, 2.0, 3.0], 0, "", 1, ""), (3001, [2.0, 4.0, 6.001], 0, "", 1, ""), (3002, [3e38] * 64, 2, "", 1, ""), (3003, [1e-38] * 64, 2, "", 1, ""), (3004, [1.0, 2.0, 3.0], 1, "", 1, "")]
    rng.shuffle(rows)
    return f32(rows)


def near_brute(rows, least=0.93):
    n = len(rows)
    good = [r[1] is not None and len(r[1]) > 0 and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) and r[2] is not None for r in rows]
    found = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                found[i, j] = found[j, i] = a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= least
    group = reached(found)
    smallest = {}
    for g, r in zip(group, rows, strict=True):
        if r[0] is not None:
            smallest[g] = min(smallest.get(g, r[0]), r[0])
    return sorted(((r[0], int(found[i].sum()), smallest.get(group[i]), r[0] == smallest.get(group[i])) for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("seed", "tile", "share"), [(1, 8, 0.5), (2, 4096, 1 / 2000)])
def test_near_duplicates(spark, monkeypatch, seed, tile, share):
    monkeypatch.setattr(common, "HOT_SHARE", share)
    rows = near_rows(seed)
    got = gridorder.near_duplicates(spark.createDataFrame(rows, KIND).repartition(3), tile=tile)
    assert sorted(map(tuple, got.collect()), key=repr) == near_brute(rows)


def test_no_vectors(spark):
    rows = spark.createDataFrame([(1, None, 1, "x", 1, "y"), (2, [math.nan] * 64, 1, "x", 1, "y")], KIND)
    assert sorted(map(tuple, gridorder.near_duplicates(rows).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert gridorder.near_duplicates(rows.filter("false")).count() == 0
