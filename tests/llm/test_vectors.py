"""Hard negatives and centroid clusters against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from lodestream.llm import centroid_clusters, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string, cluster string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "own", "own", "own") for r in rows], SCHEMA).repartition(parts)


def valid(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def single(v):
    return [float(np.float32(x)) for x in v]


def vectors(n, dim, seed, copies=0.2):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        v = rows[r.randrange(k)][1] if k and r.random() < copies else single(r.gauss(0, 1) for _ in range(dim))
        rows.append((k, v, r.randrange(3) if r.random() < 0.9 else 7))
    return rows


# 11


def mined(rows, every, positives=5, negatives=5, low=80, scale=256):
    own = [(i, lab, [math.floor(scale * x) for x in v], k) for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and valid(v)]
    out = []
    for a in own:
        if a[0] % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2], strict=False)), b[0], b[3], b[1]) for b in own if b[3] != a[3])
        for s, p, _, _ in [x for x in scored if x[3] == a[1]][:positives]:
            fit = [x for x in scored if x[3] != a[1] and low * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(a[0], p, k, x[1], -s, -x[0]) for k, x in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize(("n", "dim", "block", "seed"), [(900, 3, 100, 1), (900, 16, 400, 2), (300, 2, 1000, 3)])
def test_negatives_against_brute_force(spark, n, dim, block, seed):
    """Copies, ties, a rare label, rows that take no part, several trees."""
    rows = vectors(n, dim, seed)
    rows += [(None, rows[0][1], 1), (n + 20, rows[0][1], None), (n + 21, None, 1), (n + 22, [None] * dim, 1), (n + 23, [float("nan")] * dim, 1), (n + 24, [float("inf")] + [0.0] * (dim - 1), 1)]
    rows += [rows[10], rows[20], (20, rows[31][1], 2), (n + 40, [], 1), (n + 60, [1.0], 0), (n + 80, [0.0] * dim, 9)]
    got = hard_negatives.mine_negatives(table(spark, rows), "vec_id % 20 = 0", block=block)
    want = mined(rows, 20)
    assert len(want) > 100
    assert sorted(map(tuple, got.collect())) == want


def test_negatives_in_a_hot_group(spark):
    """A third of all rows are one vector of one label: ties are told apart by id."""
    rows = vectors(400, 8, 4, copies=0)
    rows += [(1000 + k, rows[0][1], 1) for k in range(200)]
    got = hard_negatives.mine_negatives(table(spark, rows), "vec_id % 50 = 0", block=64)
    assert sorted(map(tuple, got.collect())) == mined(rows, 50)


def test_negatives_without_rows(spark):
    df = table(spark, vectors(20, 4, 5))
    assert hard_negatives.mine_negatives(df.limit(0), "vec_id = 0").count() == 0
    assert hard_negatives.mine_negatives(df, "vec_id < 0").count() == 0
    assert hard_negatives.mine_negatives(df.where("vec_id = 0"), "vec_id = 0").count() == 0
    with pytest.raises(ValueError, match="squared norm"):
        hard_negatives.mine_negatives(table(spark, [(0, [1e30], 1)]), "true")


# 12


def clustered(rows, k, rounds, scale, dim, salt="3"):
    own = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in rows if valid(v) and len(v) == dim]
    named = sorted((hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), v) for i, v in own if i is not None)
    centroids = [v for _, v in named[:k]]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in own]

    for _ in range(rounds):
        at = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(own, at, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = assign()
    total = sum(d for d, _ in at)
    return sorted([(i, c, d, sum(x for x, y in at if y == c), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(own, at, strict=True)], key=str)


@pytest.mark.parametrize(("n", "dim", "k", "scale", "seed"), [(300, 2, 8, 4, 1), (300, 8, 5, 1024, 2), (200, 1, 6, 2, 3), (4, 3, 8, 16, 4)])
def test_clusters_against_brute_force(spark, n, dim, k, scale, seed):
    """Coarse scales make ties, copies and empty clusters; a null id is assigned and starts nothing."""
    rows = vectors(n, dim, seed)
    rows += [(None, rows[0][1], 1), (n + 1, None, 1), (n + 2, [None] * dim, 1), (n + 3, [float("nan")] * dim, 1), (n + 4, [float("-inf")] * dim, 1), (n + 5, [0.5] * (dim + 1), 1), (n + 6, [], 1), rows[1], rows[2]]
    got = centroid_clusters.cluster_vectors(table(spark, rows), k=k, rounds=4, scale=scale, dim=dim)
    assert sorted(map(tuple, got.collect()), key=str) == clustered(rows, k, 4, scale, dim)


def test_balls_skip_and_agree():
    """Where clusters are apart no member is compared; where they touch assignments are those of a full comparison."""
    r = np.random.default_rng(0)
    centres = np.array([[0, 0], [1000, 0], [0, 1000]])
    x = np.concatenate([c + r.integers(-50, 50, (40, 2)) for c in centres])
    own = np.repeat([0, 1, 2], 40).astype(np.int32)
    assert centroid_clusters.neighbours(centres, [80, 80, 80]) == [[], [], []]
    for spread in (50, 400, 900):
        x = np.concatenate([c + r.integers(-spread, spread, (200, 2)) for c in centres])
        own = r.integers(0, 3, 600).astype(np.int32)
        radii = [math.isqrt(int(((x[own == i] - centres[i]) ** 2).sum(1).max())) + 1 for i in range(3)]
        got = centroid_clusters.reassigned(x, own, centres, centroid_clusters.neighbours(centres, radii))
        assert all((a == b).all() for a, b in zip(got, centroid_clusters.nearest(x, centres), strict=True))


def test_clusters_without_rows(spark):
    df = table(spark, vectors(20, 4, 5))
    assert centroid_clusters.cluster_vectors(df.limit(0)).count() == 0
    assert centroid_clusters.cluster_vectors(df, dim=3).count() == 0
    with pytest.raises(Exception, match="no long holds"):
        centroid_clusters.cluster_vectors(table(spark, [(0, [1e30], 1)]), dim=1).count()
