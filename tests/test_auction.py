"""The auction against every permutation and the direct solution, and the density against its plain sum."""

import numpy as np

from lidarloom.operators import auction, clustering

NODE = "file string, id long, x double, y double, z double"


def rows(group, points, first=0):
    return [(group, first + i, *map(float, p)) for i, p in enumerate(points)]


def test_auction_is_optimal_in_every_group(spark):
    """Square, both rectangular ways, single rows, equal points, one side only; nulls and repeated ids beside them."""
    rng = np.random.default_rng(5)
    sides = {g: (rng.random((n, 3)), rng.random((m, 3))) for g, (n, m) in {"a": (25, 25), "b": (20, 6), "c": (3, 12), "d": (1, 1)}.items()}
    sides["e"] = (np.ones((3, 3)), np.ones((4, 3)))
    left = [r for g, (p, _) in sides.items() for r in rows(g, p)] + rows("f", rng.random((2, 3))) + [(None, 1, 0.0, 0.0, 0.0), ("a", None, 0.0, 0.0, 0.0), ("a", 99, None, 0.0, 0.0), ("a", 98, float("nan"), 0.0, 0.0), ("d", 0, 2.0, 2.0, 2.0)]
    right = [r for g, (_, p) in sides.items() for r in rows(g, p, 100)]
    got = auction.assign(spark.createDataFrame(left, NODE), spark.createDataFrame(right, NODE), "file").collect()
    assert {r["file"] for r in got} == set(sides)
    for g, (p, q) in sides.items():
        own = [r for r in got if r["file"] == g]
        cost = np.linalg.norm(p[:, None] - q[None], axis=2)
        assert len({r["left_id"] for r in own}) == len({r["right_id"] for r in own}) == len(own) == min(cost.shape)
        assert abs(sum(cost[r["left_id"], r["right_id"] - 100] for r in own) - sum(cost[i, j] for i, j in clustering.assignment(cost))) < 1e-8


def test_auction_over_parts_and_blocks(spark, monkeypatch):
    """Bidders of several tasks that see few objects of several blocks at a time outbid each other over the rounds."""
    monkeypatch.setattr(auction, "PART", 3)
    monkeypatch.setattr(auction, "BLOCK", 4)
    monkeypatch.setattr(auction, "CHOICES", 4)
    monkeypatch.setattr(auction, "LAST", 0.1)
    rng = np.random.default_rng(6)
    p, q = rng.random((7, 3)), rng.random((7, 3))
    got = auction.assign(spark.createDataFrame(rows("a", p), NODE), spark.createDataFrame(rows("a", q), NODE), "file").collect()
    cost = np.linalg.norm(p[:, None] - q[None], axis=2)
    assert sorted(r["right_id"] for r in got) == list(range(7))
    assert sum(r["d"] for r in got) - sum(cost[i, j] for i, j in clustering.assignment(cost)) < 0.1 * 3**0.5


def test_auction_of_empty_tables(spark):
    none, one = spark.createDataFrame([], NODE), spark.createDataFrame(rows("a", [(0, 0, 0)]), NODE)
    assert auction.assign(none, none, "file").count() == auction.assign(one, none, "file").count() == 0


def test_density_equals_its_plain_sum(spark):
    """Clumped, correlated points far from the origin, with nulls and copies beside them."""
    rng = np.random.default_rng(7)
    x = np.r_[rng.normal(0, 1, 300), rng.normal(6, 0.1, 200), np.full(50, 2.0)] + 5e5
    y = 0.8 * (x - 5e5) + np.r_[rng.normal(0, 1, 300), rng.normal(-3, 0.2, 200), np.full(50, 1.0)] + 4e6
    data = [*zip(map(float, x), map(float, y), strict=True), (None, 1.0), (1.0, float("nan"))]
    got = {(r["i"], r["j"]): r["density"] for r in clustering.kde(spark.createDataFrame(data, "x double, y double"), 15).collect()}
    h = np.linalg.inv(np.cov(x, y) * len(x) ** (-1 / 3))
    gx, gy = np.linspace(x.min(), x.max(), 15), np.linspace(y.min(), y.max(), 15)
    peak = np.sqrt(np.linalg.det(h)) / (2 * np.pi)
    for i in range(15):
        for j in range(15):
            d = np.stack([gx[i] - x, gy[j] - y])
            assert abs(got[i, j] - peak * np.exp(-0.5 * np.einsum("an,ab,bn->n", d, h, d)).mean()) < 2e-9 * peak
    assert len(got) == 225


def test_density_of_lines_and_few_points(spark):
    for data in ([], [(1.0, 2.0)], [(1.0, 2.0)] * 5, [(float(k), 3.0) for k in range(5)], [(float(k), 2.0 * k) for k in range(5)]):
        assert clustering.kde(spark.createDataFrame(data, "x double, y double"), 4).count() == 0
