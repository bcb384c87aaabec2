"""The triangulation's properties, and interpolation against the triangulation of all points."""

import numpy as np
import pytest

from lidarloom.functions import delaunay
from lidarloom.operators import transforms


def clouds():
    for seed in range(24):
        r = np.random.default_rng(seed)
        n = int(r.integers(3, 60))
        yield r.random((n, 2)) if seed % 3 else r.integers(0, 7, (n, 2)).astype(float)  # every third one on a lattice, with repeated points


def hull_area(p):
    points = sorted(set(map(tuple, p.tolist())))

    def half(rows):
        out = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    h = np.array(half(points) + half(points[::-1]))
    return abs(h[:, 0] @ np.roll(h[:, 1], -1) - h[:, 1] @ np.roll(h[:, 0], -1)) / 2


def test_circles_are_empty_and_the_hull_is_covered():
    for p in clouds():
        m = delaunay.Mesh(p)
        area = 0.0
        for t in m.triangles():
            a, b, c = (m.p[v] for v in t)
            assert delaunay.orient(a, b, c) > 0 and not any(delaunay.in_circle(a, b, c, q) for q in m.p)
            area += delaunay.orient(a, b, c) / 2
        assert abs(area - hull_area(p)) < 1e-9
        for t, own in enumerate(m.tri):  # neighbours know each other across the same edge
            for k in range(3) if own else ():
                other = m.tri[m.near[t][k]]
                assert t in m.near[m.near[t][k]] and {own[(k + 1) % 3], own[(k + 2) % 3]} <= set(other)


def test_predicates_are_exact():
    """Points nearly on a line and nearly on a circle, where plain floating point has the wrong sign."""
    e = 2.0**-52
    assert delaunay.orient((0.5, 0.5), (12.0, 12.0), (24.0, 24.0)) == 0
    assert delaunay.orient((0.5 + e, 0.5), (12.0, 12.0), (24.0, 24.0)) < 0 < delaunay.orient((0.5 - e, 0.5), (12.0, 12.0), (24.0, 24.0))
    square = ((1.0, 0.0), (0.0, 1.0), (-1.0, 0.0))
    assert not delaunay.in_circle(*square, (0.0, -1.0)) and delaunay.in_circle(*square, (0.0, -1.0 + e)) and not delaunay.in_circle(*square, (0.0, -1.0 - 2 * e))


@pytest.mark.parametrize("points", [[], [(1.0, 2.0)], [(0.0, 0.0), (1.0, 1.0)], [(float(i), 2.0 * i) for i in range(6)], [(1.0, 1.0)] * 5])
def test_no_triangles(points):
    assert delaunay.Mesh(np.array(points).reshape(-1, 2)).triangles() == []


@pytest.mark.parametrize("shape", ["even", "cluster"])
def test_interpolation_is_that_of_all_points(spark, shape):
    """Many points a node, also with nine in ten of them in one corner: as if all were triangulated in one place."""
    r = np.random.default_rng(3)
    p = r.random((1500, 2)) * (10, 4)
    if shape == "cluster":
        p[:1350] = p[:1350] * 0.05 + 1
    z = np.sin(p[:, 0]) + p[:, 1] ** 2
    rows = [("a", *map(float, q), float(h)) for q, h in zip(p, z, strict=True)] + [("line", float(i), 1.0, 2.0) for i in range(5)] + [("a", None, 1.0, 1.0)]
    got = transforms.interpolate(spark.createDataFrame(rows, "f string, x double, y double, z double"), "f", 9).collect()
    assert len(got) == 162 and all(g["z"] is None for g in got if g["f"] == "line")
    m, found = delaunay.Mesh(p), 0
    for g in got:
        if g["f"] == "a":
            beyond, t = m.locate((g["x"], g["y"]))
            share = delaunay.shares(*(m.p[v] for v in m.tri[t]), (g["x"], g["y"]))
            if g["z"] is None:
                assert min(share) < 0
            else:
                found += 1
                assert abs(g["z"] - np.dot(share, z[m.tri[t]])) < 1e-9
    assert found >= 40


def test_places_are_written_once(spark, monkeypatch):
    """All places are written down once, not again with their nodes."""
    import numpy as np

    from lidarloom.operators import transforms
    from lidarloom.sources import scratch

    rng = np.random.default_rng(4)
    p = spark.createDataFrame([("a", *map(float, v)) for v in rng.uniform(0, 1, (400, 3))], "g string, x double, y double, z double")
    large, written = [], scratch.written

    def seen(df):
        out = written(df)
        large.append(out.count() >= 400)
        return out

    monkeypatch.setattr(scratch, "written", seen)
    assert transforms.interpolate(p, "g", 4).count() == 16 and sum(large) == 1
