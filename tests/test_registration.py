"""Registration by rounds, samples and cliques: against known transforms, brute force and planted graphs."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lidarloom.functions import rigid
from lidarloom.operators import icp, matching, registration, spatial, transforms

CELL = "strip string, grid_id long, x double, y double, z double"
PAIRS = "grid_id long, sx double, sy double, sz double, tx double, ty double, tz double"


def motion(angle, *shift):
    turned = rigid.turn(np.array([0.0, 0.0, angle]))
    return rigid.matrix(turned, np.array(shift))


def surface(rng, n, side=12.0):
    p = rng.uniform(0, side, (n, 2))
    return np.c_[p, np.sin(p[:, 0] * 0.5) * 2 + np.cos(p[:, 1] * 0.4) * 2 + 0.8 * np.sin(p[:, 0] * 1.1 + p[:, 1] * 0.7)]


def cell_rows(strip, grid, p):
    return [(strip, grid, *map(float, v)) for v in p]


@pytest.mark.parametrize("method", sorted(registration.METHODS))
def test_recovers_the_motion_of_each_cell(spark, method):
    """Two cells with motions of their own, and one that only a strip has, which gives no row."""
    rng = np.random.default_rng(1)
    moves = {3: motion(0.02, 0.15, -0.1, 0.08), 5: motion(-0.015, -0.1, 0.12, 0.05)}
    rows = cell_rows("F", 9, surface(rng, 20))
    for g, m in moves.items():
        s = surface(rng, 1500 if method != "mac" else 200)
        t = rigid.move(m, s if method == "mac" else surface(rng, 1500)) + rng.normal(0, 0.001, (len(s), 3))
        rows += cell_rows("F", g, s) + cell_rows("O", g, t)
    found = {r["grid_id"]: r for r in registration.register(spark.createDataFrame(rows, CELL), "F", "O", method, voxel=0.1 if method == "mac" else 0.4).collect()}
    assert set(found) == set(moves)
    probe = surface(rng, 200)
    for g, m in moves.items():
        got = np.reshape(found[g]["transformation"], (4, 4))
        assert found[g]["success"] and found[g]["fitness"] > 0.8
        assert np.abs(rigid.move(got, probe) - rigid.move(m, probe)).max() < (0.3 if method in ("p2point", "ndt") else 0.15)


def test_cells_without_pairs_fail_alone(spark):
    rng = np.random.default_rng(2)
    s = surface(rng, 300)
    rows = cell_rows("F", 1, s) + cell_rows("O", 1, s + (0.02, 0, 0)) + cell_rows("F", 2, s) + cell_rows("O", 2, s + 500.0)
    found = {r["grid_id"]: r for r in registration.register(spark.createDataFrame(rows, CELL), "F", "O").collect()}
    assert found[1]["success"] and not found[2]["success"] and found[2]["error"] and found[2]["transformation"] == np.eye(4).ravel().tolist() and math.isinf(found[2]["rmse"])
    assert registration.register(spark.createDataFrame([], CELL), "F", "O").count() == 0


@pytest.mark.parametrize("plane", [True, False])
def test_one_rounds_sums(spark, plane):
    rng = np.random.default_rng(3)
    s, t, n = rng.random((60, 3)), rng.random((50, 3)), rng.normal(size=(50, 3))
    source = spark.createDataFrame([(1, i, *map(float, v)) for i, v in enumerate(s)], "grid_id long, sid long, x double, y double, z double")
    target = spark.createDataFrame([(1, i, *map(float, v), *map(float, w)) for i, (v, w) in enumerate(zip(t, n, strict=True))], "grid_id long, tid long, tx double, ty double, tz double, nx double, ny double, nz double")
    at = icp.moved(source, [(1, np.eye(4), 0.5, 0.5, 0.5)])
    got = icp.step_sums(icp.closest(at, icp.filed(target, 0.2), 0.2), plane, 2.0 if plane else None).first()
    d = np.linalg.norm(s[:, None] - t[None], axis=2)
    near = d.argmin(1)
    own = d.min(1) < 0.2
    p, q, m = s[own], t[near[own]], n[near[own]]
    assert got["n"] == own.sum() and np.isclose(got["d2"], (d.min(1)[own] ** 2).sum())
    if plane:
        r = ((p - q) * m).sum(1)
        w = 1 / (1 + (r / 2) ** 2)
        a = np.hstack((np.cross(p - 0.5, m), m))
        h = (a * w[:, None]).T @ a
        assert all(np.isclose(got[f"h{i}{j}"], h[i, j]) for i in range(6) for j in range(i, 6)) and all(np.isclose(got[f"g{i}"], ((a * w[:, None]).T @ r)[i]) for i in range(6))
    else:
        assert all(np.isclose(got[f"c{i}{j}"], ((p - 0.5)[:, i] * (q - 0.5)[:, j]).sum()) for i in range(3) for j in range(3))


def test_correspondences_are_of_the_cell(spark):
    """Equal points are rows of their own, and a nearer target of another cell is none."""
    rows = [("F", 1, 0.0, 0.0, 0.0), ("F", 1, 0.0, 0.0, 0.0), ("F", 2, 5.0, 0.0, 0.0), ("O", 1, 0.1, 0.0, 0.0), ("O", 1, 0.1, 0.0, 0.0), ("O", 1, 0.1, 0.0, 0.0), ("O", 1, 5.1, 0.0, 0.0), ("O", 2, 5.3, 0.0, 0.0)]
    cells = spark.createDataFrame(rows, CELL)
    same = [float(v) for v in np.eye(4).ravel()]
    results = spark.createDataFrame([(1, True, same), (2, True, same)], "grid_id long, success boolean, transformation array<double>")
    got = sorted((r["grid_id"], round(r["sx"], 3), round(r["tx"], 3)) for r in registration.correspondences(cells, results, "F", "O", 0.5).collect())
    assert got == [(1, 0.0, 0.1), (1, 0.0, 0.1), (2, 5.0, 5.3)]


@pytest.mark.parametrize("few", [2.0, 0.05])
def test_nearest_at_any_density(spark, few):
    """However small the first voxels are, the result is brute force's."""
    rng = np.random.default_rng(4)
    s, t = rng.random((80, 3)), rng.random((120, 3))
    source = spark.createDataFrame([(i % 2, i, *map(float, v)) for i, v in enumerate(s)], "grid_id long, sid long, x double, y double, z double")
    target = spark.createDataFrame([(i % 2, i, *map(float, v)) for i, v in enumerate(t)], "grid_id long, tid long, tx double, ty double, tz double")
    got = {r["sid"]: (r["tid"], round(r["d2"], 9)) for r in icp.nearest(source, target, 0.3, few).collect()}
    want = {}
    for i, v in enumerate(s):
        d = ((t - v) ** 2).sum(1)
        d[np.arange(120) % 2 != i % 2] = 9
        if d.min() < 0.09:
            want[i] = int(d.argmin()), round(float(d.min()), 9)
    assert got == want


def planted(spark, rng, cells=2, true=30, false=90, noise=0.0):
    """Matches of ``cells`` cells, the first ``true`` of each under a motion of its own."""
    rows, moves = [], {}
    for g in range(cells):
        m = moves[g] = motion(0.5 + g, 1.0, -2.0, 0.5)
        s = rng.random((true + false, 3)) * 10
        t = np.concatenate((rigid.move(m, s[:true]) + rng.normal(0, noise, (true, 3)), rng.random((false, 3)) * 10))
        rows += [(g, *map(float, a), *map(float, b)) for a, b in zip(s, t, strict=True)]
    return spark.createDataFrame(rows, PAIRS), moves


def test_random_samples(spark):
    """The planted motion is found, stopped early where many matches are true, alike at any partitioning."""
    p, moves = planted(spark, np.random.default_rng(5))
    first = matching.ransac(matching.numbered(p), reach=0.1).orderBy("grid_id").collect()
    again = matching.ransac(matching.numbered(p.repartition(7)), reach=0.1).orderBy("grid_id").collect()
    assert first == again and [r["grid_id"] for r in first] == [0, 1]
    for r in first:
        assert r["inliers"] >= 30 and r["n"] == 120 and r["drawn"] < 100_000 and np.allclose(np.reshape(r["transformation"], (4, 4)), moves[r["grid_id"]], atol=1e-9)
    few = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)] * 2, PAIRS)
    assert matching.ransac(matching.numbered(few)).count() == 0


@pytest.mark.parametrize("truncated", [True, False])
def test_graduated_weights(spark, truncated):
    p, moves = planted(spark, np.random.default_rng(6), true=80, false=40, noise=0.01)
    for g, m in matching.graduated(p, 0.1 if truncated else 0.5, truncated).items():
        assert np.abs(m - moves[g]).max() < 0.05


def test_cliques_of_many_wrong_matches(spark):
    """700 matches, of which 600 are wrong: all of them take part."""
    p, moves = planted(spark, np.random.default_rng(7), cells=1, true=40, false=400)
    got = transforms.clique_transforms(p, "grid_id", 0.1).first()
    assert len(got["members"]) >= 40 and np.allclose(np.reshape(got["transformation"], (4, 4)), moves[0], atol=1e-3)


def test_cliques_are_brute_force(spark):
    """Random weighted graphs: the heaviest clique of all subsets."""
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for g in range(12):
        n = 9
        w = np.where(rng.random((n, n)) < 0.6, 0.99 + 0.01 * rng.random((n, n)), 0)
        w = np.triu(w, 1) + np.triu(w, 1).T
        second = (w @ w) * w
        best = (0.0, None)
        for size in range(3, n + 1):
            for c in itertools.combinations(range(n), size):
                if all(w[a, b] > 0 for a, b in itertools.combinations(c, 2)):
                    total = second[np.ix_(c, c)].sum()
                    if total > best[0] + 1e-9:
                        best = total, list(c)
        want[g] = best
        rows += [(g, a, b, float(w[a, b])) for a, b in itertools.combinations(range(n), 2) if w[a, b] > 0]
    edges = spark.createDataFrame(rows, "grid_id long, a long, b long, w double")
    got = {r["grid_id"]: r for r in matching.heaviest_cliques(edges).collect()}
    for g, (weight, members) in want.items():
        assert (members is None) == (g not in got)
        if members:
            assert math.isclose(got[g]["weight"], weight, rel_tol=1e-9) and got[g]["members"] == members


def test_kabsch(spark):
    rng = np.random.default_rng(8)
    s = rng.random((50, 3))
    m = np.eye(4)
    m[:2, :2], m[:3, 3] = [[0.8, -0.6], [0.6, 0.8]], (1, 2, 3)
    df = spark.createDataFrame([(1, *a, *b) for a, b in zip(s.tolist(), rigid.move(m, s).tolist(), strict=True)], PAIRS)
    assert np.allclose(transforms.kabsch(df, "grid_id").first()["transformation"], m.ravel())
    assert np.allclose(np.reshape(matching.squares(df)[1], -1), m.ravel())


def histograms(points, normal, radius):
    """Point feature histograms on arrays, all pairs."""
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    q, p = np.nonzero((d <= radius) & (d > 0))
    far = d[q, p]
    line, u = (points[p] - points[q]) / far[:, None], normal[q]
    v = np.cross(u, line)
    v /= np.linalg.norm(v, axis=1)[:, None]
    w = np.cross(u, v)
    own = np.zeros((len(points), 33))
    for i, a in enumerate(((v * normal[p]).sum(1), (u * line).sum(1), np.arctan2((w * normal[p]).sum(1), (u * normal[p]).sum(1)) / np.pi)):
        np.add.at(own, (q, 11 * i + np.clip(((a + 1) * 5.5).astype(int), 0, 10)), 1)
    n = np.maximum(np.bincount(q, minlength=len(points)), 1)
    own /= n[:, None]
    out = own.copy()
    np.add.at(out, q, own[p] / np.maximum(far, 1e-3)[:, None] / n[q][:, None])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def test_feature_histograms(spark):
    """Against arrays; points alone have none, and other cells' points don't count."""
    rng = np.random.default_rng(6)
    p, n = rng.uniform(size=(80, 3)), rng.normal(size=(80, 3))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    p[0] += 50
    rows = [(g, 100 * g + i, *map(float, p[i]), *map(float, n[i])) for g in (0, 1) for i in range(80)]
    got = np.zeros((2, 80, 33))
    for r in spatial.fpfh(spark.createDataFrame(rows, "grid_id long, pid long, x double, y double, z double, nx double, ny double, nz double"), 0.3, by=("grid_id",)).collect():
        got[r["pid"] // 100, r["pid"] % 100, r["bin"]] = r["value"]
    assert np.allclose(got, histograms(p, n, 0.3)[None], atol=1e-9) and not got[:, 0].any()


def test_matches_by_features(spark):
    """Equal features find each other; one way, every source has a match."""
    rng = np.random.default_rng(9)
    feats = rng.random((40, 33))
    point = lambda first: spark.createDataFrame([(0, first + i, float(i), 0.0, 0.0) for i in range(40)], "grid_id long, pid long, x double, y double, z double")
    feature = lambda first, f: spark.createDataFrame([(first + i, b, float(f[i, b] / np.linalg.norm(f[i]))) for i in range(40) for b in range(33)], "pid long, bin int, value double")
    order = rng.permutation(40)
    args = point(0), point(100), feature(0, feats), feature(100, feats[order])
    got = {r["sid"]: r["tid"] - 100 for r in matching.feature_pairs(*args, True, 1000).collect()}
    assert len(got) == 40 and all(order[t] == s for s, t in got.items())
    best = matching.feature_pairs(*args, False, 10).agg(F.count("*"), F.max("rn")).first()
    assert tuple(best) == (10, 9)


def test_dense_targets_are_filed_in_small_voxels(spark, monkeypatch):
    """Where a voxel of the reach holds very many targets, the search doesn't begin there."""
    rng = np.random.default_rng(3)
    p = spark.createDataFrame([(1, i, *map(float, v)) for i, v in enumerate(rng.uniform(0, 0.5, (800, 3)) * [1, 1, 0])], "grid_id long, pid long, x double, y double, z double")
    sizes, closest = [], icp.closest
    monkeypatch.setattr(icp, "closest", lambda s, t, reach: sizes.append(reach) or closest(s, t, reach))
    found = icp.nearest(registration.as_source(p), registration.as_target(p), 0.3)
    assert found.where("sid = tid").count() == 800 and len(sizes) == 1 and sizes[0] < 0.05


def test_pairs_of_crowded_places_are_no_rows(spark, monkeypatch):
    """Most sources find their target in the first round even where two targets nearly coincide, whole blocks are dealt to
    parts, and the targets are brute force's, the one of the least id among equally near ones."""
    rng = np.random.default_rng(12)
    t = np.round(rng.uniform(0, 3, (900, 3)) * [1, 1, 0], 2)
    t[1] = t[0] + [0, 0, 1e-7]
    s = np.concatenate((np.repeat(np.round(rng.uniform(0, 3, (60, 3)) * [1, 1, 0], 2), 10, axis=0), [[3.4, 1, 0], [30, 1, 0]]))
    source = spark.createDataFrame([(1, i, *map(float, v)) for i, v in enumerate(s)], "grid_id long, sid long, x double, y double, z double")
    target = spark.createDataFrame([(1, i, *map(float, v)) for i, v in enumerate(t)], "grid_id long, tid long, tx double, ty double, tz double")
    first, closest = [], icp.closest
    monkeypatch.setattr(icp, "PART", 50)
    monkeypatch.setattr(icp, "PAIRS", 100)
    monkeypatch.setattr(icp, "closest", lambda s, t, reach: first.append(closest(s, t, reach)) or first[0])
    got = {r["sid"]: (r["tid"], round(r["d2"], 12)) for r in icp.nearest(source, target, 0.6).collect()}
    want = {}
    for i, v in enumerate(s):
        off = v - t
        d = off[:, 0] * off[:, 0] + off[:, 1] * off[:, 1] + off[:, 2] * off[:, 2]
        if d.min() < 0.6 * 0.6:
            want[i] = int(d.argmin()), round(float(d.min()), 12)
    assert got == want and len(want) == 601 and len(first) == 1
    assert first[0].where("tid IS NULL").count() < 60 and "min(" not in first[0]._jdf.queryExecution().executedPlan().toString()


def test_feature_histograms_of_many_neighbours(spark, monkeypatch):
    """All points within the radius count, however many they are, and seeds are dealt to parts."""
    rng = np.random.default_rng(13)
    p, n = rng.uniform(0, 0.3, size=(260, 3)), rng.normal(size=(260, 3))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    monkeypatch.setattr(spatial, "SEEDS", 60)
    got = np.zeros((260, 33))
    rows = [(i, *map(float, p[i]), *map(float, n[i])) for i in range(260)]
    for r in spatial.fpfh(spark.createDataFrame(rows, "pid long, x double, y double, z double, nx double, ny double, nz double"), 0.25).collect():
        got[r["pid"], r["bin"]] = r["value"]
    assert np.allclose(got, histograms(p, n, 0.25), atol=1e-9)


def test_cliques_hold_no_triangles(spark):
    """400 matches of one motion among 900: their clique has ten million triangles, none of which is a row."""
    from lidarloom.sources import scratch

    p, moves = planted(spark, np.random.default_rng(14), cells=1, true=400, false=500)
    before = len(scratch._MADE)
    got = transforms.clique_transforms(p, "grid_id", 0.02).first()
    assert len(got["members"]) >= 400 and np.allclose(np.reshape(got["transformation"], (4, 4)), moves[0], atol=1e-3)
    assert max(spark.read.parquet(path).count() for _, path in scratch._MADE[before:]) <= 900


def test_every_matchs_clique_is_tried(spark):
    """The heaviest clique is one of pairs that agree among themselves only by a narrow margin; another has matches more that
    its transform brings home, so that one wins."""
    rng = np.random.default_rng(15)
    m = motion(0.4, 1.0, -2.0, 0.5)
    near = rng.random((30, 3)) * 0.005  # a knot of points: distances agree whatever they are matched with
    wrong = np.hstack((near, near[rng.permutation(30)] + 5))
    s = rng.random((70, 3)) * 10
    t = rigid.move(m, s)
    t[10:] += rng.choice([-1, 1], (60, 3)) * 0.02  # near the truth, but not compatible with each other
    rows = [(0, *map(float, v)) for v in (*wrong, *np.hstack((s, t)))]
    p = scratch_numbered(spark, rows)
    heavy = matching.cliques(p, 0.1).first()["members"]
    of = {r["rn"]: np.array([r["sx"], r["sy"], r["sz"]]) for r in p.collect()}
    assert all(np.abs(of[k]).max() < 0.03 for k in heavy)
    assert np.abs(rigid.move(matching.best_clique(p, 0.1)[0], s) - rigid.move(m, s)).max() < 0.05


def scratch_numbered(spark, rows):
    from lidarloom.sources import scratch

    return scratch.written(matching.numbered(spark.createDataFrame(rows, PAIRS)))


def test_teaser_keeps_its_points(monkeypatch):
    """TEASER gets the strips in voxels of 0.1, as the original has it: a cell of 5 x 5 keeps thousands of points."""
    from lidarloom.plans import target_queries

    seen = {}
    monkeypatch.setattr(target_queries, "chosen", lambda spark, sf_dir: None)
    monkeypatch.setattr(registration, "register", lambda cells, first, second, method, voxel: seen.update({method: voxel}))
    for method in registration.METHODS:
        target_queries.method_query(method)(None, "")
    assert seen["teaser"] == 0.1 and set(seen) == set(registration.METHODS)
