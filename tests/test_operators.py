"""Operators on fixtures of their own: selection rules, kernels, sources, quantiles, edge cases."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lidarloom.functions import statistics
from lidarloom.operators import clustering, fusion, spatial, strips, targets
from lidarloom.sources import las, refs, sinks

REGION = "grid_id long, n_corr long, fitness double, rmse double, tx double, ty double, tz double, pitch double, roll double, yaw double, composite_score double"


def sizes(s, least):
    """The three rules restated in numpy, without ties."""
    n = len(s)
    if n < 3:
        elbow = n
    else:
        v = (s - s.min()) / (s.max() - s.min() + 1e-8)
        c = np.zeros(n)
        c[1:-1] = np.abs(v[:-2] - 2 * v[1:-1] + v[2:])
        peaks = [i for i in range(1, n - 1) if c[i] > c[i - 1] and c[i] > c[i + 1] and c[i] >= 0.5 * c.std()]
        elbow = min(max(peaks[0], least), n) if peaks else min(max(least, int(n * 0.3)), n)
    top = 0
    while top < n and s[top] >= 0.8 * s[0]:
        top += 1
    if n < 2:
        gap = n
    else:
        d = np.diff(s)
        drops = [i + 1 for i in range(n - 1) if abs(d[i]) > abs(d.mean()) + d.std()]
        gap = min(max(drops[0], least), n) if drops else min(max(least, n // 4), n)
    return elbow, top, gap


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 40])
def test_selection_sizes(spark, n):
    rng = np.random.default_rng(n)
    for _ in range(2):
        s = np.sort(rng.random(n))[::-1]
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(s)], "grid_id long, composite_score double")
        r = strips.selection_sizes(df, 3).first()
        assert (r["k_elbow"], r["k_threshold"], r["k_gap"]) == sizes(s, 3)


def test_no_overlap(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0, 0.0), ("a", 1.0, 1.0, 1.0), ("b", 5.0, 5.0, 0.0), ("b", 6.0, 6.0, 1.0)], "strip string, x double, y double, z double")
    assert strips.overlap(strips.bounds(df)).count() == 0


def region(k, tx=0.0, rmse=0.1, fitness=0.9):
    return (k, 100, fitness, rmse, tx, 0.0, 0.0, 0.0, 0.0, 0.0, float(k))


def test_fusion_branches(spark):
    make = lambda rows: spark.createDataFrame(rows, REGION)
    assert fusion.fuse(make([])).first()["method"] == "no_valid_registration"
    assert fusion.fuse(make([]), fallback=False).count() == 0
    two = fusion.fuse(make([region(1, 1.0, 0.5, 0.0), region(2, 2.0, 0.1, 0.0)])).first()
    assert two["method"] == "min_rmse_region" and two["tx"] == 2.0
    assert fusion.fuse(make([region(k, fitness=0.1) for k in range(4)])).first()["method"] == "low_fitness"
    many = fusion.fuse(make([region(k, 0.1 * k) for k in range(5)] + [region(9, 50.0)])).first()
    assert many["method"] == "composite_score_weighted" and abs(many["tx"]) < 1 and many["n_regions"] < 6
    one = fusion.fuse(make([region(1, 3.0), region(2, fitness=0.1), region(3, fitness=0.1)])).first()
    assert one["method"] == "single_valid_region" and one["tx"] == 3.0


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(3)
    for n, m in ((3, 3), (3, 5), (5, 3), (1, 4)):
        c = rng.random((n, m))
        got = sum(c[i, j] for i, j in clustering.assignment(c))
        k = c if n <= m else c.T
        assert abs(got - min(sum(k[i, p[i]] for i in range(len(k))) for p in permutations(range(k.shape[1]), len(k)))) < 1e-9


def test_quantiles():
    assert abs(statistics.t_quantile(0.975, 24) - 2.0638985616280205) < 1e-9 and abs(statistics.t_quantile(0.975, 9) - 2.2621571627409915) < 1e-9
    assert abs(statistics.normal_quantile(0.975) - 1.959963984540054) < 1e-9


def test_planes_and_targets(spark):
    rng = np.random.default_rng(4)
    rows, centres = [], [(0.0, 0.0, 5.0), (40.0, 0.0, 6.0), (0.0, 40.0, 7.0)]
    for k, c in enumerate(centres):
        for _ in range(60):
            u, v = rng.uniform(-1, 1, 2).tolist()
            rows.append((k, c[0] + u, c[1] + v, c[2] + 0.1 * u, 2000.0))
    df = spark.createDataFrame(rows, "k long, x double, y double, z double, intensity double")
    p = clustering.planes(df, "k").collect()
    assert len(p) == 3 and all(abs(r["angle"] - math.degrees(math.atan(0.1))) < 1e-6 and r["planarity"] < 1e-9 for r in p)
    ref = spark.createDataFrame([(i, *c) for i, c in enumerate(centres)], "reference_id long, x double, y double, z double")
    got = targets.analyse(targets.find(df, ref), ref).collect()
    assert sorted(r["reference_id"] for r in got) == [0, 1, 2] and all(r["distance_to_ref"] < 0.5 and r["point_count"] == 60 for r in got)
    assert targets.analyse(df.limit(5), ref).count() == 0 and targets.find(df, ref.limit(0)).count() == 0
    assert targets.find(df, ref, z_max=5.5).count() == 60 and targets.find(df, ref, z_max=-5.0).count() == 180


def test_curves(spark):
    x = np.arange(30.0)
    df = spark.createDataFrame([("a", int(i), float(2 + i - 0.1 * i**2)) for i in x], "g string, o long, v double")
    s = [r["smooth"] for r in targets.smooth(df, "g", "o", "v").orderBy("o").collect()]
    assert np.allclose(s, 2 + x - 0.1 * x**2)
    e = spark.createDataFrame([("a", float(5 - 3 * math.exp(-0.2 * i))) for i in range(30)], "g string, v double")
    f = targets.exponential_fit(e, "g", "v").first()
    assert abs(f["a"] + 3) < 1e-3 and abs(f["b"] - 0.2) < 1e-3 and abs(f["c"] - 5) < 1e-3
    b = targets.bootstrap(df, "g", ["o"], "v", 300).first()
    assert b["lower"] < np.mean(2 + x - 0.1 * x**2) < b["upper"]


@pytest.mark.parametrize("rgb", [False, True])
def test_las_round_trip(spark, tmp_path, rgb):
    folder = str(tmp_path / "las")
    rows = [(i * 0.5, i * 0.25 - 3, 7.0 - i * 0.1, float(i % 900), float(i), 2.0 * i, 3.0 * i) for i in range(1000)]
    df = spark.createDataFrame(rows, "x double, y double, z double, intensity float, r float, g float, b float").repartition(3)
    sinks.write_las(df if rgb else df.drop("r", "g", "b"), folder)
    head = spark.read.format("las_header").load(folder).collect()
    assert sum(h["n_points"] for h in head) == 1000 and all(h["has_colors"] == rgb for h in head)
    back = spark.read.format("las").option("recordsPerPartition", "100").load(folder)
    assert back.count() == 1000
    assert abs(back.agg(F.sum("x")).first()[0] - sum(r[0] for r in rows)) < 0.6
    assert (back.agg(F.sum("b")).first()[0] == sum(r[6] for r in rows)) if rgb else (back.where("r IS NOT NULL").count() == 0)
    assert back.where("x BETWEEN 10 AND 20").count() == 21
    assert las.read_points(spark, folder).select("strip_id").distinct().count() >= 1


def test_las_is_written_whole_or_not_at_all(spark, tmp_path):
    """A strip is many files; a failed job leaves none, and what overflows is an error."""
    import os

    folder = str(tmp_path / "las")
    df = spark.range(0, 900, 1, 3).selectExpr("id * 0.5D AS x", "1D AS y", "2D AS z", "5F AS intensity", "CAST(id % 2 AS INT) AS file_number")
    las.enable(spark)
    df.write.format("las").mode("append").option("recordsPerFile", 100).save(folder)
    names = sorted(os.listdir(folder))
    assert all(n.endswith(".las") for n in names) and len(names) == 12 and not [n for n in names if n.startswith("_")]
    n = las.read_points(spark, folder).groupBy("strip_id").count().collect()
    assert {(r["strip_id"], r["count"]) for r in n} == {(0, 450), (1, 450)}
    for bad in ("CASE WHEN id = 850 THEN 1e12D ELSE id END AS x, 1F AS intensity", "id * 1D AS x, CASE WHEN id = 850 THEN 70000F ELSE 1F END AS intensity", "CASE WHEN id = 850 THEN NULL ELSE 1D END AS x, 1F AS intensity"):
        with pytest.raises(Exception, match="scale|65535|finite"):
            sinks.write_las(spark.range(0, 900, 1, 3).selectExpr(*bad.split(", "), "1D AS y", "2D AS z"), folder)
        assert sorted(os.listdir(folder)) == names
    sinks.write_las(df, folder, mode="overwrite")
    assert las.read_points(spark, folder).count() == 900 and not set(os.listdir(folder)) & set(names)
    sinks.write_las(df.limit(0), str(tmp_path / "none"))
    assert os.listdir(tmp_path / "none") == []


@pytest.mark.parametrize("rgb", [False, True])
def test_las_of_large_measures(spark, tmp_path, rgb):
    """Intensities and colours beyond 16 bits come back as they were, beside those that fit, whose files stay plain."""
    import glob

    folder = str(tmp_path / "las")
    names = ["intensity", *("rgb" if rgb else "")]
    df = spark.range(0, 2000, 1, 2).selectExpr("id * 0.5D AS x", "1D AS y", "2D AS z", *(f"CASE WHEN id % 3 = 0 THEN id * {k + 90}D ELSE id * 1D END AS {n}" for k, n in enumerate(names)))
    sinks.write_las(df, folder, wide=True)
    back = spark.read.format("las").option("recordsPerPartition", "100").load(folder)
    rows = lambda d: sorted(tuple(r) for r in d.select("x", *names).collect())
    assert rows(back) == rows(df)
    sizes = {las.header(p)["size"] for p in glob.glob(f"{folder}/*.las")}
    assert sizes == ({26, 58} if rgb else {20, 28}) and sum(r["n_points"] for r in spark.read.format("las_header").load(folder).collect()) == 2000
    with pytest.raises(Exception, match="65535"):
        sinks.write_las(df, folder)


def test_las_broken(tmp_path):
    assert las.header(str(tmp_path / "none.las")) is None
    (tmp_path / "bad.las").write_bytes(b"nothing" * 60)
    assert las.header(str(tmp_path / "bad.las")) is None
    (tmp_path / "short.las").write_bytes(b"LASF" + struct.pack("<I", 0))
    assert las.header(str(tmp_path / "short.las")) is None


def test_references_and_sinks(spark, tmp_path):
    (tmp_path / "ref.txt").write_text("# a comment\n 1.0   2.0 3.5\n\n4 5 6\n")
    got = refs.read_references(spark, str(tmp_path / "ref.txt")).orderBy("reference_id").collect()
    assert [(r["reference_id"], r["x"], r["z"]) for r in got] == [(0, 1.0, 3.5), (1, 4.0, 6.0)]
    (tmp_path / "one.txt").write_text("1 2 3\n")
    assert refs.read_references(spark, str(tmp_path / "one.txt")).count() == 1
    sinks.write_matrix(np.eye(4).ravel(), str(tmp_path / "m"), [3, 1])
    assert np.allclose(np.load(str(tmp_path / "m.npy")), np.eye(4)) and "[1, 3]" in (tmp_path / "m.txt").read_text()
    sinks.write_report(str(tmp_path / "r"), a=spark.range(1500).toDF("n"), b=spark.range(0))
    assert spark.read.json(str(tmp_path / "r" / "a")).agg(F.sum("n")).first()[0] == 1500 * 1499 // 2
    sinks.write_csv(spark.range(3), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3


def test_streaming_equals_batch(spark, tmp_path):
    from lidarloom.sources import tables
    from lidarloom.streaming import cells

    points = tables.points(spark, "/root/testdata/sf0.001").select("strip", "x", "y", "z")
    points.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = cells.running_cells(stream, 20.0).writeStream.outputMode("complete").format("memory").queryName("cells_now").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r["strip"], r["cx"], r["cy"])
    a, b = ({key(r): (r["n"], round(r["z_mean"], 6)) for r in df.collect()} for df in (spark.table("cells_now"), cells.running_cells(points, 20.0)))
    assert a == b


def test_interpolation(spark):
    rows = [("a", float(x), float(y), 2.0 * x - y) for x, y in ((0, 0), (4, 0), (0, 4), (4, 4), (2, 1), (1, 3))]
    from lidarloom.operators import transforms

    got = transforms.interpolate(spark.createDataFrame(rows, "f string, x double, y double, z double"), "f", 9).collect()
    assert len(got) == 81 and all(abs(r["z"] - (2 * r["x"] - r["y"])) < 1e-9 for r in got)


def test_bootstrap_of_equal_values(spark):
    """Equal values are drawn independently: 50 ones and 50 twos have the interval of a mean of 100 fair draws."""
    df = spark.createDataFrame([("a", i, 1.0 + (i >= 50)) for i in range(100)], "g string, i int, v double")
    b = targets.bootstrap(df, "g", ["i"], "v", 1000).first()
    assert abs(b["lower"] - 1.402) < 0.03 and abs(b["upper"] - 1.598) < 0.03


def test_lof_finds_the_far_point(spark):
    """Neighbours are found however far they are; against all pairs."""
    rng = np.random.default_rng(4)
    v = np.concatenate((rng.normal(size=(60, 3)) * 0.01, [[5.0, 0, 0], [5.1, 0, 0], [400.0, -3, 2]]))
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(v)], "pid long, x double, y double, z double")
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :5]
    dist = np.take_along_axis(d, near, 1)
    lrd = 1 / (np.maximum(dist, dist[:, -1][near]).mean(1) + 1e-10)
    want = lrd[near].mean(1) / lrd
    got = {r["pid"]: r["lof"] for r in spatial.lof(df, 5).collect()}
    assert sorted(got) == list(range(63)) and np.allclose([got[i] for i in range(63)], want, rtol=1e-6)
    left = {r["pid"] for r in spatial.lof_inliers(df, 5, 0.05).collect()}
    assert 62 not in left and 59 <= len(left) <= 60
    assert spatial.lof(df.limit(0), 5).count() == 0 and spatial.k_nearest(df.limit(3), 5).count() == 6


def test_quantiles(spark):
    from lidarloom.functions.statistics import quantiles

    rng = np.random.default_rng(1)
    v = np.concatenate((rng.normal(size=4000), np.full(3000, 0.25), rng.normal(size=1000) * 1e9))
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double")
    shares = [0.0, 0.05, 0.5, 0.731, 0.95, 1.0]
    assert np.allclose(quantiles(df, "v", shares, few=50), np.quantile(v, shares), rtol=1e-12)
    assert quantiles(df.limit(0), "v", [0.5]) == [None]


def test_rotations(spark):
    """Logarithm and exponential undo each other, for no turn, small ones and half turns too; means are matrices."""
    def turn(axis, angle):
        x = np.array(axis) / np.linalg.norm(axis)
        k = np.array([[0, -x[2], x[1]], [x[2], 0, -x[0]], [-x[1], x[0], 0]])
        return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k

    turns = [turn((1, 2, 3), a) for a in (0.0, 1e-5, 0.3, 2.0, math.pi - 1e-3, math.pi)] + [turn(x, math.pi) for x in ((1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 1, -1), (1, -2, 0.5))]
    df = spark.createDataFrame([tuple(map(float, m.ravel())) for m in turns], ", ".join(f"r{i} double" for i in range(9)))
    r = [F.col(f"r{i}") for i in range(9)]
    back = df.select(*(v.alias(f"b{i}") for i, v in enumerate(fusion.rotation_exp(fusion.rotation_log(r))))).collect()
    assert np.allclose([list(x) for x in back], [m.ravel() for m in turns], atol=1e-6)
    two = spark.createDataFrame([(1.0, 0.25, 1.0, 2.0, 3.0, *map(float, turn((0, 0, 1), 0.2).ravel())), (1.0, 0.75, 5.0, 2.0, -1.0, *map(float, turn((0, 0, 1), 0.6).ravel()))], "fitness double, weight double, tx double, ty double, tz double, " + ", ".join(f"r{i} double" for i in range(9)))
    m = np.array(fusion.average(two, r).first()).reshape(4, 4)
    assert np.allclose(m[:3, :3], turn((0, 0, 1), 0.5)) and np.allclose(m[:3, 3], (4, 2, 0))


def test_linkage_and_hull(spark):
    """Long chains link up whatever their order; the hull of a partitioned cloud is that of the whole."""
    rng = np.random.default_rng(2)
    order = rng.permutation(200)
    df = spark.createDataFrame([(int(order[i]), float(i % 100) * 0.9, float(i // 100) * 50, 0.0) for i in range(200)], "id long, x double, y double, z double").repartition(5)
    got = {r["label"]: r["n"] for r in clustering.single_linkage(df, 1.0).collect()}
    assert got == {int(order[:100].min()): 100, int(order[100:].min()): 100}
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]
    rows = [("a", *p) for p in square + [(float(a), float(b)) for a, b in zip(rng.random(300) * 4, rng.random(300) * 3, strict=True)]] + [("b", 1.0, 1.0), ("b", 2.0, 2.0)]
    hull = clustering.convex_hull(spark.createDataFrame(rows, "g string, x double, y double").repartition(4), "g").orderBy("g", "place").collect()
    assert [(r["x"], r["y"]) for r in hull if r["g"] == "a"] == square and sum(r["g"] == "b" for r in hull) == 2


def test_smoothing_of_a_long_group(spark):
    """Each row's window against a polynomial fit of its own; short groups are left as they are."""
    rng = np.random.default_rng(4)
    y = rng.normal(size=40)
    rows = [("a", i, float(v)) for i, v in enumerate(y)] + [("b", i, float(i * i)) for i in range(3)]
    got = {(r["g"], r["o"]): r["smooth"] for r in targets.smooth(spark.createDataFrame(rows, "g string, o int, v double").repartition(3), "g", "o", "v").collect()}
    for i in range(40):
        start = max(0, min(i - 5, 29))
        fit = np.polynomial.Polynomial.fit(np.arange(start, start + 11), y[start : start + 11], 3)
        assert abs(got["a", i] - fit(i)) < 1e-9
    assert [round(got["b", i], 9) for i in range(3)] == [0, 1, 4]


def test_normal_quantiles_of_a_column(spark):
    p = [1e-300, 1e-20, 1e-9, 0.01, 0.07, 0.3, 0.5, 0.7, 0.95, 0.999]
    got = [r["z"] for r in spark.createDataFrame([(v,) for v in p], "p double").select(statistics.normal_quantile_of(F.col("p")).alias("z")).collect()]
    assert np.allclose(got, [statistics.normal_quantile(v) for v in p], rtol=1e-12, atol=1e-15)


def test_mahalanobis(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2)) @ np.array([[2.0, 0.3], [0.0, 0.5]])
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double")
    d = np.sqrt(np.einsum("ij,jk,ik->i", x - x.mean(0), np.linalg.inv(np.cov(x.T)), x - x.mean(0)))
    r = spatial.mahalanobis(df, ["a", "b"], 0.9).first()
    assert r["color_outliers"] == (d > np.quantile(d, 0.9)).sum() and abs(r["threshold"] - np.quantile(d, 0.9)) < 1e-9 and abs(r["mean_distance"] - d.mean()) < 1e-9
    for bad in (df.limit(0), df.withColumn("b", F.col("a") * 2)):
        r = spatial.mahalanobis(bad, ["a", "b"]).first()
        assert r["color_outliers"] == 0 and r["threshold"] is None and r["mean_distance"] is None


def test_infinite_values_have_quantiles(spark):
    v = [-math.inf] * 3 + [float(i) for i in range(90)] + [math.inf] * 7
    df = spark.createDataFrame([(x,) for x in v] + [(None,), (math.nan,)], "v double")
    got = statistics.quantiles(df, "v", [0.0, 0.02, 0.5, 0.9, 1.0], few=10)
    assert got[:2] == [-math.inf, -math.inf] and got[2:4] == np.quantile(v, [0.5, 0.9]).tolist() and got[4] == math.inf
    assert statistics.quantiles(df.where("v = double('infinity')"), "v", [0.3]) == [math.inf] and statistics.quantiles(df.limit(0), "v", [0.5]) == [None]


def test_medoid_is_brute_force(spark):
    """Far rows are never summed, ties go to the least id."""
    rng = np.random.default_rng(5)
    p = rng.normal(size=(200, 6))
    p[150:] += 40
    p[77] = p[20]
    names = fusion.NAMES
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], f"grid_id long, {', '.join(f'{n} double' for n in names)}")
    total = np.linalg.norm(p[:, None] - p[None], axis=2).sum(1)
    got = fusion.medoid(df)
    assert got[0] == int(total.round(9).argmin()) and abs(got[1] - total.min()) < 1e-6
    assert fusion.medoid(df.limit(0)) is None and fusion.medoid(df.limit(1))[1] == 0.0


def test_exponentials_of_many_groups(spark):
    """Closed cases and noise, all groups at once, against a fine search of the rate."""
    rng = np.random.default_rng(6)
    x = np.arange(60.0)
    cases = {"closed": -3.0 * np.exp(-0.07 * x) + 5.0, "noisy": np.sort(-2.0 * np.exp(-0.03 * x) + 1.0 + rng.normal(0, 0.02, 60)), "line": 0.5 * x, "flat": np.full(60, 2.0)}
    rows = [(g, float(v)) for g, y in cases.items() for v in y]
    rng.shuffle(rows)
    got = {r["g"]: r for r in targets.exponential_fit(spark.createDataFrame(rows + [("closed", None)], "g string, v double"), "g", "v").collect()}
    assert np.allclose([got["closed"][k] for k in "abc"], (-3.0, 0.07, 5.0), atol=1e-6)
    for g, y in cases.items():
        best = min(float(((m @ np.linalg.lstsq(m, y, rcond=None)[0] - y) ** 2).sum()) for b in np.concatenate((-np.geomspace(1, 1e-4, 400), np.geomspace(1e-4, 5, 400))) for m in [np.stack((np.exp(np.clip(-b * x, -50, 50)), np.ones(60)), 1)])
        r = got[g]
        assert float(((r["a"] * np.exp(-r["b"] * x) + r["c"] - np.sort(y)) ** 2).sum()) <= best * 1.001 + 1e-9


def test_quantiles_of_groups(spark):
    """Several columns of several groups at once, narrowed down in several rounds, against numpy; nulls, repeated values
    and a group without values."""
    from lidarloom.functions.statistics import quantiles_by

    rng = np.random.default_rng(5)
    a, b = rng.normal(size=3000), np.round(rng.exponential(size=3000), 1)
    rows = [("f" if i % 3 else "o", float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))] + [("f", None, math.nan), ("none", None, None), (None, 7.0, 7.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    shares = [0.0, 0.013, 0.5, 0.77, 1.0]
    got = quantiles_by(df, {"a": shares, "b": shares[1:3]}, "g", few=20)
    assert {g for g, _ in got} == {"f", "o", None} and got[None, "a"] == [7.0] * 5
    for g, own in (("f", np.arange(3000) % 3 > 0), ("o", np.arange(3000) % 3 == 0)):
        assert np.allclose(got[g, "a"], np.quantile(a[own], shares), rtol=1e-12) and np.allclose(got[g, "b"], np.quantile(b[own], shares[1:3]), rtol=1e-12)


@pytest.mark.parametrize("name", ["agg_describe_intensity", "flt_percentile_cut", "out_iqr", "out_combined", "agg_median_mad"])
def test_no_task_gathers_all_values(spark, name):
    """Quantiles of points are no ``percentile`` aggregates, whose one task has every distinct value; an empty table has
    nulls."""
    from lidarloom.operators import report

    rows = [("F", float(i), 0.0, 0.0, float(i * 7 % 101)) for i in range(300)]
    p = spark.createDataFrame(rows, "strip string, x double, y double, z double, intensity double")
    df = report.report(name, points=p)
    assert "percentile" not in df._jdf.queryExecution().toString().lower() and df.count() >= 1
    assert report.report(name, points=p.limit(0)).count() <= 1


def test_ranges_of_heights(spark):
    """The ranges of cells whose heights are all different don't gather them in one task."""
    from lidarloom.operators import strips

    df = spark.range(1000).selectExpr("sqrt(id) AS z", "CAST(id % 7 AS DOUBLE) AS intensity")
    got = strips.ranges(df, (0.01, 99.99), (0.0, 99.5))
    z = np.sqrt(np.arange(1000))
    want = [*np.quantile(z, [0.0001, 0.9999]), *np.quantile(np.arange(1000) % 7, [0.0, 0.995])]
    assert "percentile" not in got._jdf.queryExecution().toString().lower() and np.allclose(list(got.first()), want, rtol=1e-12)


def test_dense_clouds_are_searched_near_by(spark):
    """The nearest within a radius that holds nearly all points, against all pairs: the pairs looked at are not all
    pairs, in a dense middle, in sparse surroundings and where many points coincide."""
    rng = np.random.default_rng(8)
    p = np.round(np.concatenate((rng.normal(size=(300, 3)) * 0.1, rng.uniform(-1, 1, (60, 3)), np.zeros((20, 3)))), 4)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "pid long, x double, y double, z double")
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    assert spatial.search_radius(df, [], ("x", "y", "z"), 1.0, 5.0) < 0.5
    for k, radius, itself in ((1, 0.7, True), (6, 0.7, True), (6, 0.7, False)):
        got = {}
        for r in spatial.k_within(df, df, k, radius, itself=itself).collect():
            got.setdefault(r["q"], []).append((round(r["d"], 9), r["p"]))
        want = {i: sorted((round(float(d[i, j]), 9), j) for j in range(len(p)) if d[i, j] <= radius and (itself or i != j))[:k] for i in range(len(p))}
        assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in want.items() if v}
    even, odd = df.where("pid % 2 = 0"), df.where("pid % 2 = 1")
    near = {r["q"]: r["p"] for r in spatial.nearest(even, odd, 0.5).collect()}
    first = {i: min((round(float(d[i, j]), 12), j) for j in range(1, len(p), 2)) for i in range(0, len(p), 2)}
    assert near == {i: j for i, (v, j) in first.items() if v < 0.5}
    back = {j: min((round(float(d[i, j]), 12), i) for i in range(0, len(p), 2)) for j in range(1, len(p), 2)}
    assert {(r["q"], r["p"]) for r in spatial.mutual_nearest(even, odd, 0.5).collect()} == {(i, j) for i, j in near.items() if back[j][1] == i}


def test_equal_regions_are_equal(spark, tmp_path):
    """Regions of the same rows in another order have the same figures to the last bit, so that ties go by number."""
    from lidarloom.plans import catalog
    from lidarloom.sources import tables

    rows = [(s, 1, 10.0, 100.0, d, 0.04) for s, own in ((1, (0.3, 0.2, 0.1)), (2, (0.1, 0.2, 0.3)), (3, (0.2, 0.3, 0.1))) for d in own]
    spark.createDataFrame(rows, "l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert tables.regions(spark, str(tmp_path)).select("composite_score").distinct().count() == 1
    got = catalog.queries()["srt_score_desc"](spark, str(tmp_path)).collect()
    assert sorted((r["place"], r["grid_id"]) for r in got) == [(1, 1), (2, 2), (3, 3)]


def test_medoid_of_many_equal_rows(spark, monkeypatch):
    """Equal rows are one candidate for the medoid: their number adds no rounds."""
    from lidarloom.sources import scratch

    rows = [(i, *(float(i % 5 == 0) * k for k in range(6))) for i in range(1, 401)]
    df = spark.createDataFrame(rows, "grid_id long, tx double, ty double, tz double, pitch double, roll double, yaw double")
    tables, written = [], scratch.written
    monkeypatch.setattr(scratch, "written", lambda d: tables.append(1) or written(d))
    assert fusion.medoid(df)[0] == 1 and len(tables) <= 3


def test_colours_without_pairs(spark, monkeypatch):
    """Seeds and neighbours against a plain search, in parts of seeds, with colours that are null or no numbers, and
    without a row for each pair."""
    rng = np.random.default_rng(11)
    xyz, rgb = rng.uniform(-0.2, 0.2, (300, 3)).tolist(), rng.normal(0, 1, (300, 3)).tolist()
    xyz[40:60] = [xyz[40]] * 20
    rgb[5][0], rgb[7][1], rgb[9][2] = None, float("nan"), float("inf")
    nan_last = lambda v: (math.isnan(v), v)

    def median(values):
        v = sorted(values, key=nan_last)
        return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 if v else math.nan

    want = set(range(0, 300, 4))
    for q in range(0, 300, 4):
        near = [p for p in range(300) if math.dist(xyz[q], xyz[p]) <= 0.1]
        ok = set(near) if len(near) >= 3 else set()
        for ch in range(3):
            given = [p for p in near if rgb[p][ch] is not None]
            m = median([rgb[p][ch] for p in given])
            off = {p: abs(rgb[p][ch] - m) for p in given}
            mad = median(list(off.values()))
            limit = mad if math.isnan(mad) else max(mad, 0.1)
            ok &= {p for p in given if math.isnan(limit) or off[p] <= limit}
        want |= ok
    points = spark.createDataFrame([(i, *xyz[i], *rgb[i]) for i in range(300)], "pid long, x double, y double, z double, r double, g double, b double")
    monkeypatch.setattr(spatial, "within", None)
    monkeypatch.setattr(spatial, "SEEDS", 2)
    got = spatial.colour_consistent(points, points.where("pid % 4 = 0"), 0.1, 1.0, least=3)
    assert sorted(r["pid"] for r in got.collect()) == sorted(want)


def test_entropies_read_points_once(spark, tmp_path):
    """The counts of bins are taken from the points once; nothing after that reads them again."""
    rng = np.random.default_rng(4)
    rows = [(s, int(g), float(z), float(i)) for s in "FO" for g, z, i in zip(rng.integers(0, 4, 200), rng.random(200), rng.integers(0, 50, 200), strict=True)]
    spark.createDataFrame(rows, "strip string, grid_id long, z double, intensity double").write.parquet(str(tmp_path / "cells"))
    cells = spark.read.parquet(str(tmp_path / "cells"))
    found = strips.entropies(cells, strips.ranges(cells, (0, 100), (0, 100)), 20, 30, 1.0)
    assert not set(found.inputFiles()) & set(cells.inputFiles())
    assert found.count() == 8 and all(0 < r["z_entropy_norm"] <= 1 for r in found.collect())


def test_a_runs_tables_are_written_once(spark, monkeypatch):
    """A recorded run writes its cells once, and drops the tables of all points when they have been read."""
    from pathlib import Path

    from lidarloom.plans import flow_queries
    from lidarloom.sources import scratch

    sizes, made = [], scratch.written

    def written(df):
        out = made(df)
        sizes.append((set(df.columns), [p for p in map(Path, (f.removeprefix("file://") for f in out.inputFiles()))]))
        return out

    monkeypatch.setattr(scratch, "written", written)
    log, chosen, results = flow_queries.recorded(spark, "/root/testdata/sf0.001")
    whole = [files for columns, files in sizes if "intensity" in columns]
    assert [r[1] for r in log.rows] == ["load", "assign", "select", "extract", "register", "match"]
    assert len(whole) == 3 and not any(f.exists() for f in whole[0] + whole[1]) and all(f.exists() for f in whole[2])
    assert chosen.count() == log.rows[3][2] and results.count() == log.rows[4][2]


def test_pairs_of_regions_are_dealt(spark):
    """Adaptive execution would put the regions into one partition, and all of their pairs into one task."""
    from lidarloom.plans import catalog

    pairs = catalog.queries()["jn_pairwise_self"](spark, "/root/testdata/sf0.01")
    tasks = [r["n"] for r in pairs.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()]
    assert sum(tasks) == pairs.select("first").distinct().count() ** 2 and len(tasks) >= 8 and max(tasks) < sum(tasks) / 4
