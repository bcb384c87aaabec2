"""Survey targets: find their points, cluster, match with references, and measure. Also curves and surfaces."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lidarloom.sources import scratch

from lidarloom.functions.geometry import dist3d
from lidarloom.functions.statistics import normal_quantile_of
from lidarloom.operators import auction, clustering, spatial


def find(points: DataFrame, refs: DataFrame, buffer: float = 10.0, intensity: float = 1300.0, radius: float = 0.5, mad: float = 0.0, z_max: float | None = None) -> DataFrame:
    """Bright points around the references, with colour-consistent neighbours if ``mad``. A height limit that would
    leave nothing is ignored."""
    box = refs.agg(*(f(a).alias(f"{a}{k}") for a in "xy" for k, f in ((0, F.min), (1, F.max)))).first()
    if box["x0"] is None:
        return points.limit(0)
    near = points.where(F.col("x").between(box["x0"] - buffer, box["x1"] + buffer) & F.col("y").between(box["y0"] - buffer, box["y1"] + buffer))
    if mad:
        near = near.withColumn("pid", F.xxhash64("x", "y", "z", "intensity"))
        ids = spatial.colour_consistent(near, near.where(F.col("intensity") > intensity), radius, mad)
        found = near.join(ids, "pid", "left_semi").drop("pid")
    else:
        found = near.where(F.col("intensity") > intensity)
    if z_max is None:
        return found
    low = found.agg(F.count_if(F.col("z") < z_max).alias("__low"))
    return found.crossJoin(F.broadcast(low)).where((F.col("z") < z_max) | (F.col("__low") == 0)).drop("__low")


def kmeans(points: DataFrame, k: int, seed: int = 10) -> DataFrame:
    """``points`` with ``cluster_id``."""
    v = VectorAssembler(inputCols=["x", "y", "z"], outputCol="features").transform(points)
    return KMeans(k=k, seed=seed, initSteps=5).fit(v).transform(v).withColumnRenamed("prediction", "cluster_id").drop("features")


def analyse(points: DataFrame, refs: DataFrame, merge: float = 5.0) -> DataFrame:
    """(cluster_id, reference_id, point_count, center_x..z, ref_x..z, planarity, normal_x..z, normal_angle,
    distance_to_ref): k-means with one cluster a reference, merged by linkage, matched one to one by an auction. Fewer than
    ten points or no references: no rows. A merged cluster's place in the matching is the plain mean of its points."""
    spark = points.sparkSession
    k = refs.count()
    if not k or points.limit(10).count() < 10:
        return spark.createDataFrame([], "cluster_id int, reference_id long, ref_x double, ref_y double, ref_z double, point_count long, center_x double, center_y double, center_z double, planarity double, normal_x double, normal_y double, normal_z double, normal_angle double, distance_to_ref double")
    own = scratch.written(kmeans(points.select(*"xyz"), k))
    centres = own.groupBy(F.col("cluster_id").cast("long").alias("pid")).agg(*(F.avg(a).alias(a) for a in "xyz"))
    links = spatial.within(centres, centres, merge, strict=True).where("q < p").select(F.col("q").alias("a"), F.col("p").alias("b"))
    label = clustering.labels_of(links, centres.select(F.col("pid").alias("id")))
    merged = own.join(F.broadcast(label.select(F.col("id").cast("int").alias("cluster_id"), F.col("label").cast("int").alias("label"))), "cluster_id")
    p = scratch.written(clustering.planes(merged, "label"))
    at = p.select(F.lit(0).alias("all"), F.col("label").alias("id"), *(F.col(f"c{a}").alias(a) for a in "xyz"))
    pairs = auction.assign(at, refs.select(F.lit(0).alias("all"), F.col("reference_id").alias("id"), *"xyz"), "all")
    named = p.select(F.col("label").alias("cluster_id"), F.col("n").alias("point_count"), *(F.col(f"c{a}").alias(f"center_{a}") for a in "xyz"), "planarity", *(F.col(f"n{a}").alias(f"normal_{a}") for a in "xyz"), F.col("angle").alias("normal_angle"))
    matched = pairs.select(F.col("left_id").cast("int").alias("cluster_id"), F.col("right_id").alias("reference_id"), F.col("d").alias("distance_to_ref"))
    places = refs.select("reference_id", *(F.col(a).alias(f"ref_{a}") for a in "xyz"))
    return named.join(matched, "cluster_id").join(places, "reference_id").select("cluster_id", "reference_id", "ref_x", "ref_y", "ref_z", *named.columns[1:], "distance_to_ref")


def smooth(rows: DataFrame, by: str, order: str, value: str, window: int = 11, degree: int = 3) -> DataFrame:
    """(by, order, smooth): Savitzky-Golay over the ordered rows of each group, fixed coefficients inside and edge
    polynomials at the ends. The window is the largest odd number of rows up to ``window``. A null value makes the rows
    whose window holds it null. Each row gathers its own window only, so groups may be of any length."""
    sizes = range(1, window + 1, 2)
    bases = [np.vander(np.arange(n) - n // 2, min(n, degree + 1), increasing=True).astype(float) for n in sizes]
    table = F.array(*(F.array(*(F.array(*map(F.lit, r)) for r in (b @ np.linalg.pinv(b)).tolist())) for b in bases))
    group = Window.partitionBy(by)
    ordered = group.orderBy(order)
    reach = window - 1
    r = rows.select(by, order, F.collect_list(F.struct(F.col(value).cast("double").alias("v"))).over(ordered.rowsBetween(-reach, reach)).alias("near"), (F.row_number().over(ordered) - 1).alias("i"), F.count(F.lit(1)).over(group).cast("int").alias("rows"))
    n = F.least("rows", F.lit(window))
    r = r.withColumn("n", n - 1 + n % 2).withColumn("start", F.greatest(F.lit(0), F.least(F.col("i") - F.floor(F.col("n") / 2), F.col("rows") - F.col("n"))).cast("int"))
    own = F.slice("near", F.col("start") - F.greatest(F.lit(0), F.col("i") - reach) + 1, F.col("n"))
    weights = F.get(F.get(table, F.floor(F.col("n") / 2).cast("int")), F.col("i") - F.col("start"))
    dot = F.aggregate(F.zip_with(own, weights, lambda x, w: x["v"] * w), F.lit(0.0), lambda total, x: total + x)
    return r.select(by, order, dot.alias("smooth"))


def bootstrap(rows: DataFrame, by: str, key: list[str], value: str, times: int = 1000, seed: int = 7) -> DataFrame:
    """(by, lower, upper): percentile interval of the mean over ``times`` resamples. Each row's count in a resample is
    Poisson with mean one, drawn from a hash of its group, its ``key`` (which tells the rows of a group apart) and the
    resample, so resamples need no shuffle of their own, are reproducible, and equal values are drawn independently.

    A task keeps two arrays of ``times`` sums for each group, of counts and of counted values; only these leave it. Rows
    without a value count as draws of nothing, as in a sum."""
    named = rows.select(F.col(by).alias("own"), F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in (by, *key))).alias("text"), F.col(value).cast("double").alias("value"))
    limits, kind = np.array(POISSON), dict(rows.dtypes)[by]

    def work(batches):
        import hashlib

        sums: dict = {}
        for b in batches:
            for own, text, v in zip(b["own"], b["text"], b["value"], strict=True):
                state = sums.setdefault(own, np.zeros((2, times)))
                head = hashlib.md5(f"{text}|".encode())
                u = np.empty(times)
                for r in range(times):
                    h = head.copy()
                    h.update(str(r).encode())
                    u[r] = int.from_bytes(h.digest()[:4], "big")
                k = ((u + 0.5) / (1 << 32) > limits[:, None]).sum(0)
                state[0] += k
                if v == v:
                    state[1] += k * v
        yield pd.DataFrame({"own": list(sums), "k": [s[0].tolist() for s in sums.values()], "kv": [s[1].tolist() for s in sums.values()]})

    states = named.mapInPandas(work, f"own {kind}, k array<double>, kv array<double>")
    each = states.select("own", F.posexplode(F.arrays_zip("k", "kv"))).groupBy("own", "pos").agg(F.try_divide(F.sum("col.kv"), F.sum("col.k")).alias("m"))
    return each.groupBy(F.col("own").alias(by)).agg(F.percentile("m", F.lit(0.025)).alias("lower"), F.percentile("m", F.lit(0.975)).alias("upper"))


#: The distribution of a Poisson count with mean one, from 0 on.
POISSON = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720)]).tolist()


#: Rates among which an exponential's is looked for at first; damping at which a fit is given up, and its rounds.
RATES = (*(-np.geomspace(1, 1e-4, 60)).tolist(), *np.geomspace(1e-4, 5, 80).tolist())
GIVEN_UP, FIT_ROUNDS = 1e12, 60


def exponential_fit(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, a, b, c) of a exp(-b x) + c through each group's sorted values, x from 0 on. Nulls don't count.

    For a given rate the rest is linear, so the first aggregate tries ``RATES`` by their sums. From the best one on, steps
    of Levenberg and Marquardt: a round sums the squares and products of the derivatives and residuals of all groups at
    once; the driver solves a 3 x 3 system for each group that is still open."""
    w = Window.partitionBy("own").orderBy("y")
    data = rows.select(F.col(by).alias("own"), F.col(value).cast("double").alias("y")).where("y IS NOT NULL")
    data = scratch.written(data.withColumn("x", F.row_number().over(w) - F.lit(1.0)))
    kind = dict(rows.dtypes)[by]
    tried = data.selectExpr("own", "x", "y", f"explode(array({', '.join(f'{r!r}D' for r in RATES)})) AS b").selectExpr("own", "b", "y", "exp(greatest(-50D, least(50D, -b * x))) AS e")
    fits = tried.groupBy("own", "b").agg(*(F.expr(f"{f} AS {k}") for k, f in (("n", "count(*)"), ("e1", "sum(e)"), ("e2", "sum(e * e)"), ("y1", "sum(y)"), ("y2", "sum(y * y)"), ("ey", "sum(e * y)"))))
    start: dict = {}
    for r in fits.collect():  # groups x rates
        h, g = np.array([[r["e2"], r["e1"]], [r["e1"], r["n"]]]), np.array([r["ey"], r["y1"]])
        a, c = np.linalg.lstsq(h, g, rcond=None)[0]
        cost = float(r["y2"] - 2 * (a * r["ey"] + c * r["y1"]) + a * a * r["e2"] + 2 * a * c * r["e1"] + c * c * r["n"])
        if r["own"] not in start or (cost, abs(r["b"])) < start[r["own"]][:2]:
            start[r["own"]] = cost, abs(r["b"]), np.array([a, r["b"], c])
    found, damping = {g: v[2] for g, v in start.items()}, dict.fromkeys(start, 1e-3)
    now: dict = {}
    step: dict = {g: p for g, p in found.items()}  # what is tried next
    for _ in range(FIT_ROUNDS):
        if not step:
            break
        at = data.sparkSession.createDataFrame([(g, *(float(v) for v in p)) for g, p in step.items()], f"own {kind}, a double, b double, c double")
        d = data.join(F.broadcast(at), data["own"].eqNullSafe(at["own"])).select(data["own"], "x", "y", "a", "b", "c")
        d = d.selectExpr("own", "y", "a", "c", "x", "exp(greatest(-50D, least(50D, -b * x))) AS j0").selectExpr("own", "j0", "-a * x * j0 AS j1", "1D AS j2", "y - a * j0 - c AS r")
        sums = d.groupBy("own").agg(F.expr("sum(r * r) AS cost"), *(F.expr(f"sum(j{i} * j{k}) AS h{i}{k}") for i in range(3) for k in range(i, 3)), *(F.expr(f"sum(j{i} * r) AS g{i}") for i in range(3)))
        for r in sums.collect():
            g = r["own"]
            if g not in now or (math.isfinite(r["cost"]) and r["cost"] < now[g]["cost"]):
                small = g in now and now[g]["cost"] - r["cost"] <= 1e-13 * now[g]["cost"]
                found[g], now[g], damping[g] = step[g], r.asDict(), damping[g] / 10
            else:
                small, damping[g] = False, damping[g] * 10
            own = now[g]
            h = np.array([[own[f"h{min(i, k)}{max(i, k)}"] for k in range(3)] for i in range(3)])
            move = np.linalg.lstsq(h + damping[g] * np.diag(np.maximum(np.diag(h), 1e-12)), np.array([own[f"g{i}"] for i in range(3)]), rcond=None)[0]
            if small or damping[g] > GIVEN_UP or float(np.abs(move).max()) < 1e-12 * (1 + float(np.abs(found[g]).max())):
                del step[g]
            else:
                step[g] = found[g] + move
    return data.sparkSession.createDataFrame([(g, *(float(v) for v in p)) for g, p in found.items()], f"{by} {kind}, a double, b double, c double")


def principal_components(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(pc, variance, ratio, cumulative, loadings): of standardised columns. Spark aggregates the correlations in one
    pass; a matrix as wide as the columns is decomposed on the driver. The largest loading is made positive."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    found = rows.agg(*(F.corr(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    m = np.eye(len(columns))
    for i, j in pairs:
        m[i, j] = m[j, i] = 1.0 if i == j else (found[f"c{i}_{j}"] or 0.0)
    w, v = np.linalg.eigh(m)
    w, v = np.maximum(w[::-1], 0), v[:, ::-1]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(len(w))])
    ratio = w / w.sum()
    out = [(k + 1, float(w[k]), float(ratio[k]), float(ratio[: k + 1].sum()), [float(x) for x in v[:, k] * np.sqrt(w[k])]) for k in range(len(w))]
    return rows.sparkSession.createDataFrame(out, "pc int, variance double, ratio double, cumulative double, loadings array<double>")


def normal_plot(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, quantile): ordered values against normal quantiles at (i - 0.5) / n."""
    w = Window.partitionBy(by)
    p = (F.row_number().over(w.orderBy(value)) - 0.5) / F.count("*").over(w)
    return rows.select(by, value, normal_quantile_of(p).alias("quantile"))


def raster(points: DataFrame, side: int) -> DataFrame:
    """(i, j, z): mean height on a side x side raster over the bounds; i counts along y, j along x."""
    b = points.agg(*(f(a).alias(f"{a}{k}") for a in "xy" for k, f in ((0, F.min), (1, F.max))))
    at = lambda a: F.least(F.floor((F.col(a) - F.col(f"{a}0")) * side / F.nullif(F.col(f"{a}1") - F.col(f"{a}0"), F.lit(0.0))), F.lit(side - 1))
    return points.crossJoin(F.broadcast(b)).groupBy(at("y").alias("i"), at("x").alias("j")).agg(F.avg("z").alias("z"))


def slopes(grid: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """``grid(i, j, z)`` with slope and aspect in degrees and curvature: central differences, one-sided at edges."""
    def along(v: str, part: str, order: str, step: float):
        w = Window.partitionBy(part).orderBy(order)
        p, n = F.lag(v).over(w), F.lead(v).over(w)
        return F.coalesce((n - p) / (2 * step), (n - F.col(v)) / step, (F.col(v) - p) / step)

    g = grid.withColumn("zx", along("z", "i", "j", dx)).withColumn("zy", along("z", "j", "i", dy))
    g = g.withColumn("zxx", along("zx", "i", "j", dx)).withColumn("zyy", along("zy", "j", "i", dy))
    a = F.degrees(F.atan2("zy", "zx"))
    return g.select("i", "j", "z", F.degrees(F.atan(F.sqrt(F.col("zx") ** 2 + F.col("zy") ** 2))).alias("slope"), F.when(a < 0, a + 360).otherwise(a).alias("aspect"), (F.col("zxx") + F.col("zyy")).alias("curvature"))


def roughness(grid: DataFrame, side: int, size: int = 5) -> DataFrame:
    """(i, j, roughness): population deviation in a moving window, the edges reflected."""
    half = size // 2
    fold = lambda v: F.when(v < 0, -v - 1).when(v >= side, 2 * side - 1 - v).otherwise(v)
    o = F.array(*(F.lit(k) for k in range(-half, half + 1)))
    w = grid.select("i", "j", F.explode(o).alias("di"), F.lit(0).alias("_")).select("i", "j", "di", F.explode(o).alias("dj"))
    w = w.select("i", "j", fold(F.col("i") + F.col("di")).alias("ni"), fold(F.col("j") + F.col("dj")).alias("nj"))
    return w.join(grid.select(F.col("i").alias("ni"), F.col("j").alias("nj"), "z"), ["ni", "nj"]).groupBy("i", "j").agg(F.stddev_pop("z").alias("roughness"))


def surface_stats(grid: DataFrame) -> DataFrame:
    """Ranges and moments of height, slope and curvature; missing values don't count."""
    s = slopes(grid)
    return s.agg(*(f(c).alias(f"{c}_{n}") for c in ("z", "slope", "curvature") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))))
