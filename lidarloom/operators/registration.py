"""Rigid registration of grid cells: methods by name, each a composition of Spark jobs over all selected cells at once.

Both strips are thinned to voxel averages first. A method takes its start from the identity or from matches of point
features (``matching``), and iterated closest points (``icp``) refine it. No task ever holds a cell; the driver holds a
matrix for each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidarloom.functions.geometry import affine
from lidarloom.operators import icp, matching, spatial
from lidarloom.sources import scratch

RESULT = "grid_id long, transformation array<double>, fitness double, rmse double, mae double, n_corr long, success boolean, error string"
AXES, CELL = ("x", "y", "z"), ("grid_id",)

Starts = Callable[[DataFrame], dict[int, np.ndarray]]


@dataclass(frozen=True)
class Method:
    """A refinement within ``reach``, to planes whose normals come from ``normal`` around a point, or to points; and the
    start from matches of features within ``feature`` around a point, if there is one."""

    reach: float
    rounds: int
    normal: float | None = None
    cauchy: float | None = None
    start: Starts | None = None
    feature: float = 2.5
    mutual: bool = True
    most: int = 20_000


def by_samples(pairs: DataFrame) -> dict[int, np.ndarray]:
    """The best of random samples, solved once more over its inliers."""
    best = {r["grid_id"]: np.reshape(r["transformation"], (4, 4)) for r in matching.ransac(pairs, 0.5).collect()}
    inliers = matching.under(pairs, {g: (m, 0.0) for g, m in best.items()}).where("r2 < 0.25") if best else pairs.limit(0)
    return best | matching.squares(inliers)


#: ``ndt`` is named after distributions, but point to point with a wide reach, as its callers expect. Turbo registration
#: needs an external GPU binary and is not offered.
METHODS: dict[str, Method] = {
    "p2plane": Method(0.8, 200, normal=1.5, cauchy=2.0),
    "p2point": Method(0.8, 200),
    "ndt": Method(2.0, 50),
    "ransac": Method(0.5, 100, normal=1.0, start=by_samples),
    "fgr": Method(0.5, 100, normal=1.0, start=lambda p: matching.graduated(p, 0.5, False), mutual=False),
    "teaser": Method(0.5, 100, normal=1.0, start=lambda p: matching.graduated(p, 0.1, True)),
    "mac": Method(0.5, 100, normal=1.0, start=matching.best_clique, mutual=False, most=10_000),
}


def identified(cells: DataFrame) -> DataFrame:
    """``cells(strip, grid_id, x, y, z)`` with a row number ``pid`` that stays, since the table is written down: equal
    points are rows of their own."""
    return scratch.written(cells.select("strip", "grid_id", *AXES).withColumn("pid", F.monotonically_increasing_id()))


def as_source(points: DataFrame) -> DataFrame:
    return points.select("grid_id", F.col("pid").alias("sid"), *AXES)


def as_target(points: DataFrame, *more: str) -> DataFrame:
    return points.select("grid_id", F.col("pid").alias("tid"), *(F.col(a).alias(f"t{a}") for a in AXES), *more)


def align(source: DataFrame, target: DataFrame, method: Method) -> dict[int, icp.Fit]:
    """The transform of each cell of ``source(grid_id, pid, x, y, z)`` that ``target`` has as well."""
    aimed, start = target, None
    if method.normal:
        planes = lambda points: scratch.written(points.join(spatial.normals(points, method.normal, 30, CELL).select("pid", "nx", "ny", "nz"), "pid"))
        aimed = planes(target)
        if method.start:
            turned = planes(source)
            features = [spatial.fpfh(p, method.feature, CELL) for p in (turned, aimed)]
            start = method.start(matching.feature_pairs(turned, aimed, *features, method.mutual, method.most))
    more = icp.NORMAL if method.normal else ()
    return icp.icp(as_source(source), as_target(aimed, *more), method.reach, method.rounds, start, bool(method.normal), method.cauchy)


def register(cells: DataFrame, first: str, second: str, method: str = "p2plane", voxel: float = 0.5, inlier: float = 0.8) -> DataFrame:
    """One result row per cell of ``cells(strip, grid_id, x, y, z)`` that both strips have. Fitness, errors and n_corr are
    of the first strip's voxel averages whose nearest of the second, once moved, is within ``inlier``. A cell without
    any has no success, the identity and infinite errors."""
    c = F.col
    small = identified(spatial.voxel_down(cells, voxel, ["strip", "grid_id"]))
    pick = lambda strip, other: small.where(c("strip") == strip).join(small.where(c("strip") == other).select("grid_id").distinct(), "grid_id", "left_semi").select("grid_id", "pid", *AXES)
    source, target = scratch.written(pick(first, second)), scratch.written(pick(second, first))
    found = align(source, target, METHODS[method])
    if not found:
        return small.sparkSession.createDataFrame([], RESULT)
    fits = small.sparkSession.createDataFrame([(int(g), [float(v) for v in f.matrix.ravel()]) for g, f in sorted(found.items())], "grid_id long, transformation array<double>")
    at = icp.moved(as_source(source), [(g, f.matrix, 0.0, 0.0, 0.0) for g, f in sorted(found.items())])
    d = F.sqrt("d2")
    near = icp.closest(at, icp.filed(as_target(target), inlier), inlier).groupBy("grid_id").agg(F.count("*").alias("n_corr"), F.sqrt(F.avg("d2")).alias("rmse"), F.avg(d).alias("mae"))
    n = source.groupBy("grid_id").agg(F.count("*").alias("n"))
    good, never = c("n_corr").isNotNull(), F.lit(float("inf"))
    eye = F.array(*(F.lit(float(i % 5 == 0)) for i in range(16)))
    return fits.join(n, "grid_id").join(near, "grid_id", "left").select(
        "grid_id", F.when(good, c("transformation")).otherwise(eye).alias("transformation"), F.coalesce(c("n_corr") / c("n"), F.lit(0.0)).alias("fitness"), F.coalesce("rmse", never).alias("rmse"), F.coalesce("mae", never).alias("mae"),
        F.coalesce("n_corr", F.lit(0).cast("long")).alias("n_corr"), good.alias("success"), F.when(~good, "no correspondences").alias("error"),
    )


def correspondences(cells: DataFrame, results: DataFrame, first: str, second: str, radius: float = 0.8) -> DataFrame:
    """(grid_id, sx..tz): each source point of the ``first`` strip with the nearest target of its own cell strictly
    within ``radius`` of where its cell's transform moves it. One row a source point at most, equal points included."""
    c = F.col
    points = identified(cells)
    t = F.broadcast(results.where("success").select("grid_id", c("transformation").alias("m")))
    own = points.where(c("strip") == first).join(t, "grid_id")
    x, y, z = affine(c("x"), c("y"), c("z"), [c("m")[i] for i in range(16)])
    source = own.select("grid_id", c("pid").alias("sid"), x.alias("x"), y.alias("y"), z.alias("z"), c("x").alias("sx"), c("y").alias("sy"), c("z").alias("sz"))
    target = as_target(points.where(c("strip") == second))
    return icp.nearest(source, target, radius).select("grid_id", *(c(v).cast("float").alias(v) for v in ("sx", "sy", "sz", "tx", "ty", "tz")))
