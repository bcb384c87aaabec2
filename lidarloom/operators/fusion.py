"""Robust filtering and fusion of the cells' transforms, and metrics over correspondences. The regions are at most one
row per selected cell; correspondences may be any number and are only ever aggregated."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lidarloom.functions.geometry import affine, dist3d
from lidarloom.functions.statistics import quantiles
from lidarloom.sources import scratch

#: component, limit, least MAD: fixed values of the first pass; the second relaxes x and y and drops the angles.
FIRST = (("tx", 1.0, 0.5), ("ty", 1.0, None), ("tz", 2.0, 0.2), ("pitch", 2.0, None), ("roll", 2.0, None), ("yaw", 2.0, None))
SECOND = (("tx", 1.5, 0.5), ("ty", 1.5, None), ("tz", 2.0, 0.2))


def mad_outlier(v: str, limit: float, floor: float | None) -> Column:
    """Is ``v`` further from its median than ``limit`` MADs? Needs the columns med_<v> and mad_<v>."""
    mad = F.col(f"mad_{v}") if floor is None else F.greatest(F.col(f"mad_{v}"), F.lit(floor))
    return F.when(mad < 1e-10, F.lit(False)).otherwise(F.abs(F.col(v) - F.col(f"med_{v}")) / mad > limit)


def with_mads(regions: DataFrame, names: tuple[str, ...]) -> DataFrame:
    med = F.broadcast(regions.agg(*(F.median(v).alias(f"med_{v}") for v in names)))
    off = regions.crossJoin(med)
    mad = F.broadcast(off.agg(*(F.median(F.abs(F.col(v) - F.col(f"med_{v}"))).alias(f"mad_{v}") for v in names)))
    return off.crossJoin(mad)


def mad_filter(regions: DataFrame) -> DataFrame:
    """Regions whose transform agrees with the others: six tests at first; relaxed ones if fewer than two stay; the
    fittest half (three at least) if none stays. One or two regions pass unseen."""
    names = tuple(v for v, _, _ in FIRST)
    every = Window.partitionBy()
    r = with_mads(regions, names)
    any_ = lambda tests: F.greatest(*(mad_outlier(*t).cast("int") for t in tests)) == 1
    r = r.withColumn("n", F.count("*").over(every)).withColumn("ok1", ~any_(FIRST)).withColumn("ok2", ~any_(SECOND))
    r = r.withColumn("n1", F.count_if("ok1").over(every)).withColumn("n2", F.count_if("ok2").over(every)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("fitness"), "grid_id")))
    keep = F.when(F.col("n") <= 2, True).when(F.col("n1") >= 2, F.col("ok1")).when(F.col("n2") >= 1, F.col("ok2")).otherwise(F.col("place") <= F.greatest(F.lit(3), F.floor(F.col("n") / 2)))
    return r.where(keep).select(*regions.columns)


NAMES = tuple(v for v, _, _ in FIRST)
#: Candidates for the medoid whose distances to all are summed in the first round, and in any round at most.
TRIED, MOST_TRIED = 16, 1024


def mad_scaled(regions: DataFrame) -> DataFrame:
    """(grid_id, six components) in units of the components' MADs."""
    return with_mads(regions, NAMES).select("grid_id", *((F.col(v) / F.greatest(F.col(f"mad_{v}"), F.lit(1e-6))).alias(v) for v in NAMES))


def apart(other: str) -> Column:
    """The distance between the components and those called ``other`` and a name."""
    return F.sqrt(sum(((F.col(v) - F.col(f"{other}{v}")) ** 2 for v in NAMES), F.lit(0.0)))


def medoid(scaled: DataFrame) -> tuple[int, float] | None:
    """(grid_id, summed distance) of the row of ``scaled(grid_id, components)`` that is nearest to all others by the sum
    of distances; ties go to the least grid_id. None without rows.

    If the distances of p sum to E(p), those of a row x among n sum to at least |E(p) - n d(x, p)|, by the triangle
    inequality. A round sums the distances of the few rows of the least bounds, which are broadcast, in one pass; they
    bound all others; rows whose bound lies above the best sum can't be the medoid and are left out. At worst all rows
    are tried, ``TRIED`` at first and twice as many each round; as a rule those near the middle are."""
    n = scaled.count()
    if not n:
        return None
    # equal rows have equal sums: the one of the least grid_id stands for them as a candidate
    places, tries = scaled.groupBy(*NAMES).agg(F.min("grid_id").alias("grid_id")), TRIED
    middle = scaled.agg(*(F.median(v).alias(f"o_{v}") for v in NAMES))
    left = scratch.written(places.crossJoin(F.broadcast(middle)).select("grid_id", *NAMES, F.lit(0.0).alias("bound"), apart("o_").alias("near")))
    best: tuple[float, int] = (math.inf, -1)
    while True:
        tried = left.orderBy("bound", "near", "grid_id").limit(tries).collect()
        tries = min(2 * tries, MOST_TRIED)
        if not tried:
            return best[1], best[0]
        pivots = F.broadcast(scaled.sparkSession.createDataFrame([(r["grid_id"], *(r[v] for v in NAMES)) for r in tried], f"o long, {', '.join(f'o_{v} double' for v in NAMES)}"))
        sums = {r["o"]: r["total"] for r in scaled.join(pivots, F.lit(True)).groupBy("o").agg(F.sum(apart("o_")).alias("total")).collect()}
        best = min(best, min((round(t, 9), g) for g, t in sums.items()))
        with_sums = F.broadcast(scaled.sparkSession.createDataFrame([(r["grid_id"], *(r[v] for v in NAMES), sums[r["grid_id"]]) for r in tried], f"o long, {', '.join(f'o_{v} double' for v in NAMES)}, total double"))
        at = left.where(~F.col("grid_id").isin([r["grid_id"] for r in tried])).join(with_sums, F.lit(True))
        bounds = at.groupBy("grid_id", *NAMES, "bound", "near").agg(F.max(F.abs(F.col("total") - n * apart("o_"))).alias("new"))
        left = scratch.written(bounds.select("grid_id", *NAMES, F.greatest("bound", "new").alias("bound"), "near").where(F.col("bound") <= best[0] + 1e-6))


def medoid_filter(regions: DataFrame, k: float = 2.5) -> DataFrame:
    """Regions within median + k MAD of the medoid, in MAD-scaled components. Repeated grid_ids are rows of their own,
    but one of them stands for all as a medoid."""
    scaled = scratch.written(mad_scaled(regions))
    found = medoid(scaled.dropDuplicates(["grid_id"]))
    if found is None:
        return scaled.select("grid_id", F.lit(0.0).alias("d"))
    m = F.broadcast(scaled.where(F.col("grid_id") == found[0]).dropDuplicates(["grid_id"]).select(*(F.col(v).alias(f"m_{v}") for v in NAMES)))
    d = scaled.crossJoin(m).select("grid_id", apart("m_").alias("d"))
    med = F.broadcast(d.agg(F.median("d").alias("med")))
    dev = d.crossJoin(med)
    mad = F.broadcast(dev.agg(F.median(F.abs(F.col("d") - F.col("med"))).alias("mad")))
    return dev.crossJoin(mad).where(F.col("d") <= F.col("med") + k * F.col("mad")).select("grid_id", "d")


def weights(regions: DataFrame) -> DataFrame:
    """``regions`` with weights that sum to one: inverse to n_corr * rmse^2, zero where that is zero."""
    w = F.coalesce(1 / F.nullif(F.col("n_corr") * F.col("rmse") * F.col("rmse"), F.lit(0.0)), F.lit(0.0))
    return regions.withColumn("w", w).withColumn("weight", F.try_divide("w", F.sum("w").over(Window.partitionBy()))).drop("w")


def fuse(regions: DataFrame, least_fitness: float = 0.3, fallback: bool = True) -> DataFrame:
    """One row: method, n_regions, confidence, composite_confidence and the fused translation and rotation angles.

    No region: identity (or nothing without ``fallback``). Up to two: the one of least rmse, whatever its fitness.
    Otherwise those that are fit and agree, one alone or their weighted mean. Small angles are averaged as vectors.
    """
    parts = ("tx", "ty", "tz", "pitch", "roll", "yaw")
    n_all = F.broadcast(regions.agg(F.count("*").alias("n_all")))
    few = regions.crossJoin(n_all).where("n_all <= 2").withColumn("place", F.row_number().over(Window.orderBy("rmse", "grid_id"))).where("place = 1")
    fit = mad_filter(regions.where(F.col("fitness") >= least_fitness)).crossJoin(n_all).where("n_all > 2")
    joined = weights(fit.drop("n_all")).agg(F.count("*").alias("n_regions"), *(F.sum(F.col("weight") * F.col(v)).alias(v) for v in ("fitness", "composite_score", *parts)))
    one = few.select(F.lit("min_rmse_region").alias("method"), F.lit(1).cast("long").alias("n_regions"), F.col("fitness").alias("confidence"), F.col("composite_score").alias("composite_confidence"), *parts)
    many = joined.where("n_regions > 0").select(F.when(F.col("n_regions") == 1, "single_valid_region").otherwise("composite_score_weighted").alias("method"), "n_regions", F.col("fitness").alias("confidence"), F.col("composite_score").alias("composite_confidence"), *parts)
    found = one.unionByName(many)
    if not fallback:
        return found
    got = F.broadcast(found.agg(F.count("*").alias("got")))
    none = n_all.crossJoin(got).where("got = 0").select(F.when(F.col("n_all") == 0, "no_valid_registration").otherwise("low_fitness").alias("method"), F.lit(0).cast("long").alias("n_regions"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("composite_confidence"), *(F.lit(0.0).alias(v) for v in parts))
    return found.unionByName(none)


def rotation_log(m: list[Column]) -> list[Column]:
    """The rotation vector of a row-major rotation matrix; a half turn takes its axis from the diagonal."""
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (m[0] + m[4] + m[8] - 1) / 2))
    angle = F.acos(cos)
    k = F.when(angle < 1e-8, F.lit(0.5)).otherwise(angle / (2 * F.sin(angle)))
    plain = [k * (m[7] - m[5]), k * (m[2] - m[6]), k * (m[3] - m[1])]
    size = [F.sqrt(F.greatest((m[4 * i] + 1) / 2, F.lit(0.0))) for i in range(3)]
    # signs of the axis follow the first component that isn't zero
    sign = [F.lit(1.0), F.when(size[0] > 1e-6, F.signum(m[1] + m[3])).otherwise(1.0), F.when(size[0] > 1e-6, F.signum(m[2] + m[6])).otherwise(F.when(size[1] > 1e-6, F.signum(m[5] + m[7])).otherwise(1.0))]
    return [F.when(cos < -1 + 1e-10, angle * size[i] * sign[i]).otherwise(plain[i]) for i in range(3)]


def rotation_exp(w: list[Column]) -> list[Column]:
    """The row-major rotation matrix of a rotation vector. It is orthogonal to rounding, so nothing needs to be mended."""
    x, y, z = w
    angle = F.sqrt(x * x + y * y + z * z)
    a = F.when(angle < 1e-8, F.lit(1.0)).otherwise(F.sin(angle) / angle)
    b = F.when(angle < 1e-8, F.lit(0.5)).otherwise((1 - F.cos(angle)) / (angle * angle))
    c = F.cos(angle)
    return [c + b * x * x, b * x * y - a * z, b * x * z + a * y, b * x * y + a * z, c + b * y * y, b * y * z - a * x, b * x * z - a * y, b * y * z + a * x, c + b * z * z]


def average(regions: DataFrame, rotation: list[Column]) -> DataFrame:
    """One row m0..m15: the mean transform of ``regions(weight, tx, ty, tz)`` by the logarithms of their rotations."""
    w = rotation_log(rotation)
    mean = regions.agg(*(F.sum(F.col("weight") * v).alias(f"w{a}") for a, v in zip("xyz", w, strict=True)), *(F.sum(F.col("weight") * F.col(f"t{a}")).alias(f"t{a}") for a in "xyz"))
    r = rotation_exp([F.col(f"w{a}") for a in "xyz"])
    rows = [*r[0:3], F.col("tx"), *r[3:6], F.col("ty"), *r[6:9], F.col("tz"), *(F.lit(float(v)) for v in (0, 0, 0, 1))]
    return mean.select(*(v.alias(f"m{i}") for i, v in enumerate(rows)))


def regions_of(results: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """What ``mad_filter`` and ``weights`` read of registration results: translation, angles, matrix r0..r8 and the
    cell's ``composite_score`` (of ``scores``, else 1)."""
    from lidarloom.functions.geometry import euler_xyz

    m = [F.col("transformation")[i] for i in range(16)]
    r = [m[i] for i in (0, 1, 2, 4, 5, 6, 8, 9, 10)]
    pitch, roll, yaw = euler_xyz(r)
    out = results.where("success").select("grid_id", "n_corr", "fitness", "rmse", m[3].alias("tx"), m[7].alias("ty"), m[11].alias("tz"), pitch.alias("pitch"), roll.alias("roll"), yaw.alias("yaw"), *(v.alias(f"r{i}") for i, v in enumerate(r)))
    return out.withColumn("composite_score", F.lit(1.0)) if scores is None else out.join(scores.select("grid_id", "composite_score"), "grid_id")


def fuse_transforms(regions: DataFrame, least_fitness: float = 0.3) -> DataFrame:
    """One row: n_regions and the fused matrix m0..m15 of ``regions_of``. The fit regions that agree are averaged on the
    rotation group; with two regions or fewer, the one of least rmse stands for all; without any, the identity."""
    n = regions.count()
    if n <= 2:
        chosen = regions.withColumn("place", F.row_number().over(Window.orderBy("rmse", "grid_id"))).where("place = 1").withColumn("weight", F.lit(1.0))
    else:
        chosen = weights(mad_filter(regions.where(F.col("fitness") >= least_fitness)))
    count = chosen.agg(F.count("*").alias("n_regions"))
    mean = average(chosen, [F.col(f"r{i}") for i in range(9)])
    return count.crossJoin(mean).select("n_regions", *(F.coalesce(f"m{i}", F.lit(float(i % 5 == 0))).alias(f"m{i}") for i in range(16)))


def conjugate_offset(m: list[Column], offset: tuple[Column, Column, Column]) -> list[Column]:
    """A decentred transform in the original frame: the rotation stays, t' = t + o - R o."""
    out = list(m)
    for i in range(3):
        out[4 * i + 3] = m[4 * i + 3] + offset[i] - (m[4 * i] * offset[0] + m[4 * i + 1] * offset[1] + m[4 * i + 2] * offset[2])
    return out


def residuals(pairs: DataFrame, matrix: list[float]) -> DataFrame:
    """``pairs(sx..tz)`` with the moved source mx, my, mz and its distance d to the target."""
    c = F.col
    x, y, z = affine(c("sx"), c("sy"), c("sz"), matrix)
    return pairs.withColumns({"mx": x, "my": y, "mz": z}).withColumn("d", dist3d(c("mx") - c("tx"), c("my") - c("ty"), c("mz") - c("tz")))


def global_metrics(moved: DataFrame, inlier: float = 0.8, percent: float = 100.0) -> DataFrame:
    """One row of rmse, mae, fitness and counts; distances beyond the percentile are left out of rmse and mae."""
    d = F.col("d")
    kept = F.lit(True)
    if percent < 100:
        kept = d <= F.lit(quantiles(moved, "d", [percent / 100])[0]).cast("double")
    k = F.when(kept, d)
    return moved.agg(F.coalesce(F.sqrt(F.avg(k * k)), F.lit(0.0)).alias("global_rmse"), F.coalesce(F.avg(k), F.lit(0.0)).alias("global_mae"), F.coalesce(F.try_divide(F.count_if(d < inlier), F.count(d)), F.lit(0.0)).alias("global_fitness"), F.count("*").alias("total_correspondences"), F.count(k).alias("valid_correspondences"))


def error_summary(moved: DataFrame) -> DataFrame:
    d = F.col("d")
    pct = [50, 75, 90, 95, 99]
    p = quantiles(moved, "d", [x / 100 for x in pct])
    near = (0.5, 1.0, 2.0, 5.0)
    out = moved.agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("mae"), F.max(d).alias("max_error"), F.min(d).alias("min_error"), F.stddev_pop(d).alias("std_error"), F.count(d).alias("n"), *(F.count_if(d < t).alias(f"below_{i}") for i, t in enumerate(near)))
    return out.select("rmse", "mae", "max_error", "min_error", "std_error", *(F.lit(v).cast("double").alias(f"p{x}") for x, v in zip(pct, p, strict=True)), *(f"below_{i}" for i in range(len(near))), "n")
