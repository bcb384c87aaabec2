"""Overlap, grid, per-cell features, scores and selection of two strips.

All but the ranges and the counts of bins is one lazy plan: one-row frames (overlap, grid, ranges) are cross-joined to the points by broadcast, the
cells are plain hash aggregates that combine on the map side, and the selection is a window over the few cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lidarloom.functions.geometry import grid_id
from lidarloom.functions.statistics import quantiles_by
from lidarloom.sources import scratch

AXES = ("x", "y", "z")


def bounds(points: DataFrame, by: str = "strip") -> DataFrame:
    """One row per strip: n_points and min/max of every axis."""
    return points.groupBy(by).agg(F.count("*").alias("n_points"), *(f(a).alias(f"{a}_{n}") for a in AXES for n, f in (("min", F.min), ("max", F.max))))


def overlap(strip_bounds: DataFrame, buffer: float = 10.0) -> DataFrame:
    """One row, or none where the strips don't overlap: buffered bounds, size, area and the centre offset. x and y are
    centred on the intersection, z on the union of the ranges."""
    b = strip_bounds.agg(*(f(c).alias(n) for n, f, c in (
        ("ox0", F.max, "x_min"), ("ox1", F.min, "x_max"), ("oy0", F.max, "y_min"), ("oy1", F.min, "y_max"), ("z0", F.min, "z_min"), ("z1", F.max, "z_max"), ("n_strips", F.count, "x_min"),
    ))).where("n_strips >= 2 AND ox0 < ox1 AND oy0 < oy1")
    c = F.col
    return b.select(
        (c("ox0") - buffer).alias("x_min"), (c("ox1") + buffer).alias("x_max"), (c("oy0") - buffer).alias("y_min"), (c("oy1") + buffer).alias("y_max"),
        (c("ox1") - c("ox0") + 2 * buffer).alias("width"), (c("oy1") - c("oy0") + 2 * buffer).alias("height"),
        ((c("ox1") - c("ox0")) * (c("oy1") - c("oy0"))).alias("original_area"),
        ((c("ox0") + c("ox1")) / 2).alias("cx"), ((c("oy0") + c("oy1")) / 2).alias("cy"), ((c("z0") + c("z1")) / 2).alias("cz"),
    ).withColumn("area", c("width") * c("height"))


def grid(over: DataFrame, rows: int, cols: int) -> DataFrame:
    """The grid over the decentred overlap, one row with the edges as arrays."""
    c = F.col
    g = over.select((c("x_min") - c("cx")).alias("gx0"), (c("x_max") - c("cx")).alias("gx1"), (c("y_min") - c("cy")).alias("gy0"), (c("y_max") - c("cy")).alias("gy1"), "cx", "cy", "cz", "x_min", "x_max", "y_min", "y_max")
    g = g.select("*", ((c("gx1") - c("gx0")) / cols).alias("cell_width"), ((c("gy1") - c("gy0")) / rows).alias("cell_height"))
    edges = lambda lo, step, n: F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: c(lo) + i * c(step))
    return g.select("*", (c("cell_width") * c("cell_height")).alias("cell_area"), F.lit(rows * cols).alias("total_cells"), edges("gx0", "cell_width", cols).alias("x_edges"), edges("gy0", "cell_height", rows).alias("y_edges"))


def assign(points: DataFrame, over: DataFrame, rows: int, cols: int) -> DataFrame:
    """Points inside the overlap (edges included), decentred, with their cell."""
    g = F.broadcast(grid(over, rows, cols).select("gx0", "gy0", "cell_width", "cell_height", "cx", "cy", "cz", "x_min", "x_max", "y_min", "y_max"))
    c = F.col
    inside = points.crossJoin(g).where(c("x").between(c("x_min"), c("x_max")) & c("y").between(c("y_min"), c("y_max")))
    moved = inside.select(*(x for x in points.columns if x not in AXES), (c("x") - c("cx")).alias("x"), (c("y") - c("cy")).alias("y"), (c("z") - c("cz")).alias("z"), "gx0", "gy0", "cell_width", "cell_height")
    return moved.withColumn("grid_id", grid_id(c("x"), c("y"), (c("gx0"), c("gy0")), (c("cell_width"), c("cell_height")), rows, cols)).drop("gx0", "gy0", "cell_width", "cell_height")


def ranges(cells: DataFrame, z_pct: tuple[float, float], i_pct: tuple[float, float]) -> DataFrame:
    """One row: percentile ranges (in percent) of z and intensity over both strips; exact and interpolated."""
    found = quantiles_by(cells, {"z": [p / 100 for p in z_pct], "intensity": [p / 100 for p in i_pct]})
    row = [v for name in ("z", "intensity") for v in found.get((None, name), [None, None])]
    return cells.sparkSession.createDataFrame([tuple(row)], "z_lo double, z_hi double, i_lo double, i_hi double")


def bin_of(v: Column, lo: Column, hi: Column, n: int) -> Column:
    """Equal-width bin from 0; the last bin is closed; values outside get null, as they are dropped."""
    return F.when((v >= lo) & (v <= hi) & (hi > lo), F.least(F.floor((v - lo) * n / F.nullif(hi - lo, F.lit(0.0))), F.lit(n - 1)))


def stats(cells: DataFrame) -> DataFrame:
    """Moments and ranges of each strip's cells (population deviations)."""
    return cells.groupBy("strip", "grid_id").agg(
        F.count("*").alias("n_points"), F.avg("z").alias("z_mean"), F.stddev_pop("z").alias("z_std"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), (F.max("z") - F.min("z")).alias("z_range"),
        F.avg("intensity").alias("intensity_mean"), F.stddev_pop("intensity").alias("intensity_std"), F.min("intensity").alias("intensity_min"), F.max("intensity").alias("intensity_max"),
    )


def entropies(cells: DataFrame, rng: DataFrame, z_bins: int, i_bins: int, alpha: float) -> DataFrame:
    """Smoothed entropies and mutual information of each strip's cells, natural logarithm.

    Only filled joint bins are shuffled; what the smoothing adds to empty bins is added in closed form. A smoothed
    marginal is the sum over filled bins plus (bins - filled) equal terms; of the joint's sum of p ln p / (q r) the
    empty bins give the constant a = alpha / total times (ln a - ln q_i - ln r_j), which sums from the marginals alone.
    """
    c = F.col
    binned = cells.crossJoin(F.broadcast(rng)).select("strip", "grid_id", bin_of(c("z"), c("z_lo"), c("z_hi"), z_bins).alias("zb"), bin_of(c("intensity"), c("i_lo"), c("i_hi"), i_bins).alias("ib"))
    # at most a row per bin of a cell: written once, since four branches start from it and would each read all points
    joint = scratch.written(binned.groupBy("strip", "grid_id", "zb", "ib").agg(F.count("*").alias("n")))
    key = ["strip", "grid_id"]

    def marginal(col: str, bins: int, p: str) -> DataFrame:
        m = joint.groupBy(*key, col).agg(F.sum("n").alias("n"))
        tot = m.groupBy(*key).agg(F.sum(F.when(c(col).isNotNull(), c("n")).otherwise(0)).alias("n_in"), F.count(col).alias("filled"), F.sum(F.when(c(col).isNotNull(), (c("n") + alpha) * F.log(c("n") + alpha))).alias("t"), F.sum(F.when(c(col).isNotNull(), F.log(c("n") + alpha))).alias("sl"))
        total = c("n_in") + alpha * bins
        empty = bins - c("filled")
        t = F.coalesce("t", F.lit(0.0)) + empty * alpha * F.log(F.lit(alpha))
        log_sum = F.coalesce("sl", F.lit(0.0)) + empty * F.log(F.lit(alpha)) - bins * F.log(total)
        return tot.select(*key, total.alias(f"{p}_total"), (F.log(total) - t / total).alias(f"{p}_entropy"), log_sum.alias(f"{p}_logs"))

    zm, im = marginal("zb", z_bins, "z"), marginal("ib", i_bins, "i")
    zc = joint.where("zb IS NOT NULL").groupBy(*key, "zb").agg(F.sum("n").alias("zn"))
    ic = joint.where("ib IS NOT NULL").groupBy(*key, "ib").agg(F.sum("n").alias("in_"))
    full = joint.where("zb IS NOT NULL AND ib IS NOT NULL")
    lit = F.log(F.lit(alpha))
    # over filled joint bins: n ln(n + alpha) + alpha (ln(n + alpha) - ln alpha), and the marginal logs weighted by n
    part = full.join(zc, [*key, "zb"]).join(ic, [*key, "ib"]).groupBy(*key).agg(
        F.sum("n").alias("jn"), F.sum((c("n") + alpha) * F.log(c("n") + alpha) - alpha * lit).alias("jt"), F.sum(c("n") * (F.log(c("zn") + alpha) + F.log(c("in_") + alpha))).alias("jm")
    )
    both = zm.join(im, key).join(part, key, "left")
    jn = F.coalesce("jn", F.lit(0))
    total = jn + alpha * z_bins * i_bins
    plogp = (F.coalesce("jt", F.lit(0.0)) + alpha * z_bins * i_bins * lit) / total - F.log(total)
    cross = (F.coalesce("jm", F.lit(0.0)) - jn * (F.log("z_total") + F.log("i_total")) + alpha * (i_bins * c("z_logs") + z_bins * c("i_logs"))) / total
    mi = plogp - cross
    h = c("z_entropy") + c("i_entropy")
    return both.select(
        *key, "z_entropy", c("i_entropy").alias("intensity_entropy"), mi.alias("mutual_information"), F.when(h > 0, 2 * mi / h).otherwise(0.0).alias("normalized_mutual_information"),
        (c("z_entropy") / F.log(F.lit(float(z_bins)))).alias("z_entropy_norm"), (c("i_entropy") / F.log(F.lit(float(i_bins)))).alias("intensity_entropy_norm"),
    )


def scores(features: DataFrame, first: str, second: str, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Joint scores of the cells that both strips have. One pass: the strips are pivoted by conditional aggregates, so
    the two sides are never joined."""
    c = F.col
    pick = lambda s, v: F.max(F.when(c("strip") == s, c(v)))
    names = (("n_points", "points"), ("z_entropy_norm", "z_entropy_norm"), ("intensity_entropy_norm", "intensity_entropy_norm"), ("normalized_mutual_information", "nmi"))
    wide = features.groupBy("grid_id").agg(*(pick(s, v).alias(f"strip{k}_{n}") for k, s in ((1, first), (2, second)) for v, n in names)).where("strip1_points > 0 AND strip2_points > 0")
    wa, wb, wc = (F.lit(w) for w in weights)
    n1, n2 = c("strip1_points"), c("strip2_points")
    h = wa * (c("strip1_z_entropy_norm") + c("strip2_z_entropy_norm")) / 2
    i = wb * (c("strip1_intensity_entropy_norm") + c("strip2_intensity_entropy_norm")) / 2
    m = wc * (c("strip1_nmi") + c("strip2_nmi")) / 2
    balance = 2.0 * F.least(n1, n2) / (n1 + n2)
    return wide.select("*", (n1 + n2).alias("total_points"), (h + i + m).alias("raw_score"), balance.alias("density_balance_factor"), (balance * (h + i + m)).alias("composite_score"), h.alias("height_entropy_contribution"), i.alias("intensity_entropy_contribution"), m.alias("mutual_info_contribution"))


def selection_sizes(scored: DataFrame, min_regions: int = 3, col: str = "composite_score") -> DataFrame:
    """One row: n and the lengths k_elbow, k_threshold, k_gap of the prefixes that the three rules select.

    Runs over one row per cell, so a single ordered window is small by construction (rows x cols of the grid).
    """
    c = F.col
    w = Window.orderBy(F.desc("s"), "grid_id")
    r = scored.select("grid_id", c(col).alias("s")).withColumn("rank", F.row_number().over(w)).withColumn("prev", F.lag("s").over(w)).withColumn("next", F.lead("s").over(w))
    every = Window.partitionBy()
    r = r.withColumn("n", F.count("*").over(every)).withColumn("span", F.max("s").over(every) - F.min("s").over(every) + 1e-8).withColumn("top", F.max("s").over(every))
    r = r.withColumn("curv", F.when(c("prev").isNotNull() & c("next").isNotNull(), F.abs(c("prev") - 2 * c("s") + c("next")) / c("span")).otherwise(0.0)).withColumn("drop", c("next") - c("s"))
    r = r.withColumn("height", F.stddev_pop("curv").over(every) * 0.5).withColumn("gap", F.abs(F.avg("drop").over(every)) + F.stddev_pop("drop").over(every))
    # peaks: plateaus of equal curvature, both neighbours lower; a plateau's peak is its middle, rounded down
    o = Window.orderBy("rank")
    r = r.withColumn("island", F.sum(F.when(F.lag("curv").over(o).eqNullSafe(c("curv")), 0).otherwise(1)).over(o))
    isl = Window.partitionBy("island")
    r = r.withColumn("first", F.min("rank").over(isl)).withColumn("last", F.max("rank").over(isl))
    flat = r.select("island", "first", "last", "curv", "height", "n").distinct()
    oi = Window.orderBy("island")
    flat = flat.withColumn("before", F.lag("curv").over(oi)).withColumn("after", F.lead("curv").over(oi))
    peak = flat.where("before < curv AND after < curv AND curv >= height").agg(F.min(F.floor((c("first") + c("last")) / 2) - 1).alias("peak"))
    lead = r.agg(F.max("n").alias("n"), F.count_if(c("s") >= 0.8 * c("top")).alias("k_threshold"), F.min(F.when(F.abs(c("drop")) > c("gap"), c("rank"))).alias("gap_at")).crossJoin(peak)
    n = c("n")
    few = lambda k: F.least(k, n)
    elbow = F.when(n < 3, n).when(c("peak").isNull(), few(F.greatest(F.lit(min_regions), F.floor(n * 0.3)))).otherwise(few(F.greatest(c("peak"), F.lit(min_regions))))
    gap = F.when(n < 2, n).when(c("gap_at").isNull(), few(F.greatest(F.lit(min_regions), F.floor(n / 4)))).otherwise(few(F.greatest(c("gap_at"), F.lit(min_regions))))
    return lead.select("n", elbow.cast("long").alias("k_elbow"), "k_threshold", gap.cast("long").alias("k_gap"))


def valid_cells(scored: DataFrame, min_score: float, min_valid: int, fallback: bool = True) -> DataFrame:
    """Cells that reach the score. Fewer than ``min_valid`` of them: none with ``fallback``; without it the valid ones,
    or all where none is valid."""
    c = F.col
    n = F.count_if(c("composite_score") >= min_score).over(Window.partitionBy())
    marked = scored.withColumn("n_valid", n)
    good = c("composite_score") >= min_score
    keep = (good & (c("n_valid") >= min_valid)) if fallback else (good | (c("n_valid") == 0))
    return marked.where(keep).drop("n_valid")


def select(scored: DataFrame, min_score: float = 0.01, min_valid: int = 1, min_regions: int = 3, max_regions: int = 8, fallback: bool = True) -> DataFrame:
    """The selected cells with ``selection_rank``: all three rules select prefixes of the descending order, so their
    union is the longest, held between the limits. Ties go by cell number."""
    c = F.col
    # a row per cell of the grid: kept, since the rules and the ranking all start from it
    valid = valid_cells(scored, min_score, min_valid, fallback).persist()
    k = selection_sizes(valid, min_regions).select(F.least(F.greatest("k_elbow", "k_threshold", "k_gap", F.lit(min_regions)), F.lit(max_regions)).alias("k"))
    ranked = valid.withColumn("selection_rank", F.row_number().over(Window.orderBy(F.desc("composite_score"), "grid_id")) - 1)
    return ranked.crossJoin(F.broadcast(k)).where(c("selection_rank") < c("k")).drop("k")
