"""Linkage, assignment, planes, intervals and densities of targets: small inputs by nature, plain DataFrame work."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidarloom.functions.statistics import t_quantile
from lidarloom.operators import spatial
from lidarloom.sources import scratch


def labels_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, label): the least id that links reach. Labels spread along the links and then jump to their label's own
    label, so rounds grow with the logarithm of a chain's length; each round is a table of its own."""
    both = scratch.written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    now = scratch.written(nodes.select("id", F.col("id").alias("label")))
    while True:
        heard = both.join(now.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("heard"))
        spread = scratch.written(now.join(heard, "id", "left").select("id", F.least("label", F.coalesce("heard", "label")).alias("label"), F.col("label").alias("was")))
        jump = spread.select(F.col("id").alias("label"), F.col("label").alias("next"))
        after = scratch.written(spread.join(jump, "label").select("id", F.col("next").alias("label"), "was"))
        now = after.select("id", "label")
        if after.where("label <> was").isEmpty():
            return now


def single_linkage(centres: DataFrame, limit: float) -> DataFrame:
    """(label, n, x, y, z): centres closer than ``limit`` merge, transitively; a merged centre is the plain mean."""
    own = centres.select(F.col("id").alias("pid"), "x", "y", "z")
    links = spatial.within(own, own, limit, strict=True).where("q < p").select(F.col("q").alias("a"), F.col("p").alias("b"))
    lab = labels_of(links, centres.select("id"))
    return centres.join(lab, "id").groupBy("label").agg(F.count("*").alias("n"), *(F.avg(v).alias(v) for v in "xyz"))


def convex_hull(points: DataFrame, by: str) -> DataFrame:
    """(by, place, x, y): the corners of each group's convex hull in the plane, counter-clockwise from the least (x, y).
    Each task sends on the corners of its own points only, of which the hull of all is made."""
    schema = f"{by} {dict(points.dtypes)[by]}, place int, x double, y double"

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = np.unique(pdf[["x", "y"]].dropna().to_numpy(float), axis=0)

        def half(rows: np.ndarray) -> list:
            out: list = []
            for p in rows:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out

        ring = xy if len(xy) < 3 else np.array(half(xy)[:-1] + half(xy[::-1])[:-1])
        return pd.DataFrame({by: pdf[by].iloc[0], "place": np.arange(len(ring), dtype=np.int32), "x": ring[:, 0], "y": ring[:, 1]})

    def parts(batches):
        for b in batches:
            for _, own in b.groupby(by, dropna=False):
                yield corners(own)

    return points.select(by, "x", "y").mapInPandas(parts, schema).groupBy(by).applyInPandas(corners, schema)


def mean_interval(df: DataFrame, by: str, col: str, level: float) -> DataFrame:
    """(by, n, mean, lower, upper): Student's interval of the mean. Quantiles are computed for the degrees of freedom
    that occur, one for each group."""
    s = df.groupBy(by).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"))

    @F.pandas_udf("double")
    def quantile(n: pd.Series) -> pd.Series:
        return n.map(lambda k: t_quantile((1 + level) / 2, k - 1) if k > 1 else np.nan)

    half = quantile("n") * F.col("sd") / F.sqrt("n")
    return s.select(by, "n", "mean", (F.col("mean") - half).alias("lower"), (F.col("mean") + half).alias("upper"))


#: Boxes of the density's expansion, in bandwidths, and the degree from which on it is cut.
BOX, DEGREE = 0.5, 12
TERMS = [(k, m) for k in range(DEGREE) for m in range(DEGREE - k)]


def hermite(t: np.ndarray) -> np.ndarray:
    """exp(-t^2 / 2) He_k(t) / k! for every k below ``DEGREE``, on a last axis."""
    out = np.empty((*t.shape, DEGREE))
    out[..., 0], out[..., 1] = np.exp(-0.5 * t * t), t * np.exp(-0.5 * t * t)
    for k in range(2, DEGREE):
        out[..., k] = (t * out[..., k - 1] - out[..., k - 2]) / k
    return out


def kde(points: DataFrame, side: int) -> DataFrame:
    """(i, j, density) on a side x side grid over the bounds: a Gaussian kernel with Scott's bandwidth. Points with a
    coordinate that is null or not finite don't count. Without two points that span a plane there is no density, and no
    rows.

    Points never meet nodes. In coordinates in which the kernel is round, points are filed in boxes of half a bandwidth,
    and Spark sums the products of powers of their offsets from the box's middle (``TERMS``). A box's sum of kernels is a
    series of Hermite functions in these sums; what the cut leaves out is below 1e-9 of a kernel's peak for each point,
    wherever it lies. The boxes, whose number grows with the cube root of the points' at most, add to the grid in parts,
    and each task sends one grid on."""
    p = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("abs(x) < double('infinity') AND abs(y) < double('infinity')")
    s = p.agg(F.count(F.lit(1)).alias("n"), *(f(v).alias(f"{v}{k}") for v in "xy" for k, f in ((0, F.min), (1, F.max))), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("vxy")).first()
    det = s["vx"] * s["vy"] - s["vxy"] ** 2 if s["n"] > 1 else 0.0
    if not det > 1e-12 * (s["vx"] or 0.0) * (s["vy"] or 0.0):
        return points.sparkSession.createDataFrame([], "i long, j long, density double")
    h = s["n"] ** (-1 / 6)
    lean, wide, high = s["vxy"] / s["vx"], h * s["vx"] ** 0.5, h * (det / s["vx"]) ** 0.5
    x, y = F.col("x") - s["x0"], F.col("y") - s["y0"]
    at = p.select((x / wide).alias("u"), ((y - x * lean) / high).alias("v")).select("u", "v", F.floor(F.col("u") / BOX).alias("bu"), F.floor(F.col("v") / BOX).alias("bv"))
    at = at.select("bu", "bv", (F.col("u") - (F.col("bu") + 0.5) * BOX).alias("u"), (F.col("v") - (F.col("bv") + 0.5) * BOX).alias("v"))
    powers = at.select("bu", "bv", *(F.pow(c, F.lit(float(k))).alias(f"{c}{k}") for c in "uv" for k in range(DEGREE)))
    boxes = powers.groupBy("bu", "bv").agg(F.array(*(F.sum(F.col(f"u{k}") * F.col(f"v{m}")) for k, m in TERMS)).alias("sums"))
    step = np.arange(side) / max(side - 1, 1)
    gx, gy = step * (s["x1"] - s["x0"]), step * (s["y1"] - s["y0"])
    gu, gv = gx / wide, (gy[None] - gx[:, None] * lean) / high

    def add(batches):
        total = np.zeros((side, side))
        for b in batches:
            for lo in range(0, len(b), 32):
                part = b.iloc[lo : lo + 32]
                c = np.zeros((len(part), DEGREE, DEGREE))
                c[:, [k for k, _ in TERMS], [m for _, m in TERMS]] = np.stack(part["sums"].to_numpy())
                middle = lambda v: (part[v].to_numpy() + 0.5) * BOX  # noqa: B023, E731
                hu, hv = hermite(gu[None] - middle("bu")[:, None]), hermite(gv[None] - middle("bv")[:, None, None])
                total += np.einsum("bim,bijm->ij", hu @ c, hv)
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "part": total.ravel()})

    grids = boxes.mapInPandas(add, "i long, j long, part double")
    return grids.groupBy("i", "j").agg((F.sum("part") / float(s["n"] * 2 * np.pi * det**0.5 * h * h)).alias("density"))


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost one-to-one assignment of rows to columns, by shortest augmenting paths; rectangular is fine."""
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assignment(cost.T))
    n, m = cost.shape
    u, v, match = np.zeros(n), np.zeros(m), np.full(m, -1)
    for i in range(n):
        best, parent, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col = i, -1
        while True:
            slack = cost[row] - u[row] - v
            base = 0.0 if col < 0 else best[col]
            better = ~done & (base + slack < best)
            best[better], parent[better] = base + slack[better], col
            col = int(np.argmin(np.where(done, np.inf, best)))
            done[col] = True
            if match[col] < 0:
                break
            row = int(match[col])
        low = best[col]
        for j in np.flatnonzero(done):
            if j != col:
                u[match[j]] += low - best[j]
                v[j] -= low - best[j]
        u[i] += low
        while col >= 0:
            before = int(parent[col])
            match[col] = i if before < 0 else match[before]
            col = before
    return sorted((int(r), int(c)) for c, r in enumerate(match) if r >= 0)


def planes(points: DataFrame, by: str) -> DataFrame:
    """(by, n, cx, cy, cz, planarity, nx, ny, nz, angle): the plane through each group from its covariance, which Spark
    aggregates; only 3x3 eigenproblems reach Python. Groups of fewer than three points have none."""
    pairs = ("xx", "xy", "xz", "yy", "yz", "zz")
    s = points.groupBy(by).agg(F.count("*").alias("n"), *(F.avg(a).alias(f"c{a}") for a in "xyz"), *(F.covar_samp(p[0], p[1]).alias(p) for p in pairs)).where("n >= 3")
    schema = f"{by} {dict(points.dtypes)[by]}, n long, cx double, cy double, cz double, planarity double, nx double, ny double, nz double, angle double"

    def solve(batches):
        for b in batches:
            m = np.empty((len(b), 3, 3))
            for p in pairs:
                i, j = "xyz".index(p[0]), "xyz".index(p[1])
                m[:, i, j] = m[:, j, i] = b[p]
            w, v = np.linalg.eigh(m)
            normal = v[:, :, 0] * np.where(v[:, 2:3, 0] < 0, -1, 1)
            flat = np.where(w[:, 1] > 1e-8, w[:, 0] / np.maximum(w[:, 1], 1e-300), 0.0)
            out = b[[by, "n", "cx", "cy", "cz"]].copy()
            out["planarity"], out["nx"], out["ny"], out["nz"] = flat, normal[:, 0], normal[:, 1], normal[:, 2]
            out["angle"] = np.degrees(np.arccos(np.clip(normal[:, 2], -1, 1)))
            yield out

    return s.mapInPandas(solve, schema)
