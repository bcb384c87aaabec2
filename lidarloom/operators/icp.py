"""Iterated closest points as rounds of Spark aggregates, all cells at once.

A round moves the sources of all cells that are still open by their cell's transform, finds each one's nearest target
by an equi-join on cell and voxel, and sums what the step needs (the normal equations of the linearised distance to
planes, or the cross-covariance of points) by cell, combined on the map side. Some thirty numbers a cell reach the
driver, which solves for the step; cells whose fitness and error settle leave the rounds. No task ever holds a cell: the
work is dealt by voxel. Cells are those of a grid or a selection, so the driver holds a matrix for each.

Targets are filed under the 27 voxels around them once, dealt by cell and voxel and kept over the rounds, so that a round
shuffles the sources only. They are kept in Spark's storage, from which a lost executor's part is computed again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lidarloom.functions import rigid

AXES = ("x", "y", "z")
TARGET, NORMAL = ("tx", "ty", "tz"), ("nx", "ny", "nz")
KEY = ("grid_id", "vx", "vy", "vz")
#: Changes of fitness and error below which a cell has settled, and the fewest pairs that determine a step.
SETTLED, FEWEST = 1e-6, 6
#: The side of a block in reaches, in the first round and in later ones, by what the reach grows from one to the next, how
#: many sources of a block a task gets, and pairs that it looks at at once.
SPAN, LATER, WIDER, PART, PAIRS = 32, 4, 8, 100_000, 2_000_000


@dataclass
class Fit:
    """Where a cell's rounds stand."""

    matrix: np.ndarray = field(default_factory=lambda: np.eye(4))
    fitness: float = -1.0
    rmse: float = -1.0
    rounds: int = 0
    seen: set[tuple[int, int]] = field(default_factory=set)


def voxel_of(v: Column, size: float) -> Column:
    return F.floor(v / size)


def filed(target: DataFrame, reach: float) -> DataFrame:
    """``target(grid_id, tid, tx, ty, tz, ...)`` under each of the voxels of size ``reach`` around it."""
    out = target
    for a, t in zip(AXES, TARGET, strict=True):
        out = out.withColumn(f"v{a}", F.explode(F.array(*(voxel_of(F.col(t), reach) + i for i in (-1, 0, 1)))))
    return out.repartition(*KEY)


def matrices(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(grid_id, m, v0, v1, ...): a matrix's first twelve numbers and more numbers for each of ``rows``, as literals."""
    text = ", ".join(f"({int(g)}L, array({', '.join(f'{float(x)!r}D' for x in m.ravel()[:12])}), {', '.join(f'{float(x)!r}D' for x in more)})" for g, m, *more in rows)
    return spark.sql(f"SELECT * FROM VALUES {text} AS t(grid_id, m, {', '.join(f'v{i}' for i in range(len(rows[0]) - 2))})")


MOVED = tuple(f"m[{4 * i}] * x + m[{4 * i + 1}] * y + m[{4 * i + 2}] * z + m[{4 * i + 3}] AS {a}" for i, a in enumerate(AXES))


def moved(source: DataFrame, rows: list[tuple]) -> DataFrame:
    """``source(grid_id, sid, x, y, z)`` of the cells of ``rows`` (grid_id, matrix, cx, cy, cz), moved, and (cx, cy, cz)."""
    at = source.join(F.broadcast(matrices(source.sparkSession, rows)), "grid_id")
    return at.selectExpr("grid_id", "sid", *MOVED, "v0 AS cx", "v1 AS cy", "v2 AS cz")


def closest(source: DataFrame, filed_target: DataFrame, reach: float) -> DataFrame:
    """``source(grid_id, sid, x, y, z, ...)`` with its nearest target strictly within ``reach`` in its own cell: d2, tid,
    tx, ty, tz (and the normal where targets have one). One row a source at most; of equally near targets, the one of the
    least id. Of targets filed in blocks (``blocked``) every source has a row, with nulls where there is none."""
    if "part" in filed_target.columns:
        return in_blocks(source, filed_target, reach)
    own = [c for c in source.columns if c not in ("grid_id", "sid")]
    given = [c for c in (*TARGET, *NORMAL) if c in filed_target.columns]
    d2 = " + ".join(f"({a} - {t}) * ({a} - {t})" for a, t in zip(AXES, TARGET, strict=True))
    at = source.selectExpr("*", *(f"floor({a} / {reach!r}D) AS v{a}" for a in AXES))
    pairs = at.join(filed_target, list(KEY)).selectExpr(*KEY, "sid", f"struct({d2} AS d2, tid, {', '.join(given + own)}) AS near").where(f"near.d2 < {reach * reach!r}D")
    # a source lies in one voxel, so its candidates are in one partition of a shuffled join and stay there
    return pairs.groupBy(*KEY, "sid").agg(F.min("near").alias("near")).select("grid_id", "sid", "near.*")


def step_sums(pairs: DataFrame, plane: bool, cauchy: float | None) -> DataFrame:
    """Per cell: the matched pairs n, their summed squared distance d2, and the sums of a step. For planes: h<i><j> and
    g<i> of the normal equations in (rotation about the centre, shift), weighted by Cauchy's function of width
    ``cauchy`` if given. For points: s<i>, t<j> and c<i><j>, sources, targets and their products from the centre on."""
    x, y, z = (f"({a} - c{a})" for a in AXES)
    if plane:
        r = " + ".join(f"({a} - {t}) * {n}" for a, t, n in zip(AXES, TARGET, NORMAL, strict=True))
        row = (f"{y} * nz - {z} * ny", f"{z} * nx - {x} * nz", f"{x} * ny - {y} * nx", *NORMAL)
        p = pairs.selectExpr("grid_id", "d2", f"{r} AS r", *(f"{v} AS a{i}" for i, v in enumerate(row))).selectExpr("*", "1D AS w" if cauchy is None else f"1 / (1 + (r / {cauchy!r}D) * (r / {cauchy!r}D)) AS w")
        terms = {f"h{i}{j}": f"w * a{i} * a{j}" for i in range(6) for j in range(i, 6)} | {f"g{i}": f"w * a{i} * r" for i in range(6)}
    else:
        p = pairs.selectExpr("grid_id", "d2", *(f"{v} AS s{i}" for i, v in enumerate((x, y, z))), *(f"{t} - c{a} AS t{i}" for i, (a, t) in enumerate(zip(AXES, TARGET, strict=True))))
        terms = {f"{k}{i}": f"{k}{i}" for k in "st" for i in range(3)} | {f"c{i}{j}": f"s{i} * t{j}" for i in range(3) for j in range(3)}
    return p.groupBy("grid_id").agg(F.expr("count(*) AS n"), F.expr("sum(d2) AS d2"), *(F.expr(f"sum({v}) AS {k}") for k, v in terms.items()))


def step(sums: dict, plane: bool) -> np.ndarray:
    """The step from a cell's sums, in coordinates from its centre on."""
    if plane:
        h = np.array([[sums[f"h{min(i, j)}{max(i, j)}"] for j in range(6)] for i in range(6)])
        x = np.linalg.lstsq(h, -np.array([sums[f"g{i}"] for i in range(6)]), rcond=None)[0]
        return rigid.matrix(rigid.turn(x[:3]), x[3:])
    side = lambda k: np.array([sums[f"{k}{i}"] for i in range(3)])
    return rigid.from_sums(sums["n"], side("s"), side("t"), np.array([[sums[f"c{i}{j}"] for j in range(3)] for i in range(3)]))


def icp(source: DataFrame, target: DataFrame, reach: float, rounds: int, start: dict[int, np.ndarray] | None = None, plane: bool = False, cauchy: float | None = None) -> dict[int, Fit]:
    """The transform of each cell of ``source(grid_id, sid, x, y, z)`` onto ``target(grid_id, tid, tx, ty, tz[, nx, ny,
    nz])``, from ``start`` or the identity on. A cell leaves the rounds when fitness and error stay, or come back to those
    of an earlier round, since it would go round in a circle from there; with fewer than six pairs within ``reach`` it
    stays where it is."""
    kept, held = filed(target, reach).persist(), source.persist()
    try:
        cells = {r["grid_id"]: (r["n"], np.array([r["cx"], r["cy"], r["cz"]])) for r in held.groupBy("grid_id").agg(F.count("*").alias("n"), *(F.avg(a).alias(f"c{a}") for a in AXES)).collect()}
        found = {g: Fit(np.array((start or {}).get(g, np.eye(4)), float)) for g in cells}
        active = set(found)
        for _ in range(rounds):
            if not active:
                break
            centre = {g: rigid.move(found[g].matrix, cells[g][1][None])[0] for g in active}
            at = moved(held, [(g, found[g].matrix, *centre[g]) for g in sorted(active)])
            sums = {r["grid_id"]: r.asDict() for r in step_sums(closest(at, kept, reach), plane, cauchy).collect()}
            for g in list(active):
                own, fit = sums.get(g), found[g]
                if own is None or own["n"] < FEWEST:
                    active.discard(g)
                    continue
                now = own["n"] / cells[g][0], (own["d2"] / own["n"]) ** 0.5
                still = abs(now[0] - fit.fitness) < SETTLED and abs(now[1] - fit.rmse) < SETTLED
                fit.fitness, fit.rmse = now
                state = own["n"], round(now[1] / SETTLED)
                if still or state in fit.seen:
                    active.discard(g)
                    continue
                fit.seen.add(state)
                fit.matrix = rigid.about(step(own, plane), centre[g]) @ fit.matrix
                fit.rounds += 1
        return found
    finally:
        kept.unpersist()
        held.unpersist()


def in_block(source: DataFrame, side: float) -> DataFrame:
    return source.withColumns({f"v{a}": voxel_of(F.col(a), side) for a in AXES})


def parts_of(source: DataFrame, side: float) -> DataFrame:
    """The blocks that have sources, and the number of ``parts`` that each block's sources are dealt to."""
    return F.broadcast(in_block(source, side).groupBy(*KEY).agg(F.ceil(F.count("*") / PART).alias("parts")))


def blocked(target: DataFrame, source: DataFrame, reach: float, span: int = SPAN) -> DataFrame:
    """``target(grid_id, tid, tx, ty, tz)`` under those blocks of ``span`` reaches that have sources and that a ball of
    ``reach`` around it meets, once for each ``part`` of the block's sources."""
    side, wide = span * reach, 1.001 * reach
    out = target
    for a, t in zip(AXES, TARGET, strict=True):
        out = out.withColumn(f"v{a}", F.explode(F.sequence(voxel_of(F.col(t) - wide, side), voxel_of(F.col(t) + wide, side))))
    return out.join(parts_of(source, side), list(KEY)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))


def in_blocks(source: DataFrame, blocks: DataFrame, reach: float, span: int = SPAN) -> DataFrame:
    """``closest`` of targets that are filed in blocks: a task gets a part of a block's sources, and the targets that may be
    near them, so that pairs are never rows."""
    at = in_block(source, span * reach).join(parts_of(source, span * reach), list(KEY)).withColumn("part", F.pmod(F.xxhash64("sid"), "parts")).drop("parts")
    own = [c for c in source.columns if c not in ("grid_id", "sid")]
    key, kind = [*KEY, "part"], dict(source.dtypes)
    schema = ", ".join(["grid_id long", "sid long", "d2 double", "tid long", *(f"{t} double" for t in TARGET), *(f"{c} {kind[c]}" for c in own)])

    def work(s: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("tid")
        places = t[list(TARGET)].to_numpy(float)
        at, d2 = nearest_of(s[list(AXES)].to_numpy(float), places, reach)
        none = at < 0
        out = s[["grid_id", "sid"]].assign(d2=np.where(none, np.nan, d2))
        out["tid"] = pd.array(t["tid"].to_numpy()[at] if len(t) else np.zeros(len(s), int), dtype="Int64")
        out.loc[none, "tid"] = pd.NA
        for i, name in enumerate(TARGET):
            out[name] = np.where(none, np.nan, places[at, i] if len(t) else np.nan)
        return out.assign(**{c: s[c] for c in own})

    held = blocks.select(*key, "tid", *TARGET)
    return at.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(work, schema)


def nearest_of(points: np.ndarray, places: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each of ``points`` the nearest of ``places`` strictly within ``reach`` (its place in the array, the first of equally
    near ones; -1: none) and its squared distance. The search begins in small cells, with the points that find none
    searching again in cells of twice the size."""
    at, best = np.full(len(points), -1), np.full(len(points), np.inf)
    finite = np.flatnonzero(np.isfinite(places).all(1))
    open_ = np.flatnonzero(np.isfinite(points).all(1))
    if not len(finite) or not len(open_):
        return at, best
    size = reach
    for _ in range(16):
        cell = np.floor(places[finite] / size).astype(np.int64)
        _, n = np.unique(numbers(cell, cell.min(0), cell.max(0)), return_counts=True)
        if (n * n).sum() <= 8 * n.sum():
            break
        size /= 2
    while True:
        cell = np.floor(places[finite] / size).astype(np.int64)
        low, high = cell.min(0), cell.max(0)
        keys = numbers(cell, low, high)
        order = np.argsort(keys, kind="stable")
        keys, held = keys[order], finite[order]
        near, d2 = around(points[open_], places, held, keys, np.floor(points[open_] / size).astype(np.int64), low, high)
        found = (near >= 0) & (d2 < size * size)
        at[open_[found]], best[open_[found]] = near[found], d2[found]
        open_ = open_[~found]
        if size >= reach or not len(open_):
            return at, best
        size = min(2 * size, reach)


def numbers(cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    wide = high - low + 1
    return ((cell[:, 0] - low[0]) * wide[1] + cell[:, 1] - low[1]) * wide[2] + cell[:, 2] - low[2]


def around(points: np.ndarray, places: np.ndarray, held: np.ndarray, keys: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the ``held`` places in the 27 cells around each point: three cells in a line are one range of ``keys``."""
    at, best = np.full(len(points), -1), np.full(len(points), np.inf)
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            first, last = cell + (dx, dy, -1), cell + (dx, dy, 1)
            first[:, 2], last[:, 2] = np.maximum(first[:, 2], low[2]), np.minimum(last[:, 2], high[2])
            inside = ((first[:, :2] >= low[:2]) & (first[:, :2] <= high[:2])).all(1) & (first[:, 2] <= last[:, 2])
            own = np.flatnonzero(inside)
            start, stop = np.searchsorted(keys, numbers(first[own], low, high)), np.searchsorted(keys, numbers(last[own], low, high), "right")
            some = stop > start
            own, start, n = own[some], start[some], (stop - start)[some]
            total = np.cumsum(n)
            begin = 0
            while begin < len(own):
                end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, "right")))
                o, k = own[begin:end], n[begin:end]
                at_seg = np.cumsum(k) - k
                other = held[np.repeat(start[begin:end] - at_seg, k) + np.arange(int(k.sum()))]
                off = np.repeat(points[o], k, axis=0) - places[other]
                d2 = off[:, 0] * off[:, 0] + off[:, 1] * off[:, 1] + off[:, 2] * off[:, 2]
                least = np.minimum.reduceat(d2, at_seg)
                who = np.minimum.reduceat(np.where(d2 == np.repeat(least, k), other, len(places)), at_seg)
                better = (least < best[o]) | ((least == best[o]) & (who < at[o]))
                at[o[better]], best[o[better]] = who[better], least[better]
                begin = end
    return at, best


def nearest(source: DataFrame, target: DataFrame, reach: float, few: float = 8.0) -> DataFrame:
    """``closest`` for clouds of any density: the search begins within a radius whose voxels hold about ``few`` targets, in
    blocks of many such voxels, and sources that find none there search again in wider ones, up to ``reach``. Of targets at
    one place the one of the least id counts, so the others are left out."""
    from lidarloom.operators.spatial import search_radius
    from lidarloom.sources import scratch

    places = scratch.written(target.groupBy("grid_id", *TARGET).agg(F.min("tid").alias("tid")))
    size = search_radius(places, [F.col("grid_id")], TARGET, reach, few)
    near = closest(source, blocked(places, source, size), size)
    out = None
    while size < reach:
        near = scratch.written(near)
        found = near.where("tid IS NOT NULL")
        out = found if out is None else out.unionByName(found)
        left, size = near.where("tid IS NULL").select(*source.columns), min(WIDER * size, reach)
        near = in_blocks(left, blocked(places, left, size, LATER), size, LATER)
    last = near.where("tid IS NOT NULL")
    return last if out is None else out.unionByName(last)
