"""Rigid transforms of groups of correspondences: Spark sums the cross-covariances, tasks solve 3 x 3 problems."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidarloom.functions import delaunay, rigid
from lidarloom.operators import clustering, matching
from lidarloom.sources import scratch

S, T = ("sx", "sy", "sz"), ("tx", "ty", "tz")


def kabsch(pairs: DataFrame, by: str) -> DataFrame:
    """(by, n, transformation): each group's least-squares rigid transform, from sums that combine on the map side."""
    sums = pairs.groupBy(by).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in (*S, *T)), *(F.covar_pop(a, b).alias(f"{a}{b}") for a in S for b in T)).where("n >= 3")

    def solve(batches):
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                u, _, vt = np.linalg.svd(np.array([[r[f"{a}{c}"] for c in T] for a in S]))
                rot = rigid.nearest_rotation(vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T)) or 1]) @ u.T)
                m = np.eye(4)
                m[:3, :3], m[:3, 3] = rot, np.array([r[c] for c in T]) - rot @ np.array([r[c] for c in S])
                out.append((r[by], r["n"], m.ravel().tolist()))
            yield pd.DataFrame(out, columns=[by, "n", "transformation"])

    return sums.mapInPandas(solve, f"{by} {dict(pairs.dtypes)[by]}, n long, transformation array<double>")


def clique_transforms(pairs: DataFrame, by: str, tolerance: float, least: float = 0.99) -> DataFrame:
    """(by, weight, members, transformation) of the heaviest clique of matches of each group that keep their distances;
    groups without a clique of three have no row. ``members`` are the matches' numbers from 0 on in the order of their
    coordinates."""
    numbered = scratch.written(matching.numbered(pairs.select(F.col(by).cast("long").alias("grid_id"), *S, *T)))
    found = scratch.written(matching.cliques(numbered, tolerance, least=least))
    fits = kabsch(matching.members_of(numbered, found), "grid_id")
    return found.join(fits.select("grid_id", "transformation"), "grid_id").withColumnRenamed("grid_id", by)


def node_of(v: str, low: str, high: str, side: int) -> str:
    """SQL for the number of the grid node next to ``v`` between ``low`` and ``high``, held within the grid."""
    return f"CAST(greatest(0, least({side - 1}, coalesce(round(({v} - {low}) / nullif({high} - {low}, 0) * {side - 1}), 0))) AS INT)"


def surface_nodes(active: DataFrame, by: str, side: int) -> DataFrame:
    """(by, i, j, x, y, z, cx, cy, r2): the nodes of a side x side grid over the bounds of each group of ``active``, their
    heights on its triangulation, and the circle of the triangle that they lie in; nulls outside the hull."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        p, z = pdf[["x", "y"]].to_numpy(float), pdf["z"].to_numpy(float)
        gx, gy = (np.linspace(p[:, a].min(), p[:, a].max(), side) for a in (0, 1))
        mesh = delaunay.Mesh(p)
        rows = []
        for i in range(side):
            for j in range(side) if i % 2 == 0 else range(side - 1, -1, -1):
                node, found = (float(gx[j]), float(gy[i])), (None,) * 4
                if mesh.tri:
                    _, t = mesh.locate(node)
                    mesh.last = t
                    own = mesh.tri[t]
                    share = delaunay.shares(*(mesh.p[v] for v in own), node)
                    if min(share) >= -1e-9:
                        found = (float(np.dot(share, z[own])), *delaunay.circle(*(mesh.p[v] for v in own)))
                rows.append((pdf[by].iloc[0], i, j, *node, *found))
        return pd.DataFrame(rows, columns=[by, "i", "j", "x", "y", "z", "cx", "cy", "r2"]).astype({c: float for c in ("z", "cx", "cy", "r2")}).astype({c: object for c in ("z", "cx", "cy", "r2")}).where(lambda d: d.notna(), None)

    kind = dict(active.dtypes)[by]
    return active.select(by, "x", "y", "z").groupBy(by).applyInPandas(work, f"{by} {kind}, i int, j int, x double, y double, z double, cx double, cy double, r2 double")


def interpolate(points: DataFrame, by: str, side: int = 50) -> DataFrame:
    """(by, i, j, x, y, z): linear interpolation of each group's points (x, y, z) on their Delaunay triangulation, at the
    nodes of a side x side grid over their bounds; null outside their hull. Points at one place count as their mean;
    groups on a line, or of fewer than three places, have nulls only.

    A triangle belongs to the triangulation of all points if its circle is empty, and only triangles with nodes matter.
    So a group's task begins with the corners of the hull and the point next to each node, at most side x side of them
    however many points there are. A join then looks for points inside the circles of the nodes' triangles; the one
    deepest in each circle joins the group's task, until all circles are empty. Groups without a find leave the rounds.
    """
    c = F.col
    whole = points.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    box = scratch.written(whole.groupBy(by).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")))
    # the places are shuffled once and written once; whatever looks for something among them is small and broadcast
    filed = scratch.written(whole.groupBy(by, "x", "y").agg(F.avg("z").alias("z")).join(F.broadcast(box), by).selectExpr("*", f"{node_of('y', 'y0', 'y1', side)} AS i", f"{node_of('x', 'x0', 'x1', side)} AS j"))
    off = f"pow(x - x0 - j * (x1 - x0) / {side - 1}, 2) + pow(y - y0 - i * (y1 - y0) / {side - 1}, 2)"
    next_ = filed.groupBy(by, "i", "j").agg(F.expr(f"min(struct({off} AS d, x, y, z)) AS m")).select(by, "m.x", "m.y", "m.z")
    corners = filed.join(F.broadcast(clustering.convex_hull(filed, by).select(by, "x", "y")), [by, "x", "y"], "left_semi").select(by, "x", "y", "z")
    active = scratch.written(next_.union(corners).distinct())
    done: list[DataFrame] = []
    while True:
        nodes = scratch.written(surface_nodes(active, by, side))
        circles = nodes.where("r2 IS NOT NULL").select(by, "cx", "cy", "r2").distinct().join(F.broadcast(box), by)
        for n, v, low, high in (("i", "cy", "y0", "y1"), ("j", "cx", "x0", "x1")):
            first, last = (node_of(f"{v} {sign} sqrt(r2)", low, high, side) for sign in "-+")
            circles = circles.selectExpr("*", f"explode(sequence({first}, {last})) AS {n}")
        circles = F.broadcast(circles.select(by, "i", "j", "cx", "cy", "r2"))
        inside = filed.select(by, "i", "j", "x", "y", "z").join(circles, [by, "i", "j"]).selectExpr("*", "(x - cx) * (x - cx) + (y - cy) * (y - cy) AS d").where("d < r2 * (1 - 1e-9D)")
        more = scratch.written(inside.groupBy(by, "cx", "cy", "r2").agg(F.expr("min(struct(d, x, y, z)) AS m")).select(by, "m.x", "m.y", "m.z").distinct())
        open_ = more.select(by).distinct()
        done.append(nodes.join(open_, by, "left_anti"))
        if more.isEmpty():
            break
        active = scratch.written(active.join(open_, by, "left_semi").union(more).distinct())
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(by, "i", "j", "x", "y", "z")
