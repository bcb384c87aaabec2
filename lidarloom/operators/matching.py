"""Matches of points by their features, and transforms from matches that are mostly wrong: random samples, graduated
weights and heaviest cliques, each as Spark jobs over all cells at once.

Matches are rows ``(grid_id, rn, sx, sy, sz, tx, ty, tz)``, numbered by ``rn`` from 0 in each cell. The driver holds a
matrix a cell, as many as the selection has.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lidarloom.functions import rigid
from lidarloom.operators.icp import matrices
from lidarloom.sources import scratch

S, T = ("sx", "sy", "sz"), ("tx", "ty", "tz")
#: Points of a block of features, and blocks that a cell's matches are dealt to when hypotheses are scored.
BLOCK, SALT = 512, 8
#: Vertices of a cell whose cliques are searched for before the others.
EARLY = 8


def numbered(pairs: DataFrame, *order: str) -> DataFrame:
    """``pairs`` with ``rn``, their number in the cell from 0 on, by ``order`` and then the coordinates."""
    w = Window.partitionBy("grid_id").orderBy(*order, *S, *T)
    return pairs.withColumn("rn", F.row_number().over(w).cast("long") - 1)


# --- features ---------------------------------------------------------------------------------------------------------


def feature_blocks(points: DataFrame, features: DataFrame) -> DataFrame:
    """(grid_id, block, ids, bins, values): the points of a cell with their features, ``BLOCK`` to a row or so."""
    own = features.groupBy("pid").agg(F.collect_list("bin").alias("bins"), F.collect_list("value").alias("values"))
    n = points.groupBy("grid_id").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    at = points.select("grid_id", "pid").join(own, "pid").join(F.broadcast(n), "grid_id")
    return at.groupBy("grid_id", F.pmod(F.xxhash64("pid"), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("pid", "bins", "values")).alias("rows"))


def feature_pairs(source: DataFrame, target: DataFrame, source_features: DataFrame, target_features: DataFrame, mutual: bool, most: int) -> DataFrame:
    """Numbered matches of each cell: every source's target of the largest cosine of features (ties: least id), only
    those that are each other's with ``mutual``, at most the ``most`` best of a cell. Blocks of features meet all blocks
    of the other strip in their cell; what leaves a pair of blocks is one candidate a point."""
    c = F.col
    a = feature_blocks(source, source_features).select("grid_id", c("rows").alias("s"))
    b = feature_blocks(target, target_features).select("grid_id", c("rows").alias("t"))

    def dense(rows: list) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((len(rows), 33))
        for i, r in enumerate(rows):
            out[i, np.asarray(r["bins"], int)] = r["values"]
        return np.array([r["pid"] for r in rows]), out

    def work(batches):
        for batch in batches:
            for g, rs, rt in zip(batch["grid_id"], batch["s"], batch["t"], strict=True):
                (si, fs), (ti, ft) = dense(rs), dense(rt)
                order_s, order_t = np.argsort(si), np.argsort(ti)
                si, fs, ti, ft = si[order_s], fs[order_s], ti[order_t], ft[order_t]
                like = np.round(fs @ ft.T, 12)
                to, back = like.argmax(1), like.argmax(0)
                yield pd.DataFrame({"grid_id": g, "forward": True, "own": si, "other": ti[to], "score": like[np.arange(len(si)), to]})
                if mutual:
                    yield pd.DataFrame({"grid_id": g, "forward": False, "own": ti, "other": si[back], "score": like[back, np.arange(len(ti))]})

    met = a.join(b, "grid_id").repartition(F.xxhash64("s", "t")).mapInPandas(work, "grid_id long, forward boolean, own long, other long, score double")
    best = met.groupBy("grid_id", "forward", "own").agg(F.max(F.struct("score", (-c("other")).alias("other"))).alias("m")).select("grid_id", "forward", "own", (-c("m.other")).alias("other"), "m.score")
    pair = best.where("forward").select("grid_id", c("own").alias("sid"), c("other").alias("tid"), "score")
    if mutual:
        pair = pair.join(best.where("NOT forward").select("grid_id", c("own").alias("tid"), c("other").alias("sid")), ["grid_id", "sid", "tid"])
    kept = pair.withColumn("place", F.row_number().over(Window.partitionBy("grid_id").orderBy(F.desc("score"), "sid"))).where(c("place") <= most)
    at = lambda points, key, names: points.select("grid_id", c("pid").alias(key), *(c(x).alias(n) for x, n in zip("xyz", names, strict=True)))
    return scratch.written(numbered(kept.join(at(source, "sid", S), ["grid_id", "sid"]).join(at(target, "tid", T), ["grid_id", "tid"]).select("grid_id", "sid", "tid", *S, *T), "sid"))


# --- random samples ---------------------------------------------------------------------------------------------------


def draw(seed: int, k: int, n: Column) -> Column:
    """The ``k``-th match of hypothesis ``h`` of a cell, by a hash of both: the same at any partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "grid_id", "h", F.lit(k)).cast("binary")), 1, 8), 16, 10).cast("long") % n


def frames(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal frames (rows x 3 axes x 3) of triangles (rows x 3 points x 3), along the first edge and across it, and
    how far the third point is from the first edge."""
    along = p[:, 1] - p[:, 0]
    along = along / np.linalg.norm(along, axis=1, keepdims=True)
    side = p[:, 2] - p[:, 0]
    side = side - (side * along).sum(1, keepdims=True) * along
    far = np.linalg.norm(side, axis=1)
    side = side / np.maximum(far, 1e-300)[:, None]
    return np.stack((along, side, np.cross(along, side)), 1), far


ROTATION, SHIFT = tuple(f"r{i}" for i in range(9)), tuple(f"u{i}" for i in range(3))
HYPOTHESIS = f"grid_id long, h long, {', '.join(f'{v} double' for v in (*ROTATION, *SHIFT))}"


def hypotheses(cells: DataFrame, pairs: DataFrame, first: int, last: int, edges: float, reach: float, seed: int) -> DataFrame:
    """(grid_id, h, r0..r8, u0..u2): transforms from three matches each, of the hypotheses from ``first`` to ``last`` of
    each of ``cells(grid_id, n)``. Triangles must have edges alike to the share ``edges``, and span a plane; their frames
    give the rotation, their centres the shift, which must bring all three within ``reach`` of their targets."""
    c = F.col
    h = cells.select("grid_id", "n", F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("h"))
    h = h.select("grid_id", "h", *(draw(seed, k, c("n")).alias(f"k{k}") for k in range(3))).where("k0 <> k1 AND k0 <> k2 AND k1 <> k2")
    for k in range(3):
        h = h.join(pairs.select("grid_id", c("rn").alias(f"k{k}"), *(c(n).alias(f"{n}{k}") for n in (*S, *T))), ["grid_id", f"k{k}"])
    edge = lambda names, i, j: "sqrt(" + " + ".join(f"({n}{i} - {n}{j}) * ({n}{i} - {n}{j})" for n in names) + ")"
    h = h.selectExpr("*", *(f"{edge(names, i, j)} AS e{side}{i}" for side, names in (("s", S), ("t", T)) for i, j in ((0, 1), (1, 2), (2, 0))))
    h = h.where(" AND ".join(f"least(es{i}, et{i}) > 0 AND least(es{i}, et{i}) >= {edges!r}D * greatest(es{i}, et{i})" for i in range(3)))

    def work(batches):
        for b in batches:
            s, t = (b[[f"{n}{k}" for k in range(3) for n in names]].to_numpy(float).reshape(-1, 3, 3) for names in (S, T))
            (fs, far_s), (ft, far_t) = frames(s), frames(t)
            r = ft.transpose(0, 2, 1) @ fs
            u = t.mean(1) - (r @ s.mean(1)[:, :, None])[:, :, 0]
            off = np.linalg.norm(s @ r.transpose(0, 2, 1) + u[:, None] - t, axis=2)
            ok = (np.minimum(far_s, far_t) > 1e-9) & (off < reach).all(1)
            yield pd.DataFrame(np.c_[r.reshape(-1, 9), u][ok], columns=[*ROTATION, *SHIFT]).assign(grid_id=b["grid_id"].to_numpy()[ok], h=b["h"].to_numpy()[ok])[["grid_id", "h", *ROTATION, *SHIFT]]

    return h.mapInPandas(work, HYPOTHESIS)


def scored(found: DataFrame, pairs: DataFrame, reach: float) -> DataFrame:
    """``found`` with ``inliers``, the matches that a transform brings within ``reach``. A cell's matches are dealt to
    ``SALT`` parts, so that no task has a whole cell."""
    return brought(found, pairs, reach).groupBy("grid_id", "h", *ROTATION, *SHIFT).agg(F.count("*").alias("inliers"))


def judged(found: DataFrame, pairs: DataFrame, reach: float) -> DataFrame:
    """``found`` with ``score``, the sum over the matches that a transform brings within ``reach`` of 1 - distance / reach."""
    return brought(found, pairs, reach).groupBy("grid_id", "h", *ROTATION, *SHIFT).agg(F.sum(1 - F.sqrt("off2") / reach).alias("score"))


def brought(found: DataFrame, pairs: DataFrame, reach: float) -> DataFrame:
    """A row for each of ``found`` and each match that it brings within ``reach``, with the squared distance off2."""
    dealt = pairs.selectExpr("grid_id", f"rn % {SALT} AS part", *S, *T)
    every = found.selectExpr("*", f"explode(sequence(0L, {SALT - 1}L)) AS part")
    off = [f"(r{3 * i} * sx + r{3 * i + 1} * sy + r{3 * i + 2} * sz + u{i} - {t})" for i, t in enumerate(T)]
    return every.join(dealt, ["grid_id", "part"]).withColumn("off2", F.expr(" + ".join(f"{v} * {v}" for v in off))).where(f"off2 < {reach * reach!r}D")


def ransac(pairs: DataFrame, reach: float = 0.5, edges: float = 0.9, most: int = 100_000, confidence: float = 0.999, batch: int = 1_000, seed: int = 0) -> DataFrame:
    """(grid_id, h, inliers, n, drawn, transformation): each cell's hypothesis of the most inliers (ties: the first).

    Hypotheses are rows, drawn in batches that double; a cell stops when its best share w of inliers makes it as sure as
    ``confidence`` that a triple of true matches was drawn, log(1 - confidence) / log(1 - w^3) draws, or after ``most``.
    Cells with fewer than three matches have no row."""
    c = F.col
    n_of = {r["grid_id"]: r["n"] for r in pairs.groupBy("grid_id").agg(F.count("*").alias("n")).where("n >= 3").collect()}
    best: dict[int, tuple] = {}
    drawn, active = dict.fromkeys(n_of, 0), set(n_of)
    spark, at = pairs.sparkSession, 0
    while active and at < most:
        to = min(most, max(batch, 2 * at))
        cells = spark.createDataFrame([(g, n_of[g]) for g in sorted(active)], "grid_id long, n long")
        tried = scored(scratch.written(hypotheses(cells, pairs, at, to, edges, reach, seed)), pairs, reach)
        for r in tried.groupBy("grid_id").agg(F.max(F.struct("inliers", (-c("h")).alias("h"), *ROTATION, *SHIFT)).alias("m")).select("grid_id", "m.*").collect():
            if r["grid_id"] not in best or r["inliers"] > best[r["grid_id"]][0]:
                best[r["grid_id"]] = r["inliers"], -r["h"], [r[f"r{i}"] for i in range(9)], [r[f"u{i}"] for i in range(3)]
        at = to
        for g in list(active):
            drawn[g] = at
            w = best[g][0] / n_of[g] if g in best else 0.0
            if w >= 1 or (w > 0 and at >= math.log(1 - confidence) / math.log(1 - w**3)):
                active.discard(g)
    rows = [(g, h, k, n_of[g], drawn[g], rigid.matrix(np.reshape(r, (3, 3)), np.array(u)).ravel().tolist()) for g, (k, h, r, u) in sorted(best.items())]
    return spark.createDataFrame(rows, "grid_id long, h long, inliers long, n long, drawn long, transformation array<double>")


# --- least squares ----------------------------------------------------------------------------------------------------


def with_means(pairs: DataFrame) -> DataFrame:
    """``pairs`` with their cell's means osx..otz, from which sums count so that no digits are lost."""
    return pairs.join(F.broadcast(pairs.groupBy("grid_id").agg(*(F.expr(f"avg({v}) AS o{v}") for v in (*S, *T)))), "grid_id")


def squares(pairs: DataFrame, weight: str = "1D") -> dict[int, np.ndarray]:
    """Each cell's weighted least-squares transform, from sums that combine on the map side."""
    c = (*S, *T)
    near = (pairs if "osx" in pairs.columns else with_means(pairs)).selectExpr("grid_id", f"{weight} AS w", *(f"{v} - o{v} AS {v}" for v in c), *(f"o{v}" for v in c))
    sums = near.groupBy("grid_id").agg(F.expr("sum(w) AS w"), *(F.expr(f"sum(w * {v}) AS {v}") for v in c), *(F.expr(f"sum(w * {a} * {b}) AS {a}{b}") for a in S for b in T), *(F.expr(f"first(o{v}) AS o{v}") for v in c))
    out = {}
    for r in sums.collect():
        if not r["w"] > 1e-9:
            continue
        pick = lambda names, r=r: np.array([r[n] for n in names])
        m = rigid.from_sums(r["w"], pick(S), pick(T), np.array([[r[f"{a}{b}"] for b in T] for a in S]))
        origin, goal = pick([f"o{v}" for v in S]), pick([f"o{v}" for v in T])
        out[r["grid_id"]] = rigid.matrix(m[:3, :3], m[:3, 3] + goal - m[:3, :3] @ origin)
    return out


def under(pairs: DataFrame, transforms: dict[int, tuple]) -> DataFrame:
    """``pairs`` of the cells of ``transforms`` (matrix, mu), with r2, the squared distance of the moved source to its
    target, and mu."""
    at = pairs.join(F.broadcast(matrices(pairs.sparkSession, [(g, m, mu) for g, (m, mu) in sorted(transforms.items())])), "grid_id")
    off = [f"(m[{4 * i}] * sx + m[{4 * i + 1}] * sy + m[{4 * i + 2}] * sz + m[{4 * i + 3}] - {t})" for i, t in enumerate(T)]
    return at.selectExpr(*pairs.columns, " + ".join(f"{v} * {v}" for v in off) + " AS r2", "v0 AS mu")


def graduated(pairs: DataFrame, width: float, truncated: bool, rounds: int = 100) -> dict[int, np.ndarray]:
    """Graduated non-convexity: each round weighs all matches by the last transform, by Geman and McClure's function or
    by truncated least squares, and solves again with a sharper one; a round is one aggregate over all cells."""
    held = with_means(pairs).persist()
    try:
        found = squares(held)
        worst = {r["grid_id"]: r["r2"] / width**2 for r in under(held, {g: (m, 1.0) for g, m in found.items()}).groupBy("grid_id").agg(F.max("r2").alias("r2")).collect()} if found else {}
        mu = {g: 1 / max(2 * v - 1, 1e-3) if truncated else max(v, 1.0) for g, v in worst.items()}
        active = set(mu)
        for _ in range(rounds):
            if not active:
                break
            p = under(held, {g: (found[g], mu[g]) for g in active})
            r2 = f"(r2 / {width**2!r}D)"
            w = f"greatest(0D, least(1D, sqrt(mu * (mu + 1) / greatest({r2}, 1e-12D)) - mu))" if truncated else f"(mu / (mu + {r2})) * (mu / (mu + {r2}))"
            new = squares(p, f"{w} + 1e-12D")
            for g in list(active):
                still = g not in new or float(np.abs(new[g] - found[g]).max()) < 1e-9
                found[g] = new.get(g, found[g])
                mu[g] = mu[g] * 1.4 if truncated else mu[g] / 1.4
                if still or (mu[g] > 1e6 if truncated else mu[g] < 1):
                    active.discard(g)
        return found
    finally:
        held.unpersist()


# --- cliques ----------------------------------------------------------------------------------------------------------


#: First-order weights of a cell's graph: the weights between vertices by their places, rows x columns.
Weights = Callable[[np.ndarray, np.ndarray], np.ndarray]


def compatible(matches: pd.DataFrame, tolerance: float, least: float = 0.99) -> tuple[np.ndarray, Weights]:
    """The numbers of a cell's matches, and their weights: 1 - (difference of distances / ``tolerance``)^2 of two matches,
    where that is ``least`` or more. They are made from the coordinates where they are needed, so edges are never rows."""
    matches = matches.sort_values("rn")
    s, t = (matches[list(names)].to_numpy(float) for names in (S, T))

    def apart(p: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x, y, z = (p[i, None, k] - p[None, j, k] for k in range(3))
        return np.sqrt(x * x + y * y + z * z)

    def weights(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        d = (apart(s, i, j) - apart(t, i, j)) / tolerance
        w = 1 - d * d
        w[(w < least) | (i[:, None] == j[None])] = 0
        return w

    return matches["rn"].to_numpy(), weights


def of_edges(edges: pd.DataFrame) -> tuple[np.ndarray, Weights]:
    """The vertices of a graph of edges (a, b, w), and their weights."""
    ends = edges[["a", "b"]].to_numpy()
    nodes = np.unique(ends)
    i, j = np.searchsorted(nodes, np.concatenate((ends, ends[:, ::-1]))).T
    order = np.argsort(i, kind="stable")
    j, w, start = j[order], np.tile(edges["w"].to_numpy(float), 2)[order], np.searchsorted(i[order], np.arange(len(nodes) + 1))

    def weights(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), len(nodes)))
        for k, r in enumerate(rows):
            out[k, j[start[r]:start[r + 1]]] = w[start[r]:start[r + 1]]
        return out[:, columns]

    return nodes, weights


def stretches(n: int):
    return (np.arange(k, min(k + BLOCK, n)) for k in range(0, n, BLOCK))


def heaviest(weight: np.ndarray, start: np.ndarray) -> tuple[float, list[int]]:
    """The heaviest clique (its weight, its vertices) of a small graph whose vertices have the weights ``start`` of their
    own beside those of edges, by branches around a pivot; branches that could not beat the best one are left out. Ties
    go to the clique found first in the order of vertices."""
    n = len(weight)
    near = [frozenset(np.flatnonzero(weight[i] > 0).tolist()) for i in range(n)]
    best: tuple[float, list[int]] = (0.0, [])

    def grow(own: list[int], total: float, gain: np.ndarray, open_: frozenset) -> None:
        nonlocal best
        if not open_:
            if total > best[0] + 1e-12:
                best = total, own
            return
        at = sorted(open_)
        inside = weight[np.ix_(at, at)]
        bound = total + float(gain[at].sum()) + float(inside.sum()) / 2
        if bound <= best[0] + 1e-12:
            return
        if np.count_nonzero(inside) == len(at) * (len(at) - 1):  # all agree: nothing to choose
            best = bound, own + at
            return
        pivot = max(at, key=lambda v: (len(near[v] & open_), -v))
        for v in [v for v in at if v == pivot or v not in near[pivot]]:
            grow([*own, v], total + float(gain[v]), gain + weight[v], open_ & near[v])
            open_ -= {v}

    grow([], 0.0, start.astype(float), frozenset(range(n)))
    return best


def cliques(pairs: DataFrame, tolerance: float = 0.1, least: float = 0.99) -> DataFrame:
    """(grid_id, weight, members): the heaviest clique of each cell's matches that keep their distances."""
    return Search(pairs.select("grid_id", "rn", *S, *T), lambda pdf: compatible(pdf, tolerance, least)).heaviest()


def heaviest_cliques(graph: DataFrame) -> DataFrame:
    """(grid_id, weight, members): the heaviest clique, by second-order weights, of each cell's graph (grid_id, a, b, w),
    a < b. Cells without a clique of three have no row; of equal weights, the clique whose members come first wins."""
    return Search(graph, of_edges).heaviest()


class Search:
    """Searches for cliques in the cells' graphs, dealt by vertex: a task gets some vertices of a cell and what its graph is
    made from, matches or edges. Second-order weights, w times the sum over all triangles of the other two edges' weights,
    are products of the graph's matrix with itself, taken where they are needed in blocks: neither triangles nor weights
    are rows, and a task holds some rows of a cell's matrix, or the neighbours of one vertex."""

    def __init__(self, data: DataFrame, graph: Callable[[pd.DataFrame], tuple[np.ndarray, Weights]]) -> None:
        self.data, self.graph = scratch.written(data), graph
        self.blocks = scratch.written(self.data.groupBy("grid_id").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")))

        def sums(pdf: pd.DataFrame) -> pd.DataFrame:
            nodes, weights = graph(pdf)
            own = np.flatnonzero(nodes % pdf["blocks"].iloc[0] == pdf["block"].iloc[0])
            every = np.arange(len(nodes))
            first = weights(own, every)
            second = sum((first[:, k] @ weights(k, every) for k in stretches(len(nodes))), np.zeros(first.shape)) * first
            return pd.DataFrame({"grid_id": pdf["grid_id"].iloc[0], "node": nodes[own], "degree": (first > 0).sum(1), "total": second.sum(1)})

        self.nodes = scratch.written(self.dealt(self.data).groupBy("grid_id", "block").applyInPandas(sums, "grid_id long, node long, degree long, total double"))

    def dealt(self, df: DataFrame) -> DataFrame:
        """``df`` for each block of its cell; columns are named anew, since what is dealt meets what is dealt."""
        out = df.join(F.broadcast(self.blocks), "grid_id").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        return out.select(*(F.col(c).alias(c) for c in out.columns))

    def run(self, wanted: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        """``work(graph's data, nodes with degree, total and whether a node is wanted here)`` of the blocks of ``wanted(grid_id,
        node)``."""
        key = ["grid_id", "block"]
        own = wanted.join(F.broadcast(self.blocks), "grid_id").select(F.col("grid_id").alias("grid_id"), F.expr("pmod(node, blocks)").alias("block"), F.col("node").alias("node"), F.lit(True).alias("own"))
        own = scratch.written(own)
        some = own.select(*key).distinct()
        nodes = self.dealt(self.nodes).join(own, [*key, "node"], "left").withColumn("own", F.coalesce("own", F.lit(False))).join(some, key, "left_semi")
        data = self.dealt(self.data).join(some, key, "left_semi")
        nodes, data = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (nodes, data))
        return nodes.groupBy(*key).cogroup(data.groupBy(*key)).applyInPandas(lambda n, d: work(d, n.sort_values("node")), schema)

    def bounds(self) -> DataFrame:
        """(grid_id, node, most): what a clique can weigh at most whose first vertex, in the order of degrees, is ``node``: all
        second-order weights of its own and of its later neighbours' edges."""
        graph = self.graph

        def work(pdf: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
            nodes, weights = graph(pdf)
            rank, own, total = places(n), np.flatnonzero(n["own"]), n["total"].to_numpy()
            near = (weights(own, np.arange(len(nodes))) > 0) & (rank[None] > rank[own, None])
            return pd.DataFrame({"grid_id": n["grid_id"].iloc[0], "node": nodes[own], "most": near @ total + total[own]})

        return self.run(self.nodes.where("total > 0"), work, "grid_id long, node long, most double")

    def of_vertices(self, wanted: DataFrame, later: bool) -> DataFrame:
        """(grid_id, node, weight, members): the heaviest clique of three or more with each of the vertices ``wanted``, of
        ``later`` ones in the order of degrees or of all."""
        graph = self.graph

        def work(pdf: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
            nodes, weights = graph(pdf)
            rank, found = places(n), []
            every = np.arange(len(nodes))
            for i in np.flatnonzero(n["own"]):
                near = weights(np.array([i]), every)[0] > 0
                sub = np.concatenate(([i], np.flatnonzero(near & (rank > rank[i]) if later else near)))
                second = np.zeros((len(sub), len(sub)))
                for k in stretches(len(nodes)):
                    first = weights(sub, k)
                    second += first @ first.T
                second *= weights(sub, sub)
                others = np.flatnonzero(second[0] > 0)
                total, chosen = heaviest(second[np.ix_(others, others)], second[0, others])
                if len(chosen) >= 2:
                    found.append((n["grid_id"].iloc[0], nodes[i], 2 * total, sorted([int(nodes[i]), *nodes[sub[others[chosen]]].tolist()])))
            return pd.DataFrame(found, columns=["grid_id", "node", "weight", "members"])

        return self.run(wanted, work, "grid_id long, node long, weight double, members array<long>")

    def heaviest(self) -> DataFrame:
        """(grid_id, weight, members) of each cell's heaviest clique: the vertices of the largest bounds are searched first, the
        others where they can still beat what was found."""
        c = F.col
        most = scratch.written(self.bounds().withColumn("place", F.row_number().over(Window.partitionBy("grid_id").orderBy(F.desc("most"), "node"))))
        early = scratch.written(self.of_vertices(most.where(c("place") <= EARLY), True))
        best = F.broadcast(early.groupBy("grid_id").agg(F.max("weight").alias("best")))
        late = most.where(c("place") > EARLY).join(best, "grid_id", "left").where(c("most") >= F.coalesce("best", F.lit(0.0)) * (1 - 1e-9) - 1e-9)
        found = early.unionByName(self.of_vertices(late, True))
        top = found.groupBy("grid_id").agg(F.max(F.struct(F.round("weight", 9).alias("rounded"), F.transform("members", lambda m: -m).alias("order"), "weight", "members")).alias("m"))
        return top.select("grid_id", "m.weight", "m.members")


def places(nodes: pd.DataFrame) -> np.ndarray:
    """The place of each of a cell's vertices in the order of degrees."""
    rank = np.empty(len(nodes), int)
    rank[np.lexsort((nodes["node"], nodes["degree"]))] = np.arange(len(nodes))
    return rank


def best_clique(pairs: DataFrame, tolerance: float = 0.1, least: float = 0.99) -> dict[int, np.ndarray]:
    """Each cell's transform by maximal cliques: of every match the heaviest clique that it belongs to is a hypothesis, solved by
    least squares, and all matches of the cell say which is best, each by how far below ``tolerance`` it is brought."""
    c = F.col
    search = Search(pairs.select("grid_id", "rn", *S, *T), lambda pdf: compatible(pdf, tolerance, least))
    found = search.of_vertices(search.nodes.where("total > 0"), False).groupBy("grid_id", "members").agg(F.min("node").alias("h"), F.max("weight").alias("weight"))
    found = scratch.written(found)
    member = found.select("grid_id", "h", F.explode("members").alias("rn")).join(pairs, ["grid_id", "rn"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        s, t = pdf[list(S)].to_numpy(float), pdf[list(T)].to_numpy(float)
        r = rigid.nearest_rotation((t - t.mean(0)).T @ (s - s.mean(0)))
        return pd.DataFrame([[pdf["grid_id"].iloc[0], pdf["h"].iloc[0], *r.ravel(), *(t.mean(0) - r @ s.mean(0))]], columns=["grid_id", "h", *ROTATION, *SHIFT])

    tried = scratch.written(member.groupBy("grid_id", "h").applyInPandas(solve, HYPOTHESIS))
    score = judged(tried, pairs, tolerance).join(found.select("grid_id", "h", "weight"), ["grid_id", "h"])
    top = score.groupBy("grid_id").agg(F.max(F.struct(F.round("score", 9).alias("score"), "weight", (-c("h")).alias("h"), *ROTATION, *SHIFT)).alias("m")).select("grid_id", "m.*").collect()
    return {r["grid_id"]: rigid.matrix(np.reshape([r[v] for v in ROTATION], (3, 3)), np.array([r[v] for v in SHIFT])) for r in top}


def members_of(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The ``pairs`` that belong to their cell's clique."""
    return pairs.join(found.select("grid_id", F.explode("members").alias("rn")), ["grid_id", "rn"], "left_semi")
