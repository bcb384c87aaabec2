"""Queries of targets, curves, surfaces and registration."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lidarloom.functions import geometry
from lidarloom.operators import auction, clustering, icp, matching, registration, spatial, strips, targets, transforms
from lidarloom.plans import strip_queries
from lidarloom.plans.fusion_queries import MATRIX, SQL_LINKED, SQL_PAIRS, linked, pairs, rounded
from lidarloom.plans.views import SQL_VIEWS, with_views
from lidarloom.sources import scratch, tables
from lidarloom.streaming import cells as running

SIDE = 20
#: Targets of a file at most, one for each nation of the tables: how far the twins' tables of quantiles go.
NATIONS = 25
MEASURES = ("x", "y", "z", "intensity", "r", "g", "b")


def geo_plane_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clustering.planes(tables.cloud(spark, sf_dir), "cluster"))


def clu_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.kmeans(tables.cloud(spark, sf_dir), 5).groupBy("cluster_id").agg(F.count("*").alias("n"))


def bright(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    refs = spark.createDataFrame([(0, 20.0, 20.0, 5.0), (1, 50.0, 60.0, 9.0), (2, 80.0, 90.0, 4.0)], "reference_id long, x double, y double, z double")
    return tables.points(spark, sf_dir), refs


def tgt_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, refs = bright(spark, sf_dir)
    return rounded(targets.find(p, refs, intensity=150.0, z_max=12.0).groupBy("strip").agg(F.count("*").alias("n"), F.max("z").alias("top")))


def clu_target_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, refs = bright(spark, sf_dir)
    return targets.analyse(targets.find(p, refs, intensity=150.0), refs)


def jn_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least-cost assignment of each file's centres to its references, which are the other file's centres: one file
    has more of them than the other, so both ways are rectangular."""
    t = tables.targets(spark, sf_dir).select("file", F.col("reference_id").alias("id"), *(F.col(f"center_{a}").alias(a) for a in "xyz"))
    other = t.withColumn("file", F.when(F.col("file") == "customer", "supplier").otherwise("customer"))
    found = auction.assign(t, other, "file")
    return rounded(found.select("file", F.col("left_id").alias("center_id"), F.col("right_id").alias("reference_id"), "d"))


def win_savgol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(targets.smooth(tables.targets(spark, sf_dir), "file", "reference_id", "distance_to_ref"))


def inf_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(targets.bootstrap(tables.targets(spark, sf_dir), "file", ["reference_id"], "distance_to_ref", 1000))


def mdl_expfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.exponential_fit(tables.targets(spark, sf_dir), "file", "distance_to_ref")


def mdl_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = targets.principal_components(tables.points(spark, sf_dir), list(MEASURES))
    return rounded(found.select("pc", "variance", "ratio", "cumulative", *(F.col("loadings")[i].alias(f"on_{m}") for i, m in enumerate(MEASURES))))


def inf_qq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(targets.normal_plot(tables.targets(spark, sf_dir), "file", "distance_to_ref"))


def geo_slope_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = targets.raster(tables.points(spark, sf_dir), SIDE)
    return rounded(targets.slopes(g), 5)


def geo_surface_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(targets.surface_stats(targets.raster(tables.points(spark, sf_dir), SIDE)), 5)


def win_focal_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(targets.roughness(targets.raster(tables.points(spark, sf_dir), SIDE), SIDE), 5)


def top_corr_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 100 pairs by distance."""
    from lidarloom.plans.strip_queries import two

    a, b = two(spark, sf_dir)
    return rounded(spatial.nearest(a, b, 0.2).orderBy(F.round("d", 9), "q").limit(100))


def top_nearest_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.targets(spark, sf_dir)
    w = Window.partitionBy("file")
    n = F.greatest(F.lit(2), F.floor(F.count("*").over(w) / 2))
    return t.withColumn("rn", F.row_number().over(w.orderBy("distance_to_ref", "reference_id"))).withColumn("n", n).where("rn <= n").select("file", "reference_id")


def flt_ref_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, refs = bright(spark, sf_dir)
    return targets.find(p, refs, intensity=-1.0).groupBy("strip").agg(F.count("*").alias("n"))


def smp_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 5000 points for a plot, by a seeded hash."""
    return tables.points(spark, sf_dir).orderBy(F.xxhash64("x", "y", "z", "intensity", F.lit(3))).limit(5000)


def selected(spark: SparkSession, sf_dir: str, points: DataFrame | None = None, keep: Callable[[str, DataFrame], DataFrame] = lambda _, df: scratch.written(df)) -> tuple[DataFrame, DataFrame]:
    """(cells, selected): the strips of ``terrain`` on the flagship's grid, and the cells that the three rules select; each is
    written down by ``keep``, as the stages "assign" and "select"."""
    p = tables.terrain(spark, sf_dir) if points is None else points
    q = strip_queries
    cells = keep("assign", strips.assign(p, strips.overlap(strips.bounds(p), q.BUFFER), q.ROWS, q.COLS))
    n = cells.groupBy("strip", "grid_id").agg(F.count("*").alias("n_points"))
    f = strips.entropies(cells, strips.ranges(cells, q.Z_PCT, q.I_PCT), q.Z_BINS, q.I_BINS, q.ALPHA).join(n, ["strip", "grid_id"])
    return cells, keep("select", strips.select(strips.scores(f, "F", "O", q.WEIGHTS), 0.05, 2))


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, own = selected(spark, sf_dir)
    return cells.join(F.broadcast(own.select("grid_id")), "grid_id", "left_semi")


def aligned(cells: DataFrame, results: DataFrame) -> DataFrame:
    """(grid_id, success, aligned): whether the middle of a cell's points is moved to within a voxel of where it belongs."""
    c = F.col
    middle = cells.where("strip = 'F'").groupBy("grid_id").agg(*(F.avg(a).alias(a) for a in "xyz"))
    moved = geometry.affine(c("x"), c("y"), c("z"), [c("transformation")[i] for i in range(16)])
    off = geometry.dist3d(*(m - (c(a) + v) for m, a, v in zip(moved, "xyz", tables.SHIFT, strict=True)))
    return results.join(middle, "grid_id").select("grid_id", "success", (off < 0.4).alias("aligned"))


#: The voxel that the strips are thinned to before a method registers them, where it isn't 0.4.
THINNED = {"teaser": 0.1}


def method_query(method: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return registration.register(chosen(spark, sf_dir), "F", "O", method, voxel=THINNED.get(method, 0.4))

    return run


def reg_p2plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected cells, each with whether it was registered onto the known shift."""
    cells = scratch.written(chosen(spark, sf_dir))
    return aligned(cells, registration.register(cells, "F", "O", "p2plane", voxel=0.4))


def truth(cells: DataFrame) -> DataFrame:
    """Results that move every cell by the known shift."""
    x, y, z = tables.SHIFT
    return cells.select("grid_id").distinct().select("grid_id", F.lit(True).alias("success"), F.array(*(F.lit(float(v)) for v in (1, 0, 0, x, 0, 1, 0, y, 0, 0, 1, z, 0, 0, 0, 1))).alias("transformation"))


def reg_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correspondences of the selected cells, each source moved by the known shift and matched in its own cell."""
    cells = chosen(spark, sf_dir)
    stored = registration.correspondences(cells, truth(cells), "F", "O", 0.3)
    off = geometry.dist3d(*(F.col(f"s{a}").cast("double") + v - F.col(f"t{a}") for a, v in zip("xyz", tables.SHIFT, strict=True)))
    return rounded(stored.withColumn("d", off).groupBy("grid_id").agg(F.count("*").alias("n_correspondences"), F.avg("d").alias("mae"), F.max("d").alias("worst")), 4)


def reg_icp_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one round of point-to-point matching sums in each selected cell, from the identity and the cell's mean on."""
    points = registration.identified(chosen(spark, sf_dir))
    side = lambda strip: points.where(F.col("strip") == strip)
    source = registration.as_source(side("F"))
    centres = source.groupBy("grid_id").agg(*(F.avg(a).alias(a) for a in "xyz")).collect()
    at = icp.moved(source, [(r["grid_id"], np.eye(4), r["x"], r["y"], r["z"]) for r in centres])
    sums = icp.step_sums(icp.nearest(at, registration.as_target(side("O")), 0.3), False, None)
    return rounded(sums, 3)


def geo_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.normals(tables.cloud(spark, sf_dir), 0.2, 30))


def la_kabsch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transforms.kabsch(pairs(spark, sf_dir), "grid_id")
    return rounded(found.select("grid_id", "n", *(F.col("transformation")[4 * i + j].alias(f"m{i}{j}") for i in range(3) for j in range(4))))


def la_clique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heaviest clique of each label's matches, a quarter of which are true."""
    found = transforms.clique_transforms(linked(spark, sf_dir), "grid_id", 0.02)
    off = F.greatest(*(F.abs(F.col("transformation")[i] - v) for i, v in enumerate(MATRIX)))
    return rounded(found.select("grid_id", "weight", F.array_join("members", " ").alias("members"), (off < 1e-6).alias("found")), 5)


def la_ransac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winning hypothesis over each label's matches, a quarter of which are true."""
    p = scratch.written(matching.numbered(linked(spark, sf_dir)))
    return matching.ransac(p, reach=0.05, batch=20_000).select("grid_id", "h", "inliers", "n", "drawn")


def geo_interp_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.targets(spark, sf_dir)
    return rounded(transforms.interpolate(t.select("file", F.col("center_x").alias("x"), F.col("center_y").alias("y"), F.col("center_z").alias("z")), "file", 20), 5)


def geo_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strips' surfaces at 12 x 12 nodes, from all points of ``terrain``: whether those not on the border, where the
    hull's slivers lie, are near the true heights."""
    p = tables.terrain(spark, sf_dir)
    near = transforms.interpolate(p.select("strip", "x", "y", "z"), "strip", 12)
    x, y, z = (F.when(F.col("strip") == "O", v).otherwise(0.0) for v in tables.SHIFT)
    u, v = F.col("x") - x, F.col("y") - y
    true = F.sin(u * 0.5) * 2 + F.cos(v * 0.4) * 2 + 0.8 * F.sin(u * 1.1 + v * 0.7) + z
    inner = F.col("i").between(1, 10) & F.col("j").between(1, 10)
    return near.groupBy("strip").agg(F.count("*").alias("nodes"), F.count_if(inner & F.col("z").isNotNull()).alias("inner"), (F.max(F.when(inner, F.abs(F.col("z") - true))) < 0.5).alias("close"))


def str_running_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(running.running_cells(tables.points(spark, sf_dir), 20.0), 5)


def str_windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(running.windowed_events(tables.table(spark, sf_dir, "events")), 4)


QUERIES = (geo_normals, la_kabsch, la_clique, geo_interp_linear, str_running_cells, str_windowed_events, geo_plane_fit, clu_kmeans, tgt_find, clu_target_analysis, jn_assignment, win_savgol, inf_bootstrap, mdl_expfit, mdl_pca, inf_qq, geo_slope_aspect, geo_surface_stats, win_focal_std, top_corr_cap, top_nearest_half, flt_ref_bbox, smp_plot, reg_store, reg_p2plane, reg_icp_sums, la_ransac, geo_surface)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"reg_{m}": method_query(m) for m in registration.METHODS} | {f.__name__: f for f in QUERIES}


SQL_RASTER = f"b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points), g AS (SELECT CAST(least(floor((y - y0) * {SIDE} / (y1 - y0)), {SIDE - 1}) AS BIGINT) AS i, CAST(least(floor((x - x0) * {SIDE} / (x1 - x0)), {SIDE - 1}) AS BIGINT) AS j, avg(z) AS z FROM points CROSS JOIN b GROUP BY ALL)"
SQL_ALONG = lambda v, part, order: f"coalesce((lead({v}) OVER (PARTITION BY {part} ORDER BY {order}) - lag({v}) OVER (PARTITION BY {part} ORDER BY {order})) / 2, lead({v}) OVER (PARTITION BY {part} ORDER BY {order}) - {v}, {v} - lag({v}) OVER (PARTITION BY {part} ORDER BY {order}))"
SQL_SLOPES = f"{SQL_RASTER}, g1 AS (SELECT *, {SQL_ALONG('z', 'i', 'j')} AS zx, {SQL_ALONG('z', 'j', 'i')} AS zy FROM g), g2 AS (SELECT *, {SQL_ALONG('zx', 'i', 'j')} AS zxx, {SQL_ALONG('zy', 'j', 'i')} AS zyy FROM g1), s AS (SELECT i, j, z, degrees(atan(sqrt(zx * zx + zy * zy))) AS slope, CASE WHEN atan2(zy, zx) < 0 THEN degrees(atan2(zy, zx)) + 360 ELSE degrees(atan2(zy, zx)) END AS aspect, zxx + zyy AS curvature FROM g2)"


def sql_planes(source: str, key: str) -> str:
    """CTEs up to ``pl``: the plane of each group of ``source(key, x, y, z)``. The least eigenvalue by the cubic's roots
    and two Newton steps, its vector by the longest cross product of two rows."""
    newton = lambda e: f"{e} - (({e} - t) * {e} * {e} + c * {e} - det) / nullif((3 * {e} - 2 * t) * {e} + c, 0)"
    return f"""m AS (SELECT {key}, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, var_samp(x) AS xx, var_samp(y) AS yy, var_samp(z) AS zz, covar_samp(x, y) AS xy, covar_samp(x, z) AS xz, covar_samp(y, z) AS yz FROM {source} GROUP BY {key} HAVING count(*) >= 3),
      m1 AS (SELECT *, xx + yy + zz AS t, xx * yy + xx * zz + yy * zz - xy * xy - xz * xz - yz * yz AS c, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) AS det FROM m),
      m2 AS (SELECT *, sqrt(greatest(t * t - 3 * c, 0)) / 3 AS h FROM m1), m3 AS (SELECT *, acos(greatest(-1, least(1, coalesce((2 * t * t * t - 9 * t * c + 27 * det) / nullif(54 * h * h * h, 0), 1)))) / 3 AS phi FROM m2),
      m4 AS (SELECT *, t / 3 + 2 * h * cos(phi + 2 * pi() / 3) AS e FROM m3), m5 AS (SELECT * REPLACE (coalesce({newton('e')}, e) AS e) FROM m4), m6 AS (SELECT * REPLACE (coalesce({newton('e')}, e) AS e) FROM m5),
      m7 AS (SELECT *, (t - e - sqrt(greatest((t - e) * (t - e) - 4 * (c - e * (t - e)), 0))) / 2 AS e1, [xy * yz - xz * (yy - e), xz * xy - (xx - e) * yz, (xx - e) * (yy - e) - xy * xy] AS a, [xy * (zz - e) - xz * yz, xz * xz - (xx - e) * (zz - e), (xx - e) * yz - xy * xz] AS b, [(yy - e) * (zz - e) - yz * yz, yz * xz - xy * (zz - e), xy * yz - (yy - e) * xz] AS d FROM m6),
      m8 AS (SELECT *, CASE greatest(list_dot_product(a, a), list_dot_product(b, b), list_dot_product(d, d)) WHEN list_dot_product(a, a) THEN a WHEN list_dot_product(b, b) THEN b ELSE d END AS v FROM m7),
      m9 AS (SELECT *, CASE WHEN v[3] < 0 THEN -1 ELSE 1 END / sqrt(list_dot_product(v, v)) AS k FROM m8),
      pl AS (SELECT {key}, n, cx, cy, cz, CASE WHEN e1 > 1e-8 THEN greatest(e, 0) / e1 ELSE 0 END AS planarity, v[1] * k AS nx, v[2] * k AS ny, v[3] * k AS nz, degrees(acos(least(1, v[3] * k))) AS angle FROM m9)"""


def sql_smooth(window: int, degree: int) -> str:
    """``win_savgol`` by least squares: the value at a row of the polynomial through its window, from a table of the
    hat matrices of all window sizes."""
    import numpy as np

    hats = []
    for n in range(1, window + 1, 2):
        b = np.vander(np.arange(n), min(n, degree + 1)).astype(float)
        q, _ = np.linalg.qr(b)
        hats += [f"({n}, {i}, {j}, {float(v)!r}::DOUBLE)" for (i, j), v in np.ndenumerate(q @ q.T)]
    return f"""WITH h AS (SELECT * FROM (VALUES {', '.join(hats)}) t(n, i, j, w)), o AS (SELECT file, reference_id, distance_to_ref AS v, row_number() OVER (PARTITION BY file ORDER BY reference_id) - 1 AS pos, count(*) OVER (PARTITION BY file) AS total FROM targets),
      s AS (SELECT *, least(total - 1 + total % 2, {window}) AS n FROM o), f AS (SELECT *, greatest(0, least(pos - n // 2, total - n)) AS start FROM s)
      SELECT f.file, f.reference_id, round(sum(h.w * g.v), 6) AS smooth FROM f JOIN h ON h.n = f.n AND h.i = f.pos - f.start JOIN o g ON g.file = f.file AND g.pos = f.start + h.j GROUP BY f.file, f.reference_id"""


def sql_selected() -> str:
    """The flagship's twin over the strips of ``terrain``, and its cells as ``cells``."""
    return strip_queries.oracle_sql()["select_regions"].replace(SQL_VIEWS["points"], SQL_VIEWS["terrain"])


def terrain(text: str) -> str:
    """``text`` with ``terrain`` in front of it as its points."""
    return f"WITH points AS ({SQL_VIEWS['terrain']}), {text}"


def sql_chosen() -> str:
    """CTEs up to ``ch``, the points of the cells that the flagship's twin selects."""
    return f"{strip_queries.SQL_CELLS}, sel AS (SELECT grid_id FROM ({sql_selected()}) q), ch AS (SELECT * FROM cells JOIN sel USING (grid_id))"


def sql_near(shift: tuple[float, float, float], reach: float) -> str:
    """CTE ``near``: each source of the chosen cells with its nearest target within ``reach`` once shifted."""
    d = " + ".join(f"power(s.{a} + {v} - t.{a}, 2)" for a, v in zip("xyz", shift, strict=True))
    return f"""c AS (SELECT *, row_number() OVER () AS pid FROM ch), near AS (SELECT s.grid_id, s.pid, min({d}) AS d2, arg_min(s.x, {d}) AS sx, arg_min(s.y, {d}) AS sy, arg_min(s.z, {d}) AS sz, arg_min(t.x, {d}) AS tx, arg_min(t.y, {d}) AS ty, arg_min(t.z, {d}) AS tz
      FROM c s JOIN c t ON s.grid_id = t.grid_id AND s.strip = 'F' AND t.strip = 'O' WHERE {d} < {reach * reach} GROUP BY s.grid_id, s.pid)"""


def sql_interpolated(side: int) -> str:
    """All triples of a file's targets whose circle is empty, and the heights of the nodes within them."""
    turn = lambda a, b, c: f"(({b}.x - {a}.x) * ({c}.y - {a}.y) - ({b}.y - {a}.y) * ({c}.x - {a}.x))"
    square = lambda p: f"(power({p}.x - q.x, 2) + power({p}.y - q.y, 2))"
    minor = lambda a, b: f"(({a}.x - q.x) * ({b}.y - q.y) - ({a}.y - q.y) * ({b}.x - q.x))"
    inside = f"({square('a')} * {minor('b', 'c')} + {square('b')} * {minor('c', 'a')} + {square('c')} * {minor('a', 'b')})"
    return f"""WITH t AS (SELECT file, center_x AS x, center_y AS y, avg(center_z) AS z FROM targets GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY x, y) AS k FROM t),
      tri AS (SELECT a.file, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS byy, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz, {turn('a', 'b', 'c')} AS area FROM k a JOIN k b ON b.file = a.file AND b.k > a.k JOIN k c ON c.file = a.file AND c.k > b.k JOIN k q ON q.file = a.file
        WHERE {turn('a', 'b', 'c')} <> 0 GROUP BY ALL HAVING max(CASE WHEN q.k IN (a.k, b.k, c.k) THEN -1 ELSE sign({turn('a', 'b', 'c')}) * {inside} END) <= 0),
      g AS (SELECT file, i, j, x0 + j * (x1 - x0) / {side - 1} AS x, y0 + i * (y1 - y0) / {side - 1} AS y FROM (SELECT file, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM t GROUP BY file) b CROSS JOIN range({side}) r(i) CROSS JOIN range({side}) s(j)),
      w AS (SELECT g.*, ((bx - g.x) * (cy - g.y) - (byy - g.y) * (cx - g.x)) / area AS u, ((cx - g.x) * (ay - g.y) - (cy - g.y) * (ax - g.x)) / area AS v, az, bz, cz FROM g JOIN tri ON tri.file = g.file),
      f AS (SELECT file, i, j, any_value(u * az + v * bz + (1 - u - v) * cz) AS z FROM w WHERE least(u, v, 1 - u - v) >= -1e-9 GROUP BY file, i, j)
      SELECT g.file, CAST(g.i AS INT) AS i, CAST(g.j AS INT) AS j, round(g.x, 5) AS x, round(g.y, 5) AS y, round(f.z, 5) AS z FROM g LEFT JOIN f ON f.file = g.file AND f.i = g.i AND f.j = g.j"""


def sql_ransac(draws: int, reach: float, edges: float) -> str:
    """Every hypothesis of the first ``draws`` outright, in plain arithmetic."""
    k3, ax = range(3), "xyz"
    draw = lambda k: f"('0x' || substr(md5('0|' || grid_id || '|' || h || '|{k}'), 1, 8))::BIGINT % n"
    dot = lambda a, b: "(" + " + ".join(f"{a}{v} * {b}{v}" for v in ax) + ")"
    edge = lambda s, i, j: "sqrt(" + " + ".join(f"power(p{i}.{s}{v} - p{j}.{s}{v}, 2)" for v in ax) + ")"
    ok = " AND ".join(f"least({edge('s', i, j)}, {edge('t', i, j)}) > 0 AND least({edge('s', i, j)}, {edge('t', i, j)}) >= {edges} * greatest({edge('s', i, j)}, {edge('t', i, j)})" for i, j in ((0, 1), (1, 2), (2, 0)))
    a1 = ", ".join(f"(p1.{s}{v} - p0.{s}{v}) / {edge(s, 0, 1)} AS {s}a{v}, p2.{s}{v} - p0.{s}{v} AS {s}b{v}, (p0.{s}{v} + p1.{s}{v} + p2.{s}{v}) / 3 AS {s}m{v}" for s in "st" for v in ax)
    points = ", ".join(f"p{k}.{s}{v} AS {s}{v}{k}" for k in k3 for s in "st" for v in ax)
    a2 = ", ".join(f"{s}b{v} - {dot(f'{s}b', f'{s}a')} * {s}a{v} AS {s}c{v}" for s in "st" for v in ax)
    a3 = ", ".join(f"{s}c{v} / sqrt({dot(f'{s}c', f'{s}c')}) AS {s}d{v}" for s in "st" for v in ax)
    a4 = ", ".join(f"{s}a{ax[(i + 1) % 3]} * {s}d{ax[(i + 2) % 3]} - {s}a{ax[(i + 2) % 3]} * {s}d{ax[(i + 1) % 3]} AS {s}e{v}" for s in "st" for i, v in enumerate(ax))
    r = ", ".join(f"ta{v} * sa{w} + td{v} * sd{w} + te{v} * se{w} AS r{v}{w}" for v in ax for w in ax)
    u = ", ".join(f"tm{v} - {dot(f'r{v}', 'sm')} AS u{v}" for v in ax)
    off = lambda k: "sqrt(" + " + ".join(f"power({' + '.join(f'r{v}{w} * s{w}{k}' for w in ax)} + u{v} - t{v}{k}, 2)" for v in ax) + ")"
    hit = " + ".join(f"power({' + '.join(f'f.r{v}{w} * p.s{w}' for w in ax)} + f.u{v} - p.t{v}, 2)" for v in ax)
    return f"""WITH {SQL_LINKED}, h AS (SELECT *, {', '.join(f'{draw(k)} AS k{k}' for k in k3)} FROM (SELECT DISTINCT grid_id, n FROM p WHERE n >= 3) g CROSS JOIN range({draws}) r(h)),
      f1 AS (SELECT h.grid_id, h.h, h.n, {points}, {a1} FROM h JOIN p p0 ON p0.grid_id = h.grid_id AND p0.rn = k0 JOIN p p1 ON p1.grid_id = h.grid_id AND p1.rn = k1 JOIN p p2 ON p2.grid_id = h.grid_id AND p2.rn = k2 WHERE k0 <> k1 AND k1 <> k2 AND k0 <> k2 AND {ok}),
      f2 AS (SELECT *, {a2} FROM f1), f3 AS (SELECT *, {a3} FROM f2 WHERE {dot('sc', 'sc')} > 1e-18 AND {dot('tc', 'tc')} > 1e-18), f4 AS (SELECT *, {a4} FROM f3), f5 AS (SELECT *, {r} FROM f4), f6 AS (SELECT *, {u} FROM f5), f AS (SELECT * FROM f6 WHERE {' AND '.join(f'{off(k)} < {reach}' for k in k3)}),
      s AS (SELECT f.grid_id, f.h, f.n, count(*) AS inliers FROM f JOIN p ON p.grid_id = f.grid_id WHERE {hit} < {reach * reach} GROUP BY f.grid_id, f.h, f.n)
      SELECT grid_id, h, inliers, n, CAST({draws} AS BIGINT) AS drawn FROM (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY inliers DESC, h) AS place FROM s) q WHERE place = 1"""


def sql_clique(tolerance: float) -> str:
    """Every clique outright, grown by one match at a time."""
    d = lambda s: "sqrt(" + " + ".join(f"power(a.{s}{v} - b.{s}{v}, 2)" for v in "xyz") + ")"
    w = f"1 - power(({d('s')} - {d('t')}) / {tolerance}, 2)"
    return f"""WITH RECURSIVE {SQL_LINKED}, e AS (SELECT a.grid_id, a.rn AS a, b.rn AS b, {w} AS w FROM p a JOIN p b ON a.grid_id = b.grid_id AND a.rn <> b.rn WHERE {w} >= 0.99),
      e2 AS (SELECT x.grid_id, x.a, x.b, any_value(x.w) * sum(y.w * z.w) AS w2 FROM e x JOIN e y ON y.grid_id = x.grid_id AND y.a = x.a JOIN e z ON z.grid_id = x.grid_id AND z.a = y.b AND z.b = x.b GROUP BY ALL),
      k AS (SELECT grid_id, [a, b] AS m, 2 * w2 AS weight FROM e2 WHERE a < b
        UNION ALL SELECT k.grid_id, list_append(k.m, e2.b), any_value(k.weight) + 2 * sum(e2.w2) FROM k JOIN e2 ON e2.grid_id = k.grid_id AND list_contains(k.m, e2.a) AND e2.b > k.m[-1] GROUP BY k.grid_id, k.m, e2.b HAVING count(*) = len(k.m))
      SELECT grid_id, round(weight, 5) AS weight, array_to_string(m, ' ') AS members, true AS found FROM (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY round(weight, 9) DESC, m) AS place FROM k WHERE len(m) >= 3) q WHERE place = 1"""


def sql_leading(source: str, name: str, squarings: int = 40) -> str:
    """CTE ``name(own, i, j, v)``: v v' of the leading eigenvector v of each symmetric, positive matrix ``source(own, i, j,
    v)``, which squaring the matrix over and over leaves."""
    product = "sum(a.v * b.v)"
    return f"""{name}_all AS (SELECT own, i, j, v / sum(CASE WHEN i = j THEN v END) OVER (PARTITION BY own) AS v, 0 AS step FROM {source}
      UNION ALL SELECT a.own, a.i, b.j, {product} / sum(CASE WHEN a.i = b.j THEN {product} END) OVER (PARTITION BY a.own), a.step + 1 FROM {name}_all a JOIN {name}_all b ON a.own = b.own AND a.j = b.i WHERE a.step < {squarings} GROUP BY a.own, a.i, b.j, a.step),
      {name} AS (SELECT own, i, j, v FROM {name}_all WHERE step = {squarings})"""


def sql_kabsch() -> str:
    """The rotation by the unit quaternion that maximises the overlap, from a 4 x 4 matrix of the cross-covariances."""
    s = lambda a, b: f"s{a}{b}"
    skew = {1: ("y", "z"), 2: ("z", "x"), 3: ("x", "y")}
    entry = {(0, 0): "sxx + syy + szz"}
    for k, (a, b) in skew.items():
        entry[0, k] = f"{s(a, b)} - {s(b, a)}"
        own = "xyz"[k - 1]
        entry[k, k] = f"2 * {s(own, own)} - (sxx + syy + szz)"
    for (i, j), (a, b) in {(1, 2): ("x", "y"), (1, 3): ("x", "z"), (2, 3): ("y", "z")}.items():
        entry[i, j] = f"{s(a, b)} + {s(b, a)}"
    large = "2 * (" + " + ".join(f"abs(s{a}{b})" for a in "xyz" for b in "xyz") + ")"
    rows = " UNION ALL ".join(f"SELECT grid_id AS own, {i} AS i, {j} AS j, {entry[min(i, j), max(i, j)]}{f' + {large}' if i == j else ''} AS v FROM c" for i in range(4) for j in range(4))
    q = lambda i, j: f"max(CASE WHEN i = {min(i, j)} AND j = {max(i, j)} THEN v END)"
    turn = {}
    for a in range(3):
        b, c = (a + 1) % 3, (a + 2) % 3
        turn[a, a] = f"{q(0, 0)} + {q(a + 1, a + 1)} - {q(b + 1, b + 1)} - {q(c + 1, c + 1)}"
        turn[a, b] = f"2 * ({q(a + 1, b + 1)} - {q(0, c + 1)})"
        turn[b, a] = f"2 * ({q(a + 1, b + 1)} + {q(0, c + 1)})"
    shift = lambda i: f"ct{'xyz'[i]} - (" + " + ".join(f"r{i}{j} * cs{'xyz'[j]}" for j in range(3)) + ")"
    sums = ", ".join([f"avg({e}{a}) AS c{e}{a}" for e in "st" for a in "xyz"] + [f"covar_pop(s{a}, t{b}) AS s{a}{b}" for a in "xyz" for b in "xyz"])
    return f"""WITH RECURSIVE p AS ({SQL_PAIRS}), c AS (SELECT grid_id, count(*) AS n, {sums} FROM p GROUP BY grid_id HAVING count(*) >= 3), h AS ({rows}), {sql_leading('h', 'l')},
      r AS (SELECT own AS grid_id, {', '.join(f'{v} AS r{i}{j}' for (i, j), v in turn.items())} FROM l GROUP BY own)
      SELECT grid_id, n, {', '.join(f'round({shift(i) if j == 3 else f"r{i}{j}"}, 6) AS m{i}{j}' for i in range(3) for j in range(4))} FROM c JOIN r USING (grid_id)"""


def sql_components() -> str:
    """One component after the other, each taken off the correlations before the next."""
    k = len(MEASURES)
    cells = " UNION ALL ".join(f"SELECT 0 AS own, {i} AS i, {j} AS j, {'max(1.0::DOUBLE)' if i == j else f'corr({MEASURES[i]}, {MEASURES[j]})'} AS v FROM points" for i in range(k) for j in range(k))
    ctes = [f"m0 AS ({cells})"]
    for c in range(k):
        ctes += [sql_leading(f"m{c}", f"l{c}"), f"w{c} AS (SELECT sum(m.v * l.v) AS w FROM m{c} m JOIN l{c} l USING (i, j))"]
        ctes.append(f"p{c} AS (SELECT {c + 1} AS pc, w, i, v / sqrt((SELECT max(v) FROM l{c} WHERE i = j)) AS v FROM l{c} CROSS JOIN w{c} WHERE j = (SELECT arg_max(i, v) FROM l{c} WHERE i = j))")
        ctes.append(f"m{c + 1} AS (SELECT 0 AS own, i, j, m.v - w * l.v AS v FROM m{c} m JOIN l{c} l USING (i, j) CROSS JOIN w{c})")
    loads = ", ".join(f"max(CASE WHEN i = {i} THEN v * sqrt(w) END) AS on_{m}" for i, m in enumerate(MEASURES))
    names = ", ".join(f"round(on_{m}, 6) AS on_{m}" for m in MEASURES)
    return f"""WITH RECURSIVE points AS ({SQL_VIEWS['points']}), {', '.join(ctes)}, u AS ({' UNION ALL '.join(f'SELECT * FROM p{c}' for c in range(k))}), g AS (SELECT pc, max(w) AS w, {loads} FROM u GROUP BY pc)
      SELECT pc, round(w, 6) AS variance, round(w / sum(w) OVER (), 6) AS ratio, round(sum(w) OVER (ORDER BY pc) / sum(w) OVER (), 6) AS cumulative, {names} FROM g"""


def oracle_sql() -> dict[str, str]:
    p = lambda text: with_views("WITH " + text, ["points"])
    return {
        "geo_surface": with_views("SELECT strip, CAST(144 AS BIGINT) AS nodes, CAST(100 AS BIGINT) AS inner, true AS close FROM terrain GROUP BY strip", ["terrain"]),
        "geo_interp_linear": with_views(sql_interpolated(20), ["targets"]),
        "la_kabsch": sql_kabsch(),
        "mdl_pca": sql_components(),
        "la_ransac": sql_ransac(20_000, 0.05, 0.9),
        "la_clique": sql_clique(0.02),
        "reg_p2plane": f"SELECT grid_id, true AS success, true AS aligned FROM ({sql_selected()}) q",
        "reg_store": terrain(f"{sql_chosen()}, {sql_near(tables.SHIFT, 0.3)} SELECT grid_id, count(*) AS n_correspondences, round(avg(sqrt(d2)), 4) AS mae, round(max(sqrt(d2)), 4) AS worst FROM near GROUP BY grid_id"),
        "reg_icp_sums": terrain(f"""{sql_chosen()}, {sql_near((0, 0, 0), 0.3)}, m AS (SELECT grid_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM ch WHERE strip = 'F' GROUP BY grid_id), q AS (SELECT *, {', '.join(f's{a} - c{a} AS s{i}, t{a} - c{a} AS t{i}' for i, a in enumerate('xyz'))} FROM near JOIN m USING (grid_id))
          SELECT grid_id, count(*) AS n, round(sum(d2), 3) AS d2, {', '.join(f'round(sum({k}{i}), 3) AS {k}{i}' for k in 'st' for i in range(3))}, {', '.join(f'round(sum(s{i} * t{j}), 3) AS c{i}{j}' for i in range(3) for j in range(3))} FROM q GROUP BY grid_id"""),
        "tgt_find": with_views("SELECT strip, count(*) AS n, round(max(z), 6) AS top FROM points WHERE x BETWEEN 10 AND 90 AND y BETWEEN 10 AND 100 AND intensity > 150 AND z < 12 GROUP BY strip", ["points"]),
        "flt_ref_bbox": with_views("SELECT strip, count(*) AS n FROM points WHERE x BETWEEN 10 AND 90 AND y BETWEEN 10 AND 100 GROUP BY strip", ["points"]),
        "top_nearest_half": with_views("SELECT file, reference_id FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY distance_to_ref, reference_id) AS rn, count(*) OVER (PARTITION BY file) AS n FROM targets) t WHERE rn <= greatest(2, n // 2)", ["targets"]),
        "top_corr_cap": with_views("SELECT q, p, round(d, 6) AS d FROM (SELECT * FROM (SELECT a.pid AS q, b.pid AS p, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d, row_number() OVER (PARTITION BY a.pid ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), b.pid) AS rk FROM cloud a, cloud b WHERE a.strip = 0 AND b.strip = 1) t WHERE rk = 1 AND d < 0.2 ORDER BY round(d, 9), q LIMIT 100) u", ["cloud"]),
        "geo_slope_aspect": p(f"{SQL_SLOPES} SELECT i, j, round(z, 5) AS z, round(slope, 5) AS slope, round(aspect, 5) AS aspect, round(curvature, 5) AS curvature FROM s"),
        "geo_surface_stats": p(f"{SQL_SLOPES} SELECT " + ", ".join(f"round({f}({c}), 5) AS {c}_{n}" for c in ("z", "slope", "curvature") for n, f in (("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "stddev_pop"))) + " FROM s"),
        "win_focal_std": p(f"{SQL_RASTER}, o AS (SELECT unnest(range(-2, 3)) AS d), w AS (SELECT g.i, g.j, g.i + a.d AS ni, g.j + b.d AS nj FROM g, o a, o b), f AS (SELECT i, j, CASE WHEN ni < 0 THEN -ni - 1 WHEN ni >= {SIDE} THEN {2 * SIDE - 1} - ni ELSE ni END AS ni, CASE WHEN nj < 0 THEN -nj - 1 WHEN nj >= {SIDE} THEN {2 * SIDE - 1} - nj ELSE nj END AS nj FROM w) SELECT f.i, f.j, round(stddev_pop(g.z), 5) AS roughness FROM f JOIN g ON f.ni = g.i AND f.nj = g.j GROUP BY f.i, f.j"),
        "str_running_cells": with_views("SELECT strip, CAST(floor(x / 20.0) AS BIGINT) AS cx, CAST(floor(y / 20.0) AS BIGINT) AS cy, count(*) AS n, round(avg(z), 5) AS z_mean, round(stddev_pop(z), 5) AS z_std, round(min(z), 5) AS z_min, round(max(z), 5) AS z_max FROM points GROUP BY ALL", ["points"]),
        "inf_bootstrap": with_views("WITH u AS (SELECT file, distance_to_ref AS v, rep, (('0x' || substr(md5('7|' || file || '|' || reference_id || '|' || rep), 1, 8))::BIGINT + 0.5) / 4294967296.0 AS u FROM targets CROSS JOIN range(1000) r(rep)), k AS (SELECT *, " + " + ".join(f"CASE WHEN u > {c!r} THEN 1 ELSE 0 END" for c in targets.POISSON) + " AS k FROM u), m AS (SELECT file, rep, sum(k * v) / nullif(sum(k), 0) AS m FROM k GROUP BY file, rep) SELECT file, round(quantile_cont(m, 0.025), 6) AS lower, round(quantile_cont(m, 0.975), 6) AS upper FROM m GROUP BY file", ["targets"]),
        "inf_qq": with_views(f"""SELECT file, round(distance_to_ref, 6) AS distance_to_ref, round(z, 6) AS quantile FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY distance_to_ref) AS i, count(*) OVER (PARTITION BY file) AS n FROM targets) t
          JOIN (VALUES {", ".join(f"({n}, {i}, {NormalDist().inv_cdf((i - 0.5) / n)!r}::DOUBLE)" for n in range(1, NATIONS + 1) for i in range(1, n + 1))}) k(kn, ki, z) ON kn = n AND ki = i""", ["targets"]),
        "win_savgol": with_views(sql_smooth(11, 3), ["targets"]),
        "geo_plane_fit": with_views(f"WITH {sql_planes('cloud', 'cluster')} SELECT cluster, n, " + ", ".join(f"round({v}, 6) AS {v}" for v in ("cx", "cy", "cz", "planarity", "nx", "ny", "nz", "angle")) + " FROM pl", ["cloud"]),
        "geo_normals": with_views(f"WITH nr AS (SELECT * FROM (SELECT a.pid, b.x, b.y, b.z, row_number() OVER (PARTITION BY a.pid ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), b.pid) AS rk FROM cloud a, cloud b WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= 0.2) t WHERE rk <= 30), {sql_planes('nr', 'pid')} SELECT pid, " + ", ".join(f"round({v}, 6) AS {v}" for v in ("planarity", "nx", "ny", "nz")) + " FROM pl", ["cloud"]),
        "str_windowed_events": "SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    }
