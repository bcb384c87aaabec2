"""Queries of the strip, grid, selection and neighbour layer, with their twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lidarloom.functions import geometry
from lidarloom.operators import clustering, spatial, strips
from lidarloom.plans.fusion_queries import rounded
from lidarloom.plans.views import with_views
from lidarloom.sources import tables

ROWS, COLS, BUFFER, Z_BINS, I_BINS, ALPHA = 8, 8, 10.0, 20, 30, 1.0
Z_PCT, I_PCT, WEIGHTS = (0.01, 99.99), (0.0, 99.5), (0.4, 0.4, 0.2)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.points(spark, sf_dir)
    return strips.assign(p, strips.overlap(strips.bounds(p), BUFFER), ROWS, COLS)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    n = c.groupBy("strip", "grid_id").agg(F.count("*").alias("n_points"))
    return strips.entropies(c, strips.ranges(c, Z_PCT, I_PCT), Z_BINS, I_BINS, ALPHA).join(n, ["strip", "grid_id"])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strips.scores(features(spark, sf_dir), "F", "O", WEIGHTS)


def geo_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(strips.overlap(strips.bounds(tables.points(spark, sf_dir)), BUFFER))


def geo_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.points(spark, sf_dir)
    g = strips.grid(strips.overlap(strips.bounds(p), BUFFER), ROWS, COLS)
    return rounded(g.select("gx0", "gx1", "gy0", "gy1", "cell_width", "cell_height", "cell_area", "total_cells", F.element_at("x_edges", 3).alias("x_edge_2"), F.element_at("y_edges", -1).alias("y_edge_last")))


def prj_decenter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cells(spark, sf_dir).groupBy("strip").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z")))


def prj_grid_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).groupBy("strip", "grid_id").agg(F.count("*").alias("n_points"))


def agg_cell_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(strips.stats(cells(spark, sf_dir)), 5)


def agg_percentile_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(strips.ranges(cells(spark, sf_dir), Z_PCT, I_PCT))


def agg_hist1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    h = cells(spark, sf_dir).select("strip", "grid_id", strips.bin_of(c("intensity"), F.lit(100.0), F.lit(1500.0), I_BINS).alias("bin"))
    return h.where("bin IS NOT NULL").groupBy("strip", "grid_id", "bin").agg(F.count("*").alias("n"))


def agg_hist2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    h = tables.points(spark, sf_dir).select("strip", strips.bin_of(c("x"), F.lit(10.0), F.lit(90.0), Z_BINS).alias("xb"), strips.bin_of(c("intensity"), F.lit(100.0), F.lit(1500.0), I_BINS).alias("ib"))
    return h.where("xb IS NOT NULL AND ib IS NOT NULL").groupBy("strip", "xb", "ib").agg(F.count("*").alias("n"))


def agg_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features(spark, sf_dir))


def score_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scored(spark, sf_dir))


def jn_common_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("grid_id", "strip1_points", "strip2_points")


def select_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(strips.select(scored(spark, sf_dir), 0.05, 2).select("grid_id", "composite_score", "total_points", "selection_rank"))


def sel_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lengths of the three rules' prefixes over the regions' scores."""
    r = tables.regions(spark, sf_dir).select("grid_id", F.round("composite_score", 9).alias("composite_score"))
    return strips.selection_sizes(r, 3)


def sel_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.regions(spark, sf_dir)
    strict = strips.valid_cells(r, 1e9, 2, True).agg(F.count("*").alias("n_strict"))
    lax = strips.valid_cells(r, 1e9, 2, False).agg(F.count("*").alias("n_lax"))
    return strict.crossJoin(lax)


def jn_cell_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the selected cells only: a broadcast semi-join ahead of any kernel."""
    chosen = strips.select(scored(spark, sf_dir), 0.05, 2).select("grid_id")
    return cells(spark, sf_dir).join(F.broadcast(chosen), "grid_id", "left_semi").groupBy("strip", "grid_id").agg(F.count("*").alias("n_points"))


def smp_region_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 50 points of each cell and strip, by a seeded hash."""
    h = F.xxhash64("x", "y", "z", "intensity", F.lit(42))
    s = cells(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy("strip", "grid_id").orderBy(h, "x", "intensity")))
    return s.where("rn <= 50").groupBy("strip", "grid_id").agg(F.count("*").alias("n"))


def two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = tables.cloud(spark, sf_dir)
    return c.where("strip = 0"), c.where("strip = 1")


def jn_nn1(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two(spark, sf_dir)
    return rounded(spatial.nearest(a, b, 0.1))


def jn_mutual_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two(spark, sf_dir)
    return rounded(spatial.mutual_nearest(a, b, 0.1))


def jn_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two(spark, sf_dir)
    return rounded(spatial.within(a, b, 0.08))


def flt_nn_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two(spark, sf_dir)
    return spatial.nearest(a, b, 0.05).agg(F.count("*").alias("n"), F.round(F.max("d"), 6).alias("farthest"))


def geo_voxel_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spatial.voxel_down(tables.cloud(spark, sf_dir), 0.1, ["strip"])
    return rounded(v.select("strip", "vx", "vy", "vz", "x", "y", "z", "n"))


def out_lof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.lof(tables.cloud(spark, sf_dir)), 5)


def out_mahalanobis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.mahalanobis(tables.points(spark, sf_dir), ["r", "g", "b"]))


def geo_fpfh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature histograms of the cloud, under the directions that each vector's next three components give."""
    e = [F.col("embedding")[i].cast("double") for i in (3, 4, 5)]
    length = F.sqrt(e[0] * e[0] + e[1] * e[1] + e[2] * e[2])
    n = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), *((v / length).alias(a) for v, a in zip(e, ("nx", "ny", "nz"), strict=True)))
    return rounded(spatial.fpfh(tables.cloud(spark, sf_dir).join(n, "pid"), 0.12))


def out_color_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.cloud(spark, sf_dir).withColumns({"r": F.col("x") * 10, "g": F.col("y") * 10, "b": F.col("z") * 10})
    return spatial.colour_consistent(c, c.where("cluster = 3"), 0.12, 1.0, least=3)


def jn_cosine_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's most similar vector of its own label; the queries are the rows whose id 50 divides, against all."""
    e = tables.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    norm = e.withColumn("n", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    q = norm.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "label", F.col("v").alias("qv"), F.col("n").alias("qn"))
    dot = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    s = norm.join(q, "label").where("q <> vec_id").select("q", "vec_id", (dot / F.col("qn") / F.col("n")).alias("s"))
    return rounded(s.groupBy("q").agg(F.max(F.struct("s", "vec_id")).alias("m")).select("q", F.col("m.vec_id").alias("p"), F.col("m.s").alias("similarity")))


def prj_strip_id_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.table(spark, sf_dir, "pages").select("page_id", geometry.strip_number(F.split("url", r"[?#]")[0]).alias("strip_id"))
    return p


def prj_mem_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "supplier").select("s_suppkey", geometry.memory_text(F.col("s_suppkey") * 37.0 + 0.26).alias("memory"))


def clu_single_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.targets(spark, sf_dir).select((F.col("reference_id") * 2 + F.when(F.col("file") == "customer", 0).otherwise(1)).alias("id"), F.col("center_x").alias("x"), F.col("center_y").alias("y"), F.col("center_z").alias("z"))
    return rounded(clustering.single_linkage(t, 0.25))


def inf_t_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.targets(spark, sf_dir)
    return rounded(clustering.mean_interval(t, "file", "distance_to_ref", 0.95))


def inf_kde(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.targets(spark, sf_dir).select(F.col("center_x").alias("x"), F.col("center_y").alias("y"))
    return rounded(clustering.kde(t, 10))


QUERIES = (
    geo_overlap, geo_grid, prj_decenter, prj_grid_id, agg_cell_stats, agg_percentile_global, agg_hist1d, agg_hist2d, agg_entropy, score_composite, jn_common_grids, select_regions, sel_sizes, sel_fallback, jn_cell_extract, smp_region_cap,
    jn_nn1, jn_mutual_nn, jn_radius, flt_nn_distance, geo_voxel_down, out_lof, out_mahalanobis, geo_fpfh, out_color_mad, jn_cosine_nn, prj_strip_id_regex, prj_mem_format, clu_single_linkage, inf_t_ci, inf_kde,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


SQL_CELLS = f"""b AS (SELECT strip, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max FROM points GROUP BY strip),
  o AS (SELECT max(x_min) - {BUFFER} AS x0, min(x_max) + {BUFFER} AS x1, max(y_min) - {BUFFER} AS y0, min(y_max) + {BUFFER} AS y1, (max(x_min) + min(x_max)) / 2 AS cx, (max(y_min) + min(y_max)) / 2 AS cy, (min(z_min) + max(z_max)) / 2 AS cz,
    (min(x_max) - max(x_min)) * (min(y_max) - max(y_min)) AS original_area FROM b),
  cells AS (SELECT strip, x - cx AS x, y - cy AS y, z - cz AS z, intensity, CAST(least(greatest(floor(((y - cy) - (y0 - cy)) / ((y1 - cy - (y0 - cy)) / {ROWS})), 0), {ROWS - 1}) * {COLS} + least(greatest(floor(((x - cx) - (x0 - cx)) / ((x1 - cx - (x0 - cx)) / {COLS})), 0), {COLS - 1}) AS BIGINT) AS grid_id
    FROM points CROSS JOIN o WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)"""
SQL_RANGE = f"rng AS (SELECT quantile_cont(z, {Z_PCT[0] / 100}) AS z_lo, quantile_cont(z, {Z_PCT[1] / 100}) AS z_hi, quantile_cont(intensity, {I_PCT[0] / 100}) AS i_lo, quantile_cont(intensity, {I_PCT[1] / 100}) AS i_hi FROM cells)"
SQL_FEATURES = f"""{SQL_CELLS}, {SQL_RANGE},
  binned AS (SELECT strip, grid_id, CASE WHEN z BETWEEN z_lo AND z_hi THEN CAST(least(floor((z - z_lo) * {Z_BINS} / (z_hi - z_lo)), {Z_BINS - 1}) AS INT) END AS zb, CASE WHEN intensity BETWEEN i_lo AND i_hi THEN CAST(least(floor((intensity - i_lo) * {I_BINS} / (i_hi - i_lo)), {I_BINS - 1}) AS INT) END AS ib FROM cells CROSS JOIN rng),
  k AS (SELECT strip, grid_id, count(*) AS n_points FROM cells GROUP BY ALL),
  zs AS (SELECT k.strip, k.grid_id, s.zb, {ALPHA} + count(b.zb) AS c FROM k CROSS JOIN (SELECT unnest(range({Z_BINS}))::INT AS zb) s LEFT JOIN binned b ON b.strip = k.strip AND b.grid_id = k.grid_id AND b.zb = s.zb GROUP BY ALL),
  i_s AS (SELECT k.strip, k.grid_id, s.ib, {ALPHA} + count(b.ib) AS c FROM k CROSS JOIN (SELECT unnest(range({I_BINS}))::INT AS ib) s LEFT JOIN binned b ON b.strip = k.strip AND b.grid_id = k.grid_id AND b.ib = s.ib GROUP BY ALL),
  zp AS (SELECT *, c / sum(c) OVER (PARTITION BY strip, grid_id) AS p FROM zs), ip AS (SELECT *, c / sum(c) OVER (PARTITION BY strip, grid_id) AS p FROM i_s),
  jc AS (SELECT strip, grid_id, zb, ib, count(*) AS n FROM binned WHERE zb IS NOT NULL AND ib IS NOT NULL GROUP BY ALL),
  js AS (SELECT zp.strip, zp.grid_id, zp.p AS q, ip.p AS r, {ALPHA} + coalesce(jc.n, 0) AS c FROM zp JOIN ip ON zp.strip = ip.strip AND zp.grid_id = ip.grid_id LEFT JOIN jc ON jc.strip = zp.strip AND jc.grid_id = zp.grid_id AND jc.zb = zp.zb AND jc.ib = ip.ib),
  jp AS (SELECT *, c / sum(c) OVER (PARTITION BY strip, grid_id) AS p FROM js),
  mi AS (SELECT strip, grid_id, sum(p * ln(p / (q * r))) AS mi FROM jp GROUP BY ALL), he AS (SELECT strip, grid_id, -sum(p * ln(p)) AS h FROM zp GROUP BY ALL), ie AS (SELECT strip, grid_id, -sum(p * ln(p)) AS h FROM ip GROUP BY ALL),
  f AS (SELECT k.strip, k.grid_id, k.n_points, he.h AS z_entropy, ie.h AS intensity_entropy, mi.mi AS mutual_information, 2 * mi.mi / (he.h + ie.h) AS normalized_mutual_information, he.h / ln({Z_BINS}) AS z_entropy_norm, ie.h / ln({I_BINS}) AS intensity_entropy_norm
    FROM k JOIN he USING (strip, grid_id) JOIN ie USING (strip, grid_id) JOIN mi USING (strip, grid_id))"""
SQL_SCORES = f"""{SQL_FEATURES},
  sc AS (SELECT a.grid_id, a.n_points AS strip1_points, b.n_points AS strip2_points, a.z_entropy_norm AS strip1_z_entropy_norm, a.intensity_entropy_norm AS strip1_intensity_entropy_norm, a.normalized_mutual_information AS strip1_nmi, b.z_entropy_norm AS strip2_z_entropy_norm, b.intensity_entropy_norm AS strip2_intensity_entropy_norm, b.normalized_mutual_information AS strip2_nmi,
    a.n_points + b.n_points AS total_points, {WEIGHTS[0]} * (a.z_entropy_norm + b.z_entropy_norm) / 2 AS hc, {WEIGHTS[1]} * (a.intensity_entropy_norm + b.intensity_entropy_norm) / 2 AS ic, {WEIGHTS[2]} * (a.normalized_mutual_information + b.normalized_mutual_information) / 2 AS mc,
    2.0 * least(a.n_points, b.n_points) / (a.n_points + b.n_points) AS dbf FROM f a JOIN f b ON a.grid_id = b.grid_id AND a.strip = 'F' AND b.strip = 'O'),
  s AS (SELECT *, dbf * (hc + ic + mc) AS composite_score FROM sc)"""


def sql_sizes(source: str, col: str, least: int) -> str:
    """CTEs up to ``ks(n, k_elbow, k_threshold, k_gap)`` over the scores of ``source``."""
    return f"""o1 AS (SELECT *, row_number() OVER (ORDER BY {col} DESC, grid_id) AS rk, lag({col}) OVER (ORDER BY {col} DESC, grid_id) AS pv, lead({col}) OVER (ORDER BY {col} DESC, grid_id) AS nx, count(*) OVER () AS n, max({col}) OVER () - min({col}) OVER () + 1e-8 AS span, max({col}) OVER () AS top FROM {source}),
  o2 AS (SELECT *, CASE WHEN pv IS NULL OR nx IS NULL THEN 0 ELSE abs(pv - 2 * {col} + nx) / span END AS cv, nx - {col} AS dr FROM o1),
  o3 AS (SELECT *, 0.5 * stddev_pop(cv) OVER () AS ht, abs(avg(dr) OVER ()) + stddev_pop(dr) OVER () AS gp, lag(cv) OVER (ORDER BY rk) AS cp, lead(cv) OVER (ORDER BY rk) AS cn FROM o2),
  ks AS (SELECT max(n) AS n, CASE WHEN max(n) < 3 THEN max(n) WHEN min(CASE WHEN cp < cv AND cn < cv AND cv >= ht THEN rk END) IS NULL THEN least(greatest({least}, CAST(floor(max(n) * 0.3) AS BIGINT)), max(n)) ELSE least(greatest(min(CASE WHEN cp < cv AND cn < cv AND cv >= ht THEN rk END) - 1, {least}), max(n)) END AS k_elbow,
    count(CASE WHEN {col} >= 0.8 * top THEN 1 END) AS k_threshold, CASE WHEN max(n) < 2 THEN max(n) WHEN min(CASE WHEN abs(dr) > gp THEN rk END) IS NULL THEN least(greatest({least}, max(n) // 4), max(n)) ELSE least(greatest(min(CASE WHEN abs(dr) > gp THEN rk END), {least}), max(n)) END AS k_gap FROM o3)"""


def oracle_sql() -> dict[str, str]:
    p = lambda text: with_views("WITH " + text, ["points"])
    c = lambda text: with_views(text, ["cloud"])
    d = lambda a, b: f"sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y) + ({a}.z - {b}.z) * ({a}.z - {b}.z))"
    pairs = f"pr AS (SELECT a.pid AS q, b.pid AS p, {d('a', 'b')} AS d FROM cloud a, cloud b WHERE a.strip = 0 AND b.strip = 1)"
    knn = f"nn AS (SELECT * FROM (SELECT a.pid AS q, b.pid AS p, {d('a', 'b')} AS d, row_number() OVER (PARTITION BY a.pid ORDER BY {d('a', 'b')}, b.pid) AS rk FROM cloud a, cloud b WHERE a.pid <> b.pid) t WHERE rk <= 20)"
    ranked = "SELECT grid_id, round(composite_score, 6) AS composite_score, total_points, rk - 1 AS selection_rank FROM (SELECT *, row_number() OVER (ORDER BY composite_score DESC, grid_id) AS rk FROM v) t CROSS JOIN ks WHERE rk <= least(greatest(k_elbow, k_threshold, k_gap, 3), 8)"
    valid = "v AS (SELECT * FROM s WHERE composite_score >= 0.05 AND (SELECT count(*) FROM s WHERE composite_score >= 0.05) >= 2)"
    r6 = lambda names: ", ".join(f"round({n}, 6) AS {n}" for n in names.split())
    return {
        "geo_overlap": p(SQL_CELLS + " SELECT round(x0, 6) AS x_min, round(x1, 6) AS x_max, round(y0, 6) AS y_min, round(y1, 6) AS y_max, round(x1 - x0, 6) AS width, round(y1 - y0, 6) AS height, round(original_area, 6) AS original_area, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, round((x1 - x0) * (y1 - y0), 6) AS area FROM o"),
        "geo_grid": p(SQL_CELLS + f" SELECT round(x0 - cx, 6) AS gx0, round(x1 - cx, 6) AS gx1, round(y0 - cy, 6) AS gy0, round(y1 - cy, 6) AS gy1, round((x1 - x0) / {COLS}, 6) AS cell_width, round((y1 - y0) / {ROWS}, 6) AS cell_height, round((x1 - x0) / {COLS} * (y1 - y0) / {ROWS}, 6) AS cell_area, {ROWS * COLS} AS total_cells, round(x0 - cx + 2 * (x1 - x0) / {COLS}, 6) AS x_edge_2, round(y1 - cy, 6) AS y_edge_last FROM o"),
        "prj_decenter": p(SQL_CELLS + " SELECT strip, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM cells GROUP BY strip"),
        "prj_grid_id": p(SQL_CELLS + " SELECT strip, grid_id, count(*) AS n_points FROM cells GROUP BY strip, grid_id"),
        "agg_cell_stats": p(SQL_CELLS + " SELECT strip, grid_id, count(*) AS n_points, round(avg(z), 5) AS z_mean, round(stddev_pop(z), 5) AS z_std, round(min(z), 5) AS z_min, round(max(z), 5) AS z_max, round(max(z) - min(z), 5) AS z_range, round(avg(intensity), 5) AS intensity_mean, round(stddev_pop(intensity), 5) AS intensity_std, round(min(intensity), 5) AS intensity_min, round(max(intensity), 5) AS intensity_max FROM cells GROUP BY strip, grid_id"),
        "agg_percentile_global": p(f"{SQL_CELLS}, {SQL_RANGE} SELECT {r6('z_lo z_hi i_lo i_hi')} FROM rng"),
        "agg_hist1d": p(SQL_CELLS + f" SELECT strip, grid_id, CAST(least(floor((intensity - 100) * {I_BINS} / 1400), {I_BINS - 1}) AS BIGINT) AS bin, count(*) AS n FROM cells WHERE intensity BETWEEN 100 AND 1500 GROUP BY ALL"),
        "agg_hist2d": with_views(f"SELECT strip, CAST(least(floor((x - 10.0) * {Z_BINS} / 80.0), {Z_BINS - 1}) AS BIGINT) AS xb, CAST(least(floor((intensity - 100) * {I_BINS} / 1400), {I_BINS - 1}) AS BIGINT) AS ib, count(*) AS n FROM points WHERE x BETWEEN 10 AND 90 AND intensity BETWEEN 100 AND 1500 GROUP BY ALL", ["points"]),
        "agg_entropy": p(SQL_FEATURES + f" SELECT strip, grid_id, {r6('z_entropy intensity_entropy mutual_information normalized_mutual_information z_entropy_norm intensity_entropy_norm')}, n_points FROM f"),
        "score_composite": p(SQL_SCORES + f" SELECT grid_id, strip1_points, {r6('strip1_z_entropy_norm strip1_intensity_entropy_norm strip1_nmi')}, strip2_points, {r6('strip2_z_entropy_norm strip2_intensity_entropy_norm strip2_nmi')}, total_points, round(hc + ic + mc, 6) AS raw_score, round(dbf, 6) AS density_balance_factor, {r6('composite_score')}, round(hc, 6) AS height_entropy_contribution, round(ic, 6) AS intensity_entropy_contribution, round(mc, 6) AS mutual_info_contribution FROM s"),
        "jn_common_grids": p(SQL_CELLS + " SELECT grid_id, count(*) FILTER (strip = 'F') AS strip1_points, count(*) FILTER (strip = 'O') AS strip2_points FROM cells GROUP BY grid_id HAVING count(DISTINCT strip) = 2"),
        "select_regions": p(f"{SQL_SCORES}, {valid}, {sql_sizes('v', 'composite_score', 3)} {ranked}"),
        "sel_sizes": with_views(f"WITH rs AS (SELECT grid_id, round(composite_score, 9) AS composite_score FROM regions), {sql_sizes('rs', 'composite_score', 3)} SELECT n, k_elbow, k_threshold, k_gap FROM ks", ["regions"]),
        "sel_fallback": with_views("SELECT 0::BIGINT AS n_strict, count(*) AS n_lax FROM regions", ["regions"]),
        "jn_cell_extract": p(f"{SQL_SCORES}, {valid}, {sql_sizes('v', 'composite_score', 3)}, ch AS ({ranked}) SELECT strip, grid_id, count(*) AS n_points FROM cells WHERE grid_id IN (SELECT grid_id FROM ch) GROUP BY strip, grid_id"),
        "smp_region_cap": p(SQL_CELLS + " SELECT strip, grid_id, least(count(*), 50) AS n FROM cells GROUP BY strip, grid_id"),
        "jn_nn1": c(f"WITH {pairs} SELECT q, p, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, p) AS rk FROM pr WHERE d < 0.1) t WHERE rk = 1"),
        "jn_mutual_nn": c(f"WITH {pairs} SELECT q, p, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, p) AS rk, row_number() OVER (PARTITION BY p ORDER BY d, q) AS rp FROM pr WHERE d < 0.1) t WHERE rk = 1 AND rp = 1"),
        "jn_radius": c(f"WITH {pairs} SELECT q, p, round(d, 6) AS d FROM pr WHERE d <= 0.08"),
        "flt_nn_distance": c(f"WITH {pairs} SELECT count(*) AS n, round(max(d), 6) AS farthest FROM (SELECT q, min(d) AS d FROM pr WHERE d < 0.05 GROUP BY q) t"),
        "geo_voxel_down": c("WITH lo AS (SELECT strip, min(x) - 0.05 AS lx, min(y) - 0.05 AS ly, min(z) - 0.05 AS lz FROM cloud GROUP BY strip) SELECT c.strip, CAST(floor((x - lx) / 0.1) AS BIGINT) AS vx, CAST(floor((y - ly) / 0.1) AS BIGINT) AS vy, CAST(floor((z - lz) / 0.1) AS BIGINT) AS vz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM cloud c JOIN lo ON c.strip = lo.strip GROUP BY ALL"),
        "out_lof": c(f"WITH {knn}, kd AS (SELECT q, max(d) AS kd FROM nn GROUP BY q), ld AS (SELECT nn.q, 1 / (avg(greatest(nn.d, kd.kd)) + 1e-10) AS lrd FROM nn JOIN kd ON kd.q = nn.p GROUP BY nn.q) SELECT nn.q AS pid, round(avg(b.lrd) / max(a.lrd), 5) AS lof FROM nn JOIN ld a ON a.q = nn.q JOIN ld b ON b.q = nn.p GROUP BY nn.q"),
        "out_mahalanobis": with_views("""
          WITH c AS (SELECT avg(r) AS mr, avg(g) AS mg, avg(b) AS mb, var_samp(r) AS rr, var_samp(g) AS gg, var_samp(b) AS bb, covar_samp(r, g) AS rg, covar_samp(r, b) AS rb, covar_samp(g, b) AS gb FROM points),
          d AS (SELECT c.*, rr * (gg * bb - gb * gb) - rg * (rg * bb - gb * rb) + rb * (rg * gb - gg * rb) AS det FROM c),
          m AS (SELECT sqrt(((gg * bb - gb * gb) * power(r - mr, 2) + (rr * bb - rb * rb) * power(g - mg, 2) + (rr * gg - rg * rg) * power(b - mb, 2)
          + 2 * (rb * gb - rg * bb) * (r - mr) * (g - mg) + 2 * (rg * gb - rb * gg) * (r - mr) * (b - mb) + 2 * (rg * rb - rr * gb) * (g - mg) * (b - mb)) / nullif(det, 0)) AS dist
          FROM points CROSS JOIN d)
          SELECT sum(CASE WHEN round(dist, 9) > round(t, 9) THEN 1 ELSE 0 END) AS color_outliers, round(max(t), 6) AS threshold, round(avg(dist), 6) AS mean_distance FROM m CROSS JOIN (SELECT quantile_cont(dist, 0.95) AS t FROM m) AS q""", ["points"]),
        "geo_fpfh": with_views(f"""WITH nm AS (SELECT vec_id, embedding[4]::DOUBLE AS a, embedding[5]::DOUBLE AS b, embedding[6]::DOUBLE AS c FROM embeddings),
          t AS (SELECT pid, x, y, z, a / sqrt(a * a + b * b + c * c) AS nx, b / sqrt(a * a + b * b + c * c) AS ny, c / sqrt(a * a + b * b + c * c) AS nz FROM cloud JOIN nm ON vec_id = pid),
          pr AS (SELECT * FROM (SELECT s.pid AS q, b.pid AS p, {d('s', 'b')} AS d FROM t s JOIN t b ON s.pid <> b.pid) w WHERE d <= 0.12),
          l AS (SELECT q, p, d, s.nx AS ux, s.ny AS uy, s.nz AS uz, b.nx AS mx, b.ny AS my, b.nz AS mz, (b.x - s.x) / greatest(d, 1e-12) AS lx, (b.y - s.y) / greatest(d, 1e-12) AS ly, (b.z - s.z) / greatest(d, 1e-12) AS lz FROM pr JOIN t s ON s.pid = q JOIN t b ON b.pid = p),
          v0 AS (SELECT *, uy * lz - uz * ly AS gx, uz * lx - ux * lz AS gy, ux * ly - uy * lx AS gz FROM l), v AS (SELECT *, greatest(sqrt(gx * gx + gy * gy + gz * gz), 1e-12) AS len FROM v0),
          w AS (SELECT *, gx / len AS vx, gy / len AS vy, gz / len AS vz FROM v),
          an AS (SELECT q, [vx * mx + vy * my + vz * mz, ux * lx + uy * ly + uz * lz, atan2((uy * vz - uz * vy) * mx + (uz * vx - ux * vz) * my + (ux * vy - uy * vx) * mz, ux * mx + uy * my + uz * mz) / pi()] AS al FROM w),
          bn AS (SELECT q, i * 11 + CAST(greatest(0, least(10, floor((al[i + 1] + 1) * 5.5))) AS INT) AS bin FROM an, (SELECT unnest(range(3))::INT AS i) k),
          n AS (SELECT q, count(*) AS n FROM pr GROUP BY q), own AS (SELECT bn.q, bin, count(*) / max(n.n)::DOUBLE AS f FROM bn JOIN n ON n.q = bn.q GROUP BY bn.q, bin),
          al AS (SELECT q, bin, f FROM own UNION ALL SELECT pr.q, own.bin, own.f / greatest(pr.d, 1e-3) / n.n FROM pr JOIN n ON n.q = pr.q JOIN own ON own.q = pr.p), tt AS (SELECT q, bin, sum(f) AS f FROM al GROUP BY q, bin)
          SELECT q AS pid, bin, round(f / sqrt(sum(f * f) OVER (PARTITION BY q)), 6) AS value FROM tt""", ["cloud"]),
        "out_color_mad": c(f"""WITH cl AS (SELECT *, x * 10 AS r, y * 10 AS g, z * 10 AS bl FROM cloud), nr AS (SELECT s.pid AS q, b.pid AS p, b.r, b.g, b.bl FROM cl s, cl b WHERE s.cluster = 3 AND {d('s', 'b')} <= 0.12),
          md AS (SELECT q, median(r) AS mr, median(g) AS mg, median(bl) AS mb FROM nr GROUP BY q HAVING count(*) >= 3), dv AS (SELECT nr.q, nr.p, abs(r - mr) AS dr, abs(g - mg) AS dg, abs(bl - mb) AS db FROM nr JOIN md ON nr.q = md.q), mm AS (SELECT q, greatest(median(dr), 0.1) AS tr, greatest(median(dg), 0.1) AS tg, greatest(median(db), 0.1) AS tb FROM dv GROUP BY q)
          SELECT pid FROM cl WHERE cluster = 3 UNION SELECT p FROM dv JOIN mm ON dv.q = mm.q WHERE dr <= tr AND dg <= tg AND db <= tb"""),
        "jn_cosine_nn": "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS q, b.vec_id AS p, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.vec_id % 50 = 0) SELECT q, p, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, p DESC) AS rk FROM s) t WHERE rk = 1",
        "prj_strip_id_regex": r"SELECT page_id, coalesce(TRY_CAST(regexp_extract(regexp_replace(list_last(string_split(regexp_replace(url, '[?#].*$', ''), '/')), '\.[^.]*$', ''), '(\d+)', 1) AS BIGINT), 0) AS strip_id FROM pages",
        "prj_mem_format": "SELECT s_suppkey, CASE WHEN s_suppkey * 37.0 + 0.26 < 1024 THEN printf('%.1f MB', (s_suppkey * 37.0 + 0.26)::DOUBLE) ELSE printf('%.1f GB', ((s_suppkey * 37.0 + 0.26) / 1024)::DOUBLE) END AS memory FROM supplier",
        "clu_single_linkage": with_views("""WITH RECURSIVE_PLACEHOLDER t AS (SELECT reference_id * 2 + CASE WHEN file = 'customer' THEN 0 ELSE 1 END AS id, center_x AS x, center_y AS y, center_z AS z FROM targets)""", ["targets"]).replace("WITH targets", "WITH RECURSIVE targets").replace("RECURSIVE_PLACEHOLDER ", "") + f""", lk AS (SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON {d('a', 'b')} < 0.25), rc AS (SELECT id AS node, id AS seen FROM t UNION SELECT rc.node, lk.b FROM rc JOIN lk ON lk.a = rc.seen),
          lb AS (SELECT node, min(seen) AS label FROM rc GROUP BY node) SELECT label, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM t JOIN lb ON t.id = lb.node GROUP BY label""",
        "inf_t_ci": with_views("SELECT file, count(*) AS n, round(avg(distance_to_ref), 6) AS mean, round(avg(distance_to_ref) - CASE count(*) WHEN 25 THEN 2.0638985616280205 WHEN 10 THEN 2.2621571627409915 END * stddev_samp(distance_to_ref) / sqrt(count(*)), 6) AS lower, round(avg(distance_to_ref) + CASE count(*) WHEN 25 THEN 2.0638985616280205 WHEN 10 THEN 2.2621571627409915 END * stddev_samp(distance_to_ref) / sqrt(count(*)), 6) AS upper FROM targets GROUP BY file", ["targets"]),
        "inf_kde": with_views("""WITH s AS (SELECT count(*) AS n, min(center_x) AS x0, max(center_x) AS x1, min(center_y) AS y0, max(center_y) AS y1, var_samp(center_x) AS vx, var_samp(center_y) AS vy, covar_samp(center_x, center_y) AS vxy FROM targets),
          h AS (SELECT *, power(n, -1.0 / 3) AS f, vx * vy - vxy * vxy AS det FROM s), g AS (SELECT i, j, x0 + (x1 - x0) * i / 9.0 AS gx, y0 + (y1 - y0) * j / 9.0 AS gy, h.* FROM h, (SELECT unnest(range(10)) AS i) a, (SELECT unnest(range(10)) AS j) b)
          SELECT i, j, round(sum(exp(-0.5 * (vy * power(gx - center_x, 2) - 2 * vxy * (gx - center_x) * (gy - center_y) + vx * power(gy - center_y, 2)) / (det * f))) / max(n * 2 * pi() * sqrt(det) * f), 6) AS density FROM g, targets GROUP BY i, j""", ["targets"]),
    }
