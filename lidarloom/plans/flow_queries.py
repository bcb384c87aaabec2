"""Queries that go the whole way: strips as LAS files, read, selected, registered, fused, measured and written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lidarloom.functions import rigid
from lidarloom.functions.geometry import strip_number
from lidarloom.operators import clustering, fusion, registration, stages, strips
from lidarloom.plans import fusion_queries, strip_queries, target_queries
from lidarloom.plans.fusion_queries import COS, MATRIX, SIN, SQL_ANGLES, SQL_D, rounded
from lidarloom.plans.views import with_views
from lidarloom.sources import las, refs, scratch, sinks, tables
from lidarloom.sources.las import local

def as_las(points: DataFrame, *by: str, scale: float = 1e-6) -> str:
    """The folder of LAS files that ``points`` are written to, numbered in the order of the groups; a group is as many
    files as tasks have points of it."""
    folder = local(scratch.new_path(points.sparkSession, "las"))
    groups = points.select(*by).distinct().withColumn("file_number", F.row_number().over(Window.orderBy(*by)) - 1)
    sinks.write_las(points.join(F.broadcast(groups), list(by)), folder, scale, wide=True)
    return folder


def strips_as_las(spark: SparkSession, sf_dir: str) -> str:
    return as_las(tables.points(spark, sf_dir), "strip")


def src_las_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both strips as LAS files, and what the files' headers say of them together."""
    las.enable(spark)
    h = spark.read.format("las_header").load(strips_as_las(spark, sf_dir))
    return rounded(h.agg(F.sum("n_points").alias("n_points"), *(f(c).alias(c) for c, f in (("x_min", F.min), ("x_max", F.max), ("y_min", F.min), ("y_max", F.max), ("z_min", F.min), ("z_max", F.max))), F.every("has_colors").alias("has_colors")), 3)


def src_las_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of both files, colours included, read back within a box that is pushed down to the files."""
    las.enable(spark)
    p = spark.read.format("las").load(strips_as_las(spark, sf_dir)).where("x >= 20.0005 AND x <= 60.0005")
    return rounded(p.agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.avg(F.col("g").cast("double")).alias("g")), 3)


def src_las_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by file, as a DataFrame with the file's name and number."""
    p = las.read_points(spark, strips_as_las(spark, sf_dir))
    return rounded(p.groupBy("strip_id").agg(F.count("*").alias("n"), F.max("x").alias("x_max")).select("n", "x_max"), 3)


def src_multi_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many files at once, by a pattern: one for each line of each strip."""
    folder = as_las(tables.points(spark, sf_dir), "strip", "line")
    return rounded(las.read_points(spark, f"{folder}/*.las").agg(F.count("*").alias("n"), F.sum("y").alias("y")), 1)


def src_ref_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference targets as a text file of coordinates with a comment, read back."""
    path = scratch.new_path(spark, "refs")
    t = tables.targets(spark, sf_dir).where("file = 'supplier'")
    lines = t.select(F.format_string("%.6f  %.6f %.6f", "center_x", "center_y", "center_z").alias("value"))
    spark.createDataFrame([("# x y z",)], "value string").union(lines).coalesce(1).write.text(path)
    return rounded(refs.read_references(spark, path).agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("z").alias("z")), 3)


def snk_las(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each strip that the LAS sink has written, as the headers of its files have them."""
    las.enable(spark)
    h = spark.read.format("las_header").load(strips_as_las(spark, sf_dir)).withColumn("strip", strip_number(F.col("filepath")))
    return rounded(h.groupBy("strip").agg(F.sum("n_points").alias("n"), F.min("x_min").alias("x_min"), F.max("z_max").alias("z_max")), 3)


def snk_las_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy of the cloud under a transform, written as LAS and read back."""
    moved = sinks.transform_points(tables.cloud(spark, sf_dir), MATRIX).withColumn("intensity", F.lit(1.0))
    las.enable(spark)
    p = spark.read.format("las").load(as_las(moved, "strip"))
    return rounded(p.agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z")), 4)


def fused(spark: SparkSession, sf_dir: str) -> list[float]:
    """The regions' mean transform on the rotation group, row by row."""
    df, m = fusion_queries.angles(spark, sf_dir)
    named = fusion.weights(df).withColumns({f"r{i}": v for i, v in enumerate(m)})
    return list(fusion.average(named, [F.col(f"r{i}") for i in range(9)]).first())


def entries(spark: SparkSession, m) -> DataFrame:
    return spark.createDataFrame([(i, j, round(float(m[i, j]), 6)) for i in range(3) for j in range(4)], "i int, j int, v double")


def snk_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions' fused matrix in a file, read back."""
    import numpy as np

    path = local(scratch.new_path(spark, "matrix"))
    sinks.write_matrix(fused(spark, sf_dir), path, [r["grid_id"] for r in tables.regions(spark, sf_dir).select("grid_id").collect()])
    return entries(spark, np.load(path + ".npy"))


def snk_fusion_npy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same matrix under the name of its strips and grid, read back by that name."""
    import numpy as np

    folder = local(scratch.new_path(spark, "fusion"))
    sinks.write_fusion(fused(spark, sf_dir), folder, "F-O", strip_queries.ROWS, strip_queries.COLS)
    return entries(spark, np.load(f"{folder}/F-O_{strip_queries.ROWS}_{strip_queries.COLS}.npy"))


def moved_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.residuals(fusion_queries.pairs(spark, sf_dir), MATRIX)


def snk_corr_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error file of all correspondences, read back."""
    path = scratch.new_path(spark, "errors")
    sinks.write_errors(moved_pairs(spark, sf_dir), path)
    e = spark.read.option("sep", " ").schema("sx double, sy double, sz double, mx double, my double, mz double, tx double, ty double, tz double, d double").csv(path)
    return rounded(e.agg(F.count("*").alias("n"), F.avg("d").alias("d"), F.max("d").alias("worst")), 4)


def snk_csvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "csv")
    sinks.write_csv(tables.targets(spark, sf_dir).select("file", "reference_id", "point_count"), path)
    return spark.read.option("header", True).schema("file string, reference_id long, point_count long").csv(path)


def snk_append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two entries of a log, appended one after the other."""
    path = scratch.new_path(spark, "log")
    for file in ("customer", "supplier"):
        sinks.append_log(tables.targets(spark, sf_dir).where(F.col("file") == file).groupBy("file").agg(F.count("*").alias("n")), path)
    return spark.read.option("header", True).option("sep", "\t").schema("file string, n long").csv(path)


def snk_err_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "summary")
    s = fusion.error_summary(moved_pairs(spark, sf_dir))
    sinks.write_csv(s, path)
    return rounded(spark.read.option("header", True).schema(s.schema).csv(path))


def snk_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of two sections, every row of which is read back."""
    path = scratch.new_path(spark, "report")
    t = tables.targets(spark, sf_dir)
    sinks.write_report(path, targets=t.select("file", "reference_id"), regions=tables.regions(spark, sf_dir).select("grid_id"))
    read = lambda name, schema: spark.read.schema(schema).json(f"{path}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "n")
    return read("targets", "file string").union(read("regions", "grid_id long"))


def flt_score_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose composite score reaches 0.4."""
    return rounded(strip_queries.scored(spark, sf_dir).where(F.round("composite_score", 6) >= 0.4).select("grid_id", "composite_score"))


def srt_group_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each cell's points begin and end once all points are sorted by strip and cell: sums over the cells."""
    n = strip_queries.prj_grid_id(spark, sf_dir)
    stop = F.sum("n_points").over(Window.orderBy("strip", "grid_id").rowsBetween(Window.unboundedPreceding, 0))
    return n.select("strip", "grid_id", (stop - F.col("n_points")).alias("start"), stop.alias("stop"))


def two_strips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, selected, results): the strips of ``terrain`` by way of LAS files, and the cells that the flagship's rules
    select, registered."""
    p = las.read_points(spark, as_las(tables.terrain(spark, sf_dir), "strip"))
    p = p.select(F.when(F.col("strip_id") == 0, "F").otherwise("O").alias("strip"), "x", "y", "z", F.col("intensity").cast("double").alias("intensity"))
    cells, selected = target_queries.selected(spark, sf_dir, p)
    chosen = cells.join(F.broadcast(selected.select("grid_id")), "grid_id", "left_semi")
    return cells, selected, scratch.written(registration.register(chosen, "F", "O", "p2plane", voxel=0.4))


def flow_two_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: LAS files, overlap, the flagship's grid and selection, registration, fusion on the rotation group,
    correspondences and global metrics, the fused matrix in the original frame in a file. One row a selected cell, with
    its rank, whether it was registered well, and whether the fused matrix is the known shift and its metrics are close."""
    cells, selected, results = two_strips(spark, sf_dir)
    m = [float(v) for v in fusion.fuse_transforms(fusion.regions_of(results, selected)).first()[1:]]
    over = strips.overlap(strips.bounds(tables.terrain(spark, sf_dir)), strip_queries.BUFFER).first()
    offset = [F.lit(float(over[c])) for c in ("cx", "cy", "cz")]
    original = spark.range(1).select(*(v.alias(f"m{i}") for i, v in enumerate(fusion.conjugate_offset([F.lit(v) for v in m], tuple(offset))))).first()
    sinks.write_matrix(list(original), local(scratch.new_path(spark, "fused")), [r["grid_id"] for r in selected.select("grid_id").collect()])
    chosen = cells.join(F.broadcast(selected.select("grid_id")), "grid_id", "left_semi")
    metrics = fusion.global_metrics(fusion.residuals(registration.correspondences(chosen, results, "F", "O", 0.8), m), 0.8, 100.0).first()
    off = max(abs(m[4 * i + 3] - tables.SHIFT[i]) for i in range(3))
    turned = max(abs(m[4 * i + j] - (i == j)) for i in range(3) for j in range(3))
    good = target_queries.aligned(chosen, results).select("grid_id", "aligned")
    return rounded(selected.join(good, "grid_id").select("grid_id", "selection_rank", "aligned", F.lit(off < 0.1 and turned < 0.02).alias("shift_found"), F.lit(metrics["global_rmse"] < 0.5 and metrics["global_fitness"] > 0.95).alias("close")))


def recorded(spark: SparkSession, sf_dir: str) -> tuple[stages.Recorder, DataFrame, DataFrame]:
    """A run of the strips up to their registration, stage by stage: (recorder, cells of the selection, results)."""
    log = stages.Recorder(spark)
    points = log.stage("load", tables.terrain(spark, sf_dir))
    cells, selected = target_queries.selected(spark, sf_dir, points, log.stage)
    scratch.drop(points)
    chosen = log.stage("extract", cells.join(F.broadcast(selected.select("grid_id")), "grid_id", "left_semi"))
    scratch.drop(cells)
    results = log.stage("register", registration.register(chosen, "F", "O", "p2plane", voxel=0.4))
    log.stage("match", registration.correspondences(chosen, target_queries.truth(chosen), "F", "O", 0.3))
    return log, chosen, results


def agg_memory_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of a run with the rows that were observed in each, whether it has a time, and whether the report's peak
    of memory is above its first, last and mean figures."""
    log, _, _ = recorded(spark, sf_dir)
    peak = F.broadcast(log.report().select((F.col("peak_memory_mb") >= F.greatest("initial_memory_mb", "final_memory_mb", "avg_memory_mb")).alias("peak_above")))
    return log.records().crossJoin(peak).select("place", "stage", "rows", (F.col("seconds") > 0).alias("timed"), "peak_above")


def snk_memlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text records of the registered cells, read back: all but the memory itself."""
    log, chosen, results = recorded(spark, sf_dir)
    path = scratch.new_path(spark, "memory")
    records = stages.cell_records(chosen, results, "F", "O", log.rows[-2][4], log.rows[-2][5])
    stages.write_memory_log(records, log.report(), path)
    back = spark.read.option("sep", " ").schema(", ".join(f"{n} {t}" for n, t in records.dtypes)).csv(path)
    return back.select("grid_id", "region_index", "strip1_points", "strip2_points", "total_points", "error")


def reg_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods by name over the selected cells: how many succeed, and how well."""
    chosen = scratch.written(target_queries.chosen(spark, sf_dir))
    found = [registration.register(chosen, "F", "O", m, voxel=0.6).select(F.lit(m).alias("method"), "success", "fitness") for m in ("p2plane", "p2point", "ndt")]
    return found[0].union(found[1]).union(found[2]).groupBy("method").agg(F.count_if("success").alias("cells"), (F.avg("fitness") > 0.5).alias("fit"))


def fus_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions' mean transform on the rotation group, as a matrix."""
    df, m = fusion_queries.angles(spark, sf_dir)
    named = fusion.weights(df).withColumns({f"r{i}": v for i, v in enumerate(m)})
    return rounded(fusion.average(named, [F.col(f"r{i}") for i in range(9)]).select(*(f"m{i}" for i in range(12))))


def la_so3_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's rotation from its logarithm, against the rotation itself: the largest difference."""
    df, m = fusion_queries.angles(spark, sf_dir)
    back = fusion.rotation_exp(fusion.rotation_log(m))
    off = F.greatest(*(F.abs(a - b) for a, b in zip(back, m, strict=True)))
    return df.agg(F.count("*").alias("n"), (F.max(off) < 1e-9).alias("same"))


def la_svd_orthogonalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rotation of each region's disturbed matrix: as long as it is orthogonal, and near the true one."""
    import numpy as np
    import pandas as pd

    df, m = fusion_queries.angles(spark, sf_dir)
    rows = df.select("grid_id", F.array(*(v + 0.01 * ((i * 7) % 5 - 2) / 2 for i, v in enumerate(m))).alias("m"))

    def work(batches):
        for b in batches:
            r = [rigid.nearest_rotation(np.array(v).reshape(3, 3)) for v in b["m"]]
            yield pd.DataFrame({"grid_id": b["grid_id"], "orthogonal": [bool(np.allclose(x @ x.T, np.eye(3), atol=1e-12) and np.linalg.det(x) > 0) for x in r], "near": [bool(np.abs(x.ravel() - v).max() < 0.03) for x, v in zip(r, b["m"], strict=True)]})

    return rows.mapInPandas(work, "grid_id long, orthogonal boolean, near boolean")


def geo_convex_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of the hull of each cluster's points in the plane, and how many corners it has."""
    h = clustering.convex_hull(tables.cloud(spark, sf_dir), "cluster")
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy("cluster").orderBy("place")
    area = h.select("cluster", (F.col("x") * nxt("y") - nxt("x") * F.col("y")).alias("a"))
    return rounded(area.groupBy("cluster").agg(F.count("*").alias("corners"), (F.sum("a") / 2).alias("area")))


QUERIES = (src_las_header, src_las_points, src_las_df, src_multi_file, src_ref_txt, snk_las, snk_las_copy, snk_matrix, snk_fusion_npy, snk_corr_errors, snk_csvs, snk_append_log, snk_err_summary, snk_report_json, flt_score_threshold, srt_group_slices, flow_two_strips, agg_memory_report, snk_memlog, reg_driver, fus_average, la_so3_exp, la_svd_orthogonalise, geo_convex_hull)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    p = lambda text: with_views(text, ["points"])
    t = lambda text: with_views(text, ["targets"])
    strip = strip_queries.oracle_sql()
    r = lambda *e: ", ".join(f"round({x}, 6) AS m{i}" for i, x in enumerate(e))
    found = {
        "src_las_header": p("SELECT CAST(count(*) AS BIGINT) AS n_points, " + ", ".join(f"round({f}({a}), 3) AS {a}_{f}" for a in "xyz" for f in ("min", "max")) + ", true AS has_colors FROM points"),
        "src_las_points": p("SELECT count(*) AS n, round(avg(x), 3) AS x, round(avg(y), 3) AS y, round(avg(z), 3) AS z, round(avg(g), 3) AS g FROM points WHERE x BETWEEN 20.0005 AND 60.0005"),
        "src_las_df": p("SELECT count(*) AS n, round(max(x), 3) AS x_max FROM points GROUP BY strip"),
        "src_multi_file": p("SELECT count(*) AS n, round(sum(y), 1) AS y FROM points"),
        "src_ref_txt": t("SELECT count(*) AS n, round(sum(center_x), 3) AS x, round(sum(center_y), 3) AS y, round(sum(center_z), 3) AS z FROM targets WHERE file = 'supplier'"),
        "snk_las": p("SELECT CASE WHEN strip = 'F' THEN 0::BIGINT ELSE 1::BIGINT END AS strip, CAST(count(*) AS BIGINT) AS n, round(min(x), 3) AS x_min, round(max(z), 3) AS z_max FROM points GROUP BY strip"),
        "snk_las_copy": with_views(f"SELECT count(*) AS n, round(avg({COS} * x - {SIN} * y + 0.05), 4) AS x, round(avg({SIN} * x + {COS} * y - 0.02), 4) AS y, round(avg(z + 0.01), 4) AS z FROM cloud", ["cloud"]),
        "snk_corr_errors": f"WITH {SQL_D} SELECT count(*) AS n, round(avg(d), 4) AS d, round(max(d), 4) AS worst FROM e",
        "snk_csvs": t("SELECT file, reference_id, point_count FROM targets"),
        "snk_append_log": t("SELECT file, count(*) AS n FROM targets GROUP BY file"),
        "snk_err_summary": fusion_queries.oracle_sql()["agg_err_summary"],
        "snk_report_json": with_views("SELECT 'targets' AS section, count(*) AS n FROM targets UNION ALL SELECT 'regions', count(*) FROM regions", ["targets", "regions"]),
        "flt_score_threshold": f"SELECT grid_id, composite_score FROM ({strip['score_composite']}) s WHERE composite_score >= 0.4",
        "srt_group_slices": f"SELECT strip, grid_id, CAST(sum(n_points) OVER o - n_points AS BIGINT) AS start, CAST(sum(n_points) OVER o AS BIGINT) AS stop FROM ({strip['prj_grid_id']}) g WINDOW o AS (ORDER BY strip, grid_id)",
        "flow_two_strips": f"SELECT grid_id, selection_rank, true AS aligned, true AS shift_found, true AS close FROM ({target_queries.sql_selected()}) q",
        "agg_memory_report": target_queries.terrain(f"""{target_queries.sql_chosen()}, {target_queries.sql_near(tables.SHIFT, 0.3)}, n AS (SELECT 0 AS place, 'load' AS stage, count(*) AS rows FROM points UNION ALL SELECT 1, 'assign', count(*) FROM cells UNION ALL SELECT 2, 'select', count(*) FROM sel
          UNION ALL SELECT 3, 'extract', count(*) FROM ch UNION ALL SELECT 4, 'register', count(*) FROM sel UNION ALL SELECT 5, 'match', count(*) FROM near) SELECT place, stage, rows, true AS timed, true AS peak_above FROM n"""),
        "snk_memlog": target_queries.terrain(f"""{target_queries.sql_chosen()} SELECT grid_id, CAST(row_number() OVER (ORDER BY grid_id) - 1 AS INT) AS region_index, count(*) FILTER (strip = 'F') AS strip1_points, count(*) FILTER (strip = 'O') AS strip2_points, count(*) AS total_points, '-' AS error FROM ch GROUP BY grid_id"""),
        "reg_driver": f"SELECT method, (SELECT count(*) FROM ({target_queries.sql_selected()}) q) AS cells, true AS fit FROM (VALUES ('p2plane'), ('p2point'), ('ndt')) m(method)",
        "fus_average": with_views(f"""WITH {SQL_ANGLES}, t AS (SELECT *, acos(greatest(-1.0, least(1.0, (m0 + m4 + m8 - 1) / 2))) AS th, 1 / (n_corr * rmse * rmse) AS w FROM m), k AS (SELECT *, CASE WHEN th < 1e-8 THEN 0.5 ELSE th / (2 * sin(th)) END AS k FROM t),
          g AS (SELECT sum(w * k * (m7 - m5)) / sum(w) AS x, sum(w * k * (m2 - m6)) / sum(w) AS y, sum(w * k * (m3 - m1)) / sum(w) AS z, sum(w * tx) / sum(w) AS tx, sum(w * ty) / sum(w) AS ty, sum(w * tz) / sum(w) AS tz FROM k),
          f AS (SELECT *, sin(a) / a AS s, (1 - cos(a)) / (a * a) AS b, cos(a) AS c FROM (SELECT *, sqrt(x * x + y * y + z * z) AS a FROM g) q)
          SELECT {r('c + b*x*x', 'b*x*y - s*z', 'b*x*z + s*y', 'tx', 'b*x*y + s*z', 'c + b*y*y', 'b*y*z - s*x', 'ty', 'b*x*z - s*y', 'b*y*z + s*x', 'c + b*z*z', 'tz')} FROM f""", ["regions"]),
        "geo_convex_hull": with_views("""WITH t AS (SELECT DISTINCT cluster, x, y FROM cloud), ed AS (SELECT a.cluster, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS byy FROM t a JOIN t b ON a.cluster = b.cluster AND (a.x, a.y) <> (b.x, b.y)),
          hull AS (SELECT ed.cluster, ax, ay, bx, byy FROM ed JOIN t ON t.cluster = ed.cluster GROUP BY ALL HAVING min((bx - ax) * (t.y - ay) - (byy - ay) * (t.x - ax)) >= 0)
          SELECT cluster, count(*) AS corners, round(sum(ax * byy - bx * ay) / 2, 6) AS area FROM hull GROUP BY cluster""", ["cloud"]),
        "la_so3_exp": with_views("SELECT count(*) AS n, true AS same FROM regions", ["regions"]),
        "la_svd_orthogonalise": with_views("SELECT grid_id, true AS orthogonal, true AS near FROM regions", ["regions"]),
    }
    values = ", ".join(f"({i}, {j}, m{4 * i + j})" for i in range(3) for j in range(4))
    same = f"SELECT CAST(v.i AS INT) AS i, CAST(v.j AS INT) AS j, v.v FROM ({found['fus_average']}) f, LATERAL (VALUES {values}) v(i, j, v)"
    return found | {"snk_matrix": same, "snk_fusion_npy": same}
