"""Queries of the fusion and metric layer, with their twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lidarloom.functions import geometry
from lidarloom.operators import fusion
from lidarloom.plans.views import with_views
from lidarloom.sources import tables

#: A fixed rigid transform: a turn about z by 0.3 rad, and a shift.
COS, SIN = 0.955336489125606, 0.29552020666133955
MATRIX = [COS, -SIN, 0.0, 0.05, SIN, COS, 0.0, -0.02, 0.0, 0.0, 1.0, 0.01, 0.0, 0.0, 0.0, 1.0]
SQL_MOVED = f"({COS} * sx - {SIN} * sy + 0.05) AS mx, ({SIN} * sx + {COS} * sy - 0.02) AS my, (sz + 0.01) AS mz"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correspondences: each vector's first three components with its next three, by label."""
    e = F.col("embedding")
    v = tables.table(spark, sf_dir, "embeddings")
    return v.select(F.col("label").cast("int").alias("grid_id"), *(e[i].cast("double").alias(n) for i, n in enumerate(("sx", "sy", "sz", "tx", "ty", "tz"))))


SQL_PAIRS = "SELECT CAST(label AS INT) AS grid_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {n}" for i, n in enumerate(("sx", "sy", "sz", "tx", "ty", "tz"))) + " FROM embeddings"
def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pairs``, of which every fourth vector's is a true match under ``MATRIX``."""
    c = F.col
    e = tables.table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("grid_id"), (c("vec_id") % 4 == 0).alias("true_match"), *(c("embedding")[i].cast("double").alias(n) for i, n in enumerate(("sx", "sy", "sz", "ex", "ey", "ez"))))
    moved = geometry.affine(c("sx"), c("sy"), c("sz"), MATRIX)
    return e.select("grid_id", "sx", "sy", "sz", *(F.when(c("true_match"), m).otherwise(c(f"e{a}")).alias(f"t{a}") for a, m in zip("xyz", moved, strict=True)))


SQL_LINKED = f"""linked AS (SELECT CAST(label AS BIGINT) AS grid_id, sx, sy, sz, CASE WHEN m THEN {COS} * sx + {-SIN} * sy + 0.0 * sz + 0.05 ELSE e[4]::DOUBLE END AS tx, CASE WHEN m THEN {SIN} * sx + {COS} * sy + 0.0 * sz + -0.02 ELSE e[5]::DOUBLE END AS ty, CASE WHEN m THEN 0.0 * sx + 0.0 * sy + 1.0 * sz + 0.01 ELSE e[6]::DOUBLE END AS tz
  FROM (SELECT label, embedding AS e, vec_id % 4 = 0 AS m, embedding[1]::DOUBLE AS sx, embedding[2]::DOUBLE AS sy, embedding[3]::DOUBLE AS sz FROM embeddings)),
  p AS (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY sx, sy, sz, tx, ty, tz) - 1 AS rn, count(*) OVER (PARTITION BY grid_id) AS n FROM linked)"""
SQL_D = f"pairs AS ({SQL_PAIRS}), moved AS (SELECT *, {SQL_MOVED} FROM pairs), e AS (SELECT *, sqrt((mx - tx) * (mx - tx) + (my - ty) * (my - ty) + (mz - tz) * (mz - tz)) AS d FROM moved)"


def prj_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fusion.residuals(pairs(spark, sf_dir), MATRIX).groupBy("grid_id").agg(F.count("*").alias("n"), F.avg("mx").alias("mx"), F.avg("my").alias("my"), F.avg("mz").alias("mz")))


def agg_global_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fusion.global_metrics(fusion.residuals(pairs(spark, sf_dir), MATRIX), 0.3, 95.0))


def agg_reg_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    e = fusion.residuals(pairs(spark, sf_dir), MATRIX)
    return rounded(e.groupBy("grid_id").agg((F.count_if(d < 0.3) / F.count("*")).alias("fitness"), F.sqrt(F.avg(F.when(d < 0.3, d * d))).alias("rmse"), F.avg(d).alias("mae"), F.count("*").alias("n_corr")))


def agg_err_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fusion.error_summary(fusion.residuals(pairs(spark, sf_dir), MATRIX)))


def flt_valid_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = tables.regions(spark, sf_dir).where("fitness >= 0.5").select(F.col("grid_id").cast("int").alias("grid_id"))
    return pairs(spark, sf_dir).join(valid, "grid_id", "left_semi").groupBy("grid_id").agg(F.count("*").alias("n"))


def smp_corr_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 20 correspondences of each cell, chosen by a seeded hash."""
    p = pairs(spark, sf_dir).withColumn("h", F.xxhash64("sx", "sy", "sz", F.lit(7)))
    from pyspark.sql import Window

    return p.withColumn("rn", F.row_number().over(Window.partitionBy("grid_id").orderBy("h", "sx"))).where("rn <= 20").groupBy("grid_id").agg(F.count("*").alias("n"))


def out_mad_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.mad_filter(tables.regions(spark, sf_dir)).select("grid_id")


def out_mad_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.medoid_filter(tables.regions(spark, sf_dir)).select("grid_id", F.round("d", 5).alias("d"))


def fus_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fusion.fuse(tables.regions(spark, sf_dir)))


def fus_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fusion.fuse(tables.regions(spark, sf_dir), least_fitness=1e9))


def top_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.regions(spark, sf_dir)
    n = r.agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    return r.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("fitness", 9)), "grid_id"))).crossJoin(F.broadcast(n)).where(F.col("place") <= F.greatest(F.lit(3), F.floor(F.col("n") / 2))).select("grid_id", "place")


def angles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    """Regions with the nine entries of the rotation Rz(yaw) Ry(roll) Rx(pitch), in columns m0..m8."""
    r = tables.regions(spark, sf_dir).selectExpr("*", *(f"{f}(radians({v})) AS {f[0]}{v[0]}" for v in ("pitch", "roll", "yaw") for f in ("cos", "sin")))
    e = ("cy*cr", "cy*sr*sp - sy*cp", "cy*sr*cp + sy*sp", "sy*cr", "sy*sr*sp + cy*cp", "sy*sr*cp - cy*sp", "-sr", "cr*sp", "cr*cp")
    return r.selectExpr("*", *(f"{x} AS m{i}" for i, x in enumerate(e))), [F.col(f"m{i}") for i in range(9)]


SQL_ANGLES = ("r AS (SELECT *, " + ", ".join(f"{f}(radians({v})) AS {f[0]}{v[0]}" for v in ("pitch", "roll", "yaw") for f in ("cos", "sin")) + " FROM regions), m AS (SELECT *, cy*cr AS m0, cy*sr*sp - sy*cp AS m1, cy*sr*cp + sy*sp AS m2, sy*cr AS m3, sy*sr*sp + cy*cp AS m4, sy*sr*cp - cy*sp AS m5, -sr AS m6, cr*sp AS m7, cr*cp AS m8 FROM r)")


def prj_euler(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, m = angles(spark, sf_dir)
    x, y, z = geometry.euler_xyz(m)
    return rounded(df.select("grid_id", x.alias("ax"), y.alias("ay"), z.alias("az")))


def la_conjugate_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, m = angles(spark, sf_dir)
    t = [*m[0:3], F.col("tx"), *m[3:6], F.col("ty"), *m[6:9], F.col("tz")]
    out = fusion.conjugate_offset(t, (F.lit(100.0), F.lit(-50.0), F.lit(7.0)))
    return rounded(df.select("grid_id", out[3].alias("tx"), out[7].alias("ty"), out[11].alias("tz")))


def la_so3_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rotation vector of each region and its weighted mean's parts: log of a matrix in closed form."""
    df, m = angles(spark, sf_dir)
    df = fusion.weights(df)
    th = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (m[0] + m[4] + m[8] - 1) / 2)))
    k = F.when(th < 1e-8, F.lit(0.5)).otherwise(th / (2 * F.sin(th)))
    w = [k * (m[7] - m[5]), k * (m[2] - m[6]), k * (m[3] - m[1])]
    return rounded(df.agg(*(F.sum(F.col("weight") * v).alias(f"w{a}") for a, v in zip("xyz", w, strict=True)), *(F.sum(F.col("weight") * F.col(f"t{a}")).alias(f"t{a}") for a in "xyz")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (prj_affine, agg_global_metrics, agg_reg_quality, agg_err_summary, flt_valid_grids, smp_corr_cap, out_mad_transform, out_mad_cluster, fus_main, fus_identity, top_fitness, prj_euler, la_conjugate_offset, la_so3_log)
    return {f.__name__: f for f in own}


def _mads(names: tuple[str, ...]) -> str:
    return "med AS (SELECT " + ", ".join(f"median({v}) AS med_{v}" for v in names) + " FROM regions), mad AS (SELECT " + ", ".join(f"median(abs({v} - med_{v})) AS mad_{v}" for v in names) + " FROM regions CROSS JOIN med)"


def oracle_sql() -> dict[str, str]:
    six = ("tx", "ty", "tz", "pitch", "roll", "yaw")
    tests = lambda lims: " OR ".join(f"(CASE WHEN {m} < 1e-10 THEN false ELSE abs({v} - med_{v}) / {m} > {k} END)" for v, k, m in lims)
    first = tests((("tx", 1, "greatest(mad_tx, 0.5)"), ("ty", 1, "mad_ty"), ("tz", 2, "greatest(mad_tz, 0.2)"), ("pitch", 2, "mad_pitch"), ("roll", 2, "mad_roll"), ("yaw", 2, "mad_yaw")))
    second = tests((("tx", 1.5, "greatest(mad_tx, 0.5)"), ("ty", 1.5, "mad_ty"), ("tz", 2, "greatest(mad_tz, 0.2)")))

    def filtered(source: str) -> str:
        return _mads(six).replace("FROM regions", f"FROM {source}") + f""", marked AS (SELECT r.*, NOT ({first}) AS ok1, NOT ({second}) AS ok2 FROM {source} r CROSS JOIN med CROSS JOIN mad),
          tot AS (SELECT count(*) AS n, count(*) FILTER (ok1) AS n1, count(*) FILTER (ok2) AS n2 FROM marked),
          good AS (SELECT marked.* FROM (SELECT *, row_number() OVER (ORDER BY fitness DESC, grid_id) AS place FROM marked) marked CROSS JOIN tot WHERE CASE WHEN n <= 2 THEN true WHEN n1 >= 2 THEN ok1 WHEN n2 >= 1 THEN ok2 ELSE place <= greatest(3, n // 2) END)"""

    scaled = "scaled AS (SELECT grid_id, " + ", ".join(f"{v} / greatest(mad_{v}, 1e-6) AS {v}" for v in six) + " FROM regions CROSS JOIN med CROSS JOIN mad)"
    dist = lambda a, b: "sqrt(" + " + ".join(f"power({a}.{v} - {b}.{v}, 2)" for v in six) + ")"
    out = {
        "prj_affine": f"WITH {SQL_D} SELECT grid_id, count(*) AS n, round(avg(mx), 6) AS mx, round(avg(my), 6) AS my, round(avg(mz), 6) AS mz FROM e GROUP BY grid_id",
        "agg_global_metrics": f"WITH {SQL_D}, q AS (SELECT quantile_cont(d, 0.95) AS cut FROM e) SELECT round(sqrt(avg(CASE WHEN d <= cut THEN d * d END)), 6) AS global_rmse, round(avg(CASE WHEN d <= cut THEN d END), 6) AS global_mae, round(avg(CASE WHEN d < 0.3 THEN 1.0 ELSE 0.0 END), 6) AS global_fitness, count(*) AS total_correspondences, count(CASE WHEN d <= cut THEN 1 END) AS valid_correspondences FROM e CROSS JOIN q",
        "agg_reg_quality": f"WITH {SQL_D} SELECT grid_id, round(avg(CASE WHEN d < 0.3 THEN 1.0 ELSE 0.0 END), 6) AS fitness, round(sqrt(avg(CASE WHEN d < 0.3 THEN d * d END)), 6) AS rmse, round(avg(d), 6) AS mae, count(*) AS n_corr FROM e GROUP BY grid_id",
        "agg_err_summary": f"WITH {SQL_D} SELECT round(sqrt(avg(d * d)), 6) AS rmse, round(avg(d), 6) AS mae, round(max(d), 6) AS max_error, round(min(d), 6) AS min_error, round(stddev_pop(d), 6) AS std_error, " + ", ".join(f"round(quantile_cont(d, {p / 100}), 6) AS p{p}" for p in (50, 75, 90, 95, 99)) + ", " + ", ".join(f"count(CASE WHEN d < {t} THEN 1 END) AS below_{i}" for i, t in enumerate((0.5, 1.0, 2.0, 5.0))) + ", count(*) AS n FROM e",
        "flt_valid_grids": with_views(f"SELECT grid_id, count(*) AS n FROM ({SQL_PAIRS}) p WHERE grid_id IN (SELECT grid_id FROM regions WHERE fitness >= 0.5) GROUP BY grid_id", ["regions"]),
        "smp_corr_cap": f"SELECT grid_id, least(count(*), 20) AS n FROM ({SQL_PAIRS}) p GROUP BY grid_id",
        "out_mad_transform": with_views(f"WITH {filtered('regions')} SELECT grid_id FROM good", ["regions"]),
        "out_mad_cluster": with_views(f"""WITH {_mads(six)}, {scaled}, best AS (SELECT a.grid_id, sum({dist('a', 'b')}) AS total FROM scaled a JOIN scaled b ON a.grid_id <> b.grid_id GROUP BY a.grid_id ORDER BY total, a.grid_id LIMIT 1),
          d AS (SELECT s.grid_id, {dist('s', 'm')} AS d FROM scaled s CROSS JOIN (SELECT * FROM scaled WHERE grid_id IN (SELECT grid_id FROM best)) m), q AS (SELECT median(d) AS md FROM d), q2 AS (SELECT median(abs(d - md)) AS mm FROM d CROSS JOIN q)
          SELECT grid_id, round(d, 5) AS d FROM d CROSS JOIN q CROSS JOIN q2 WHERE d <= md + 2.5 * mm""", ["regions"]),
        "fus_main": with_views(f"""WITH fit AS (SELECT * FROM regions WHERE fitness >= 0.3), {filtered('fit')}, w AS (SELECT *, 1 / (n_corr * rmse * rmse) AS w FROM good)
          SELECT CASE WHEN count(*) = 1 THEN 'single_valid_region' ELSE 'composite_score_weighted' END AS method, count(*) AS n_regions, round(sum(w * fitness) / sum(w), 6) AS confidence, round(sum(w * composite_score) / sum(w), 6) AS composite_confidence, """ + ", ".join(f"round(sum(w * {v}) / sum(w), 6) AS {v}" for v in six) + " FROM w", ["regions"]),
        "fus_identity": "SELECT 'low_fitness' AS method, CAST(0 AS BIGINT) AS n_regions, 0.0::DOUBLE AS confidence, 0.0::DOUBLE AS composite_confidence, " + ", ".join(f"0.0::DOUBLE AS {v}" for v in six),
        "top_fitness": with_views("SELECT grid_id, place FROM (SELECT grid_id, row_number() OVER (ORDER BY round(fitness, 9) DESC, grid_id) AS place, count(*) OVER () AS n FROM regions) t WHERE place <= greatest(3, n // 2)", ["regions"]),
        "prj_euler": with_views(f"WITH {SQL_ANGLES} SELECT grid_id, round(degrees(atan2(m7, m8)), 6) AS ax, round(degrees(atan2(-m6, sqrt(m7 * m7 + m8 * m8))), 6) AS ay, round(degrees(atan2(m3, m0)), 6) AS az FROM m", ["regions"]),
        "la_conjugate_offset": with_views(f"WITH {SQL_ANGLES} SELECT grid_id, round(tx + 100 - (m0 * 100 - m1 * 50 + m2 * 7), 6) AS tx, round(ty - 50 - (m3 * 100 - m4 * 50 + m5 * 7), 6) AS ty, round(tz + 7 - (m6 * 100 - m7 * 50 + m8 * 7), 6) AS tz FROM m", ["regions"]),
        "la_so3_log": with_views(f"""WITH {SQL_ANGLES}, t AS (SELECT *, acos(greatest(-1.0, least(1.0, (m0 + m4 + m8 - 1) / 2))) AS th, 1 / (n_corr * rmse * rmse) AS w FROM m), k AS (SELECT *, CASE WHEN th < 1e-8 THEN 0.5 ELSE th / (2 * sin(th)) END AS k FROM t)
          SELECT round(sum(w * k * (m7 - m5)) / sum(w), 6) AS wx, round(sum(w * k * (m2 - m6)) / sum(w), 6) AS wy, round(sum(w * k * (m3 - m1)) / sum(w), 6) AS wz, round(sum(w * tx) / sum(w), 6) AS tx, round(sum(w * ty) / sum(w), 6) AS ty, round(sum(w * tz) / sum(w), 6) AS tz FROM k""", ["regions"]),
    }
    return out
