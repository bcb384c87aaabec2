"""Point, region, target and sequence views over the star-schema tables. All are narrow projections of one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The shift between the strips of ``terrain``: what registration has to find.
SHIFT = (0.15, -0.1, 0.08)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(strip, x, y, z, intensity, r, g, b, line): two overlapping strips."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_linestatus").alias("strip"),
        (c("l_extendedprice") / 1000).alias("x"),
        (c("l_quantity") * 2).alias("y"),
        (c("l_discount") * 100 + c("l_tax") * 100).alias("z"),
        c("l_partkey").cast("double").alias("intensity"),
        c("l_suppkey").cast("double").alias("r"),
        c("l_linenumber").cast("double").alias("g"),
        (c("l_tax") * 100).alias("b"),
        c("l_returnflag").alias("line"),
    )


def terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(strip, x, y, z, intensity): two strips over the same hills, the second one shifted by ``SHIFT``. The strips' points
    are not each other's."""
    c = F.col
    p = table(spark, sf_dir, "lineitem").select(
        c("l_linestatus").alias("strip"), (F.pmod(c("l_extendedprice"), F.lit(100.0)) / 5).alias("x"),
        ((c("l_quantity") * 2 - ((c("l_partkey") * 7 + c("l_suppkey") * 13 + c("l_linenumber") * 29) % 1000) / 500) / 5).alias("y"), (c("l_partkey") % 40).alias("k"),
    )
    x, y, second = c("x"), c("y"), c("strip") == "O"
    p = p.withColumn("z", F.sin(x * 0.5) * 2 + F.cos(y * 0.4) * 2 + 0.8 * F.sin(x * 1.1 + y * 0.7)).withColumn("intensity", F.floor(100 + 50 * F.sin(x * 0.9) * F.cos(y * 0.6) + c("k")).cast("double"))
    return p.select("strip", *((c(a) + F.when(second, v).otherwise(0.0)).alias(a) for a, v in zip("xyz", SHIFT, strict=True)), "intensity")


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, strip, cluster, x, y, z): a 3-d cloud with unique ids."""
    c = F.col
    e = c("embedding")
    return table(spark, sf_dir, "embeddings").select(
        c("vec_id").alias("pid"), (c("label") % 2).cast("int").alias("strip"), c("label").cast("int").alias("cluster"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), e[2].cast("double").alias("z")
    )


def mean(column: str):
    """The mean of a column of doubles by an exact sum of its decimals (12 digits after the point), so that rows in any
    order and in any parts have the same mean to the last bit, and equal groups are equal."""
    v = F.col(column)
    d = v.try_cast("decimal(28,12)")  # null of what isn't finite, or too large
    return F.when(F.count(d) == F.count(v), F.try_divide(F.sum(d).cast("double"), F.count(v))).otherwise(F.avg(v))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grid_id, n_corr, fitness, rmse, tx, ty, tz, pitch, roll, yaw, composite_score): one row per supplier, standing
    in for registered cells."""
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy(F.col("l_suppkey").alias("grid_id")).agg(
        F.count("*").alias("n_corr"), *(mean(f"l_{v}").alias(v[0]) for v in ("discount", "tax", "quantity")), mean("l_extendedprice").alias("e"), F.avg("l_linenumber").alias("n")
    )
    return g.select(
        "grid_id",
        "n_corr",
        F.expr("least(1.0, d * 10)").alias("fitness"),
        F.expr("t + 0.01").alias("rmse"),
        F.expr("q / 10 - 2.5").alias("tx"),
        F.expr("e / 10000 - 3.5").alias("ty"),
        F.expr("n - 4").alias("tz"),
        F.expr("(d - 0.05) * 100").alias("pitch"),
        F.expr("(t - 0.04) * 100").alias("roll"),
        F.expr("(q - 25) / 10").alias("yaw"),
        F.expr("q * d").alias("composite_score"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, reference_id, cluster_id, point_count, center_x..z, ref_x..z, planarity, normal_angle, distance_to_ref):
    per nation, two 'files' (customers and suppliers) of detected targets against one reference."""
    def one(name: str, key: str, nation: str, bal: str) -> DataFrame:
        return table(spark, sf_dir, name).groupBy(F.col(nation).cast("long").alias("reference_id")).agg(
            F.count("*").alias("point_count"), F.avg(bal).alias("m"), F.min(bal).alias("lo"), F.max(bal).alias("hi"), F.avg(key).alias("k")
        ).withColumn("file", F.lit(name))
    both = one("customer", "c_custkey", "c_nationkey", "c_acctbal").unionByName(one("supplier", "s_suppkey", "s_nationkey", "s_acctbal"))
    t = both.select(
        "file", "reference_id", F.col("reference_id").alias("cluster_id"), "point_count",
        F.expr("m / 1000").alias("center_x"), F.expr("lo / 1000").alias("center_y"), F.expr("hi / 1000").alias("center_z"),
        F.lit(4.5).alias("ref_x"), F.lit(-0.9).alias("ref_y"), F.lit(9.9).alias("ref_z"),
        F.expr("abs(m - lo) / (abs(hi - lo) + 1)").alias("planarity"), F.expr("pmod(k, 90.0)").alias("normal_angle"),
    )
    return t.withColumn("distance_to_ref", F.expr("sqrt(pow(center_x - ref_x, 2) + pow(center_y - ref_y, 2) + pow(center_z - ref_z, 2))"))
