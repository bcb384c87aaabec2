"""The views of ``sources.tables`` for queries, and the same views as SQL for their twins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from lidarloom.sources import tables

SQL_VIEWS = {
    "points": "SELECT l_linestatus AS strip, l_extendedprice / 1000 AS x, l_quantity * 2 AS y, l_discount * 100 + l_tax * 100 AS z, CAST(l_partkey AS DOUBLE) AS intensity, CAST(l_suppkey AS DOUBLE) AS r, CAST(l_linenumber AS DOUBLE) AS g, l_tax * 100 AS b, l_returnflag AS line FROM lineitem",
    "cloud": "SELECT vec_id AS pid, CAST(label % 2 AS INT) AS strip, CAST(label AS INT) AS cluster, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings",
    "regions": """SELECT l_suppkey AS grid_id, count(*) AS n_corr, least(1.0, avg(l_discount) * 10) AS fitness, avg(l_tax) + 0.01 AS rmse, avg(l_quantity) / 10 - 2.5 AS tx, avg(l_extendedprice) / 10000 - 3.5 AS ty, avg(l_linenumber) - 4 AS tz,
      (avg(l_discount) - 0.05) * 100 AS pitch, (avg(l_tax) - 0.04) * 100 AS roll, (avg(l_quantity) - 25) / 10 AS yaw, avg(l_quantity) * avg(l_discount) AS composite_score FROM lineitem GROUP BY l_suppkey""",
    "targets": """SELECT *, sqrt(power(center_x - ref_x, 2) + power(center_y - ref_y, 2) + power(center_z - ref_z, 2)) AS distance_to_ref FROM (
      SELECT file, reference_id, reference_id AS cluster_id, point_count, m / 1000 AS center_x, lo / 1000 AS center_y, hi / 1000 AS center_z, 4.5::DOUBLE AS ref_x, -0.9::DOUBLE AS ref_y, 9.9::DOUBLE AS ref_z, abs(m - lo) / (abs(hi - lo) + 1) AS planarity, k % 90.0 AS normal_angle FROM (
        SELECT 'customer' AS file, CAST(c_nationkey AS BIGINT) AS reference_id, count(*) AS point_count, avg(c_acctbal) AS m, min(c_acctbal) AS lo, max(c_acctbal) AS hi, avg(c_custkey) AS k FROM customer GROUP BY c_nationkey
        UNION ALL SELECT 'supplier', CAST(s_nationkey AS BIGINT), count(*), avg(s_acctbal), min(s_acctbal), max(s_acctbal), avg(s_suppkey) FROM supplier GROUP BY s_nationkey))""",
    "terrain": f"""SELECT strip, x + CASE WHEN strip = 'O' THEN {tables.SHIFT[0]} ELSE 0 END AS x, y + CASE WHEN strip = 'O' THEN {tables.SHIFT[1]} ELSE 0 END AS y, z + CASE WHEN strip = 'O' THEN {tables.SHIFT[2]} ELSE 0 END AS z, intensity FROM (
      SELECT strip, x, y, sin(x * 0.5) * 2 + cos(y * 0.4) * 2 + 0.8 * sin(x * 1.1 + y * 0.7) AS z, CAST(floor(100 + 50 * sin(x * 0.9) * cos(y * 0.6) + k) AS DOUBLE) AS intensity FROM (
        SELECT l_linestatus AS strip, (l_extendedprice % 100.0) / 5 AS x, (l_quantity * 2 - ((l_partkey * 7 + l_suppkey * 13 + l_linenumber * 29) % 1000) / 500) / 5 AS y, l_partkey % 40 AS k FROM lineitem))""",
    "events": None,
}


def frames(spark: SparkSession, sf_dir: str, names: Iterable[str]) -> dict[str, DataFrame]:
    make = {"points": tables.points, "terrain": tables.terrain, "cloud": tables.cloud, "regions": tables.regions, "targets": tables.targets, "events": lambda s, d: tables.table(s, d, "events")}
    return {n: make[n](spark, sf_dir) for n in names}


def with_views(text: str, names: Iterable[str]) -> str:
    """``text`` with the named views in front of it as common table expressions."""
    ctes = ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names if SQL_VIEWS[n])
    text = text.strip()
    if not ctes:
        return text
    return f"WITH {ctes}, {text[5:]}" if text.upper().startswith("WITH ") else f"WITH {ctes} {text}"
