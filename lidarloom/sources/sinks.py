"""Where results go. Tables are written by Spark in parallel; only one-row results are written by the driver."""

from __future__ import annotations

import os
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidarloom.functions.geometry import affine
from lidarloom.sources import las


def transform_points(points: DataFrame, matrix: Sequence[float]) -> DataFrame:
    """Points under a 4x4 matrix; an identity (to 1e-6) leaves the plan as it is."""
    if np.allclose(np.reshape(matrix, (4, 4)), np.eye(4), atol=1e-6):
        return points
    x, y, z = affine(F.col("x"), F.col("y"), F.col("z"), matrix)
    return points.withColumns({"x": x, "y": y, "z": z})


def write_las(points: DataFrame, folder: str, scale: float = 0.001, mode: str = "append", wide: bool = False) -> None:
    """``points(x, y, z, intensity[, r, g, b][, file_number])`` as LAS files of ``folder``: by all tasks at once, and
    either all files or none. ``wide``: what doesn't fit 16 bits is written as extra bytes instead of being an error."""
    las.enable(points.sparkSession)
    cols = ["x", "y", "z", "intensity", *(["r", "g", "b"] if {"r", "g", "b"} <= set(points.columns) else []), *(["file_number"] if "file_number" in points.columns else [])]
    points.select(*cols).write.format("las").mode(mode).option("scale", scale).option("wide", wide).save(folder)


def write_matrix(matrix: Sequence[float], path: str, grids: Sequence[int] = ()) -> None:
    """A 4x4 matrix as ``.npy`` and as commented text."""
    m = np.reshape(np.asarray(matrix, float), (4, 4))
    np.save(path + ".npy", m)
    with open(path + ".txt", "w") as f:
        f.write(f"# transformation, {len(grids)} regions\n# grids: {sorted(grids)}\n")
        f.writelines(" ".join(f"{v:12.8f}" for v in row) + "\n" for row in m)


def write_fusion(matrix: Sequence[float], folder: str, pair: str, rows: int, cols: int) -> str:
    """The fused matrix in the decentred frame as ``<pair>_<rows>_<cols>.npy`` of ``folder``; its path."""
    path = f"{folder}/{pair}_{rows}_{cols}.npy"
    os.makedirs(folder, exist_ok=True)
    np.save(path, np.reshape(np.asarray(matrix, float), (4, 4)))
    return path


def write_errors(moved: DataFrame, path: str) -> None:
    """Per-correspondence errors, ten columns of six digits, written in parallel to ``path``, and their statistics to
    ``path``-statistics."""
    names = ("sx", "sy", "sz", "mx", "my", "mz", "tx", "ty", "tz", "d")
    moved.select(*(F.format_string("%.6f", F.col(n)).alias(n) for n in names)).write.mode("overwrite").option("sep", " ").csv(path)
    moved.sparkSession.createDataFrame([(x,) for x in error_lines(moved)], "value string").coalesce(1).write.mode("overwrite").text(path + "-statistics")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_log(row: DataFrame, path: str) -> None:
    row.write.mode("append").option("sep", "\t").option("header", True).csv(path)


def write_report(path: str, **sections: DataFrame) -> None:
    """A JSON report: a folder of JSON lines for each section, written by Spark, all rows of it."""
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def error_lines(moved: DataFrame) -> list[str]:
    """What stands above the per-correspondence errors: their number, mean, root mean square and extremes."""
    d = F.col("d")
    s = moved.agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.sqrt(F.avg(d * d)).alias("rms"), F.min(d).alias("least"), F.max(d).alias("most")).first()
    return [f"# {k}: {s[k]}" for k in ("n", "mean", "rms", "least", "most")]
