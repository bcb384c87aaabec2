"""Reference targets: white-space separated text, one target a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """(reference_id, x, y, z), numbered in reading order; comments and blank lines are skipped, one line is fine."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' AND NOT startswith(v, '#')")
    parts = F.split("v", r"\s+")
    rows = lines.select(F.monotonically_increasing_id().alias("at"), *(parts[i].cast("double").alias(a) for i, a in enumerate("xyz")))
    from pyspark.sql import Window

    return rows.withColumn("reference_id", F.row_number().over(Window.orderBy("at")) - 1).select("reference_id", "x", "y", "z")
