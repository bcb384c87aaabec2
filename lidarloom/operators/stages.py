"""Records of a run: the rows, time and memory of each stage, and of each cell that is registered.

Rows are counted on the way by ``DataFrame.observe``, so a stage is not computed twice for its record. Memory is what
Spark's storage holds on the driver and all executors, as the context reports it: a figure of the whole system, as
before and after each stage, not of one process.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lidarloom.sources import scratch

RECORD = "place int, stage string, rows long, seconds double, before_mb double, after_mb double"
REPORT = "initial_memory_mb double, peak_memory_mb double, final_memory_mb double, avg_memory_mb double, avg_memory_increase_mb double"


def storage_mb(spark: SparkSession) -> float:
    """MB that Spark's storage uses on all nodes."""
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    used, it = 0, status.valuesIterator()
    while it.hasNext():
        own = it.next()
        used += own._1() - own._2()
    return used / 2**20


@dataclass
class Recorder:
    """Stages in the order in which they end."""

    spark: SparkSession
    rows: list[tuple] = field(default_factory=list)

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """``df``, written down; its rows, seconds and memory are recorded as ``name``."""
        seen = Observation()
        before, start = storage_mb(self.spark), time.perf_counter()
        out = scratch.written(df.observe(seen, F.count(F.lit(1)).alias("rows")))
        self.rows.append((len(self.rows), name, int(seen.get.get("rows", 0)), time.perf_counter() - start, before, storage_mb(self.spark)))
        return out

    def records(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, RECORD)

    def report(self) -> DataFrame:
        """One row: memory at first, at its peak, at last, on average, and by how much the average lies above the first.
        Without stages, all are the present figure."""
        now = storage_mb(self.spark)
        after = [r[5] for r in self.rows] or [now]
        first = self.rows[0][4] if self.rows else now
        mean = sum(after) / len(after)
        return self.spark.createDataFrame([(first, max([first, *after]), after[-1], mean, mean - first)], REPORT)


def cell_records(cells: DataFrame, results: DataFrame, first: str, second: str, before_mb: float, after_mb: float) -> DataFrame:
    """(grid_id, region_index, pre_memory_mb, post_memory_mb, memory_increase_mb, strip1_points, strip2_points,
    total_points, memory_efficiency, error): a record for each registered cell, in the order of cells. All cells are
    registered at once, so the memory is that before and after all of them; efficiency is MB a thousand points."""
    c = F.col
    n = cells.groupBy("grid_id").agg(F.count_if(c("strip") == first).alias("strip1_points"), F.count_if(c("strip") == second).alias("strip2_points"))
    more = float(after_mb - before_mb)
    at = results.select("grid_id", "error").join(n, "grid_id").withColumn("total_points", c("strip1_points") + c("strip2_points"))
    return at.select(
        "grid_id", (F.row_number().over(Window.orderBy("grid_id")) - 1).alias("region_index"), F.lit(float(before_mb)).alias("pre_memory_mb"), F.lit(float(after_mb)).alias("post_memory_mb"), F.lit(more).alias("memory_increase_mb"),
        "strip1_points", "strip2_points", "total_points", F.when(c("total_points") > 0, more / c("total_points") * 1000).otherwise(0.0).alias("memory_efficiency"), "error",
    )


def write_memory_log(records: DataFrame, report: DataFrame, path: str) -> None:
    """The cells' records as text, two decimals, separated by blanks, and the report's figures as ``# name: value``
    lines in ``path``-report."""
    two = lambda name: F.format_string("%.2f", F.col(name)).alias(name)
    text = [two(n) if t == "double" else F.coalesce(F.col(n).cast("string"), F.lit("-")).alias(n) for n, t in records.dtypes]
    records.select(*text).write.mode("overwrite").option("sep", " ").csv(path)
    names = [n for n, _ in report.dtypes]
    lines = F.explode(F.array(*(F.format_string(f"# {n}: %.2f", F.col(n)) for n in names)))
    report.select(lines.alias("value")).coalesce(1).write.mode("overwrite").text(path + "-report")
