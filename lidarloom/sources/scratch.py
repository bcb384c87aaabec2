"""Tables and files that an operator needs on its way: in the folder that the driver and all executors share. Results are
lazy and may still read them, so they are kept while the driver lives and deleted when it ends, but for large ones that
are dropped once nothing reads them any more."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where the setting is missing, a folder of our own serves if all
    work runs in this process; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lidarloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_MADE: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, kind: str) -> str:
    """A path of its own in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


@atexit.register
def delete_all() -> None:
    """Deletes what was made, and what was written beside it under a longer name (a sink's second file)."""
    for spark, path in _MADE:
        with contextlib.suppress(Exception):  # the session or its JVM may have gone before
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path + "*")
            system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            for found in system.globStatus(where) or ():
                system.delete(found.getPath(), True)
    _MADE.clear()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Deletes what ``written`` has made of ``table``, which nothing reads any more."""
    spark, folders = table.sparkSession, {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in table.inputFiles()}
    for made in [m for m in _MADE if m[1].rsplit("/", 1)[-1] in folders]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made[1])
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _MADE.remove(made)
