"""What the corpus operators share: shared storage, free column names, skew-safe grouping and connected components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch of texts that goes to Python.
BATCH = 1_000

_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as ``spark.checkpoint.dir`` names it. Where the setting is
    missing, a folder of our own serves if all work runs in this process; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lidarloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage ends there and no executor's loss undoes
    it. The table goes when this process ends, or before that by ``alone``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def alone(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, written down; the tables that it has written on the way are deleted."""
    before = set(_WRITTEN)
    out = materialize(make())
    for path in set(_WRITTEN) - before - {out.written_to}:
        delete(path)
    return out


def delete(path: str) -> None:
    jvm = _WRITTEN.pop(path).sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(jvm.org.apache.spark.SparkContext.getOrCreate().hadoopConfiguration()).delete(where, True)


@atexit.register
def delete_all() -> None:
    for path in list(_WRITTEN):
        with contextlib.suppress(Exception):  # the session or its JVM may have gone before
            if _WRITTEN[path].sparkContext._jsc:
                delete(path)


def free(df: DataFrame, name: str) -> str:
    """``name``, or with underscores added, so that no column of ``df`` is called so (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits of a text in two longs; a null text counts as a text of its own."""
    md = F.md5(F.coalesce(text.cast("binary"), F.unhex(F.lit("FF"))))
    half = lambda at: F.conv(F.substring(md, at, 16), 16, -10).cast("long")
    return half(1), half(17)


def split_by(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], list[pa.RecordBatch]]]:
    """The groups of rows sorted by the first ``keys`` columns (integers), each as slices of batches."""
    at, own = None, []
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], axis=1)
        cut = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]))
        for start, stop in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            here = tuple(key[start].tolist())
            if own and here != at:
                yield at, own
                own = []
            at = here
            own.append(b.slice(start, stop - start))
    if own:
        yield at, own


def small_batches(df: DataFrame) -> DataFrame:
    """Texts go to Python in batches of at most ``BATCH`` rows (a setting of the session, lowered if it is larger: Spark
    reads it when the plan runs, so it can't be put back here), and workers on this machine find the package wherever
    the driver was started."""
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))
    return df


_RESIDENT: dict[object, object] = {}


def resident(key: object, make: Callable[[], object]) -> object:
    """What this worker keeps from task to task, caches above all. One thing at a time: asking for another frees it."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def sample_texts(docs: DataFrame, most: int) -> DataFrame:
    """(text) of at most ``most`` rows: those with the least hashed ids, the same at any partitioning. The ids are
    chosen first, so that only chosen texts move."""
    docs = docs.select("doc_id", "text")
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("chosen_id")).distinct()
    return docs.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("chosen_id")), "left_semi").select("text").limit(most)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the graph of ``edges(a, b)`` as ``(node, component)``, component = smallest node reachable.

    Each round every node points at the neighbour (or itself) with the least random rank; the graph is contracted
    along these pointers, so nodes shrink by a constant factor a round whatever the shape of the graph (a plain
    minimum would need one round per link of a chain). Self loops and repeated or null edges are ignored; nodes
    without edges do not appear. The rounds' tables are deleted at the end.

    One component may hold very many nodes. They are never gathered under its key but by partial aggregation, and are
    given its least node by a join of plain shuffles (``with_least``), whose skewed partitions adaptive execution splits.
    """
    return alone(lambda: contracted(edges))


def contracted(edges: DataFrame) -> DataFrame:
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = materialize(edges)
    pointers = []
    while not edges.isEmpty():
        rank = lambda c, seed=len(pointers): F.struct(F.xxhash64(F.lit(seed), c).alias("rank"), c.alias("id"))
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy(F.col("a").alias("node")).agg(F.min(rank(F.col("b"))).alias("m"))
        to = materialize(to.select("node", F.least("m", rank(F.col("node")))["id"].alias("to")))
        pointers.append(to)
        moved = edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        edges = materialize(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).where("a < b").distinct())
    if not pointers:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = pointers[-1]
    for before in reversed(pointers[:-1]):
        later = found.select(F.col("node").alias("to"), F.col("to").alias("last"))
        found = before.join(later, "to", "left").select("node", F.coalesce("last", "to").alias("to"))
    found = materialize(found)
    return with_least(found, "to", F.col("node"), "component").select("node", "component")


def with_least(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """``rows`` with the least ``value`` of their ``key``. The least values are aggregated before anything is shuffled
    and written down, so that the join back has nothing but shuffles and sorts in its stage and can be split."""
    return rows.join(materialize(rows.groupBy(key).agg(F.min(value).alias(name))), key)
