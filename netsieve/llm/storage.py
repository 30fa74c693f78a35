"""Intermediate tables in the cluster's shared folder (``spark.checkpoint.dir``)."""

from __future__ import annotations

import ctypes
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsieve.session import scratch_path

#: A side is broadcast only when its counted rows fit here; it is 8-40 bytes a row.
BROADCAST_ROWS = 1_000_000


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by ``materialise`` that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after counting a materialised ``df``; beyond ``limit`` rows a shuffle join."""
    return F.broadcast(df) if df.count() <= limit else df


def unused_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has that name (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def tasks(spark: SparkSession) -> int:
    """Shuffle partitions of the session: how many ways work is dealt out."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def workers_import(spark: SparkSession) -> None:
    """Let Python workers that share this file system (tests, local runs) import the package.

    On a cluster the package is installed or shipped with ``--py-files``.
    """
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    known = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in known:
        env["PYTHONPATH"] = ":".join([*known, root])


#: Large tables that a worker keeps from task to task (tokenizers and the pieces they have met), by name.
worker_tables: dict[str, object] = {}


def map_arrow(df: DataFrame, fn, schema, keeps_tables: bool = False) -> DataFrame:
    """``mapInArrow``; unless ``fn`` keeps worker tables, its tasks begin by dropping those of earlier operators.

    Workers serve many operators one after the other: what a task has freed goes back to the system.
    """
    workers_import(df.sparkSession)
    return df.mapInArrow(_lean(fn, keeps_tables), schema)


def _lean(fn, keeps_tables: bool):
    def run(batches):
        if not keeps_tables:
            worker_tables.clear()
            _give_back()
        try:
            yield from fn(batches)
        finally:
            _give_back()
    return run


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)
