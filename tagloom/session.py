"""Small helpers tied to the running session: shared scratch space and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a session on one machine may fall back to a temporary folder, which goes when the process
    ends: on a cluster the executors could not see it, so an unset folder is an error there.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        path = tempfile.mkdtemp(prefix="tagloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for tables handed from one job to the next."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a derived table below the shared folder and read it back: computed once, and no executor's loss costs it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collect_small(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 64 << 20) -> DataFrame | None:
    """Evaluate a derived table once into a local relation; None if it has too many rows or bytes.

    The table is kept while it is measured, so that a small one is computed once. Nothing of a
    large one goes beyond its executors.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) for f in df.schema]
        width = sum(texts, F.lit(8 * len(texts)))
        size = kept.agg(F.count("*").alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
        if size["rows"] > max_rows or size["bytes"] > max_bytes:
            return None
        return df.sparkSession.createDataFrame(kept.toArrow(), schema=df.schema)
    finally:
        kept.unpersist()


def pin_small(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 64 << 20) -> DataFrame:
    """Evaluate a derived side table once and mark it for broadcast if its rows and bytes are proven small.

    A larger table is returned as it came, so the join that uses it is planned as a shuffle join.
    """
    local = collect_small(df, max_rows, max_bytes)
    return df if local is None else F.broadcast(local)


def spread(df: DataFrame, key: str, tasks: int = 8) -> DataFrame:
    """Cut an input of at most ``tasks`` splits into ``tasks`` for CPU-heavy text work.

    Splits of a file are ranges of bytes, and all rows of a file with one row group lie in one of them. So few
    splits bound the bytes that are moved; a larger input passes through untouched, whatever the size of the cluster.
    """
    return df.repartition(tasks, key) if df.rdd.getNumPartitions() <= tasks else df
