"""Helpers shared by the corpus operators: stored tables, code for tasks, byte classes of texts."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.session import scratch_path

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\f\r"  # [\x20\x09-\x0D]
#: Byte maps for ``bytes.translate``. UTF-8 bytes of other characters are 0x80 and above and stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ALNUM = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in LOWER)


def portable(module: str) -> None:
    """Send a module's functions to tasks by value, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a derived table below the shared folder and read it back; lost executors cost no rework."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """From now on rows of this session go to Python in batches of some ``most`` bytes, not of up to 64 MB, which an executor holds
    outside its heap for every running task. A value that the session was given stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, "67108864b"):
        spark.conf.set(name, str(most))


def blobs(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A batch's texts as UTF-8 bytes; null counts as empty."""
    return [b or b"" for b in batch.column(name).cast(pa.binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], name: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that their texts stay below ``most`` bytes; a longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_pylist()
        begin = held = 0
        for row, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(begin, row - begin)
                begin, held = row, 0
            held += size
        if batch.num_rows > begin:
            yield batch.slice(begin)


def most_frequent(df: DataFrame, times: str, most: int) -> DataFrame:
    """The rows with the highest counts, at most ``most`` of them, without sorting: a threshold on the count.

    Thresholds are the steps of a fine logarithmic scale, whose histogram has a few hundred rows.
    """
    step = F.floor(F.log2(F.col(times).cast("double")) * 16).cast("int")
    histogram = {r["step"]: r["n"] for r in df.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()}
    kept, least = 0, None
    for level in sorted((x for x in histogram if x is not None), reverse=True):
        kept += histogram[level]
        if kept > most:
            break
        least = level
    return df.filter(F.lit(False) if least is None else step >= least)


def fold(doc_id: str | Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit("")).cast("string").cast("binary")) % folds


def join_by_weight(rows: DataFrame, groups: DataFrame, on: list[str], weight: str, total: int, parts: int = 1000, how: str = "left") -> DataFrame:
    """Join (left or inner) of rows to the groups they belong to, where ``weight`` is how many rows a group has.

    Groups of more than ``total / parts`` rows are broadcast: there are fewer than ``parts`` of them.
    The others, none of them hot, are joined by a shuffle.
    """
    heavy = groups.filter(F.col(weight) * parts > total)
    light = groups.filter(F.col(weight) * parts <= total)
    hot = rows.join(F.broadcast(heavy), on)
    rest = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light, on, how)
    return hot.unionByName(rest)


portable(__name__)
