"""Counts of items that reach a floor, without shuffling the items that cannot.

In most corpora nearly all distinct words and n-grams occur once. A first pass counts hashed slots: every task fills one array of
counters that stop at the floor, and only these arrays are merged. An item whose slot stays below the floor occurs too seldom
itself. The second pass shuffles the other items alone and counts them exactly, so a slot shared by chance costs a
row and changes no result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

BLOCK = 1 << 16  # counters that are merged as one record
PART = 5_000_000  # occurrences of items, rare ones included, for which one task adds up counts


def _counters(rows: DataFrame, floor: int, slots: int) -> tuple[np.ndarray, int]:
    """Which slots reach the floor, as bits, and the number of items. ``rows`` has an array ``slot``; the driver gets a bit a slot."""
    kind = np.uint8 if floor < 1 << 7 else np.uint32
    size = min(BLOCK, slots)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, items = np.zeros(slots, kind), 0
        for batch in batches:
            found, times = np.unique(batch.column("slot").flatten().to_numpy(zero_copy_only=False), return_counts=True)
            items += int(times.sum())
            held[found] = np.minimum(held[found] + np.minimum(times, floor), floor)
        parts = held.reshape(-1, size)
        used = np.flatnonzero(parts.any(axis=1))
        counters = [np.int64(items).tobytes(), *(parts[i].tobytes() for i in used.tolist())]  # the first are all items
        packed = [pa.array([-1, *used.tolist()], pa.int32()), pa.array(counters, pa.binary())]
        yield pa.RecordBatch.from_arrays(packed, names=["block", "counters"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        if frame["block"].iloc[0] < 0:
            items = sum(int(np.frombuffer(c, np.int64)[0]) for c in frame["counters"])
            return pd.DataFrame({"block": frame["block"].iloc[:1], "bits": [np.int64(items).tobytes()]})
        total = np.zeros(size, np.int64)
        for counters in frame["counters"]:
            total += np.frombuffer(counters, kind)
        return pd.DataFrame({"block": frame["block"].iloc[:1], "bits": [np.packbits(total >= floor).tobytes()]})

    merged = rows.select("slot").mapInArrow(fill, "block int, counters binary").groupBy("block").applyInPandas(merge, "block int, bits binary")
    out, items = np.zeros((slots // size, size // 8), np.uint8), 0
    for r in merged.collect():
        if r["block"] < 0:
            items = int(np.frombuffer(r["bits"], np.int64)[0])
        else:
            out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel(), items


def able_items(df: DataFrame, items: Column, name: str, floor: int, slots: int = 1 << 24) -> DataFrame:
    """``(name, n)``: per batch of a task the counts of items whose slot reaches the floor. These rows are all that is shuffled."""
    return _able_items(df, items, name, floor, slots)[0]


def _able_items(df: DataFrame, items: Column, name: str, floor: int, slots: int) -> tuple[DataFrame, int]:
    """The same, with the number of all items."""
    if slots < 8 or slots & (slots - 1):
        raise ValueError("slots must be a power of two, 8 at least")
    listed = F.filter(items, lambda x: x.isNotNull())
    hashed = F.transform("item", lambda x: F.pmod(F.xxhash64(x), F.lit(slots)).cast("int"))
    rows = df.select(listed.alias("item")).withColumn("slot", hashed)  # a filter would be pushed down and compute the items twice
    bits, total = _counters(rows, floor, slots)
    sent = df.sparkSession.sparkContext.broadcast(bits.tobytes())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            slot = batch.column("slot").flatten().to_numpy(zero_copy_only=False)
            able = bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1
            counted = pc.value_counts(batch.column("item").flatten().filter(pa.array(able.astype(bool))))
            yield pa.RecordBatch.from_arrays([counted.field("values").cast(pa.string()), counted.field("counts").cast(pa.int64())], names=[name, "n"])

    return rows.mapInArrow(keep, f"`{name}` string, n bigint"), total


def floor_counts(df: DataFrame, items: Column, name: str, floor: int, slots: int = 1 << 24) -> DataFrame:
    """``(name, n)`` of the strings found at least ``floor`` times in the array ``items`` over all rows, counted exactly.

    ``slots`` (a power of two) should be some times the number of distinct items; fewer prune less and give the same rows. A task
    holds a byte a slot. Null items and null arrays count nothing; repeated rows count each time. ``df`` is read twice, so costly
    items should be stored before. Equal items are added up only where they meet, in as many tasks as keep ``PART`` items or fewer
    each, so what a task holds does not grow with the rows.
    """
    able, total = _able_items(df, items, name, floor, slots)
    able = able.repartition(max(8, -(-total // PART)), name)
    return able.groupBy(name).agg(F.sum("n").alias("n")).filter(F.col("n") >= floor)
