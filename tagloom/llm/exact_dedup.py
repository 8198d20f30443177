"""Exact dedup by counting quotient filters.

Each partition builds a filter of its documents' 64-bit fingerprints: high bits choose a slot, the
low bits are kept as sorted remainders with counts. Filters merge without loss, slot range by slot
range, by merging sorted remainders and adding counts. Texts whose fingerprint counts more than one
are then grouped by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import BLANKS, blobs, chunks, join_by_weight, portable, stored

SLOT_BITS = 10  # slots of a filter range
DROP = BLANKS.encode()


def _fingerprint(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, code points of the text, hash of the original text, SHA-256 and fingerprint without blanks."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            digests = [hashlib.sha256(b.translate(None, DROP)).digest() for b in blobs(batch)]
            columns = [
                batch.column("doc_id"), batch.column("points"), batch.column("origin"),
                pa.array(digests, pa.binary()), pa.array(map(_fingerprint, digests), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "points", "origin", "sha", "print"])

    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.length(whole).cast("long").alias("points"),
        F.xxhash64(text).alias("origin"), F.col(text).alias("text"),
    )
    return rows.mapInArrow(hashed, "doc_id bigint, points bigint, origin bigint, sha binary, print bigint")


def range_bits(rows: int, per_range: int = 1 << 17) -> int:
    """Bits that cut the fingerprints into ranges of about ``per_range`` at most."""
    return max(0, int(np.ceil(np.log2(max(1, rows / per_range)))))


def _filters(prints: np.ndarray, counts: np.ndarray, bits: int) -> pd.DataFrame:
    """One row per range of slots: run length of each slot, sorted remainders, their counts."""
    slots = prints >> np.uint64(64 - bits - SLOT_BITS)
    remainders = prints & np.uint64((1 << (64 - bits - SLOT_BITS)) - 1)
    ranges = (slots >> np.uint64(SLOT_BITS)).astype(np.int64)
    edges = np.flatnonzero(np.diff(ranges, prepend=-1)).tolist() + [len(ranges)]
    rows = []
    for begin, end in zip(edges[:-1], edges[1:]):
        runs = np.bincount((slots[begin:end] & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64), minlength=1 << SLOT_BITS)
        rows.append((int(ranges[begin]), runs.astype("<u4").tobytes(), remainders[begin:end].tobytes(), counts[begin:end].tobytes()))
    return pd.DataFrame(rows, columns=["range", "runs", "remainders", "counts"])


def _merged(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted runs (a stable sort merges them) and add the counts of equal fingerprints."""
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1]))) if len(prints) else np.zeros(0, np.int64)
    return prints[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def build_filters(prints: DataFrame, bits: int, name: str = "print", most: int = 1 << 22) -> DataFrame:
    """The filters of every partition; a partition of over ``most`` distinct values writes several."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            new = batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            held, counts = _merged(np.concatenate((held, new)), np.concatenate((counts, np.ones(len(new), np.int64))))
            if len(held) > most:
                yield pa.RecordBatch.from_pandas(_filters(held, counts, bits), preserve_index=False)
                held, counts = held[:0], counts[:0]
        if len(held):
            yield pa.RecordBatch.from_pandas(_filters(held, counts, bits), preserve_index=False)

    return prints.select(name).mapInArrow(build, "range bigint, runs binary, remainders binary, counts binary")


def merge_filters(filters: DataFrame, bits: int, least: int = 2) -> DataFrame:
    """``(print, copies)`` of the fingerprints that count ``least`` or more over all filters.

    A range holds about as many values as ``range_bits`` allows; copies add to counts, not to values.
    """
    low = 64 - bits - SLOT_BITS

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        prints, counts = [], []
        for at, runs, remainders, times in group[["range", "runs", "remainders", "counts"]].itertuples(index=False):
            slots = np.repeat(np.arange(1 << SLOT_BITS, dtype=np.uint64), np.frombuffer(runs, "<u4"))
            slots = slots | np.uint64(at) << np.uint64(SLOT_BITS) if bits else slots
            prints.append(slots << np.uint64(low) | np.frombuffer(remainders, np.uint64))
            counts.append(np.frombuffer(times, np.int64))
        found, times = _merged(np.concatenate(prints), np.concatenate(counts))
        keep = times >= least
        return pd.DataFrame({"print": found[keep].view(np.int64), "copies": times[keep]})

    return filters.groupBy("range").applyInPandas(merge, "print bigint, copies bigint")


def _slots_of(prints: DataFrame, bits: int = 24) -> DataFrame:
    """The slots in use as words of 64 bits: at most ``2 ** (bits - 6)`` rows, whatever the input."""
    slot = F.shiftrightunsigned("print", 64 - bits)
    word, bit = F.shiftright(slot, 6), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(print, {64 - bits}) & 63 as int))")
    return prints.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))


def _candidates(docs: DataFrame, repeated: DataFrame, text: str, key: str, bits: int = 24) -> DataFrame:
    """Texts without blanks whose slot is in use: all that repeat, and few others."""

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            texts = [b.translate(None, DROP) for b in blobs(batch)]
            digests = [hashlib.sha256(b).digest() for b in texts]
            columns = [
                batch.column("doc_id"), batch.column("points"), pa.array(digests, pa.binary()),
                pa.array(map(_fingerprint, digests), pa.int64()), pa.array(texts, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "points", "sha", "print", "plain"])

    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.length(whole).cast("long").alias("points"), F.col(text).alias("text"))
    rows = rows.mapInArrow(plain, "doc_id bigint, points bigint, sha binary, print bigint, plain binary")
    slot = F.shiftrightunsigned("print", 64 - bits)
    rows = rows.withColumn("word", F.shiftright(slot, 6))
    rows = rows.join(F.broadcast(_slots_of(repeated, bits)), "word")
    used = F.expr(f"shiftrightunsigned(bits, cast(shiftrightunsigned(print, {64 - bits}) & 63 as int)) & 1")
    return rows.filter(used == 1).select("doc_id", "points", "sha", "print", "plain")


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: ``doc_id, keep_id, group_size, kept, text_sha256`` and ``origin``, a hash of the original text.

    Texts are equal when identical without blanks; null counts as empty, and empty texts are equal.
    Of equal texts the longest original stays, then the smallest id; a null id comes last. ``kept``
    is true for the rows whose id stays, so rows repeated with their id share the answer.
    """
    rows = stored(fingerprints(docs, text, key), "fingerprints")
    total = rows.count()
    bits = range_bits(total)
    repeated = stored(merge_filters(build_filters(rows, bits), bits), "repeated-prints")
    # Grouping by the bytes first inside each task sends a text once per task, not once per copy.
    best = F.max(F.struct("points", F.bitwise_not("doc_id").alias("back"), "doc_id")).alias("best")
    groups = _candidates(docs, repeated, text, key).groupBy("print", "sha", "plain").agg(F.count("*").alias("group_size"), best)
    groups = groups.filter("group_size > 1").select("print", "sha", "group_size", F.col("best.doc_id").alias("keep_id"))
    groups = stored(groups, "copy-groups")
    joined = join_by_weight(rows, groups, ["print", "sha"], "group_size", total)
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "origin",
    )


portable(__name__)
