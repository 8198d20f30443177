"""Benchmark decontamination: windows of benchmark words looked up in the windows of every document.

A word is a run of ASCII letters, digits and characters beyond ASCII, lower-cased in A-Z. A window is
``width`` consecutive words of an item; an item of fewer words is one window. Windows found by their
hash are verified word by word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import ALNUM, blobs, chunks, portable, stored

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of ``width`` word numbers, modulo 2**64."""
    n = len(ids) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(width if n > 0 else 0):
        out = out * BASE + ids[i : i + n]
    return out


class _Windows:
    """The windows of a block of items: word numbers, sorted hashes, and the items of each window."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.words: dict[bytes, int] = {}
        self.items = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.items)}
        self.owners: dict[bytes, set[int]] = defaultdict(set)
        hashes: dict[int, set[int]] = defaultdict(set)
        for item, text in items:
            ids = np.array([self.words.setdefault(w, len(self.words) + 1) for w in text.translate(ALNUM).split()], np.uint64)
            size = min(width, len(ids))
            for at, h in enumerate(_rolling(ids, size) if size else ()):
                self.owners[ids[at : at + size].tobytes()].add(number[item])
                hashes[size].add(int(h))
        self.hashes = {size: np.array(sorted(found), np.uint64) for size, found in hashes.items()}

    def find(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, merged (begin, end) word ranges of occurring windows, and their items."""
        words = text.translate(ALNUM).split()
        get = self.words.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        ranges, items = [], set()
        for size, hashes in self.hashes.items():
            if len(ids) < size:
                continue
            begins = np.flatnonzero(known[size:] - known[:-size] == size)  # only words that the items use
            if not len(begins):
                continue
            begins = begins[np.isin(_rolling(ids, size)[begins], hashes)]
            for at in begins.tolist():
                owners = self.owners.get(ids[at : at + size].tobytes())
                if owners:
                    ranges.append((at, at + size))
                    items.update(self.items[k] for k in owners)
        merged: list[tuple[int, int]] = []
        for begin, end in sorted(ranges):
            if merged and begin <= merged[-1][1]:
                merged[-1] = merged[-1][0], max(end, merged[-1][1])
            else:
                merged.append((begin, end))
        return len(words), merged, items


def _blocks(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of at most about ``most`` bytes; the first block is all of a small benchmark."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-2 * total // most)) if total > most else 1
    for part in range(parts):
        block = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        yield [(r["item"] or "", r["text"].encode()) for r in block.collect()]


def scan(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    width: int = 13, block_bytes: int = 2 << 20, keep: list[str] | None = None,
) -> DataFrame:
    """Add to each row ``n_words``, ``spans`` (begin, end word ranges of hits) and ``items`` (sorted ids).

    Whole texts are scanned; null or empty texts have no words, null item texts no windows, and a
    null item id counts as the empty text. A benchmark beyond ``block_bytes`` is broadcast in blocks,
    one after the other, whose spans are joined row by row, so its size has no limit.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "spans", "items")]
    found = pa.struct([
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
        ("items", pa.list_(pa.string())),
    ])
    spark = docs.sparkSession

    def scanned(rows: DataFrame, items: list[tuple[str, bytes]], text: Column, keep: list[str]) -> DataFrame:
        """Texts alone travel to Python, once; the kept columns wait where they are."""
        sent = spark.sparkContext.broadcast(items)

        def search(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            windows = _Windows(sent.value, width)
            for batch in texts:
                rows = []
                for part in chunks(iter([pa.RecordBatch.from_arrays([batch], names=["text"])]), "text", 1 << 20):
                    for n, spans, names in map(windows.find, blobs(part)):
                        rows.append({"n_words": n, "spans": [{"begin": b, "end": e} for b, e in spans], "items": sorted(names)})
                yield pa.array(rows, found)

        kind = "n_words bigint, spans array<struct<begin:int,end:int>>, items array<string>"
        scan_text = F.arrow_udf(search, kind).asNondeterministic()  # so that no plan computes it twice
        return rows.select(*keep, scan_text(text).alias("__found")).select(*keep, "__found.n_words", "__found.spans", "__found.items")

    blocks = _blocks(benchmark, item, item_text, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return scanned(docs, first, F.col(text), keep)
    rows = docs.select(*keep, F.col(text).alias("__text"), F.monotonically_increasing_id().alias("__row"))
    rows = stored(rows, "decontamination-rows")
    parts = [stored(scanned(rows, b, F.col("__text"), ["__row"]), "decontamination-block") for b in chain((first, second), blocks)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    every = every.groupBy("__row").agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return rows.drop("__text").join(every, "__row").select(*keep, "n_words", "spans", "items")


def hit_words(spans: str = "spans"):
    """How many words lie in at least one of the ranges."""
    ordered = F.array_sort(spans)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))

    def add(state, span):
        begin = F.greatest(span["begin"], state["upto"])
        return F.struct(
            (state["n"] + F.greatest(span["end"] - begin, F.lit(0))).alias("n"), F.greatest(span["end"], state["upto"]).alias("upto")
        )

    return F.aggregate(ordered, start, add, lambda s: s["n"])


def judge(scanned: DataFrame) -> DataFrame:
    """Per row: words, hit words, items, and whether hits reach a twentieth of the words."""
    hits = scanned.withColumn("n_hit", hit_words())
    return hits.withColumns(
        {
            "n_items": F.size("items").cast("long"),
            "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")),
        }
    )


def without_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = 13) -> DataFrame:
    """Rows with the hit words cut out of their texts; what stands between words stays. Null stays null."""
    marked = scan(docs, benchmark, text, width=width, keep=docs.columns)
    return remove_spans(marked, text).drop("n_words", "spans", "items")


def remove_spans(marked: DataFrame, text: str = "text") -> DataFrame:
    names = marked.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            spans = batch.column("spans").to_pylist()
            out = [_cut(t, s) if t and s else t for t, s in zip(texts, spans)]
            columns = [pa.array(out, pa.binary()).cast(pa.string()) if c == text else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return marked.mapInArrow(cut, marked.schema)


def _cut(text: bytes, spans: list[dict]) -> bytes:
    mask = np.frombuffer(text.translate(ALNUM), np.uint8) != 32
    edges = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    kept, at = [], 0
    for span in sorted(spans, key=lambda s: s["begin"]):
        begin, end = int(begins[span["begin"]]), int(ends[span["end"] - 1])
        kept.append(text[at : max(at, begin)])
        at = max(at, end)
    return b"".join([*kept, text[at:]])


portable(__name__)
