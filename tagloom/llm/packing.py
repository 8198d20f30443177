"""Cost-balanced packing of documents into sequences of a fixed length.

Documents become token ids; what fills whole sequences is cut off first. The rest of each document
goes, longest first, to the sequence with the lowest cost that still has room, where a piece of n
tokens costs ``linear * n + quadratic * n * n`` (attention). A piece that fits nowhere is cut. Work
is map-only: a task packs its own documents in blocks of bounded size, each block into as few
sequences as its tokens need, so at most one sequence of a block is padded.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import chunks, portable
from tagloom.llm.tokens import Encoder

SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def assign(lengths: list[int], room: int, linear: float = 1.0, quadratic: float = 1 / 1024) -> list[tuple[int, int, int, int]]:
    """Place pieces shorter than ``room``: (piece, start in it, length, sequence) in order of placement.

    As few sequences as the total needs. The longest piece is next; of the sequences with room for
    it, the one of lowest cost takes it (ties: the first). If none has room, the emptiest takes as
    much as fits and the rest queues again.
    """
    count = -(-sum(lengths) // room)
    left, cost = [room] * count, [0.0] * count
    ready = [(0.0, s) for s in range(count)]  # sequences that may have room, by cost
    short: list[tuple[int, int]] = []  # sequences seen too full, emptiest first
    queue = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(queue)
    placed = []
    while queue:
        n, piece, start = heapq.heappop(queue)
        n = -n
        while short and -short[0][0] >= n:
            s = heapq.heappop(short)[1]
            heapq.heappush(ready, (cost[s], s))
        while ready and left[ready[0][1]] < n:
            s = heapq.heappop(ready)[1]
            if left[s]:
                heapq.heappush(short, (-left[s], s))
        if ready:
            s, take = heapq.heappop(ready)[1], n
        else:
            s = heapq.heappop(short)[1]
            take = left[s]
            heapq.heappush(queue, (take - n, piece, start + take))
        placed.append((piece, start, take, s))
        left[s] -= take
        cost[s] += linear * take + quadratic * take * take
        if left[s]:
            heapq.heappush(ready, (cost[s], s))
    return placed


def pack(
    docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", room: int = 1024, end: int = 0,
    linear: float = 1.0, quadratic: float = 1 / 1024, block_tokens: int = 1 << 19,
) -> DataFrame:
    """Pieces of all documents: where each lies, and its ids as little-endian unsigned 32-bit numbers.

    ``vocabulary`` is the text of a tokenizer file. A null text counts as empty and has only the
    ``end`` id; a null ``key`` stays null; rows that repeat are packed each. Sequence numbers are
    unique, not consecutive, and a task that is run again gives the same ones.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema(
        [(n, pa.binary() if n == "ids" else pa.int64()) for n in "doc_id start length doc_tokens sequence_id offset ids".split()]
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        state = {"next": TaskContext.get().partitionId() << 40}
        rest: list[tuple] = []  # (key, start, tokens of the document, ids)

        def block() -> pa.RecordBatch:
            rows, offsets = [], {}
            base = state["next"]
            for i, start, take, s in assign([len(r[3]) for r in rest], room, linear, quadratic):
                doc, begin, total, ids = rest[i]
                at = offsets.get(s, 0)
                offsets[s] = at + take
                rows.append((doc, begin + start, take, total, base + s, at, ids[start : start + take].tobytes()))
            state["next"] += len(offsets)
            rest.clear()
            return _batch(rows, schema)

        held = 0
        for batch in chunks(batches, "__text", 8 << 20):
            rows = []
            for doc, content in zip(batch.column("__key").to_pylist(), batch.column("__text").to_pylist()):
                ids = np.append(encoder.ids(content or ""), end).astype("<u4")
                whole = len(ids) // room * room
                for begin in range(0, whole, room):
                    rows.append((doc, begin, room, len(ids), state["next"], 0, ids[begin : begin + room].tobytes()))
                    state["next"] += 1
                if whole < len(ids):
                    rest.append((doc, whole, len(ids), ids[whole:].copy()))
                    held += len(ids) - whole
                if held >= block_tokens:
                    yield block()
                    held = 0
                if len(rows) >= 4096:
                    yield _batch(rows, schema)
                    rows = []
            if rows:
                yield _batch(rows, schema)
        if rest:
            yield block()

    return docs.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text")).mapInArrow(packed, SCHEMA)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


portable(__name__)
