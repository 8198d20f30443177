"""Toxicity: a factorization machine over hashed terms.

A text's features are its distinct hashed terms. The score adds a weight per term and, through a
short vector per term, a weight for every pair of terms, which an additive model cannot learn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import ALNUM, blobs, chunks, portable, stored

BUCKETS = 1 << 22


@dataclass
class Machine:
    """``ids``: sorted hashed terms with weights; every other term weighs nothing."""

    ids: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, rows: np.ndarray, places: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """Scores of ``n`` texts from (row, place in ``ids``, value) triples."""
        return _sigmoid(self.bias + _margin(rows, places, values, n, self.linear, self.factors)[0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def _margin(rows, places, values, n, linear, factors):
    """Weights plus pair weights of each row, and the sum of its factors."""
    margin = np.bincount(rows, linear[places] * values, n).astype(float)  # without terms it counts in integers
    sums = np.empty((n, factors.shape[1]))
    for k in range(factors.shape[1]):
        v = factors[places, k] * values
        sums[:, k] = np.bincount(rows, v, n)
        margin += 0.5 * (sums[:, k] ** 2 - np.bincount(rows, v * v, n))
    return margin, sums


def _of_word(word: bytes) -> tuple[int, ...]:
    """The hashed terms of a word: itself and its first 5 and 6 bytes, which inflected forms share."""
    parts = [word] + [b"%d " % n + word[:n] for n in (5, 6) if len(word) > n]
    return tuple(zlib.crc32(p) % BUCKETS for p in parts)


def _triples(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of each text's places; the value is how often the place occurs, 4 at most."""
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    flat = np.array([p for x in lists for p in x], dtype=np.int64)
    pairs, times = np.unique(rows << 32 | flat, return_counts=True)
    return pairs >> 32, pairs & 0xFFFFFFFF, np.minimum(times, 4).astype(float)


def _sample(docs: DataFrame, labels: DataFrame, text: str, label: str, key: str, max_rows: int) -> DataFrame:
    """Hashed terms of the documents of at most ``max_rows`` labels, those with the smallest hashes of their ids.

    Only these few ids and labels travel to the documents; no text is shuffled.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = [set(b.translate(ALNUM).split()) for b in blobs(batch)]
            terms = pa.array([sorted(t for w in ws for t in _of_word(w)) for ws in words], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("label"), terms], names=["label", "terms"])

    marks = labels.filter(F.col(label).isNotNull()).select(F.col(key).alias("id"), F.col(label).cast("int").alias("label"))
    chosen = marks.orderBy(F.xxhash64("id"), "id", "label").limit(max_rows)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    return rows.select("label", "text").mapInArrow(hashed, "label int, terms array<int>")


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id",
    max_rows: int = 10_000, max_terms: int = 1 << 13,
    min_rows: int = 4, factors: int = 4, rounds: int = 60, shrink: float = 0.06, seed: int = 7,
) -> Machine:
    """Train on the documents of at most ``max_rows`` labels (null labels and null ids are left out).

    Of the terms found in ``min_rows`` rows or more, the ``max_terms`` whose shares differ most
    between the labels get weights. Proximal steps with soft thresholds (``shrink`` over the root of
    the row count) drive the weights of uninformative terms to zero, so long clean texts do not add
    up noise. Without rows, or with one label only, the machine returns that share of ones.
    """
    sample = stored(_sample(docs, labels, text, label, key, max_rows), "toxicity-sample")
    totals = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    n, ones = max(1, totals["n"]), totals["ones"]
    gap = F.abs(F.col("ones") / max(1, ones) - (F.col("rows") - F.col("ones")) / max(1, n - ones))
    rate = F.col("rows") / (n + 1)
    found = sample.select("label", F.explode(F.array_distinct("terms")).alias("term"))
    found = found.groupBy("term").agg(F.count("*").alias("rows"), F.sum("label").alias("ones")).filter(F.col("rows") >= min_rows)
    found = found.orderBy((gap / F.sqrt(rate * (1 - rate))).desc(), "term").limit(max_terms)
    ids = np.array(sorted(r["term"] for r in found.collect()), dtype=np.int64)
    kept = sample.sparkSession.sparkContext.broadcast(ids)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(t, dtype=np.int64) for t in batch.column("terms").to_pylist()]
            rows = [np.searchsorted(kept.value, t[np.isin(t, kept.value)]) for t in rows]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.list_(pa.int32()))], names=["label", "terms"])

    data = sample.mapInArrow(known, "label int, terms array<int>").toArrow()
    return _descend(ids, data, factors, rounds, shrink, seed)


def _descend(ids, data, width, rounds, shrink, seed) -> Machine:
    y = np.array(data.column("label").to_pylist(), dtype=float)
    n, d = len(y), len(ids)
    share = float(y.mean()) if n else 0.0
    if share in (0.0, 1.0):
        return Machine(ids, -30.0 if share == 0.0 else 30.0, np.zeros(d), np.zeros((d, width)))
    rows, places, values = _triples(data.column("terms").to_pylist())
    rng = np.random.default_rng(seed)
    bias, linear = np.log(share / (1 - share)), np.zeros(d)
    v = rng.normal(0, 0.02, (d, width))
    seen_w, seen_v, seen_b = np.full(d, 1e-8), np.full((d, width), 1e-8), 1e-8
    squared, shrink = values**2, shrink / np.sqrt(n)
    for _ in range(rounds):
        margin, sums = _margin(rows, places, values, n, linear, v)
        g = (_sigmoid(bias + margin) - y) / n
        each = g[rows] * values
        gw, own = np.bincount(places, each, d), np.bincount(places, g[rows] * squared, d)
        seen_w += gw * gw
        step = 0.5 / np.sqrt(seen_w)
        linear -= step * gw
        linear = np.sign(linear) * np.maximum(np.abs(linear) - step * shrink, 0)
        for k in range(width):
            gv = np.bincount(places, each * sums[rows, k], d) - v[:, k] * own
            seen_v[:, k] += gv * gv
            step = 0.05 / np.sqrt(seen_v[:, k])
            v[:, k] -= step * gv
            v[:, k] = np.sign(v[:, k]) * np.maximum(np.abs(v[:, k]) - step * shrink, 0)
        seen_b += g.sum() ** 2
        bias -= 0.1 * g.sum() / np.sqrt(seen_b)
    return Machine(ids, float(bias), linear, v)


def score(docs: DataFrame, machine: Machine, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of every row and its score from 0 to 1.

    The whole text counts; a null or empty text gets the score of a text without terms. A text that is kept is sent to Python
    once, not a second time to be scored.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    scoring = text if text in keep else "__text"
    sent_columns = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias(scoring))
    used = np.flatnonzero((machine.linear != 0) | (machine.factors != 0).any(axis=1))  # the others change nothing
    small = machine.ids[used], machine.bias, machine.linear[used], machine.factors[used]
    sent = docs.sparkSession.sparkContext.broadcast(small)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Machine(*sent.value)
        place = {int(t): i for i, t in enumerate(model.ids)}
        memo: dict[bytes, tuple[int, ...]] = {}  # of word to places; bounded

        def places(text: bytes) -> list[int]:
            found: list[int] = []
            for w in set(text.translate(ALNUM).split()):
                at = memo.get(w)
                if at is None:
                    at = tuple(place[t] for t in _of_word(w) if t in place)
                    if len(memo) < 300_000 and len(w) < 40:
                        memo[w] = at
                found += at
            return found

        for batch in chunks(batches, scoring):
            lists = [places(b) for b in blobs(batch, scoring)]
            got = pa.array(model.score(*_triples(lists), len(lists)), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), got], names=[*keep, out])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return sent_columns.mapInArrow(scored, f"{fields}, `{out}` double")


portable(__name__)
