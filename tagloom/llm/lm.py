"""A hidden Markov language model over words.

Words are runs without blanks, lower-cased in A-Z, and an end mark. Frequent words are outcomes of
their own; all others share one outcome, inside which a word has a probability from its count.
Baum-Welch iterations add up expected counts of every partition; the scaled forward recursion gives
the exact likelihood of a whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import LOWER, blobs, chunks, join_by_weight, most_frequent, portable, stored

END_ID = np.zeros(1, np.int32)  # the end mark's outcome


@dataclass
class Model:
    """Start, transition (row to column) and emission (outcome by state) probabilities."""

    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray


class _Steps:
    """Texts laid out by position: the first outcomes of all, then the second ones, longest text first."""

    def __init__(self, texts: list[np.ndarray]):
        lengths = np.array([len(t) for t in texts], np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        self.active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        self.begins = np.concatenate(([0], np.cumsum(self.active)))
        self.flat = np.empty(self.begins[-1], np.int32)
        for place, text in enumerate(self.order):
            self.flat[self.begins[: lengths[place]] + place] = texts[text]

    def forward(self, model: Model, keep: bool = False):
        """Natural log-likelihood per text (in the given order); scaled forward values and scales if kept."""
        states = len(model.start)
        found = np.zeros(len(self.order))
        ahead = np.empty((len(self.flat) if keep else 0, states), np.float32)
        scales = np.empty(len(ahead), np.float32)
        now, ones = None, np.ones(states, np.float32)
        for t, m in enumerate(self.active.tolist()):
            at = self.begins[t]
            emits = model.emits.take(self.flat[at : at + m], 0)
            now = emits * model.start if now is None else (now[:m] @ model.moves) * emits
            scale = now @ ones  # a product is many times faster than a sum over so few columns
            now /= scale[:, None]
            found[:m] += np.log(scale, dtype=np.float64)
            if keep:
                ahead[at : at + m], scales[at : at + m] = now, scale
        out = np.empty(len(found))
        out[self.order] = found
        return out, ahead, scales

    def expected(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, moves and emissions of the texts."""
        _, ahead, scales = self.forward(model, keep=True)
        moves = np.zeros_like(model.moves, dtype=np.float64)
        active = self.active.tolist()
        back = np.ones((active[-1], len(model.start)), np.float32)
        turned = np.ascontiguousarray(model.moves.T)
        for t in range(len(active) - 2, -1, -1):
            at, after, m = self.begins[t], self.begins[t + 1], active[t + 1]
            flow = model.emits.take(self.flat[after : after + m], 0)
            flow *= back
            flow /= scales[after : after + m, None]
            moves += ahead[at : at + m].T @ flow
            ahead[after : after + m] *= back
            back = np.ones((active[t], len(model.start)), np.float32)
            back[:m] = flow @ turned
        ahead[: active[0]] *= back
        outcomes = len(model.emits)
        emits = np.stack([np.bincount(self.flat, ahead[:, k], outcomes) for k in range(ahead.shape[1])], 1)
        return ahead[: active[0]].sum(0, dtype=np.float64), moves * model.moves, emits


def _words(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def _frequent(train: DataFrame, often: int, most: int, hold: int = 1 << 18) -> list[tuple[str, int]]:
    """Words found ``often`` times in all training texts, the most frequent, with their counts; of bounded number and length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(found: Counter) -> pa.RecordBatch:
            rows = list(found.items())
            return pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in rows], pa.binary()).cast(pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["word", "times"]
            )

        found = Counter()
        for batch in chunks(batches, "text"):
            for b in blobs(batch):
                found.update(w for w in _words(b) if len(w) <= 48)
                if len(found) > hold:  # sums of a task go on by word in the next step; none is dropped
                    yield part(found)
                    found = Counter()
        yield part(found)

    counted = train.select("text").mapInArrow(count, "word string, times bigint").groupBy("word").agg(F.sum("times").alias("times"))
    return sorted((r["word"], r["times"]) for r in most_frequent(stored(counted.filter(F.col("times") >= often), "lm-frequent"), "times", most).collect())


def _encode(docs: DataFrame, frequent: list[str]) -> DataFrame:
    """Texts as outcome numbers, and the words that share the last outcome. 0 is the end mark."""
    sent = docs.sparkSession.sparkContext.broadcast([w.encode() for w in frequent])
    rare = len(frequent) + 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(sent.value, 1)}
        row = TaskContext.get().partitionId() << 40
        for batch in chunks(batches, "text", 8 << 20):
            ids, odd_words, odd_times = [], [], []
            edges, odd_edges = [0], [0]
            for b in blobs(batch):
                words = _words(b)
                got = np.fromiter(map(number.get, words, repeat(rare)), np.int32, len(words))
                odd = Counter(words[i] for i in np.flatnonzero(got == rare).tolist())
                ids += [got, END_ID]
                edges.append(edges[-1] + len(got) + 1)
                odd_words += odd
                odd_times += odd.values()
                odd_edges.append(len(odd_words))
            rest = pa.StructArray.from_arrays([pa.array(odd_words, pa.binary()).cast(pa.string()), pa.array(odd_times, pa.int64())], names=["word", "times"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(row, row + len(edges) - 1), pa.int64()), batch.column("doc_id"), batch.column("held_out"),
                    pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(ids))),
                    pa.ListArray.from_arrays(pa.array(odd_edges, pa.int32()), rest),
                ],
                names=["row", "doc_id", "held_out", "ids", "rest"],
            )
            row += len(edges) - 1

    schema = f"row bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, ids array<int>, rest array<struct<word:string,times:bigint>>"
    return docs.select("doc_id", "held_out", "text").mapInArrow(encode, schema)


def _rare_counts(encoded: DataFrame) -> tuple[DataFrame, int, int]:
    """Per row: occurrences of rare words known from training, and the sum of log10(c + 0.5) of all rare words.

    Also the number of known rare words, and of their occurrences in training. A long or late word
    may be in many rows: counts are combined inside tasks, and hot words are joined by broadcast.
    """
    rest = encoded.select("row", "held_out", F.explode("rest").alias("r")).select("row", "held_out", "r.word", "r.times")
    seen = F.sum(F.when(F.col("held_out"), 0).otherwise(F.col("times"))).alias("seen")
    words = stored(rest.groupBy("word").agg(F.count("*").alias("rows"), seen), "lm-rare-words")
    total, known, times = words.agg(F.sum("rows"), F.count(F.when(F.col("seen") > 0, 1)), F.sum("seen")).first()
    met = join_by_weight(rest.select("row", "word", "times"), words, ["word"], "rows", total or 1, how="inner")
    known_times = F.sum(F.when(F.col("seen") > 0, F.col("times")).otherwise(0)).cast("double")
    logs = F.sum(F.col("times") * F.log10(F.col("seen") + F.lit(0.5)))
    return met.groupBy("row").agg(known_times.alias("known"), logs.alias("logs")), known, times or 0


def _batches(batches: Iterator[pa.RecordBatch], most: int = 1_500_000, hold: int = 8_000_000) -> Iterator[tuple[list[np.ndarray], pa.Table]]:
    """Texts of like length in groups of about ``most`` outcomes, with their rows; a longer text stands alone.

    Up to ``hold`` outcomes are sorted by length, so that few groups have long texts: a group takes
    as many steps as its longest text has outcomes.
    """

    def grouped(held: list[np.ndarray], parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts)
        lengths = np.array([len(t) for t in held])
        order = np.argsort(-lengths, kind="stable")
        group = (np.cumsum(lengths[order]) - lengths[order]) // most
        for part in np.split(order, np.flatnonzero(np.diff(group)) + 1):
            yield [held[i] for i in part], rows.take(part)

    held, parts, size = [], [], 0
    for batch in batches:
        column = batch.column("ids")
        values, edges = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        held += [values[b:e] for b, e in zip(edges[:-1], edges[1:])]
        parts.append(batch)
        size += int(edges[-1] - edges[0])
        if size >= hold:
            yield from grouped(held, parts)
            held, parts, size = [], [], 0
    if held:
        yield from grouped(held, parts)


def _expected(train: DataFrame, model: Model) -> DataFrame:
    """Expected counts, added up over all training texts: one row per outcome, state or start."""
    sent = train.sparkSession.sparkContext.broadcast((model.start, model.moves, model.emits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        start, moves, emits = np.zeros(len(model.start)), np.zeros(model.moves.shape), np.zeros(model.emits.shape)
        for texts, _ in _batches(batches):
            s, m, e = _Steps(texts).expected(model)
            start += s
            moves += m
            emits += e
        used = np.flatnonzero(emits.any(axis=1))
        rows = [*([int(i), *emits[i]] for i in used), *([-1 - k, *moves[k]] for k in range(len(moves))), [-1 - len(moves), *start]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["of", *(f"s{k}" for k in range(len(start)))])

    states = len(model.start)
    schema = "of bigint, " + ", ".join(f"s{k} double" for k in range(states))
    sums = [F.sum(f"s{k}").alias(f"s{k}") for k in range(states)]
    return train.select("ids").mapInArrow(count, schema).groupBy("of").agg(*sums)


def _first_model(counts: np.ndarray, states: int, seed: int) -> Model:
    """Emissions near the word frequencies, disturbed by seeded noise, and states that tend to stay."""
    rng = np.random.default_rng(seed)
    share = (counts + 0.5) / (counts + 0.5).sum()
    emits = share[:, None] * np.exp(rng.normal(size=(len(counts), states)))
    stay = 0.9 if states > 1 else 1.0
    moves = np.full((states, states), (1 - stay) / max(1, states - 1))
    np.fill_diagonal(moves, stay)
    return Model(*(x.astype(np.float32) for x in (np.full(states, 1 / states), moves, emits / emits.sum(0))))


def score(
    docs: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id",
    states: int = 12, rounds: int = 5, max_words: int = 1 << 15, often: int = 8, prior: float = 5.0, seed: int = 7,
) -> DataFrame:
    """Per row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` in log10.

    The model learns from all whole texts that are not held out (null ``held_out`` counts as true).
    A null or empty text is the end mark alone. At most ``max_words`` words have outcomes of their
    own. Emission counts get ``prior`` occurrences spread like the words of the corpus. Without
    training texts all words are unknown.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.col(text).alias("text"))
    frequent = _frequent(rows.filter(~F.col("held_out")), often, max_words)
    encoded = stored(_encode(rows, [w for w, _ in frequent]), "lm-texts", "zstd")
    train = encoded.filter(~F.col("held_out"))
    rare, rare_words, rare_times = _rare_counts(encoded)
    rare = stored(rare, "lm-rare")
    counts = np.array([train.count(), *(n for _, n in frequent), rare_times], np.float64)  # of end marks, words, the shared outcome
    model = _first_model(counts, states, seed)
    for _ in range(rounds if counts.sum() else 0):
        model = _improved(_expected(train, model).toPandas(), counts, states, prior)

    total, distinct = counts.sum(), (counts[:-1] > 0).sum() + rare_words
    base_floor = np.log10(total + 0.5 * (distinct + 1))
    rare_floor = np.log10(rare_times + 0.5 * (rare_words + 1))
    base_logs = np.append(np.log10(counts[:-1] + 0.5), 0.0)  # of rare words the sums are known
    sent = docs.sparkSession.sparkContext.broadcast((model.start, model.moves, model.emits, base_logs, counts > 0))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *parts, logs, seen = sent.value
        model = Model(*parts)
        seen = seen.copy()
        seen[-1] = False
        for texts, origin in _batches(batches):
            found = _Steps(texts).forward(model)[0] / np.log(10)
            yield from origin.select(["row", "doc_id", "held_out"]).append_column(
                "n_tokens", pa.array([len(t) for t in texts], pa.int64())
            ).append_column("n_rare", pa.array([int((t == len(logs) - 1).sum()) for t in texts], pa.int64())).append_column(
                "n_seen", pa.array([int(seen[t].sum()) for t in texts], pa.int64())
            ).append_column("logs_seen", pa.array([float(logs[t].sum()) for t in texts], pa.float64())).append_column(
                "likelihood", pa.array(found, pa.float64())
            ).combine_chunks().to_batches()

    kind = encoded.schema["doc_id"].dataType.simpleString()
    schema = f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_rare bigint, n_seen bigint, logs_seen double, likelihood double"
    judged = encoded.select("row", "doc_id", "held_out", "ids").mapInArrow(judge, schema)
    judged = judged.join(rare, "row", "left").fillna(0.0, ["known", "logs"])
    base = F.col("logs_seen") + F.col("logs") - F.col("n_tokens") * F.lit(float(base_floor))
    return judged.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_seen") + F.col("known")).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"),
        (F.col("likelihood") + F.col("logs") - F.col("n_rare") * F.lit(float(rare_floor))).alias("score"),
    )


def _improved(rows: pd.DataFrame, counts: np.ndarray, states: int, prior: float) -> Model:
    """The next model from the added expected counts."""
    share = (counts + 0.5) / (counts + 0.5).sum()
    start, moves, emits = np.full(states, 0.1), np.full((states, states), 0.1), np.repeat(prior * share[:, None], states, axis=1)
    of, values = rows["of"].to_numpy(), rows.drop(columns="of").to_numpy()
    emits[of[of >= 0]] += values[of >= 0]
    moves[-1 - of[(of < 0) & (of >= -states)]] += values[(of < 0) & (of >= -states)]
    start += values[of == -1 - states].sum(0)
    return Model(*(x.astype(np.float32) for x in (start / start.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))))


portable(__name__)
