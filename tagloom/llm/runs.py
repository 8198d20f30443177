"""Periodic runs of words: difference-cover longest common extensions on a harmonic grid.

A run with period ``q`` is a stretch in which words ``q`` apart are identical. The places where a word
equals the one ``q`` further form a stretch of at least ``q`` places, so one of them is a multiple of
``q``: the grid of all ``(k * q, (k + 1) * q)`` meets every run, with ``n * log n`` points in all. From
each point at which the two words agree, the run is as long as the words agree to both sides.

How far they agree is a longest common extension. Only the suffixes at places of a difference cover
(4 places of 13) are sorted, by their first 13 words and then by doubling. For any two places there is a
distance below 13 at which both lie in the cover: the words up to there are compared, the rest is a range
minimum over the sorted suffixes' common lengths, read from a sparse table. A second structure over the
reversed words extends to the left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import blobs, chunks, portable

#: A difference cover. Every difference modulo the period is one between two members.
PERIOD, COVER = 13, (0, 1, 3, 9)
STRETCH = 4 << 20  # bytes of text that a task treats at once; a longer text stands alone
POINTS = 1 << 20  # grid points looked at at once


class Extensions:
    """``common(i, j)``: how many words from ``i`` on equal those from ``j`` on.

    ``words`` are numbers from 0. ``owner`` names the text of each place; places of different texts are
    never asked for. Each text must be followed by a number of its own, which ends every extension.
    """

    def __init__(self, words: np.ndarray, owner: np.ndarray):
        self.words = np.concatenate((words.astype(np.int64) + 1, np.zeros(3 * PERIOD, np.int64)))
        self.slot = np.full(PERIOD, -1, np.int64)
        self.slot[list(COVER)] = np.arange(len(COVER))
        ahead = np.arange(PERIOD)[:, None, None] + np.arange(PERIOD)
        inside = self.slot[ahead % PERIOD] >= 0  # place, distance
        self.delta = np.argmax(inside.reshape(PERIOD, 1, PERIOD) & inside.reshape(1, PERIOD, PERIOD), axis=2)
        self._sort(len(words), owner)

    def _sort(self, size: int, owner: np.ndarray):
        places = (np.arange(-(-size // PERIOD))[:, None] * PERIOD + np.array(COVER)).ravel()
        places = places[places < size]  # only the last few can lie beyond, so numbers stay without gaps
        bits = max(1, int(self.words.max()).bit_length())
        each = 63 // bits
        keys = []
        for begin in range(0, PERIOD, each):
            key = np.zeros(len(places), np.int64)
            for i in range(begin, min(begin + each, PERIOD)):
                key = key << bits | self.words[places + i]
            keys.append(key)
        keys = [owner[places], *keys]
        order = np.lexsort(keys[::-1])
        rank = self._ranks(order, *keys)
        levels = [rank]
        while len(places) and levels[-1].max() + 1 < len(places):
            step = len(COVER) << (len(levels) - 1)
            after = np.zeros(len(places), np.int64)
            after[: max(0, len(places) - step)] = levels[-1][step:] + 1
            key = levels[-1] * (len(places) + 1) + after
            order = np.argsort(key, kind="stable")
            levels.append(self._ranks(order, key))
        self.rank = levels[-1].astype(np.int32)
        self.tables = [self._lengths(places, order, owner, levels)]
        while (2 << (len(self.tables) - 1)) <= len(places):
            last, half = self.tables[-1], 1 << (len(self.tables) - 1)
            self.tables.append(np.minimum(last[:-half], last[half:]))

    @staticmethod
    def _ranks(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
        """Numbers without gaps of equal keys, in their order."""
        new = np.zeros(len(order), np.int64)
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        return rank

    def _lengths(self, places, order, owner, levels) -> np.ndarray:
        """Words that each sorted suffix has in common with the one before it; none across texts."""
        out = np.zeros(len(order), np.int32)
        a, b = order[:-1], order[1:]
        ask = np.flatnonzero(owner[places[a]] == owner[places[b]]) if len(order) else np.zeros(0, np.int64)
        a, b = a[ask], b[ask]
        equal = np.zeros(len(ask), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            step = len(COVER) << level
            inside = (a < len(places)) & (b < len(places))
            same = np.flatnonzero(inside)
            same = same[levels[level][a[same]] == levels[level][b[same]]]
            a[same] += step
            b[same] += step
            equal[same] += PERIOD << level
        first, second = places[order[:-1][ask]], places[order[1:][ask]]
        out[1:][ask] = equal + self._compare(first + equal, second + equal, np.full(len(ask), PERIOD))[0]
        return out

    def _compare(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal words from ``i`` and ``j`` on, ``most`` at most, and which pairs reached that."""
        equal = np.zeros(len(i), np.int64)
        alive = np.flatnonzero(most > 0)
        while len(alive):
            at = equal[alive]
            alive = alive[self.words[i[alive] + at] == self.words[j[alive] + at]]
            equal[alive] += 1
            alive = alive[equal[alive] < most[alive]]
        return equal, equal == most

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        most = self.delta[i % PERIOD, j % PERIOD]
        equal, reached = self._compare(i, j, most)
        ask = np.flatnonzero(reached)
        if len(ask):
            a, b = i[ask] + most[ask], j[ask] + most[ask]
            a, b = (self.rank[p // PERIOD * len(COVER) + self.slot[p % PERIOD]] for p in (a, b))
            low, high = np.minimum(a, b) + 1, np.maximum(a, b)  # lengths from low to high, both included
            level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
            least = np.empty(len(ask), np.int64)
            for k in np.unique(level).tolist():
                own = np.flatnonzero(level == k)
                table = self.tables[k]
                least[own] = np.minimum(table[low[own]], table[high[own] - (1 << k) + 1])
            equal[ask] += least
        return equal


def _grid(begins: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of grid points: a place and a period, for texts of these begins and sizes."""
    halves = sizes // 2
    text = np.repeat(np.arange(len(sizes)), halves)
    period = np.arange(len(text)) - np.repeat(np.cumsum(halves) - halves, halves) + 1
    times = (sizes[text] - 1) // period if len(text) else period
    upto = np.cumsum(times)
    at = 0
    while at < len(text):
        done = int(upto[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(upto, done + POINTS, side="right")))
        each = times[at:to]
        step = np.repeat(period[at:to], each)
        number = np.arange(len(step)) - np.repeat(np.cumsum(each) - each, each)
        yield np.repeat(begins[text[at:to]], each) + number * step, step
        at = to


def runs_of(texts: list[np.ndarray], least: int) -> tuple[np.ndarray, ...]:
    """``text, start, length, period`` of all runs of texts of word numbers, by text, start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes  # a mark of its own before each text and after the last
    total = int(sizes.sum()) + len(texts) + 1
    flat = np.concatenate([np.zeros(0, np.int64), *texts])
    words = np.zeros(total, np.int64)
    marks = np.concatenate((begins - 1, [total - 1]))
    inside = np.ones(total, bool)
    inside[marks] = False
    words[inside] = flat
    words[marks] = int(flat.max(initial=0)) + 1 + np.arange(len(marks))
    owner = np.cumsum(~inside)
    found = [np.zeros((3, 0), np.int64)]
    points = []
    for place, period in _grid(begins, sizes):
        agree = words[place] == words[place + period]
        points.append(np.stack((place[agree], period[agree])))
    points = np.concatenate([np.zeros((2, 0), np.int64), *points], axis=1)
    if points.shape[1]:
        right, left = Extensions(words, owner), Extensions(words[::-1], owner[::-1])
        for at in range(0, points.shape[1], POINTS):
            place, period = points[:, at : at + POINTS]
            start = place - left.common(total - place, total - place - period)
            length = place + period + right.common(place, place + period) - start
            kept = length >= np.maximum(least, 2 * period)
            found.append(np.unique(np.stack((start, length, period))[:, kept], axis=1))
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)  # the smallest of the periods of a stretch
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    text = np.searchsorted(begins, start, side="right") - 1
    return text, start - (begins[text] if len(text) else 0), length, period


def _collapsed(words: list[bytes], starts, lengths, periods) -> bytes:
    """The words that no run repeats, with one blank between them."""
    if not len(starts):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts + periods, 1)
    np.add.at(edges, starts + lengths, -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()])


def find_runs(docs: DataFrame, text: str = "text", least: int = 12, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of every row, ``n_words``, ``runs`` and ``collapsed``.

    ``runs`` are all maximal runs of at least ``least`` words and two periods, as ``start, length,
    period`` with the smallest period, by start and then period. ``collapsed`` holds the words that no run
    contains after its first period, joined by one blank. Words are runs without ASCII blanks.

    Whole texts are treated where they lie, without a shuffle; a text must fit a task. A null, empty or
    blank text has no words, no runs and an empty collapsed text. Repeated rows are treated each for
    itself. Columns that are named like the new ones give way to them; others pass through.
    """
    new = ("n_words", "runs", "collapsed")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__text", STRETCH):
            texts = [b.split() for b in blobs(batch, "__text")]
            sizes = np.array([len(t) for t in texts], np.int64)
            coded = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
            cuts = np.cumsum(sizes)[:-1]
            which, *run = runs_of(np.split(coded.indices.to_numpy().astype(np.int64), cuts), least)
            edges = np.searchsorted(which, np.arange(len(texts) + 1))
            found = pa.StructArray.from_arrays([pa.array(c) for c in run], ["start", "length", "period"])
            out = [
                _collapsed(words, *(c[b:e] for c in run)) for words, b, e in zip(texts, edges[:-1].tolist(), edges[1:].tolist())
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in keep), pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(edges, pa.int32()), found), pa.array(out, pa.binary()).cast(pa.string()),
                ],
                names=[*keep, *new],
            )

    schema = f"{fields}n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(search, schema)


portable(__name__)
