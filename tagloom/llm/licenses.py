"""License scans: notices and licence files against templates, then inheritance down the directories.

Passages are the lines of a file, all windows of as many consecutive words as a template has, over line
ends and comment marks, and of a licence file the whole text too. A passage and a template are compared by the cosine of their TF-IDF vectors, with document frequencies of all words from the
whole corpus.
A file without a notice takes the licence of the nearest directory above it that has a licence file.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import LOWER, blobs, chunks, join_by_weight, portable, stored

WORD_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in LOWER)  # words are [a-z0-9]+
#: How names of licence files begin; an extension or a label such as -MIT may follow.
FILE_NAMES = ("license", "licence", "copying", "notice", "unlicense")


def texts() -> list[tuple[str, str]]:
    """Full licence texts and standard headers, from the files ``<name>.txt`` and ``<name>.header.txt``."""
    folder = Path(__file__).with_name("license_texts")
    return [(p.name.removesuffix(".txt").removesuffix(".header"), p.read_text(encoding="utf-8")) for p in sorted(folder.glob("*.txt"))]


def _frequencies(files: DataFrame, most: int = 1 << 18) -> DataFrame:
    """``term, n``: in how many files each word occurs; the empty term holds the number of files."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(found: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([t.decode() for t in found], pa.string()), pa.array(found.values(), pa.int64())], names=["term", "n"])

        found = Counter()
        for batch in batches:
            found[b""] += batch.num_rows
            for b in blobs(batch):
                found.update(set(b.translate(WORD_BYTES).split()))
                if len(found) > most:
                    yield part(found)
                    found = Counter()
        yield part(found)

    return files.select("text").mapInArrow(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def _idf(files: int, frequency: int) -> float:
    return math.log((files + 1) / (frequency + 1)) + 1


@dataclass
class _Found:
    """The most alike template. ``words`` are those whose weight is not known yet and could change it."""

    name: str | None = None
    likeness: float | None = None
    words: frozenset[bytes] = frozenset()


class _Matcher:
    """The templates' vectors, and bounds that leave out what cannot reach ``least``.

    The weight of a word whose frequency is not given counts as 1, the least there is, so that the
    likeness is never below the true one.
    """

    def __init__(self, templates: Sequence[tuple[str, str]], idf: dict[bytes, float], least: float):
        self.least, self.idf = least, idf
        bags = [(name, Counter(text.encode().translate(WORD_BYTES).split())) for name, text in templates]
        self.templates, self.lengths = [], []
        for name, bag in bags:
            vector = {t: n * idf[t] for t, n in bag.items()}
            if vector:
                self.lengths.append(bag.total())
                self.templates.append((name, vector, math.sqrt(sum(v * v for v in vector.values()))))
        self.terms = {t: i for i, t in enumerate(sorted(set().union(*(v for _, v, _ in self.templates))))}
        self.squares = np.zeros((len(self.terms), len(self.templates)))
        for k, (_, vector, size) in enumerate(self.templates):
            for t, v in vector.items():
                self.squares[self.terms[t], k] = (v / size) ** 2

    def reach(self, words: set[bytes]) -> list[int]:
        """Templates of which these words make enough: the cosine is at most the norm of their share."""
        at = [self.terms[w] for w in words & self.terms.keys()]
        return np.flatnonzero(self.squares[at].sum(0) >= self.least**2 * 0.999).tolist() if at else []

    def windows(self, k: int, words: list[bytes], values: np.ndarray, least: float) -> Iterator[tuple[int, int, float, float]]:
        """Windows of consecutive words, as long as the template, that are ``least`` alike: begin, end, product, squared norm."""
        _, vector, size = self.templates[k]
        length = min(self.lengths[k], len(words))
        sums = np.concatenate(([0.0], np.cumsum(values * np.array([vector.get(w, 0.0) for w in words]))))
        dots = sums[length:] - sums[:-length]
        sums = np.concatenate(([0.0], np.cumsum(values**2)))  # the norm, did no word repeat; repeats only add to it
        near = dots >= (least - 1e-6) * size * 0.999999 * np.sqrt(np.maximum(sums[length:] - sums[:-length], 0))
        bag, square, begin, end = Counter(), 0.0, 0, 0
        for at in np.flatnonzero(near & (dots > 0)).tolist():
            if at >= end:
                bag, square, begin, end = Counter(), 0.0, at, at
            while end < at + length:
                n, value = bag[words[end]], float(values[end])
                square += (2 * n + 1) * value * value
                bag[words[end]] = n + 1
                end += 1
            while begin < at:
                n, value = bag[words[begin]], float(values[begin])
                square -= (2 * n - 1) * value * value
                bag[words[begin]] = n - 1
                begin += 1
            if dots[at] >= (least - 1e-6) * size * math.sqrt(square):
                yield at, at + length, float(dots[at]), square

    def best(self, text: bytes, whole: bool, rest: dict[bytes, float] | None = None) -> _Found:
        """``rest`` holds the weights of words in no template."""
        plain = text.translate(bytes(10 if i == 10 else c for i, c in enumerate(WORD_BYTES)))
        likely = self.reach(set(plain.split()))
        if not likely:
            return _Found()
        weights = self.idf if rest is None else {**rest, **self.idf}
        found: dict[tuple[float, str], set[bytes]] = {}  # words without a weight, by likeness and name

        def note(dot: float, square: float, k: int, words: Iterable[bytes]) -> None:
            name, _, size = self.templates[k]
            likeness = round(dot / (math.sqrt(square) * size), 6)
            if likeness >= self.least:
                found.setdefault((-likeness, name), set()).update(w for w in words if w not in weights)

        passages = plain.split(b"\n")
        for passage in [*passages, plain] if whole else passages:
            bag = Counter(passage.split())
            near = self.reach(bag.keys())
            square = sum((n * weights.get(t, 1.0)) ** 2 for t, n in bag.items()) if near else 0.0
            for k in near:
                vector = self.templates[k][1]
                note(sum(v * bag[t] * weights[t] for t, v in vector.items() if t in bag), square, k, bag)
        words = plain.split()
        values = np.array([weights.get(w, 1.0) for w in words])
        for k in likely:
            sure = max((-likeness for (likeness, _), open_ in found.items() if not open_), default=self.least)
            for begin, end, dot, square in self.windows(k, words, values, sure):
                note(dot, square, k, words[begin:end])
        if not found:
            return _Found()
        likeness, name = min(found)
        # What holds only words of known weight is exact; a better bound with other words is not.
        return _Found(name, -likeness, frozenset() if not found[likeness, name] else frozenset().union(*found.values()))


def _own(files: DataFrame, templates: Sequence[tuple[str, str]], least: float) -> DataFrame:
    """``key, path, own_license, similarity`` of every file."""
    frequencies = stored(_frequencies(files), "word-files")
    terms = sorted({w.decode() for _, text in templates for w in text.encode().translate(WORD_BYTES).split()})
    counts = {r["term"]: r["n"] for r in frequencies.filter(F.col("term").isin("", *terms)).collect()}  # of the templates alone
    total = counts.pop("", 0)
    idf = {t.encode(): _idf(total, counts.get(t, 0)) for t in terms}
    sent = files.sparkSession.sparkContext.broadcast((list(templates), idf, least))
    kind = files.schema["key"].dataType.simpleString()
    names = ["row", "key", "path", "own_license", "similarity", "whole", "text", "words"]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _Matcher(*sent.value)
        row = TaskContext.get().partitionId() << 40
        for batch in chunks(batches, "text"):
            texts = blobs(batch)
            found = [matcher.best(b, w) for b, w in zip(texts, batch.column("whole").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(row, row + len(found)), pa.int64()), batch.column("key"), batch.column("path"),
                    pa.array([f.name for f in found], pa.string()), pa.array([f.likeness for f in found], pa.float64()), batch.column("whole"),
                    pa.array([b if f.words else None for b, f in zip(texts, found)], pa.binary()).cast(pa.string()),
                    pa.array([[w.decode() for w in f.words] or None for f in found], pa.list_(pa.string())),
                ],
                names=names,
            )
            row += len(found)

    schema = f"row bigint, key {kind}, path string, own_license string, similarity double, whole boolean, text string, words array<string>"
    first = stored(files.mapInArrow(match, schema), "file-bounds")
    out = ["key", "path", "own_license", "similarity"]

    # Passages that may match and hold words of other files: again, with the weights of those words.
    unsure = first.filter("words is not null")
    words = unsure.select("row", F.explode("words").alias("term"))
    groups = frequencies.join(words.groupBy("term").agg(F.count("*").alias("times")), "term")
    met = join_by_weight(words, stored(groups, "open-words"), ["term"], "times", max(1, words.count()), how="inner")
    weighed = met.groupBy("row").agg(F.collect_list(F.struct("term", "n")).alias("rest"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _Matcher(*sent.value)
        for batch in chunks(batches, "text"):
            weights = [{r["term"].encode(): _idf(total, r["n"]) for r in rest} for rest in batch.column("rest").to_pylist()]
            found = [matcher.best(b, w, r) for b, w, r in zip(blobs(batch), batch.column("whole").to_pylist(), weights)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("path"), pa.array([f.name for f in found], pa.string()), pa.array([f.likeness for f in found], pa.float64())], names=out
            )

    second = unsure.join(weighed, "row").select("key", "path", "whole", "text", "rest")
    second = stored(second.mapInArrow(again, f"key {kind}, path string, own_license string, similarity double"), "file-matches")
    return first.filter("words is null").select(*out).unionByName(second)


def _directory(path: Column) -> Column:
    """What stands before the last slash; empty for a bare name, null for a null path."""
    return F.regexp_extract(path, "(?s)^(.*)/[^/]*$", 1)


def is_license_file(path: Column) -> Column:
    name = F.lower(F.regexp_extract(path, "([^/]*)$", 1))
    return F.coalesce(F.regexp_extract(name, "^([a-z]*)", 1).isin(*FILE_NAMES) & name.rlike(r"^[a-z]+([-._][a-z0-9]+)*$"), F.lit(False))


def scan(files: DataFrame, templates: Sequence[tuple[str, str]], path: str = "path", text: str = "text", key: str = "doc_id", least: float = 0.6) -> DataFrame:
    """Per row: ``key, path, own_license, similarity, license, inherited_from``.

    ``license`` is the file's own, else that of the nearest directory at or above its own with a
    matching licence file (most alike, then by name and path), whose path is ``inherited_from``. A
    null text matches nothing; a file with a null path inherits nothing; repeated rows stay.
    """
    rows = files.select(F.col(key).alias("key"), F.col(path).alias("path"), F.col(text).alias("text"), is_license_file(F.col(path)).alias("whole"))
    own = _own(rows, templates, least).withColumn("directory", _directory(F.col("path")))
    rank = F.struct((-F.col("similarity")).alias("likeness"), F.col("own_license").alias("license"), F.col("path").alias("origin"))
    given = own.filter(is_license_file(F.col("path")) & F.col("own_license").isNotNull()).groupBy("directory")
    given = stored(given.agg(F.min(rank).alias("best")).select("directory", "best.license", "best.origin"), "directory-licenses")

    # Joins go from directory to directory; files only look up their own one.
    directories = stored(own.filter("directory is not null").groupBy("directory").agg(F.count("*").alias("files")), "directories")
    parts = F.split("directory", "/")
    above = directories.select("directory", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"))
    above = above.withColumn("parent", F.array_join(F.slice(F.split("directory", "/"), F.lit(1), F.col("depth")), "/"))
    above = stored(above, "directory-parents")
    weights = above.groupBy(F.col("parent").alias("directory")).agg(F.count("*").alias("below"))
    offered = given.join(weights, "directory").withColumnRenamed("directory", "parent")
    met = join_by_weight(above, offered, ["parent"], "below", max(1, above.count()), how="inner")
    nearest = met.groupBy("directory").agg(F.max_by(F.struct("license", "origin"), "depth").alias("near"))
    nearest = nearest.join(directories, "directory").select("directory", "near", "files")
    joined = join_by_weight(own, stored(nearest, "inherited-licenses"), ["directory"], "files", max(1, own.count()))
    inherited = F.col("own_license").isNull() & F.col("near").isNotNull()
    return joined.select(
        F.col("key").alias(key), "path", "own_license", "similarity",
        F.coalesce("own_license", "near.license").alias("license"), F.when(inherited, F.col("near.origin")).alias("inherited_from"),
    )


portable(__name__)
