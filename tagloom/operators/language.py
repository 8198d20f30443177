"""Language identification as a corpus job.

A profile holds how often each character n-gram occurs in each language of a labelled table. A text
is scored per language by the sum, over its n-grams, of ``log((count + 1) / (total + grams))``;
n-grams the profile has never seen say nothing. The best language wins, ties to the first by name.

The profile is built by one aggregation. Scoring a text needs nothing but the profile, so a profile
of checked size goes to every task and each text is scored where it lies: no text is shuffled. A
larger profile is joined to the n-grams instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tagloom.functions.text import char_ngrams, collapse_whitespace
from tagloom.operators.features import each, item_counts

GRAMS = 1 << 21  # n-grams that a task sorts at once
POINT_BITS = 21  # a Unicode code point fits, and three of them fit a 64-bit integer


def _squeezed(text: str) -> Column:
    return collapse_whitespace(F.lower(F.col(text)))


def language_profile(df: DataFrame, text: str = "text", lang: str = "lang", n: int = 3) -> DataFrame:
    """``(lang, gram, n)`` counts of a labelled table, summed inside each task before the shuffle.

    N-grams that fit an integer are counted by sorting them, some texts at a time; no row per n-gram arises.
    """
    if n * POINT_BITS >= 64:
        grams = each(df.withColumnRenamed(lang, "lang"), char_ngrams(_squeezed(text), n), "gram", ["lang"])
        return grams.groupBy("lang", "gram").agg(F.count("*").alias("n"))
    packed, unpacked, at_once = _packer(n), _unpacker(n), GRAMS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0

        def flush(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                grams, times = np.unique(np.concatenate(parts), return_counts=True)
                columns = [pa.array([name] * len(grams), kind), pa.array(unpacked(grams), pa.string()), pa.array(times, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])

        for batch in batches:
            kind = batch.column("lang").type
            for name, body in zip(batch.column("lang").to_pylist(), batch.column("body")):
                if body.is_valid:
                    grams = packed(body.as_py())
                    held.setdefault(name, []).append(grams)
                    size += len(grams)
                    if size >= at_once:
                        yield from flush(kind)
                        held, size = {}, 0
        if held:
            yield from flush(kind)

    labelled = df.select(F.col(lang).alias("lang"), _squeezed(text).alias("body"))
    counted = labelled.mapInArrow(count, f"lang {df.schema[lang].dataType.simpleString()}, gram string, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def gram_counts(profile: DataFrame, languages: Sequence[str]) -> DataFrame:
    """``(gram, n0, n1, ...)``: one row per n-gram with its count in each language."""
    counts = [F.coalesce(F.sum(F.when(F.col("lang") == name, F.col("n"))), F.lit(0)) for name in languages]
    wide = profile.filter(F.col("lang").isin(*languages)).groupBy("gram")
    return wide.agg(*[count.alias(f"n{i}") for i, count in enumerate(counts)])


def detect_language(
    df: DataFrame,
    profile: DataFrame,
    languages: Sequence[str],
    text: str = "text",
    out: str = "detected",
    n: int = 3,
    max_grams: int = 1_000_000,
) -> DataFrame:
    """Add the language of each text; null where the text is null or has no known n-gram.

    Rows need no key. A profile of at most ``max_grams`` n-grams goes to every task and texts are
    scored where they lie. With a larger one, texts meet it by a join on the n-gram, and the scores
    come back by a hash of the text; the answers are the same.
    """
    languages = sorted(languages)
    counts = gram_counts(profile, languages)
    counts.persist(StorageLevel.MEMORY_AND_DISK)
    if counts.count() <= max_grams:
        small = counts.toPandas()
        counts.unpersist()
        score = _scorer(df, small, languages, n)
        return df.withColumn(out, score(_squeezed(text)))
    marked = df.withColumn("_text_hash", F.md5(text))
    return marked.join(_detect_by_join(marked, counts, languages, text, "_text_hash", out, n), "_text_hash", "left").drop("_text_hash")


def _detect_by_join(
    df: DataFrame, counts: DataFrame, languages: Sequence[str], text: str, key: str, out: str, n: int
) -> DataFrame:
    """``(key, out)``: a text's different n-grams meet their counts by a join, and scores are summed per text.

    Equal texts share a key, which scales their sums alike and leaves the best language as it is.
    """
    places = range(len(languages))
    total = counts.agg(F.count("*").alias("grams"), *[F.sum(f"n{i}").alias(f"n{i}") for i in places]).first()
    below = [float(total["grams"] + (total[f"n{i}"] or 0)) for i in places]
    logs = [F.log((F.col(f"n{i}") + 1) / below[i]).alias(f"w{i}") for i in places]
    weights = counts.select("gram", sum((F.col(f"n{i}") for i in places), F.lit(0)).alias("seen"), *logs)
    grams = _text_grams(df, text, key, n)
    # n-grams of over a 50,000th of the profile, fewer than 50,000, are broadcast; the rest is shuffled, and never hot
    hot = F.col("seen") * 50_000 > sum((total[f"n{i}"] or 0) for i in places)
    common, rare = F.broadcast(weights.filter(hot)), weights.filter(~hot)
    met = grams.join(common, "gram").unionByName(grams.join(common, "gram", "left_anti").join(rare, "gram"))
    sums = F.array(*[F.sum(F.col("n") * F.col(f"w{i}")) for i in places])
    scores = met.groupBy(key).agg(sums.alias("_scores"))
    best = F.array_position("_scores", F.array_max("_scores")).cast("int")
    names = F.array(*[F.lit(name) for name in languages])
    return scores.select(key, F.element_at(names, best).alias(out))


def keep_language(
    df: DataFrame,
    profile: DataFrame,
    languages: Sequence[str],
    language: str = "en",
    text: str = "text",
) -> DataFrame:
    """The rows whose text is in one language; the helper column does not stay."""
    found = detect_language(df, profile, languages, text, out="_detected")
    return found.filter(F.col("_detected") == language).drop("_detected")


def keep_language_column(df: DataFrame, language: str = "en", lang: str = "lang") -> DataFrame:
    """The same where a trusted language column exists; the column does not stay."""
    return df.filter(F.col(lang) == language).drop(lang)


def _packer(n: int):
    """A function that turns every n-gram of a text into one integer.

    It is made here, not named in the module, so that tasks get it with the job and need no package.
    """

    def packed(text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        length = max(len(points) - n + 1, 0)
        grams = np.zeros(length, dtype=np.uint64)
        for place in range(n):
            if n * POINT_BITS < 64:
                grams <<= np.uint64(POINT_BITS)
            else:  # longer n-grams are hashed to 64 bits
                grams = (grams ^ (grams >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            grams += points[place : place + length]
        return grams

    return packed


def _unpacker(n: int):
    """The n-grams of integers that hold their characters."""

    def unpacked(grams: np.ndarray) -> list[str]:
        points = np.stack([grams >> np.uint64(POINT_BITS * place) & np.uint64((1 << POINT_BITS) - 1) for place in range(n)[::-1]], axis=1)
        joined = points.astype("<u4").tobytes().decode("utf-32-le")
        return [joined[begin : begin + n] for begin in range(0, len(joined), n)]

    return unpacked


def _text_grams(df: DataFrame, text: str, key: str, n: int) -> DataFrame:
    """``(key, gram, n)``: how often each n-gram occurs in its own text, by sorting the text's n-grams; nothing is shuffled."""
    if n * POINT_BITS >= 64:
        return item_counts(df, char_ngrams(_squeezed(text), n), "gram", [key])
    packed, unpacked, at_once = _packer(n), _unpacker(n), GRAMS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            grams, times = (np.concatenate(c) for c in zip(*(c for _, *c in held)))
            names = pa.array([name for name, *_ in held], pa.string()).take(pa.array(np.repeat(np.arange(len(held)), [len(g) for _, g, _ in held])))
            columns = [names, pa.array(unpacked(grams), pa.string()), pa.array(times, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["key", "gram", "n"])

        held, size = [], 0
        for batch in batches:
            for name, body in zip(batch.column("key"), batch.column("body")):
                if body.is_valid:
                    held.append((name.as_py(), *np.unique(packed(body.as_py()), return_counts=True)))
                    size += len(held[-1][1])
                    if size * 8 >= at_once:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    rows = df.select(F.col(key).alias("key"), _squeezed(text).alias("body"))
    return rows.mapInArrow(count, "key string, gram string, n bigint").withColumnRenamed("key", key)


def _scorer(df: DataFrame, counts: pd.DataFrame, languages: Sequence[str], n: int):
    """A vectorised function ``text -> language`` over a profile that every task holds."""
    packed = _packer(n)
    grams = packed("".join(counts["gram"]))[::n]
    order = np.argsort(grams)
    seen = counts.drop(columns="gram").to_numpy(dtype=np.float64)[order]
    weights = np.log((seen + 1) / (seen.sum(axis=0) + len(seen)))
    profile: Broadcast = df.sparkSession.sparkContext.broadcast((grams[order], weights))

    @F.pandas_udf("string")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, weight = profile.value
        for texts in batches:
            yield texts.map(lambda text: None if text is None else best(text, known, weight))

    def best(text: str, known: np.ndarray, weight: np.ndarray) -> str | None:
        grams = packed(text)
        at = np.searchsorted(known, grams)
        at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == grams)] if len(known) else at[:0]
        return languages[int(weight[at].sum(axis=0).argmax())] if len(at) else None

    # keeps Catalyst from scoring a text again for each use of the column, or below a shuffle
    return score.asNondeterministic()
