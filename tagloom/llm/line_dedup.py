"""Line dedup: lines whose key stands in many documents are dropped from all of them.

A line's key is the line without blanks at its ends, lower-cased in A-Z. Keys are told apart by 128
bits of hash. Everything is built from column expressions and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import ASCII_UPPER, BLANKS, join_by_weight, stored


def line_key(line: Column) -> Column:
    """``lower`` changes A-Z only where all characters are ASCII; other lines are translated."""
    bare = F.btrim(line, F.lit(BLANKS))
    plain = F.octet_length(bare) == F.char_length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, ASCII_UPPER, ASCII_UPPER.lower()))


def _hashed(line: Column) -> Column:
    key = line_key(line)
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), F.char_length(key).alias("size"))


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 10, shortest: int = 1) -> DataFrame:
    """Per row: ``doc_id, n_lines, n_dropped, kept``, where ``kept`` is the text of the lines that stay, in order.

    Lines end at ``\\n``; a null or empty text is one empty line. A key of at least ``shortest`` code
    points that stands in ``least`` rows or more drops all its lines. Repeated rows count each.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = docs.select(F.col(key).alias("doc_id"), F.split(whole, "\n", -1).alias("lines"))
    # A document names a key once, so counting rows counts documents; partial sums leave few of a common key.
    keys = F.array_distinct(F.transform("lines", _hashed))
    keys = stored(lines.select("doc_id", F.filter(keys, lambda k: k["size"] >= shortest).alias("keys")), "line-keys")
    counted = keys.select("doc_id", F.explode("keys").alias("k")).select("doc_id", "k.h1", "k.h2")
    often = counted.groupBy("h1", "h2").agg(F.count("*").alias("times")).filter(F.col("times") >= least)
    often = stored(often, "frequent-lines")
    total = often.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n")).first()["n"]
    hits = join_by_weight(counted, often, ["h1", "h2"], "times", total, how="inner")
    hits = hits.groupBy(F.col("doc_id").alias("of")).agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    # Ids that are null or repeat share the union of their rows' frequent keys, which changes no row.
    joined = lines.join(hits, F.col("doc_id").eqNullSafe(F.col("of")), "left")

    def stays(line: Column) -> Column:
        k = _hashed(line)
        return (k["size"] < shortest) | ~F.array_contains("gone", F.struct(k["h1"].alias("h1"), k["h2"].alias("h2")))

    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", stays))
    out = joined.withColumn("stay", kept)
    n = F.size("lines").cast("long")
    return out.select("doc_id", n.alias("n_lines"), (n - F.size("stay")).alias("n_dropped"), F.array_join("stay", "\n").alias("kept"))
