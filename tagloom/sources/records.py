"""Delimited records whose quoted fields may hold line breaks, read by as many tasks as the files have splits.

A line can only be understood if one knows whether it begins inside a quoted field. Each split is therefore read twice.
The first pass notes, for each split, its lines and how it would end if it began outside or inside of a quoted field; put
together along a file, these two answers tell how every split really begins. The second pass joins the lines of each record.
Only the pieces of records that cross from one split into the next travel.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.session import collect_small, store

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

CLOSING = re.compile(r'(?:[^"]++|"")*+"')  # up to the quote that ends a quoted field
LONGEST = 16 << 20  # characters of a record; a longer one is a quote that nothing closes


def ends_inside(line: str, inside: bool, sep: str = "\t") -> bool:
    """Whether a quoted field is open at the end of the line. A quote only opens a field where the field begins."""
    at = 0
    while True:
        if inside:
            closing = CLOSING.match(line, at)
            if closing is None:
                return True
            inside, at = False, line.find(sep, closing.end())
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        else:
            at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and the place where their split begins, in order within a task."""
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")]
    return spark.read.option("lineSep", "\n").text(path).select(*where, "value")


def _splits(lines: DataFrame, sep: str) -> DataFrame:
    """``(file, split, first, inside)``: the number of a split's first line, and whether it begins inside of a quoted field."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], list] = {}  # a task's splits: lines, end if begun outside, end if begun inside
        for batch in batches:
            quoted = pc.match_substring(batch.column("value"), '"').to_pylist()
            for file, split, value, q in zip(*(batch.column(c).to_pylist() for c in ("file", "split", "value")), quoted):
                state = seen.setdefault((file, split), [0, False, True])
                state[0] += 1
                if q:
                    state[1], state[2] = ends_inside(value, state[1], sep), ends_inside(value, state[2], sep)
        rows = [(*k, *v) for k, v in seen.items()]
        names = ["file", "split", "lines", "outside", "inside"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    found = store(lines.mapInArrow(walk, "file string, split bigint, lines bigint, outside boolean, inside boolean"), "file-splits")
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    # A split that ends alike from either side settles all that follows; the others keep or turn over what they find.
    settles, turns = F.col("outside") == F.col("inside"), F.col("outside") & ~F.col("inside")
    marked = found.withColumns(
        {
            "first": F.coalesce(F.sum("lines").over(earlier), F.lit(0)) + 1,
            "settled": F.coalesce(F.last(F.when(settles, F.col("outside")), ignorenulls=True).over(earlier), F.lit(False)),
            "stretch": F.coalesce(F.sum(settles.cast("int")).over(earlier), F.lit(0)),
        }
    )
    since = Window.partitionBy("file", "stretch").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    turned = F.coalesce(F.sum(turns.cast("int")).over(since), F.lit(0)) % 2 == 1
    return marked.select("file", "split", "first", (F.col("settled") != turned).alias("inside"))


def scan_records(spark: SparkSession, path: str, sep: str = "\t", header: bool = True) -> DataFrame:
    """``(file, line, record, closed)``: every record with the number of its first line in its file.

    Lines of one quoted field are joined by their line break. ``closed`` is false where the file ends inside a quoted field, or
    a record grew beyond 16 million characters; of such a record that many are kept. A record's trailing carriage return and empty
    records go. With ``header`` the first record of each file goes. Nothing is assumed about where splits begin.
    """
    lines = _lines(spark, path)
    splits = _splits(lines, sep)
    small = collect_small(splits)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole records as kind 0; what a split begins with inside a field as kind 1 (closed here) or 2, what it leaves open as 3."""
        here, parts, size, kind, begun, inside, number = None, [], 0, 0, 0, False, 0
        rows: list[tuple] = []

        def finish(ended: int):
            nonlocal parts, size
            rows.append((*here, begun, ended, "\n".join(parts), size))
            parts, size = [], 0

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["file", "split", "line", "kind", "record", "size"])
            rows.clear()
            return out

        for batch in batches:
            quoted = pc.match_substring(batch.column("value"), '"').to_pylist()
            columns = [batch.column(c).to_pylist() for c in ("file", "split", "first", "inside", "value")]
            for file, split, first, open_before, value, q in zip(*columns, quoted):
                if (file, split) != here:
                    if parts:
                        finish(2 if kind else 3)
                    here, number, inside = (file, split), first, open_before
                    kind, begun = (1 if inside else 0), first
                if not parts:
                    begun = number
                if size < LONGEST:
                    parts.append(value)
                elif not parts[-1:] == [""]:
                    parts.append("")  # the rest of an endless record only counts
                size += len(value) + 1
                if q:
                    inside = ends_inside(value, inside, sep)
                if not inside:
                    finish(kind)
                    kind = 0
                number += 1
            if rows:
                yield batch_of()
        if parts:
            finish(2 if kind else 3)
        if rows:
            yield batch_of()

    if small is not None:  # lines stay where they are read, in order
        placed = lines.join(F.broadcast(small), ["file", "split"])
    else:
        numbered = lines.withColumn("at", F.monotonically_increasing_id())
        placed = numbered.join(splits, ["file", "split"]).repartition("file", "split").sortWithinPartitions("file", "split", "at")
    pieces = placed.select("file", "split", "first", "inside", "value").mapInArrow(
        join, "file string, split bigint, line bigint, kind int, record string, size bigint"
    )
    pieces = store(pieces, "record-pieces")
    crossing = pieces.filter("kind > 0")
    order = Window.partitionBy("file").orderBy("split", "line")
    crossing = crossing.withColumn("group", F.sum((F.col("kind") == 3).cast("int")).over(order))
    before = Window.partitionBy("file", "group").orderBy("split", "line").rowsBetween(Window.unboundedPreceding, -1)
    needed = F.coalesce(F.sum("size").over(before), F.lit(0)) <= LONGEST  # of an endless record only the beginning is gathered
    crossing = crossing.withColumn("record", F.when(needed, F.col("record")))
    sorted_parts = F.array_sort(F.collect_list(F.when(F.col("record").isNotNull(), F.struct("split", "line", "record"))))
    stitched = crossing.groupBy("file", "group").agg(
        F.min("line").alias("line"), F.max(F.when(F.col("kind") == 1, 1).otherwise(0)).alias("ended"), F.sum("size").alias("size"),
        F.array_join(F.transform(sorted_parts, lambda p: p["record"]), "\n").alias("record"),
    )
    whole = pieces.filter("kind = 0").select("file", "line", "record", (F.col("size") <= LONGEST).alias("closed"))
    joined = stitched.select("file", "line", "record", ((F.col("ended") == 1) & (F.col("size") <= LONGEST)).alias("closed"))
    records = whole.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r$", "")).filter("record != ''")
    return records.filter("line > 1") if header else records


def read_records(
    spark: SparkSession, path: str, schema: str | T.StructType, sep: str = "\t", header: bool = True, most_bad: float = 0.0
) -> tuple[DataFrame, DataFrame]:
    """Good rows, with their ``file`` and ``line``, and bad ones as ``file, line, cause, record``.

    A record is bad if a quote is not closed, it has too few or too many fields, or a value does not fit its column's
    type; the first cause in this order is named. A bad share of more than ``most_bad`` raises, so 0 accepts none. Empty
    fields are null. Good and bad rows together are all records.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = [f"f{i}" for i in range(len(wanted))]
    as_text = ", ".join(f"{f} string" for f in fields) + ", broken string"
    options = {"sep": sep, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken", "maxCharsPerColumn": "-1"}
    options |= {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    records = scan_records(spark, path, sep, header)
    parsed = records.withColumn("p", F.from_csv("record", as_text, options))
    value = lambda f: F.nullif(F.col(f"p.{f}"), F.lit(""))
    cause = F.when(~F.col("closed"), "quote not closed").when(F.col("p.broken").isNotNull(), "number of fields")
    for f, field in zip(fields, wanted):
        if not isinstance(field.dataType, T.StringType):
            misfit = value(f).isNotNull() & value(f).try_cast(field.dataType).isNull()
            cause = cause.when(misfit, f"{field.name} is no {field.dataType.simpleString()}")
    columns = [value(f).try_cast(field.dataType).alias(field.name) for f, field in zip(fields, wanted)]
    judged = store(parsed.select("file", "line", "record", cause.alias("cause"), F.struct(*columns).alias("row")), "judged-records")
    bad = judged.filter("cause is not null").select("file", "line", "cause", "record")
    counts = judged.agg(F.count("*").alias("n"), F.count("cause").alias("bad")).first()
    if counts["bad"] > most_bad * counts["n"]:
        first = bad.orderBy("file", "line").first()
        raise ValueError(f"{counts['bad']} of {counts['n']} records are bad, such as line {first['line']} of {first['file']}: {first['cause']}")
    return judged.filter("cause is null").select("file", "line", "row.*"), bad
