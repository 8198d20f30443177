"""Row identity: unions, provenance, dense numbering, removal by key, first rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.session import checkpoint_dir, pin_small


def flag_union(train: DataFrame, test: DataFrame, flag: str = "is_test") -> DataFrame:
    """Train and test rows in one frame, told apart by a flag."""
    return train.withColumn(flag, F.lit(False)).unionByName(test.withColumn(flag, F.lit(True)))


def split_by_flag(df: DataFrame, flag: str = "is_test") -> tuple[DataFrame, DataFrame]:
    """Back to train and test rows, without the flag."""
    return df.filter(~F.col(flag)).drop(flag), df.filter(F.col(flag)).drop(flag)


def drop_keys(df: DataFrame, keys: DataFrame, key: str = "row_id") -> DataFrame:
    """Remove the rows whose key is listed."""
    return df.join(keys.select(key), key, "left_anti")


def append_rows(df: DataFrame, *more: DataFrame) -> DataFrame:
    """Put rows back; columns are matched by name."""
    for rows in more:
        df = df.unionByName(rows)
    return df


def head_per_class(df: DataFrame, n: int = 1, label: str = "sdg", key: str = "row_id") -> DataFrame:
    """The first n rows of each class in key order.

    Spark turns the rank filter into a group limit below the shuffle, so of a hot class every
    task sends at most n rows on.
    """
    rank = F.row_number().over(Window.partitionBy(label).orderBy(key))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def head(df: DataFrame, n: int, key: str = "row_id") -> DataFrame:
    return df.orderBy(key).limit(n)


def concat_corpora(
    parts: Sequence[tuple[str, DataFrame]], key: str = "row_id", drop: Sequence[str] = ("author",)
) -> DataFrame:
    """Merge corpora, keeping where each row came from.

    ``subset`` names the source, ``subset_index`` is the row's old key, and the key becomes a dense
    number from 0: sources in the given order, old order inside each. Columns that a source lacks
    are null.
    """
    merged = None
    for order, (name, df) in enumerate(parts):
        part = (
            df.drop(*drop)
            .withColumnRenamed(key, "subset_index")
            .withColumns({"subset": F.lit(name), "_part": F.lit(order)})
        )
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    return number_keys(merged, "_part", "subset_index", key).drop("_part")


def number_keys(df: DataFrame, part: str, key: str, out: str) -> DataFrame:
    """Dense numbers from 0 in (part, key) order, for a key that is unique and not null in each part.

    Only the narrow keys are sorted, in ranges cut at sampled quantiles, so outlying or hashed keys
    crowd no range. The numbers come back to the rows by the key; a null or repeated key raises.
    """
    known = F.when(F.col(key).isNotNull(), F.col(key)).otherwise(F.raise_error(F.lit(f"null in {key}")))
    keys = df.select(part, known.alias(key))
    # counted by the columns of the join, so the same exchange serves both
    numbers = dense_index(keys, F.asc(part), F.asc(key), out=out).groupBy(part, key).agg(F.min(out).alias(out), F.count("*").alias("_times"))
    repeated = F.raise_error(F.concat(F.lit(f"{key} is repeated: "), F.col(key).cast("string")))
    numbers = numbers.select(part, key, F.when(F.col("_times") == 1, F.col(out)).otherwise(repeated).alias(out))
    return df.join(numbers, [part, key])


def dense_index(df: DataFrame, *order: Column, out: str = "index") -> DataFrame:
    """Dense numbers from 0 in any sort order, without a one-task window.

    A range sort is checkpointed so that its partitions stay as they are; a row's number is the
    rows in the partitions before its own plus its place there. The sort order must be total.
    """
    checkpoint_dir(df.sparkSession)
    ordered = df.orderBy(*order).checkpoint()
    placed = ordered.withColumns(
        {"_task": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}
    )
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_task")
        .agg(F.count("*").alias("_n"))
        .select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.join(pin_small(offsets), "_task")
        .withColumn(out, F.col("_offset") + F.col("_place"))
        .drop("_task", "_place", "_offset")
    )
