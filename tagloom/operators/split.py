"""Exact stratified splits.

Rows are ordered inside their class by a seeded hash of their key, and the first ones go to train.
Sorting each class whole would put a hot class into one task, so the cut is found in two steps:
rows are counted per class and hash prefix, and only the one prefix that holds a class's cut is
ranked row by row. The result is one (hash, key) cut per class, which is broadcast to a plain scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tagloom.session import collect_small, pin_small

PREFIX = 4  # hex digits of the hash that form a counting bucket: 65,536 buckets per class


def row_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def class_quotas(sizes: DataFrame, by: str, test_size: float) -> DataFrame:
    """Train rows per class, given ``(class, n, first_key)``.

    The test set has ``ceil(test_size * rows)`` rows. Train rows are shared in proportion to class
    size, first the whole parts and then by largest remainder, ties to the smaller class.
    """
    total = F.sum("n").over(Window.partitionBy())
    shares = sizes.withColumn("_all", total).withColumn(
        "_train", F.col("_all") - F.ceil(F.lit(float(test_size)) * F.col("_all"))
    )
    # products of two row counts do not fit a 64-bit integer at scale
    product = "cast(n as decimal(19,0)) * cast(_train as decimal(19,0))"
    whole = F.expr(f"cast({product} div cast(_all as decimal(19,0)) as bigint)")
    rest = F.expr(f"({product}) % cast(_all as decimal(19,0))")
    shares = shares.withColumns({"_whole": whole, "_rest": rest})
    missing = F.col("_train") - F.sum("_whole").over(Window.partitionBy())
    turn = F.row_number().over(Window.orderBy(F.col("_rest").desc(), F.col(by).asc_nulls_last()))
    return shares.select(by, "n", "first_key", (F.col("_whole") + (turn <= missing).cast("bigint")).alias("quota"))


def class_cuts(
    df: DataFrame, by: str, test_size: float, key: str, seed: int, rare_rules: bool = False
) -> DataFrame:
    """Per class: its size, train quota, first key, and the (hash, key) of its last train row.

    Class and key are kept while the cuts are found, so that what leads up to ``df``, such as a
    filter on its texts, runs once for them and not once per step.
    """
    kept = df.select(F.col(by).alias("_row_class"), key).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = kept.groupBy(F.col("_row_class").alias("_class"))
    sizes = sizes.agg(F.count("*").alias("n"), F.min(key).alias("first_key"))
    local = collect_small(sizes)
    # every table below has one row per class, so the check of the sizes holds for them too
    side = F.broadcast if local is not None else (lambda table: table)
    sizes = sizes if local is None else local
    quotas = class_quotas(sizes.filter("n > 1") if rare_rules else sizes, "_class", test_size)
    if rare_rules:
        quotas = quotas.unionByName(sizes.filter("n = 1").withColumn("quota", F.col("n")))

    rows = kept.withColumn("_hash", row_hash(key, seed)).withColumn("_bucket", F.substring("_hash", 1, PREFIX))
    same = F.col("_class").eqNullSafe(F.col("_row_class"))
    running = Window.partitionBy("_row_class").orderBy("_bucket")
    reached = (
        rows.groupBy("_row_class", "_bucket").agg(F.count("*").alias("_n")).withColumn("_through", F.sum("_n").over(running))
    )
    needed = F.col("quota") - F.col("_through") + F.col("_n")
    edges = reached.join(side(quotas), same).filter((needed > 0) & (F.col("quota") <= F.col("_through")))
    edges = edges.select("_class", F.col("_bucket").alias("_edge"), needed.alias("_need"))
    near = rows.join(side(edges), same & (F.col("_bucket") == F.col("_edge")))
    rank = F.row_number().over(Window.partitionBy("_row_class").orderBy("_hash", key))
    last = near.withColumn("_rank", rank).filter("_rank = _need")
    last = last.select("_row_class", F.col("_hash").alias("cut_hash"), F.col(key).alias("cut_key"))
    cuts = quotas.join(side(last), same, "left").drop("_row_class")
    pinned = pin_small(cuts)
    if pinned is not cuts:
        kept.unpersist()
    return pinned


def _flag_after_cut(
    df: DataFrame, cuts: DataFrame, by: str, key: str, seed: int, flag: str, rare_rules: bool = False
) -> DataFrame:
    here = F.struct(row_hash(key, seed), F.col(key))
    held_out = F.col("cut_hash").isNull() | (here > F.struct("cut_hash", "cut_key"))
    if rare_rules:
        held_out = (
            F.when(F.col("n") == 1, F.lit(False))
            .when(F.col("quota") == F.col("n"), F.col(key) == F.col("first_key"))
            .otherwise(held_out)
        )
    joined = df.join(cuts, F.col(by).eqNullSafe(F.col("_class")), "left")
    return joined.withColumn(flag, held_out).drop(*cuts.columns)


def stratified_split(
    df: DataFrame, by: str = "sdg", test_size: float = 0.3, key: str = "row_id", seed: int = 13, flag: str = "is_test"
) -> DataFrame:
    """Flag the test rows of an exact stratified split. The key must be unique."""
    return _flag_after_cut(df, class_cuts(df, by, test_size, key, seed), by, key, seed, flag)


def dev_split(
    df: DataFrame, by: str = "sdg", dev_size: float = 0.1, key: str = "row_id", seed: int = 13, flag: str = "is_dev"
) -> DataFrame:
    """Flag the dev rows of a stratified split with two rules for rare classes.

    A class with one row takes no part and stays in train. A larger class that got no dev row
    gives its first row to dev.
    """
    cuts = class_cuts(df, by, dev_size, key, seed, rare_rules=True)
    return _flag_after_cut(df, cuts, by, key, seed, flag, rare_rules=True)


def train_dev_test(
    df: DataFrame,
    by: str = "sdg",
    test_size: float = 0.3,
    dev_size: float = 0.1,
    key: str = "row_id",
    seed: int = 13,
    out: str = "split",
) -> DataFrame:
    """Name each row's part: ``test``, then ``dev`` and ``train`` out of the rest."""
    tested = stratified_split(df, by, test_size, key, seed, flag="_test")
    cuts = class_cuts(tested.filter(~F.col("_test")), by, dev_size, key, seed, rare_rules=True)
    flagged = _flag_after_cut(tested, cuts, by, key, seed, "_dev", rare_rules=True)
    name = F.when(F.col("_test"), "test").when(F.col("_dev"), "dev").otherwise("train")
    return flagged.withColumn(out, name).drop("_test", "_dev")
