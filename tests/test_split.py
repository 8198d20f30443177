import hashlib
import math
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.operators import split


def corpus(spark, sizes):
    rows = [(i * 10 + c, c) for c, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, sdg int")


def quotas(sizes, test_size):
    total = sum(sizes.values())
    train = total - math.ceil(test_size * total)
    whole = {c: n * train // total for c, n in sizes.items()}
    by_rest = sorted(sizes, key=lambda c: (-(sizes[c] * train % total), c))
    for c in by_rest[: train - sum(whole.values())]:
        whole[c] += 1
    return whole


def held_out(keys, quota, seed=13):
    ranked = sorted(keys, key=lambda k: (hashlib.md5(f"{k}:{seed}".encode()).hexdigest(), k))
    return set(ranked[quota:])


def test_fixture_sizes(spark):
    flagged = split.stratified_split(corpus(spark, {1: 10, 2: 10, 3: 3}))
    counts = Counter((r["sdg"], r["is_test"]) for r in flagged.collect())
    assert counts == {(1, False): 7, (2, False): 7, (3, False): 2, (1, True): 3, (2, True): 3, (3, True): 1}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(0, 9), st.integers(1, 60), min_size=1, max_size=6), st.sampled_from([0.1, 0.3, 0.5]))
def test_split_equals_brute_force(spark, sizes, test_size):
    df = corpus(spark, sizes)
    got = split.stratified_split(df.repartition(3), test_size=test_size).collect()
    quota = quotas(sizes, test_size)
    want = {
        k for c, n in sizes.items() for k in held_out([i * 10 + c for i in range(n)], quota[c])
    }
    assert {r["row_id"] for r in got if r["is_test"]} == want
    assert len(got) == sum(sizes.values())


def test_hot_class_many_buckets(spark):
    df = spark.range(20_000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50 + 2).cast("int").alias("sdg")
    )
    got = split.stratified_split(df).groupBy("is_test").count().collect()
    assert {r["is_test"]: r["count"] for r in got} == {True: 6000, False: 14000}


def test_null_class_is_kept(spark):
    df = spark.createDataFrame([(i, None if i < 10 else 1) for i in range(20)], "row_id long, sdg int")
    counts = Counter((r["sdg"], r["is_test"]) for r in split.stratified_split(df).collect())
    assert counts == {(None, True): 3, (None, False): 7, (1, True): 3, (1, False): 7}


def test_without_the_small_table_shortcut(spark, monkeypatch):
    df = corpus(spark, {1: 30, 2: 11, 3: 4})
    want = {r["row_id"] for r in split.stratified_split(df).collect() if r["is_test"]}
    monkeypatch.setattr(split, "collect_small", lambda table: None)
    monkeypatch.setattr(split, "pin_small", lambda table: table)
    assert {r["row_id"] for r in split.stratified_split(df).collect() if r["is_test"]} == want


def test_dev_rules(spark):
    rows = split.dev_split(corpus(spark, {1: 1, 2: 2, 3: 20})).collect()
    dev = Counter(r["sdg"] for r in rows if r["is_dev"])
    assert dev[1] == 0 and dev[2] == 1 and dev[3] >= 1
    assert [r["row_id"] for r in rows if r["sdg"] == 2 and r["is_dev"]] == [2]


def test_three_parts_are_disjoint_and_complete(spark):
    df = corpus(spark, {1: 100, 2: 41, 3: 9})
    named = split.train_dev_test(df)
    parts = Counter(r["split"] for r in named.collect())
    assert sum(parts.values()) == 150 and parts["test"] == 45
    tests = {r["row_id"] for r in named.collect() if r["split"] == "test"}
    assert tests == {r["row_id"] for r in split.stratified_split(df).collect() if r["is_test"]}


@pytest.mark.parametrize("parts", [1, 7])
def test_same_rows_for_any_partitioning(spark, parts):
    df = corpus(spark, {1: 50, 2: 13})
    base = {r["row_id"] for r in split.stratified_split(df).collect() if r["is_test"]}
    again = split.stratified_split(df.repartition(parts, F.rand(1)))
    assert {r["row_id"] for r in again.collect() if r["is_test"]} == base


def test_labelling_rows_shuffles_nothing(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 5).alias("sdg"))
    plan = split.stratified_split(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
