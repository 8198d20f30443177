import math
import random

import pytest
from pyspark.sql import functions as F

from tagloom.operators import filters, rows
from tagloom.plans import prepare


def test_drop_missing_text(spark):
    df = spark.createDataFrame([(None,), ("unknown",), ("",), ("x",)], "abstract string")
    assert [r[0] for r in filters.drop_missing_text(df).collect()] == ["", "x"]


def test_keep_agreed(spark):
    df = spark.createDataFrame([(0.5,), (0.49,), (None,), (math.nan,)], "agreement double")
    assert [r[0] for r in filters.keep_agreed(df).collect()] == [0.5]


def test_keep_likely_positive(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (0, 0), (0, 3)], "labels_negative int, labels_positive int")
    kept = filters.keep_likely_positive(df).collect()
    assert [tuple(r) for r in kept] == [(1, 1, 0.5), (0, 3, 0.0)]


def test_flag_union_and_back(spark):
    train = spark.createDataFrame([(1, "a")], "k int, v string")
    test = spark.createDataFrame([("b", 2)], "v string, k int")
    again = rows.split_by_flag(rows.flag_union(train, test))
    assert [tuple(r) for df in again for r in df.collect()] == [(1, "a"), (2, "b")]


def test_concat_corpora(spark):
    a = spark.createDataFrame([(9, 1, "f", "x"), (2, 2, "g", "y")], "row_id long, sdg int, faculty string, author string")
    b = spark.createDataFrame([(5, 3), (2, 4)], "row_id long, sdg int")
    merged = rows.concat_corpora([("z", a), ("o", b)])
    assert "author" not in merged.columns
    got = sorted((r["row_id"], r["subset"], r["subset_index"], r["sdg"], r["faculty"]) for r in merged.collect())
    assert got == [(0, "z", 2, 2, "g"), (1, "z", 9, 1, "f"), (2, "o", 2, 4, None), (3, "o", 5, 3, None)]
    filled = prepare.merge_corpora([("z", a), ("o", b)], na_rep="NA")
    assert {r["faculty"] for r in filters.keep_provenance(filled, "o").collect()} == {"NA"}


def test_number_keys_is_dense_for_any_spread_of_keys(spark):
    rng = random.Random(3)
    keys = rng.sample(range(-50, 60), 80) + [2**40 + i for i in range(5)] + [-(2**62) - 5, 2**62 + 7, 2**63 - 1, -(2**63)]
    keys += [rng.randrange(-(2**63), 2**63) for _ in range(50)]
    data = [(0, k) for k in keys] + [(1, k) for k in keys[:10]]
    df = spark.createDataFrame(data, "part int, key long").repartition(5)
    got = rows.number_keys(df, "part", "key", "n").collect()
    assert sorted((r["n"], r["part"], r["key"]) for r in got) == [(i, *row) for i, row in enumerate(sorted(data))]


def test_null_keys_raise(spark):
    df = spark.createDataFrame([(0, 1), (0, None)], "part int, key long")
    with pytest.raises(Exception, match="null in key"):
        rows.number_keys(df, "part", "key", "n").collect()


def test_number_keys_of_nothing(spark):
    empty = spark.createDataFrame([], "part int, key long")
    assert rows.number_keys(empty, "part", "key", "n").count() == 0


def test_dense_index_survives_repartitioning(spark):
    data = [(i % 7, i) for i in range(500)]
    df = spark.createDataFrame(data, "a int, b int").repartition(6)
    got = rows.dense_index(df, F.desc("a"), F.asc("b"), out="i").collect()
    want = sorted(data, key=lambda row: (-row[0], row[1]))
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["i"])] == want
    assert sorted(r["i"] for r in got) == list(range(500))


def test_head_per_class_limits_below_the_shuffle(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("sdg"))
    top = rows.head_per_class(df, 2)
    assert sorted((r["sdg"], r["row_id"]) for r in top.collect()) == [(0, 0), (0, 3), (1, 1), (1, 4), (2, 2), (2, 5)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_prepare_titled(spark):
    raw = spark.createDataFrame(
        [
            (0, "SDG4.00", "A", "f", "2019", "Why? Because.", "c", "some\n text"),
            (1, "bad", "A", "f", "2019", "T.", "c", "x"),
            (2, "SDG10.00", "A", "f", "2019", "T.", "c", None),
        ],
        "row_id long, sdg string, author string, faculty string, year string, title string, citation2 string, abstract string",
    )
    (row,) = prepare.prepare_titled(raw).collect()
    assert (row["sdg"], row["abstract"]) == (4, "Why. some text")
    assert [r["row_id"] for r in prepare.rejected_labels(raw).collect()] == [1]


def test_prepare_voted(spark):
    raw = spark.createDataFrame(
        [(0, "a", 1, 0, 3, 1.0), (1, "b", 1, 3, 1, 0.5), (2, "c", 1, 0, 1, 0.2)],
        "row_id long, text string, sdg int, labels_negative int, labels_positive int, agreement double",
    )
    assert [(r["row_id"], r["abstract"]) for r in prepare.prepare_voted(raw).collect()] == [(0, "a")]
