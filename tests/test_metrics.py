import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tagloom.operators import metrics

PAIRS = [(1, 1), (1, 2), (9, 1)]


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame(PAIRS, "label int, prediction int")


def rounded(row):
    return tuple(round(value, 9) if isinstance(value, float) else value for value in row)


def by(df, key="label"):
    return {r[key]: r for r in df.collect()}


def test_confusion(pairs):
    got = {(r["prediction"], r["label"]): r["n"] for r in metrics.confusion_matrix(pairs, [1, 2]).collect()}
    assert got == {(1, 1): 1, (1, 2): 0, (2, 1): 1, (2, 2): 0}
    wide = by(metrics.confusion_table(pairs, [1, 2]), "prediction")
    assert (wide[1]["true_1"], wide[1]["true_2"], wide[2]["true_1"], wide[2]["true_2"]) == (1, 0, 1, 0)


def test_class_report(pairs):
    got = by(metrics.class_report(pairs, [1, 2, 3]))
    assert tuple(got[1])[1:] == (0.5, 0.5, 0.5, 2)
    assert tuple(got[2])[1:] == (0.0, 0.0, 0.0, 0)
    assert tuple(got[3])[1:] == (0.0, 0.0, 0.0, 0)


def test_averages(pairs):
    got = by(metrics.averages(pairs, [1, 2, 3]))
    assert got["macro avg"]["f1"] == pytest.approx(1 / 6)
    assert got["weighted avg"]["f1"] == pytest.approx(1 / 2)
    empty = by(metrics.averages(pairs.filter("label = 9"), [2, 3]))
    assert tuple(empty["weighted avg"])[1:] == (0.0, 0.0, 0.0, 0)


def test_micro_when_a_label_is_off_the_list(pairs):
    (row,) = metrics.overall(pairs, [1, 2, 3]).collect()
    assert row["label"] == "micro avg"
    assert (row["precision"], row["recall"]) == (pytest.approx(1 / 3), pytest.approx(1 / 2))
    (row,) = metrics.overall(pairs, [1, 2, 9]).collect()
    assert row["label"] == "accuracy" and row["f1"] == pytest.approx(1 / 3)


def test_report_text(pairs):
    lines = [r["text"] for r in metrics.report_text(metrics.full_report(pairs, [1, 2, 9])).orderBy("line").collect()]
    assert lines == [
        "      sdg_01    0.5000    0.5000    0.5000         2",
        "      sdg_02    0.0000    0.0000    0.0000         0",
        "      sdg_09    0.0000    0.0000    0.0000         1",
        "    accuracy                        0.3333         3",
        "   macro avg    0.1667    0.1667    0.1667         3",
        "weighted avg    0.3333    0.3333    0.3333         3",
    ]


def test_keys_give_the_report_of_each_group(spark):
    rng = random.Random(5)
    data = [(rng.choice("ab"), rng.randint(1, 5), rng.randint(1, 5)) for _ in range(300)]
    df = spark.createDataFrame(data, "model string, label int, prediction int")
    labels = [1, 2, 3, 4]
    whole = metrics.full_report(df, labels, ["model"]).collect()
    for name in "ab":
        alone = metrics.full_report(df.filter(F.col("model") == name).drop("model"), labels).collect()
        grouped = [rounded(r)[1:] for r in whole if r["model"] == name]
        assert sorted(grouped) == sorted(rounded(r) for r in alone)
    matrix = metrics.confusion_matrix(df, labels, ["model"]).collect()
    counts = Counter(data)
    assert len(matrix) == 2 * 16
    assert all(r["n"] == counts[(r["model"], r["label"], r["prediction"])] for r in matrix)


def test_distribution(spark):
    df = spark.createDataFrame([(1, False), (1, False), (2, False), (2, True)], "sdg int, is_test boolean")
    got = {r["sdg"]: tuple(r)[1:] for r in metrics.class_distribution(df).collect()}
    assert got == {1: (2, 0, 66.7), 2: (1, 1, 33.3)}


def test_auc_fixture(spark):
    df = spark.createDataFrame([(2, [0.1]), (2, [0.4]), (1, [0.4]), (1, [0.8])], "label int, probs array<double>")
    (row,) = metrics.label_auc(df, [1]).collect()
    assert (row["n_pos"], row["n_neg"], row["auc"]) == (2, 2, 0.875)


def test_auc_is_null_with_one_side(spark):
    df = spark.createDataFrame([(1, [0.1, 0.2])], "label int, probs array<double>")
    assert {r["label"]: r["auc"] for r in metrics.label_auc(df, [1, 2]).collect()} == {1: None, 2: None}


@pytest.mark.parametrize("fineness", [4096, 3, 1])
def test_auc_equals_pair_counting(spark, fineness):
    rng = random.Random(9)
    scores = [0.0, 0.0, 0.0, 1.0, 0.25, 0.5, -0.0, 5e-324, -5e-324, 1e308, -1e308, math.inf, -math.inf, math.nextafter(0.5, 0), math.nextafter(0.5, 1), -0.5]
    data = [(rng.randint(1, 3), [rng.choice(scores) if rng.random() < 0.6 else rng.random() for _ in range(3)]) for _ in range(300)]
    df = spark.createDataFrame(data, "label int, probs array<double>").repartition(4)
    got = {r["label"]: r["auc"] for r in metrics.label_auc(df, [1, 2, 3], fineness=fineness).collect()}
    for label in (1, 2, 3):
        pos = [p[label - 1] for true, p in data if true == label]
        neg = [p[label - 1] for true, p in data if true != label]
        pairs = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
        assert got[label] == pytest.approx(pairs / len(pos) / len(neg))


def test_order_keys_grow_with_scores(spark):
    rng = random.Random(4)
    near = [math.nextafter(2.0**e, side) for e in range(-1074, 1023, 7) for side in (0, math.inf)]
    scores = sorted({*near, *(-x for x in near), *(rng.random() for _ in range(2000)), *(rng.gauss(0, 10.0 ** rng.randint(-300, 300)) for _ in range(2000)), 0.0})
    df = spark.createDataFrame([(x,) for x in scores], "x double")
    keys = [r["key"] for r in df.select("x", metrics._order_key(F.col("x")).alias("key")).orderBy("x").collect()]
    assert all(a <= b for a, b in zip(keys, keys[1:])) and len(set(keys)) > 0.8 * len(scores)


def test_category_scores(spark):
    df = spark.createDataFrame(
        [(1, [0.9, 0.1]), (1, [0.4, 0.6]), (2, [0.3, 0.7])], "label int, probs array<double>"
    )
    got = by(metrics.category_scores(df, [1, 2]))
    assert got["1"]["precision"] == 1.0 and got["1"]["recall"] == 0.5 and got["1"]["auc"] == 1.0
    assert got["micro"]["f1"] == pytest.approx(2 / 3) and got["macro"]["auc"] == 1.0
