"""Counts with a floor against plain counts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tagloom.operators import floor


@pytest.mark.parametrize(("least", "slots"), [(1, 1 << 20), (3, 1 << 20), (3, 8), (200, 1 << 12)])
def test_same_counts_and_fewer_rows(spark, least, slots):
    rng = random.Random(least)
    rows = [[rng.choice(["hot", f"w{rng.randrange(300)}", f"once{rng.randrange(10**9)}"]) for _ in range(rng.randint(0, 40))] for _ in range(400)]
    rows += [None, [], [None, "hot"], ["é", "é", "é", ""], ["", ""]]
    df = spark.createDataFrame([(r, "x") for r in rows], "tokens array<string>, n string").repartition(5)
    want = {w: n for w, n in Counter(w for r in rows for w in r or () if w is not None).items() if n >= least}
    assert {r["word"]: r["n"] for r in floor.floor_counts(df, F.col("tokens"), "word", least, slots).collect()} == want
    distinct = df.select(F.explode("tokens").alias("t")).distinct().count()
    moved = floor.able_items(df, F.col("tokens"), "word", least, slots).select("word").distinct().count()
    assert moved >= len(want)
    if least > 1 and slots > 1 << 12:
        assert moved < 0.15 * distinct  # words that occur once stay where they are
    assert floor.floor_counts(df.limit(0), F.col("tokens"), "word", least, slots).collect() == []


def test_slots_are_checked(spark):
    with pytest.raises(ValueError):
        floor.floor_counts(spark.createDataFrame([(["a"],)], "t array<string>"), F.col("t"), "w", 2, slots=100)


def test_items_are_computed_once_per_pass_and_parts_follow_their_number(spark, monkeypatch):
    """No filter on the items goes down to the rows; a task adds up at most so many items, without hash tables before the shuffle."""
    df = spark.createDataFrame([([f"w{i % 7}", f"v{i}"],) for i in range(300)] + [(None,)], "tokens array<string>").repartition(3)
    monkeypatch.setattr(floor, "PART", 50)
    found = floor.floor_counts(df, F.transform("tokens", F.upper), "word", 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(word" in plan and ", 12)" in plan  # 600 items
    assert plan.index("Exchange hashpartitioning(word") > plan.rindex("HashAggregate")  # the plan begins with the last step
    assert "Filter (size(" not in plan
    assert sorted(map(tuple, found.collect())) == sorted((f"W{k}", len(range(k, 300, 7))) for k in range(7))
