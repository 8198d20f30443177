import math
import re
import subprocess
import sys
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tagloom.operators import language

TRAIN = [
    ("en", "the cat and the dog"),
    ("en", "this is  the THING"),
    ("de", "der hund und die katze"),
    ("de", "das ist der garten"),
]
TEXTS = ["the dog is this", "der garten und das", "th", "", "zzzzqqqq", None, "the der the der die", "über 😀 the"]


@pytest.fixture
def profile(spark):
    return language.language_profile(spark.createDataFrame(TRAIN, "lang string, text string"))


def grams(text):
    squeezed = " ".join(text.lower().split())
    return [squeezed[i : i + 3] for i in range(len(squeezed) - 2)]


def brute(text):
    if text is None:
        return None
    counts = {name: Counter(g for lang, t in TRAIN if lang == name for g in grams(t)) for name in ("de", "en")}
    known = set(counts["de"]) | set(counts["en"])
    seen = [g for g in grams(text) if g in known]
    if not seen:
        return None
    score = {
        name: sum(math.log((c[g] + 1) / (sum(c.values()) + len(known))) for g in seen) for name, c in counts.items()
    }
    return max(sorted(score), key=score.get)


def test_profile_counts(profile):
    got = {(r["lang"], r["gram"]): r["n"] for r in profile.collect()}
    want = Counter((lang, g) for lang, t in TRAIN for g in grams(t))
    assert got == want


@pytest.mark.parametrize("max_grams", [1_000_000, 5])
def test_both_ways_equal_brute_force(spark, profile, max_grams):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = language.detect_language(df, profile, ["en", "de"], max_grams=max_grams)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("ArrowEvalPython" in plan) == (max_grams > 5)
    assert {r["doc_id"]: r["detected"] for r in got.collect()} == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_scoring_in_place_shuffles_nothing(spark, profile):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    kept = language.keep_language(df, profile, ["en", "de"])
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.columns == ["doc_id", "text"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, t in enumerate(TEXTS) if brute(t) == "en"]


def test_other_sizes_of_n(spark):
    labelled = spark.createDataFrame(TRAIN, "lang string, text string")
    for n in (1, 2, 4):
        profile = language.language_profile(labelled, n=n)
        df = spark.createDataFrame([(0, "the thing"), (1, "der garten")], "doc_id long, text string")
        got = language.detect_language(df, profile, ["de", "en"], n=n)
        assert {r["doc_id"]: r["detected"] for r in got.collect()} == {0: "en", 1: "de"}


def test_column_form(spark):
    df = spark.createDataFrame([("en", 1), ("de", 2), (None, 3)], "lang string, k int")
    assert [tuple(r) for r in language.keep_language_column(df).collect()] == [(1,)]


def test_detects_the_labelled_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    half = F.xxhash64("doc_id") % 2 == 0
    profile = language.language_profile(docs.filter(half))
    got = language.detect_language(docs.filter(~half), profile, ["de", "en", "es", "fr"])
    total, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("detected"))).first()
    assert right / total > 0.98


def test_tasks_need_no_package():
    """What the scoring function calls travels whole: tasks may run where the package is not installed."""
    sent = cloudpickle.dumps(language._packer(3))
    script = "import pickle, sys; print(pickle.loads(bytes.fromhex(sys.argv[1]))('abcd').tolist())"
    done = subprocess.run([sys.executable, "-I", "-c", script, sent.hex()], capture_output=True, text=True, cwd="/")
    assert done.stdout.strip() == str(language._packer(3)("abcd").tolist()), done.stderr


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_profile_counts_every_gram(spark, monkeypatch, n):
    """Null languages, null and short texts, characters beyond 16 bits; counts of several turns of a task add up. No row per n-gram."""
    monkeypatch.setattr(language, "GRAMS", 20)
    rows = [*TRAIN, *TRAIN, ("en", None), (None, "no language"), ("de", ""), ("de", "ab"), ("fr", "\U0001f600\U0001f600 \u00c9t\u00e9\u00a0 \t!\x00z")]
    profile = language.language_profile(spark.createDataFrame(rows, "lang string, text string").repartition(2), n=n)
    want = Counter()
    for lang, body in rows:
        squeezed = re.sub(r"\s+", " ", (body or "").lower())
        want.update((lang, squeezed[i : i + n]) for i in range(len(squeezed) - n + 1))
    assert {(r["lang"], r["gram"]): r["n"] for r in profile.collect()} == want
    assert ("Generate" in profile._jdf.queryExecution().toString()) == (n == 4)


@pytest.mark.parametrize("n", [2, 4])
def test_grams_of_texts(spark, monkeypatch, n):
    """Counts per text, for texts that share a key, too; short and null texts have none. N-grams are not listed row by row first."""
    monkeypatch.setattr(language, "GRAMS", 40)
    rows = [("a", "the the"), ("a", "the the"), ("b", None), ("c", ""), ("d", "x"), (None, "noname"), ("e", "\U0001f600\U0001f600\U0001f600\U0001f600\U0001f600")]
    got = language._text_grams(spark.createDataFrame(rows, "key string, text string").repartition(2), "text", "key", n)
    want = Counter()
    for key, body in rows:
        want.update((key, (body or "")[i : i + n]) for i in range(len(body or "") - n + 1))
    summed = Counter()
    for r in got.collect():
        summed[r["key"], r["gram"]] += r["n"]
    assert got.columns == ["key", "gram", "n"] and summed == want
    assert ("Generate" in got._jdf.queryExecution().toString()) == (n == 4)
