import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tagloom.operators import features, metrics, model, split
from tagloom.sources import tables

SMALL = "/root/testdata/sf0.001"


def test_vocabulary_and_ngrams(spark):
    docs = [(0, ["a", "b", "a"]), (1, []), (2, ["a", "b"])]
    df = spark.createDataFrame(docs, "row_id int, tokens array<string>")
    assert [tuple(r) for r in features.vocabulary(df).collect()] == [("a", 3)]
    got = {r["ngram"]: r["n"] for r in features.ngram_counts(df, 2).collect()}
    assert got == {"a b": 2, "b a": 1}
    per_doc = {(r["row_id"], r["ngram"]): r["n"] for r in features.ngram_counts(df, 1, keys=["row_id"]).collect()}
    assert per_doc == {(0, "a"): 2, (0, "b"): 1, (2, "a"): 1, (2, "b"): 1}
    in_row = features.document_ngrams(df, 1)
    assert {(r["row_id"], r["ngram"]): r["n"] for r in in_row.collect()} == per_doc
    assert "Exchange" not in in_row._jdf.queryExecution().executedPlan().toString()


def test_span_chunks_keep_every_document(spark):
    df = spark.createDataFrame([(0, [str(i) for i in range(200)]), (1, [])], "row_id int, tokens array<string>")
    got = sorted((r["row_id"], r["span"], r["start"], len(r["tokens"])) for r in features.span_chunks(df).collect())
    assert got == [(0, 0, 0, 128), (0, 1, 96, 104), (1, 0, 0, 0)]


def test_mean_pool(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 6.0]), (2, [5.0, 5.0])], "k int, v array<double>")
    assert {r["k"]: r["pooled"] for r in features.mean_pool(df, "v", ["k"]).collect()} == {1: [2.0, 4.0], 2: [5.0, 5.0]}


def test_string_index(spark):
    df = spark.createDataFrame([(c,) for c in "babacad"], "c string")
    counts = Counter(r["c"] for r in df.collect())
    got = {r["c"]: r["c_indexed"] for r in features.string_index(df, "c").collect()}
    want = {c: i for i, c in enumerate(sorted(counts, key=lambda c: (-counts[c], c)))}
    assert got == want


def test_string_index_equals_the_fitted_encoder(spark):
    docs = tables.docs(spark, SMALL).select("row_id", "year")
    index = {r["year"]: r["year_indexed"] for r in features.string_index(docs, "year").collect()}
    docs = docs.withColumn("name", F.col("year"))
    encoded = features.encode_categories(docs, ["year"])
    many = features.encode_categories(docs, ["year"], max_categories=3)
    assert sorted(map(str, encoded.collect())) == sorted(map(str, many.select(encoded.columns).collect()))
    for row in encoded.select("name", vector_to_array("year_encoded").alias("v")).distinct().collect():
        slot = index[row["name"]]
        assert row["v"] == [float(i == slot) for i in range(len(index) - 1)]


def test_missing_categories(spark):
    df = spark.createDataFrame([("x",), ("x",), ("",), (None,), ("y",)], "c string")
    encoded = features.encode_categories(df, ["c"], na_rep="NA")
    vectors = Counter(tuple(r[0]) for r in encoded.select(vector_to_array("c_encoded")).collect())
    assert sorted(vectors.values()) == [1, 2, 2]
    with pytest.raises(Exception):
        features.encode_categories(df, ["c"]).collect()


@pytest.fixture(scope="module")
def tokens(spark):
    from tagloom.plans import prepare

    docs = tables.authored_docs(spark, SMALL).withColumn("sdg", F.col("sdg") % 4 + 1)
    return split.stratified_split(prepare.clean_corpus(docs, tokens="tokens")).drop("abstract").persist()


def test_one_task_embedding_does_not_depend_on_the_file_layout(spark, tokens):
    first, _ = model.embed(tokens.repartition(3), partitions=1)
    second, _ = model.embed(tokens.repartition(7, F.rand(4)), partitions=1)
    rows = [
        {r["row_id"]: r["v"] for r in df.select("row_id", vector_to_array("abstract_vectorized").alias("v")).collect()}
        for df in (first, second)
    ]
    assert rows[0] == rows[1]


def test_fit_on_train_only(spark, tokens):
    _, union = model.embed(tokens, partitions=1)
    _, train = model.embed(tokens, fit_on="train", partitions=1)
    assert features.word_vectors(train).count() < features.word_vectors(union).count()
    with pytest.raises(ValueError):
        model.embed(tokens, fit_on="dev")


def test_classifier_beats_the_majority_and_predicts_the_maximum(spark):
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet").select(
        F.col("vec_id").alias("row_id"), (F.col("label") + 1).alias("sdg"), features.array_to_vector("embedding").alias("v")
    )
    fitted = model.fit_classifier(vectors, ["v"], max_iter=30)
    rows = model.predict(fitted, vectors).collect()
    majority = max(Counter(r["label"] for r in rows).values()) / len(rows)
    assert sum(r["label"] == r["prediction"] for r in rows) / len(rows) > majority
    for r in rows:
        assert len(r["probability"]) == 11
        assert sum(r["probability"]) == pytest.approx(1)
        assert r["prediction"] == r["probability"].index(max(r["probability"]))
        assert r["max_prob"] == max(r["probability"])


def test_model_is_overwritten(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (1, 0.1), (2, 0.9)], "sdg int, x double")
    path = str(tmp_path / "model")
    for iterations in (1, 5):
        model.save_model(model.fit_classifier(df, ["x"], max_iter=iterations), path)
    from pyspark.ml import PipelineModel

    assert PipelineModel.load(path).transform(df).count() == 4


def test_ablation_conditions(spark, tokens):
    rows = model.feature_ablation(tokens, max_iter=3, partitions=2)
    tests = tokens.filter("is_test").count()
    assert {r["condition"]: r["count"] for r in rows.groupBy("condition").count().collect()} == {
        "authors": tests, "default": tests, "none": tests
    }
    report = metrics.full_report(rows, range(1, 5), ["condition"])
    assert report.select("condition").distinct().count() == 3


def test_cross_corpus_and_ngrams(spark, tokens):
    english, others = tokens.filter("faculty = 'en'"), tokens.filter("faculty <> 'en' and is_test")
    rows = model.cross_corpus(english, others, max_iter=3, partitions=2)
    counts = {r["test_set"]: r["count"] for r in rows.groupBy("test_set").count().collect()}
    assert counts == {"own": english.filter("is_test").count(), "other": others.count()}
    bow = model.bag_of_ngrams(tokens, n=3, num_features=1 << 10, max_iter=3)
    assert bow.count() == tokens.filter("is_test").count()


def test_many_categories_are_fitted_in_blocks(spark, tmp_path, monkeypatch):
    """Beyond a number of coefficients Spark's regression is not called; predictions are those of the same optimum."""
    rng = random.Random(6)
    rows = [(k, rng.randint(1, 3), rng.random() < 0.3, f"a{rng.randint(0, 4)}", rng.gauss(0, 1), rng.gauss(0, 1)) for k in range(400)]
    df = spark.createDataFrame(rows, "row_id long, sdg int, is_test boolean, author string, x double, y double")
    df = df.select("row_id", "sdg", "is_test", "author", features.array_to_vector(F.array("x", "y")).alias("v"))
    encoded = features.encode_categories(df, ["author"])
    train, test = encoded.filter("not is_test"), encoded.filter("is_test")
    used = ["v", "author_encoded"]
    want = {r["row_id"]: r for r in model.predict(model.fit_features(train, used), test).collect()}
    with monkeypatch.context() as patched:
        patched.setattr(model, "fit_classifier", None)
        wide = model.fit_features(train, used, most=10)
    got = model.predict(wide, test).collect()
    assert len(got) == len(want) == test.count()
    for r in got:
        assert r["label"] == want[r["row_id"]]["label"] and len(r["probability"]) == 4
        assert r["probability"] == pytest.approx(want[r["row_id"]]["probability"], abs=2e-3)
    for _ in range(2):
        model.save_model(wide, f"{tmp_path}/m")
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/m/inputs").collect()) == sorted(used)


def test_many_categories_are_not_named_in_schemas(spark, monkeypatch):
    """Spark's encoder and assembler list a name for each category on the driver; for many categories neither is called."""
    rows = [(k, k % 3, f"a{k % 40}" if k % 5 else "often", float(k)) for k in range(200)]
    df = spark.createDataFrame(rows, "row_id long, sdg int, author string, x double").withColumn("v", features.array_to_vector(F.array("x", F.lit(0.0))))
    small = features.encode_categories(df, ["author"])
    monkeypatch.setattr(features, "OneHotEncoder", None)
    many = features.encode_categories(df, ["author"], max_categories=3)
    assert not many.schema["author_encoded"].metadata and many.schema["author_encoded"].dataType == small.schema["author_encoded"].dataType
    assert sorted(map(str, small.collect())) == sorted(map(str, many.select(small.columns).collect()))
    monkeypatch.setattr(model, "VectorAssembler", None)
    found = {r["row_id"]: dict(zip(r["slots"], r["values"])) for r in model.feature_entries(many, ["v", "author_encoded"], ["row_id"]).collect()}
    for r in small.collect():
        whole = [*r["v"].toArray(), *r["author_encoded"].toArray()]
        assert found[r["row_id"]] == {i: x for i, x in enumerate(whole) if x}


def test_a_large_vocabulary_is_not_held_by_the_driver(spark, tokens, monkeypatch):
    """Beyond a number of words Spark's Word2Vec is not called; words, vector sizes, rows and means are as it would give them."""
    rows = tokens.select("row_id", "sdg", "is_test", "tokens").unionByName(spark.createDataFrame([(None, 1, True, []), (-1, 1, True, ["unseen"])], "row_id long, sdg int, is_test boolean, tokens array<string>"))
    few = features.fit_embedding(rows, "tokens", "v", partitions=2)
    monkeypatch.setattr(features, "Word2Vec", None)
    many = features.fit_embedding(rows, "tokens", "v", partitions=2, spark_words=10)
    words = {r["word"]: r["vector"] for r in features.word_vectors(many).collect()}
    assert words.keys() == {r["word"] for r in features.word_vectors(few).collect()}
    assert many.getVectors().schema["vector"].dataType == few.getVectors().schema["vector"].dataType
    found, like = many.transform(rows), few.transform(rows)
    assert found.columns == like.columns and found.dtypes == like.dtypes and found.count() == rows.count()
    for r in found.collect():
        want = np.sum([words.get(t, [0.0] * 10) for t in r["tokens"]], axis=0) / max(1, len(r["tokens"])) if r["tokens"] else np.zeros(10)
        assert np.abs(r["v"].toArray() - want).max() < 1e-9
