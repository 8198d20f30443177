"""Whole n-gram runs: dev rows choose, models are stored, other corpora are tested on."""

import random

import pytest
from pyspark.sql import functions as F

from tagloom import __main__ as cli
from tagloom.functions import labels
from tagloom.operators import model, rows, sparse
from tagloom.plans import train
from tagloom.sources import stores


def corpus(spark, seed, n=240):
    """Single words say nothing, pairs of words give the class; labels of half of the dev rows would mislead."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        label = 1 + k % 2
        part = ("train", "train", "dev", "test")[k // 2 % 4]
        pairs = [("a", "b"), ("c", "d")] if label == 1 else [("a", "d"), ("c", "b")]
        tokens = [t for _ in range(12) for t in (*rng.choice(pairs), "x")]
        out.append((k, label, tokens, part, "ab"[k % 3 == 0]))
    return spark.createDataFrame(out, "row_id long, sdg int, tokens array<string>, split string, subset string")


def test_run_from_the_command_line(spark, tmp_path, monkeypatch):
    corpus(spark, 1).write.parquet(f"{tmp_path}/own")
    corpus(spark, 2).write.parquet(f"{tmp_path}/other")
    fit = sparse.fit
    monkeypatch.setattr(sparse, "fit", lambda *a, **k: fit(*a, **{**k, "max_iter": 15}))
    args = ["train-ngrams", "--input", f"{tmp_path}/own,far={tmp_path}/other", "--output", f"{tmp_path}/out", "--classes", "2", "--sizes", "1,2", "--name", "near"]
    cli.main(args)
    preds = spark.read.parquet(f"{tmp_path}/out/predictions")
    found = {r["test_set"]: (r["n"], r["right"]) for r in preds.groupBy("test_set").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("right")).collect()}
    assert found == {"near": (60, 1.0), "far": (60, 1.0), "a": (40, 1.0), "b": (20, 1.0)}
    assert set(preds.select(*stores.REPORT_KEYS).distinct().toPandas()["seed"].astype(str)) == {"13"}
    stored = f"{tmp_path}/out/models/ngrams/near-13/n=2"
    cli.main(["score", "--model", stored, "--input", f"{tmp_path}/other", "--output", f"{tmp_path}/scored"])
    scored = spark.read.parquet(f"{tmp_path}/scored")
    assert scored.count() == 240 and scored.filter("label != prediction").count() == 0


def test_dev_rows_are_not_learned_from(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(sparse, "fit", lambda rows, *a, **k: seen.append({r["row_id"] for r in rows.collect()}) or "model")
    df = corpus(spark, 3).withColumns({"is_test": F.col("split") == "test", "is_dev": F.col("split") == "dev"})
    assert train.fit_best_ngrams(df, [1, 2], [1], "is_dev") == (1, "model")
    assert seen == [{r["row_id"] for r in df.filter("split = 'train'").collect()}]
    with pytest.raises(ValueError):
        train.fit_best_ngrams(df, [1, 2], [1, 2])


def test_repeated_keys_raise(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "part string, key int")
    with pytest.raises(Exception, match="key is repeated: 1"):
        rows.number_keys(df, "part", "key", "n").collect()
    docs = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (None, 1)], "row_id int, sdg int")
    probs = spark.createDataFrame([(1, [0.2, 0.8]), (None, [1.0, 0.0]), (None, [1.0, 0.0])], "row_id int, probs array<double>")
    got = sorted(((r["row_id"], r["label"], r["prediction"]) for r in labels.predictions_table(docs, probs, [1, 2]).collect()), key=repr)
    assert got == [(1, 1, 2), (1, 2, 2), (2, 1, None), (None, 1, None)]
    with pytest.raises(Exception, match="row_id has several probabilities: 1"):
        labels.predictions_table(docs, probs.union(probs), [1, 2]).collect()


def test_counts_of_runs_are_replaced_one_by_one(spark, tmp_path):
    def run(seed, pairs):
        df = spark.createDataFrame([(k, y, p) for k, (y, p) in enumerate(pairs)], "row_id long, label int, prediction int")
        train.store_predictions(df, str(tmp_path), "linear", "a", "a", seed)

    def stored():
        return {(r["seed"], r["label"], r["prediction"]): r["n"] for r in train.stored_confusion(spark, str(tmp_path), [1, 2]).collect() if r["n"]}

    run(0, [(1, 1), (1, 1), (2, 1), (3, 3)])
    run(13, [(1, 2)])
    assert stored() == {("0", 1, 1): 2, ("0", 2, 1): 1, ("13", 1, 2): 1}
    before = {p: p.stat().st_mtime_ns for p in tmp_path.glob("counts/*/*/*/seed=0/*.parquet")}
    run(13, [(2, 2), (2, 2)])
    assert stored() == {("0", 1, 1): 2, ("0", 2, 1): 1, ("13", 2, 2): 2}
    assert before == {p: p.stat().st_mtime_ns for p in tmp_path.glob("counts/*/*/*/seed=0/*.parquet")} and len(before) == 1
    merged = {(r["label"], r["prediction"]): r["n"] for r in train.merged_confusion(spark, str(tmp_path), [1, 2]).collect()}
    assert merged == {(1, 1): 2, (2, 1): 1, (1, 2): 0, (2, 2): 2}
    files = train.stored_confusion(spark, str(tmp_path), [1, 2]).inputFiles()
    assert files and all("/counts/" in f for f in files)


def test_stored_pipeline_scores_raw_rows_in_another_session(spark, tmp_path):
    rng = random.Random(6)
    data = [(k, 1 + k % 2, [rng.choice("ab" if k % 2 else "cd") for _ in range(20)], rng.choice(["x", "y", "", None])) for k in range(80)]
    df = spark.createDataFrame(data, "row_id long, sdg int, tokens array<string>, faculty string")
    for columns in (["faculty"], []):
        fitted = model.fit_pipeline(df.filter("row_id < 60"), columns, max_iter=20, partitions=1)
        path = f"{tmp_path}/p{len(columns)}"
        model.save_model(fitted, path)
        raw = df.filter("row_id >= 60").union(spark.createDataFrame([(99, 1, ["c", "new"], "unseen"), (98, 2, [], None)], df.schema))
        want = {r["row_id"]: (r["prediction"], r["probability"]) for r in model.predict(fitted, raw).collect()}
        fresh = spark.newSession()
        again = fresh.createDataFrame(raw.collect(), raw.schema)
        got = {r["row_id"]: (r["prediction"], r["probability"]) for r in model.predict(model.load_pipeline(path, again), again).collect()}
        assert got == want and len(got) == 22 and sum(got[k][0] == 1 + k % 2 for k in range(60, 80)) == 20
        with pytest.raises(ValueError, match="tokens"):
            model.load_pipeline(path, raw.drop("tokens"))
    with pytest.raises(ValueError, match="categories"):
        model.fit_pipeline(df, ["faculty"], max_categories=1)
