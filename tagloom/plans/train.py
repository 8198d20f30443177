"""Train, predict and report runs whose results are stored side by side under one folder."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators import features, filters, metrics, model, sparse
from tagloom.sources import stores


def store_predictions(
    predictions: DataFrame, root: str, name: str, train_set: str, test_set: str, seed: int = 0
) -> DataFrame:
    """Put one run's predictions into the predictions table, beside those of other runs and seeds, and their pair counts beside.

    A run that is repeated replaces its own predictions and counts alone. Returns the stored rows, so nothing that follows computes the
    predictions again.
    """
    keys = dict(zip(stores.REPORT_KEYS, (name, train_set, test_set, str(seed))))
    run = "/".join(f"{key}={value}" for key, value in keys.items())
    path = f"{root}/predictions/{run}"
    predictions.drop(*keys).write.mode("overwrite").parquet(path)
    stored = predictions.sparkSession.read.parquet(path)
    metrics.pair_counts(stored).coalesce(1).write.mode("overwrite").parquet(f"{root}/counts/{run}")
    return stored.withColumns({key: F.lit(value) for key, value in keys.items()})


def store_report(rows: Sequence[DataFrame], root: str, labels: Sequence[int], run: str) -> DataFrame:
    """Score stored predictions by run, write the reports, and return their rows."""
    report = metrics.full_report(reduce(DataFrame.unionByName, rows), labels, stores.REPORT_KEYS)
    stores.write_report(report, f"{root}/reports/{run}")
    return report


def run_ablation(
    corpus: DataFrame,
    root: str,
    labels: Sequence[int],
    train_set: str,
    conditions: Mapping[str, Sequence[str]] = model.CONDITIONS,
    name: str = "linear",
    max_iter: int = 100,
    partitions: int = 8,
    seed: int = 0,
) -> DataFrame:
    """Fit, store and score the classifier once per feature condition; returns the report rows.

    ``corpus`` holds ``row_id``, ``sdg``, ``tokens``, ``is_test`` and the category columns. Models,
    vocabulary, predictions and reports go below ``root``.
    """
    embedded, vectors = model.embed(corpus, partitions=partitions, seed=seed)
    stored = []
    for condition, fitted, tested in model.fit_conditions(embedded, conditions, "sdg", "is_test", "row_id", max_iter):
        model.save_model(fitted, f"{root}/models/{name}/{train_set}-{condition}-{seed}")
        tests = store_predictions(model.predict(fitted, tested), root, name, train_set, condition, seed)
        stored.append(tests)
        if condition == "default":  # the merged model on each of its sources
            stored += by_source(tests, corpus, root, name, train_set, seed)
    stores.write_vocabulary(features.word_vectors(vectors), f"{root}/models/{name}/{train_set}-vocabulary-{seed}")
    return store_report(stored, root, labels, f"{name}-{train_set}-{seed}")


def run_cross_corpus(
    corpus: DataFrame,
    other_test: DataFrame,
    root: str,
    labels: Sequence[int],
    train_set: str,
    test_set: str,
    name: str = "linear",
    max_iter: int = 100,
    partitions: int = 8,
    seed: int = 0,
) -> DataFrame:
    """Train on one corpus, store and score its own test rows and those of another corpus.

    ``labels`` covers both corpora; a class that one of them lacks scores 0 there.
    """
    both = model.cross_corpus(corpus, other_test, max_iter=max_iter, partitions=partitions, seed=seed)
    own = store_predictions(both.filter("test_set = 'own'"), root, name, train_set, train_set, seed)
    other = store_predictions(both.filter("test_set = 'other'"), root, name, train_set, test_set, seed)
    return store_report([own, other], root, labels, f"{name}-{train_set}-{test_set}-{seed}")


def fit_best_ngrams(
    corpus: DataFrame, labels: Sequence[int], sizes: Sequence[int] = (1, 2, 3), dev: str | None = None, max_iter: int = 100, num_features: int = 1 << 18
) -> tuple[int, sparse.SparseModel]:
    """Fit the bag-of-n-grams classifier for each n; the n and model whose macro F1 on the dev rows is best, of ties the smaller n.

    Test rows (``is_test``) and rows flagged ``dev`` are never trained on. Without dev rows only one n may be given.
    """
    if dev is None and len(sizes) > 1:
        raise ValueError("dev rows choose among several sizes; name their column")
    held = F.col("is_test") if dev is None else F.col("is_test") | F.col(dev)
    rows = corpus.select("row_id", "sdg", "tokens", held.alias("held"), (F.lit(False) if dev is None else F.col(dev)).alias("dev"))
    best = None
    for n in sorted(sizes):
        fitted, hashed = model.fit_ngrams(rows, n, flag="held", keep=("row_id", "dev"), num_features=num_features, max_iter=max_iter)
        score = 0.0
        if len(sizes) > 1:
            predicted = sparse.predict(fitted, hashed.filter("dev"))
            score = metrics.averages(predicted, labels).filter("label = 'macro avg'").first()["f1"]
        if best is None or score > best[0]:
            best = score, n, fitted
    return best[1], best[2]


def score_ngrams(fitted: sparse.SparseModel, rows: DataFrame, n: int) -> DataFrame:
    """Predictions of a fitted or loaded n-gram classifier for rows of ``row_id, sdg, tokens``."""
    return sparse.predict(fitted, rows.select("row_id", "sdg", sparse.hashed_ngrams(F.col("tokens"), n, fitted.features).alias("slots")))


def run_ngrams(
    corpus: DataFrame,
    root: str,
    labels: Sequence[int],
    train_set: str,
    name: str = "ngrams",
    n: int | Sequence[int] = 1,
    max_iter: int = 100,
    seed: int = 0,
    dev: str | None = None,
    others: Mapping[str, DataFrame] | None = None,
    num_features: int = 1 << 18,
) -> DataFrame:
    """Train the bag-of-n-grams classifier, store it, and store and score its test rows.

    ``n`` may be several sizes, of which the dev rows choose. A merged corpus is also scored on the test rows of each source, and
    every corpus on the test rows of ``others``, by name. The model goes below ``root``, to a folder that names its n.
    """
    size, fitted = fit_best_ngrams(corpus, labels, [n] if isinstance(n, int) else n, dev, max_iter, num_features)
    sparse.save(fitted, f"{root}/models/{name}/{train_set}-{seed}/n={size}")
    tested = store_predictions(score_ngrams(fitted, corpus.filter("is_test"), size), root, name, train_set, train_set, seed)
    stored = [tested, *by_source(tested, corpus, root, name, train_set, seed)]
    for other, rows in (others or {}).items():
        stored.append(store_predictions(score_ngrams(fitted, rows, size), root, name, train_set, other, seed))
    return store_report(stored, root, labels, f"{name}-{train_set}-{seed}")


def by_source(stored: DataFrame, corpus: DataFrame, root: str, name: str, train_set: str, seed: int = 0) -> list[DataFrame]:
    """The stored predictions of a merged corpus once more per source, selected by provenance.

    The model was trained on all sources; ``subset`` tells where a row came from. Without that
    column there is nothing to select.
    """
    if "subset" not in corpus.columns:
        return []
    sources = [row["subset"] for row in corpus.select("subset").distinct().orderBy("subset").collect()]  # one per source
    keyed = stored.drop(*stores.REPORT_KEYS).join(corpus.select("row_id", "subset"), "row_id")
    return [
        store_predictions(filters.keep_provenance(keyed, source).drop("subset"), root, name, train_set, source, seed) for source in sources
    ]


def stored_counts(spark, root: str) -> DataFrame:
    """``(label, prediction, n)`` and the run's keys, of every stored run. A few rows a run, however many predictions it has."""
    fields = ["label int", "prediction int", "n bigint", *[f"{key} string" for key in stores.REPORT_KEYS]]
    return spark.read.schema(", ".join(fields)).parquet(f"{root}/counts")


def stored_confusion(spark, root: str, labels: Sequence[int]) -> DataFrame:
    """The confusion matrix of every stored run, from the counts alone; no prediction is read again."""
    return metrics.confusion_of_counts(stored_counts(spark, root), labels, stores.REPORT_KEYS)


def merged_confusion(spark, root: str, labels: Sequence[int], over: str = "seed") -> DataFrame:
    """The same with the counts of all values of one key added up, such as all seeds of a run."""
    keys = [key for key in stores.REPORT_KEYS if key != over]
    counts = stored_counts(spark, root).groupBy(*keys, "label", "prediction").agg(F.sum("n").alias("n"))
    return metrics.confusion_of_counts(counts, labels, keys)
