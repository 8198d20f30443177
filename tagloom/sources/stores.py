"""Stored results: evaluation reports, labelled documents, vocabularies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.labels import label_map
from tagloom.sources.tsv import write_tsv

REPORT_KEYS = ("model", "train_set", "test_set", "seed")


def write_report(report: DataFrame, path: str, keys: Sequence[str] = REPORT_KEYS) -> None:
    """One JSON object per evaluation, ``name -> {precision, recall, f1-score, support}``, and ``accuracy`` one number.

    The keys become folders, so evaluations of other models, data sets and seeds sit side by side.
    """
    scores = F.to_json(F.struct("precision", "recall", F.col("f1").alias("f1-score"), "support"))
    body = F.when(F.col("label") == "accuracy", F.col("f1").cast("string")).otherwise(scores)
    name = F.regexp_replace(F.to_json(F.array("label")), r"^\[|\]$", "")  # a quoted JSON string
    lines = F.sort_array(F.collect_list(F.struct("line", F.concat(name, F.lit(":"), body).alias("entry"))))
    objects = report.groupBy(*keys).agg(lines.alias("_lines"))
    entries = F.array_join(F.transform("_lines", lambda line: line["entry"]), ",")
    objects = objects.select(*keys, F.concat(F.lit("{"), entries, F.lit("}")).alias("value"))
    objects.write.mode("overwrite").partitionBy(*keys).text(path)


def read_report(spark: SparkSession, path: str, keys: Sequence[str] = REPORT_KEYS) -> DataFrame:
    """Stored evaluations as rows again; keys are text. ``accuracy`` stands in all three scores, its support is the average rows'."""
    scores = "struct<precision: double, recall: double, `f1-score`: double, support: bigint>"
    fields = ", ".join(["value string", *[f"`{key}` string" for key in keys]])
    rows = spark.read.schema(fields).text(path)
    average = F.from_json(F.get_json_object("value", "$['macro avg']"), scores)
    rows = rows.withColumn("_support", average["support"])
    rows = rows.select(*keys, "_support", F.explode(F.from_json("value", "map<string, string>")).alias("label", "_text"))
    one = F.col("label") == "accuracy"
    rows = rows.withColumns({"_scores": F.from_json(F.when(~one, F.col("_text")), scores), "_number": F.when(one, F.col("_text").cast("double"))})
    names = {"precision": "precision", "recall": "recall", "f1-score": "f1"}
    return rows.select(
        *keys,
        "label",
        *[F.coalesce(F.col("_scores")[name], "_number").alias(alias) for name, alias in names.items()],
        F.when(one, F.col("_support")).otherwise(F.col("_scores.support")).alias("support"),
    )


def write_label_docs(
    df: DataFrame, path: str, labels: Sequence[int], label: str = "sdg", parts: Sequence[str] = ("dataset", "split")
) -> None:
    """Documents with a complete one-vs-all label map, one folder per data set and split."""
    docs = df.withColumn("cats", label_map(F.col(label), labels)).drop(label)
    docs.write.mode("overwrite").partitionBy(*parts).parquet(path)


def write_vocabulary(vectors: DataFrame, path: str) -> None:
    """``(word, vector)`` lines without a header."""
    printed = F.concat(F.lit("["), F.array_join(F.col("vector").cast("array<string>"), ", "), F.lit("]"))
    write_tsv(vectors.select("word", printed.alias("vector")), path, header=False)
