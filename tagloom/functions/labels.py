"""Expressions on class labels and label probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_name(label: Column, prefix: str = "sdg_") -> Column:
    """``sdg_01`` .. ``sdg_09``, ``sdg_10`` and up, and ``sdg_-1`` for the no-class label."""
    digits = label.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(digits) == 1, "0").otherwise(""), digits)


def label_map(label: Column, labels: Sequence[int]) -> Column:
    """A complete ``label -> 0 or 1`` map over the given labels."""
    names = F.array(*[F.lit(str(value)) for value in labels])
    hits = F.array(*[(label == F.lit(value)).cast("int") for value in labels])
    return F.map_from_arrays(names, F.transform(hits, lambda hit: F.coalesce(hit, F.lit(0))))


def argmax_array(probabilities: Column, labels: Sequence[int]) -> Column:
    """``struct<prediction, probability>``: the first maximum in label order."""
    best = F.array_max(probabilities)
    names = F.array(*[F.lit(value) for value in labels])
    return F.struct(
        F.get(names, (F.array_position(probabilities, best) - 1).cast("int")).alias("prediction"),
        best.alias("probability"),
    )


def argmax_map(probabilities: Column) -> Column:
    """The same over a ``label -> probability`` map; its entry order decides ties."""
    ranked = F.transform(
        F.map_entries(probabilities),
        lambda entry, i: F.struct(
            entry["value"].alias("probability"), (-i).alias("order"), entry["key"].alias("prediction")
        ),
    )
    best = F.array_max(ranked)
    return F.struct(best["prediction"].alias("prediction"), best["probability"].alias("probability"))


def predictions_table(
    docs: DataFrame, probabilities: DataFrame, labels: Sequence[int], key: str = "row_id", label: str = "sdg"
) -> DataFrame:
    """Documents with their best label and its probability, matched by key; null where there is none.

    A key has one row of probabilities; a repeated one raises. Rows of probabilities without a key belong to no document.
    Documents that share a key share its prediction.
    """
    best = argmax_array(F.col("probs"), labels)
    found = probabilities.filter(F.col(key).isNotNull()).groupBy(key).agg(F.first("probs").alias("probs"), F.count("*").alias("_times"))
    repeated = F.raise_error(F.concat(F.lit(f"{key} has several probabilities: "), F.col(key).cast("string")))
    found = found.select(key, F.when(F.col("_times") == 1, best).otherwise(repeated).alias("_best"))
    return docs.withColumnRenamed(label, "label").join(found, key, "left").select("*", "_best.*").drop("_best")
