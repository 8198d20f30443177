"""Scores of predictions over an explicit label list, per any set of grouping keys.

Every score starts from one count per (keys, label, prediction). Hash aggregation combines these
counts inside each task before the shuffle, so a hot class or condition costs no more than others.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.labels import argmax_array, label_name

Labels = Sequence[int]


def _values(labels: Labels) -> Column:
    return F.array(*[F.lit(value) for value in labels])


def pair_counts(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, "label", "prediction").agg(F.count("*").alias("n"))


def _one_row_per_key(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The observed key combinations, or one row without columns.

    The sum ties them to the pair counts, so that Spark reuses that shuffle; a plain distinct would
    be planned as a second scan.
    """
    if not keys:
        return counts.sparkSession.range(1).select()
    return counts.groupBy(*keys).agg(F.sum("n").alias("_n")).filter("_n > 0").select(*keys)


def class_distribution(df: DataFrame, by: str = "sdg", flag: str = "is_test", more: Sequence[Column] = ()) -> DataFrame:
    """Train and test rows per class, each class's share of the train rows in percent, and ``more`` sums."""
    counts = df.groupBy(by).agg(
        F.count_if(~F.col(flag)).alias("n_train"), F.count_if(F.col(flag)).alias("n_test"), *more
    )
    total = F.sum("n_train").over(Window.partitionBy())
    return counts.withColumn("train_percent", F.round(100.0 * F.col("n_train") / total, 1))


def confusion_matrix(df: DataFrame, labels: Labels, keys: Sequence[str] = ()) -> DataFrame:
    """Long form ``(keys, prediction, label, n)``, zero-filled; pairs off the list are ignored."""
    return confusion_of_counts(pair_counts(df, keys), labels, keys)


def confusion_of_counts(counts: DataFrame, labels: Labels, keys: Sequence[str] = ()) -> DataFrame:
    """The same from pair counts, such as those stored of each run: ``(keys, label, prediction, n)``, one row or several a pair."""
    zeros = (
        _one_row_per_key(counts, keys)
        .withColumn("label", F.explode(_values(labels)))
        .withColumn("prediction", F.explode(_values(labels)))
        .withColumn("n", F.lit(0).cast("bigint"))
    )
    # a test of the count as well stays above the shuffle, which the keys then share
    on_list = F.col("label").isin(*labels) & F.col("prediction").isin(*labels)
    listed = counts.withColumn("n", F.when(on_list, F.col("n"))).filter("n > 0")
    return listed.unionByName(zeros).groupBy(*keys, "prediction", "label").agg(F.sum("n").alias("n"))


def confusion_by_condition(
    df: DataFrame, labels_of: Mapping[object, Labels], keys: Sequence[str] = (), condition: str = "condition"
) -> DataFrame:
    """Confusion matrices where each condition has a label list of its own; a condition without one raises."""
    known = F.col(condition).isin(*labels_of)
    error = F.raise_error(F.concat(F.lit("no label list for condition "), F.coalesce(F.col(condition).cast("string"), F.lit("null"))))
    kind = df.schema[condition].dataType
    df = df.withColumn(condition, F.when(known, F.col(condition)).otherwise(error.cast(kind)))
    matrices = [
        confusion_matrix(
            df.filter(F.col(condition).isin(*[name for name in labels_of if tuple(labels_of[name]) == listed])),
            listed,
            [condition, *keys],
        )
        for listed in dict.fromkeys(tuple(labels) for labels in labels_of.values())
    ]
    return reduce(DataFrame.unionByName, matrices)


def confusion_table(df: DataFrame, labels: Labels, keys: Sequence[str] = (), prefix: str = "true_") -> DataFrame:
    """Wide form: one row per predicted label, one column per true label."""
    wide = confusion_matrix(df, labels, keys).groupBy(*keys, "prediction").pivot("label", list(labels)).sum("n")
    return wide.withColumnsRenamed({str(value): f"{prefix}{value}" for value in labels})


def _class_counts(df: DataFrame, labels: Labels, keys: Sequence[str]) -> DataFrame:
    """``(keys, class, tp, predicted, support)`` for each listed label, rows off the list included."""
    counts = pair_counts(df, keys)
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(zero)

    def side(label: Column, tp: Column, predicted: Column, support: Column) -> Column:
        return F.struct(
            label.alias("class"), tp.alias("tp"), predicted.alias("predicted"), support.alias("support")
        )

    sides = F.array(
        side(F.col("label"), hit, zero, F.col("n")), side(F.col("prediction"), zero, F.col("n"), zero)
    )
    seen = counts.select(*keys, F.inline(sides)).filter(F.col("class").isin(*labels))
    listed = _one_row_per_key(counts, keys).select(*keys, F.explode(_values(labels)).alias("class"))
    listed = listed.withColumns({"tp": zero, "predicted": zero, "support": zero})
    return (
        seen.unionByName(listed)
        .groupBy(*keys, "class")
        .agg(*[F.sum(name).alias(name) for name in ("tp", "predicted", "support")])
    )


def _ratio(above: Column, below: Column) -> Column:
    """Division in which nothing over nothing is 0."""
    return F.coalesce(F.try_divide(above.cast("double"), below.cast("double")), F.lit(0.0))


def _with_scores(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        {
            "precision": _ratio(F.col("tp"), F.col("predicted")),
            "recall": _ratio(F.col("tp"), F.col("support")),
            "f1": _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")),
        }
    )


SCORES = ("precision", "recall", "f1", "support")


def class_report(df: DataFrame, labels: Labels, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per listed label; 0 where a score is undefined."""
    scored = _with_scores(_class_counts(df, labels, keys))
    return scored.select(*keys, F.col("class").alias("label"), *SCORES)


def averages(df: DataFrame, labels: Labels, keys: Sequence[str] = ()) -> DataFrame:
    """``macro avg`` and ``weighted avg`` rows over the label list, empty classes included."""
    scored = _with_scores(_class_counts(df, labels, keys))
    kinds = scored.groupBy(*keys).agg(
        F.struct(
            F.lit("macro avg").alias("label"),
            *[F.avg(name).alias(name) for name in SCORES[:3]],
            F.sum("support").alias("support"),
        ).alias("macro"),
        F.struct(
            F.lit("weighted avg").alias("label"),
            *[_ratio(F.sum(F.col(name) * F.col("support")), F.sum("support")).alias(name) for name in SCORES[:3]],
            F.sum("support").alias("support"),
        ).alias("weighted"),
    )
    return kinds.select(*keys, F.inline(F.array("macro", "weighted")))


def overall(df: DataFrame, labels: Labels, keys: Sequence[str] = ()) -> DataFrame:
    """The ``accuracy`` row, or ``micro avg`` when some observed label is null or not on the list."""
    counts = pair_counts(df, keys)
    true_listed, pred_listed = F.col("label").isin(*labels), F.col("prediction").isin(*labels)
    n, equal = F.col("n"), F.col("label") == F.col("prediction")
    sums = counts.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(equal & true_listed, n)), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(pred_listed, n)), F.lit(0)).alias("predicted"),
        F.coalesce(F.sum(F.when(true_listed, n)), F.lit(0)).alias("support"),
        F.bool_and(F.coalesce(true_listed & pred_listed, F.lit(False))).alias("all_listed"),
    )
    return _with_scores(sums).select(
        *keys,
        F.when(F.col("all_listed"), "accuracy").otherwise("micro avg").alias("label"),
        *SCORES,
    )


def full_report(df: DataFrame, labels: Labels, keys: Sequence[str] = (), prefix: str = "sdg_") -> DataFrame:
    """Class rows under their printed names, then the overall row and the averages; ``line`` orders them."""
    classes = class_report(df, labels, keys).withColumn("line", F.array_position(_values(labels), F.col("label")))
    classes = classes.withColumn("label", label_name(F.col("label"), prefix))
    below = overall(df, labels, keys).unionByName(averages(df, labels, keys))
    place = F.when(F.col("label") == "macro avg", 2).when(F.col("label") == "weighted avg", 3).otherwise(1)
    below = below.withColumn("line", (place + len(labels)).cast("bigint"))
    return classes.unionByName(below)


def report_text(report: DataFrame, digits: int = 4) -> DataFrame:
    """The rows of a full report as right-aligned text with fixed decimals, under ``report_header``.

    Decimals are those nearest to the binary value, ties to even, as C prints them.
    """

    def number(name: str) -> Column:
        return F.lpad(_printed(F.col(name), digits), 9, " ")

    only_f1 = F.col("label") == "accuracy"
    blank = F.lit(" " * 9)
    text = F.concat_ws(
        " ",
        F.lpad("label", 12, " "),
        F.when(only_f1, blank).otherwise(number("precision")),
        F.when(only_f1, blank).otherwise(number("recall")),
        number("f1"),
        F.lpad(F.col("support").cast("string"), 9, " "),
    )
    return report.withColumn("text", text)


def report_header() -> str:
    """The line above a printed report."""
    return " ".join([" " * 12, *[name.rjust(9) for name in ("precision", "recall", "f1-score", "support")]])


def _printed(value: Column, digits: int) -> Column:
    """A score rounded by its exact binary value, ties to even.

    Twice the scaled value is computed with its rounding error (the value is split into two halves of
    its bits, whose products are exact), so the comparison with a tie is exact as well.
    """
    twice = F.lit(float(2 * 10**digits))
    near = value * twice
    wide = value * F.lit(134217729.0)  # 2**27 + 1 splits the 53 bits
    high = wide - (wide - value)
    error = (high * twice - near) + (value - high) * twice
    low = F.floor(near / 2)
    gap = (near - (2 * low + 1)) + error
    whole = low + F.when(gap > 0, 1).when(gap < 0, 0).otherwise(low % 2)
    above = F.floor(whole / 10**digits).cast("string")
    return F.concat(above, F.lit("."), F.lpad((whole % 10**digits).cast("string"), digits, "0"))


def category_scores(df: DataFrame, labels: Labels, probabilities: str = "probs") -> DataFrame:
    """Scores of label probabilities: per-label, micro and macro P, R and F1, and ROC AUC.

    The predicted label is the first maximum. The macro AUC counts labels without an AUC as 0.
    """
    best = argmax_array(F.col(probabilities), labels)
    pairs = df.select("label", best["prediction"].alias("prediction"))
    counts = _class_counts(pairs, labels, ())
    auc = label_auc(df, labels, probabilities)
    scored = _with_scores(counts).join(auc.select(F.col("label").alias("class"), "auc"), "class")
    per_label = scored.select(F.col("class").cast("string").alias("label"), *SCORES, "auc")
    micro = _with_scores(counts.agg(*[F.sum(name).alias(name) for name in ("tp", "predicted", "support")]))
    micro = micro.select(F.lit("micro").alias("label"), *SCORES, F.lit(None).cast("double").alias("auc"))
    macro = per_label.agg(
        F.lit("macro").alias("label"),
        *[F.avg(name).alias(name) for name in SCORES[:3]],
        F.sum("support").alias("support"),
        F.avg(F.coalesce("auc", F.lit(0.0))).alias("auc"),
    )
    return per_label.unionByName(micro).unionByName(macro)


def _order_key(score: Column) -> Column:
    """A number that grows with the score and spreads scores over their binary digits: an exponent and a fraction."""
    size = F.abs(score)
    exponent = F.floor(F.log2(size))
    place = exponent + 1076 + size / F.pow(F.lit(2.0), exponent) - 1  # the least exponent of a double is -1074
    place = F.when(score == 0, 0.0).when(size == math.inf, 4096.0).otherwise(place)
    return F.signum(score) * place


def label_auc(df: DataFrame, labels: Labels, probabilities: str = "probs", fineness: int = 4096) -> DataFrame:
    """One-vs-rest area under the ROC curve per label; null when a label has only one side.

    The area is the share of (positive, negative) pairs that the score puts in order, ties half. A
    score that is null or not a number ranks below all others.
    Equal scores are merged first. Their order keys are cut into steps of one ``fineness``-th, and each step again: pairs
    inside a fine step are counted by a window over that step alone, pairs across steps follow from totals, first of the fine
    steps of a step, then of all steps. So no task sorts all rows of a label, scores are read once, and nothing is sampled.
    """
    names = F.array(*[F.lit(value) for value in labels])
    bottom = F.lit(-math.inf)
    scored = df.select("label", F.posexplode(probabilities).alias("_at", "score")).select(
        F.get(names, F.col("_at")).alias("_label"), F.coalesce(F.nanvl("score", bottom), bottom).alias("score"), F.col("label").alias("_true")
    )
    is_hit = F.col("_true") == F.col("_label")
    merged = scored.groupBy(F.col("_label").alias("label"), "score").agg(
        F.count_if(is_hit).alias("pos"), F.count_if(~is_hit).alias("neg")
    )
    place = _order_key(F.col("score")) * fineness
    merged = merged.withColumns({"_step": F.floor(place), "_fine": F.floor((place - F.floor(place)) * fineness)})
    merged = merged.withColumn("_pairs", F.lit(0).cast("decimal(38,0)"))
    inside = _with_pairs(merged, ["label", "_step", "_fine"], "score", ties=True)
    fine = _with_pairs(inside, ["label", "_step"], "_fine")
    steps = _with_pairs(fine, ["label"], "_step")
    area = F.try_divide(F.col("_pairs").cast("double"), 2.0 * F.col("pos").cast("double") * F.col("neg").cast("double"))
    return steps.select("label", F.col("pos").alias("n_pos"), F.col("neg").alias("n_neg"), area.alias("auc"))


def _with_pairs(df: DataFrame, keys: Sequence[str], order: str, ties: bool = False) -> DataFrame:
    """Rows added up by ``keys``: ``pos``, ``neg``, and twice the ordered pairs inside rows and across them, in order of ``order``."""
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    below = 2 * F.coalesce(F.sum("neg").over(earlier), F.lit(0))
    ahead = df.withColumn("_below", below + F.col("neg") if ties else below)
    # twice the pairs, so that ties stay whole numbers
    across = F.col("pos").cast("decimal(19,0)") * F.col("_below").cast("decimal(19,0)")
    return ahead.groupBy(*keys).agg(
        F.sum(F.col("_pairs") + across).cast("decimal(38,0)").alias("_pairs"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
