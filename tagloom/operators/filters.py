"""Row filters of the preparation step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def negative_share(negative: Column, positive: Column) -> Column:
    """Share of votes against the label; null when nobody voted."""
    against = negative.cast("double")
    return F.try_divide(against, against + positive)


def keep_agreed(df: DataFrame, minimum: float = 0.5, agreement: str = "agreement") -> DataFrame:
    """Rows whose voters agree enough. NaN sorts above every number in Spark, so it is named."""
    return df.filter((F.col(agreement) >= minimum) & ~F.isnan(agreement))


def keep_likely_positive(
    df: DataFrame,
    maximum: float = 0.5,
    negative: str = "labels_negative",
    positive: str = "labels_positive",
) -> DataFrame:
    """Rows whose label is not voted down; adds ``prob_neg``. Rows without votes are dropped."""
    share = negative_share(F.col(negative), F.col(positive))
    return df.withColumn("prob_neg", share).filter(F.col("prob_neg") <= maximum)


def drop_missing_text(df: DataFrame, text: str = "abstract", marker: str = "unknown") -> DataFrame:
    """Rows without text, or whose text is the marker word that stands for none."""
    return df.filter(F.coalesce(F.col(text), F.lit(marker)) != marker)


def keep_class(df: DataFrame, value: int, label: str = "sdg") -> DataFrame:
    return df.filter(F.col(label) == value)


def keep_provenance(df: DataFrame, name: str, subset: str = "subset") -> DataFrame:
    """The part of a merged corpus that came from one source."""
    return df.filter(F.col(subset) == name)
