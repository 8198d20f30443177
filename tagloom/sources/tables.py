"""The input tables and the corpus views that the registered queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEEDS = (0, 13, 27, 30, 77)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as a labelled corpus: key, class, side categories, title, text."""
    sdg = F.replace("source", F.lit("src"), F.lit("")).cast("int") + 1
    return documents(spark, folder).select(
        F.col("doc_id").alias("row_id"),
        sdg.alias("sdg"),
        F.concat(F.lit("SDG"), sdg.cast("string"), F.lit(".00")).alias("raw_label"),
        F.col("lang").alias("faculty"),
        (F.lit(2010) + F.col("doc_id") % 10).cast("string").alias("year"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("abstract"),
    )


def docs_skewed(spark: SparkSession, folder: str) -> DataFrame:
    """The same corpus with class sizes 1, 2, 4, 8, ... so that rare and hot classes both occur."""
    sdg = F.least(F.lit(17), F.length(F.bin(F.col("row_id") + 1)))
    return docs(spark, folder).withColumn("sdg", sdg)


def authored_docs(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus with an author column, made of the first two words of each text."""
    return docs(spark, folder).withColumn("author", F.substring_index("title", " ", 2))


def corpus_a(spark: SparkSession, folder: str) -> DataFrame:
    return authored_docs(spark, folder).filter(F.col("faculty") == "en").drop("raw_label", "title")


def corpus_b(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).filter(F.col("faculty") != "en").select("row_id", "sdg", "abstract")


def votes(spark: SparkSession, folder: str) -> DataFrame:
    """Per item: votes for and against its label, and how far the voters agree."""
    counted = (
        table(spark, folder, "events")
        .groupBy(F.expr("event_id div 10").alias("user_id"))
        .agg(
            F.count_if(F.col("event_type") == "purchase").cast("int").alias("labels_positive"),
            F.count_if(F.col("event_type") == "error").cast("int").alias("labels_negative"),
        )
    )
    gap = F.abs(F.col("labels_positive") - F.col("labels_negative")).cast("double")
    total = (F.col("labels_positive") + F.col("labels_negative")).cast("double")
    return counted.withColumn("agreement", F.try_divide(gap, total))


def preds(spark: SparkSession, folder: str, seeds: tuple[int, ...] = (0,)) -> DataFrame:
    """Labels and predictions per condition, model and seed."""
    label = F.col("label") + 1
    swapped = (F.col("label") + 1) % 10 + 1
    return (
        table(spark, folder, "embeddings")
        .withColumn("seed", F.explode(F.array(*[F.lit(seed) for seed in seeds])))
        .select(
            "vec_id",
            (F.col("vec_id") % 3).cast("int").alias("condition"),
            (F.col("vec_id") % 2).cast("int").alias("model"),
            "seed",
            label.alias("label"),
            F.when((F.col("vec_id") + F.col("seed")) % 7 == 0, swapped).otherwise(label).alias("prediction"),
        )
    )


def probs(spark: SparkSession, folder: str) -> DataFrame:
    """Ten label probabilities per item as an array, with the true label."""
    # ten sums over all 64 components, every tenth one in a sum
    sums = [
        sum((F.get("embedding", F.lit(i)).cast("double") for i in range(start + 10, 64, 10)), F.get("embedding", F.lit(start)).cast("double"))
        for start in range(10)
    ]
    raw = F.array(*sums)
    # a lambda would compute an outer value once per item, so the outer value is zipped in
    lifted = F.zip_with("raw", F.array_repeat(F.array_min("raw"), 10), lambda value, low: value - low + 0.1)
    total = F.aggregate("lifted", F.lit(0.0), lambda acc, value: acc + value)
    shares = F.zip_with("lifted", F.array_repeat(total, 10), lambda value, whole: F.round(value / whole, 6))
    return (
        table(spark, folder, "embeddings")
        .select("vec_id", (F.col("label") + 1).alias("label"), raw.alias("raw"))
        .withColumn("lifted", lifted)
        .select("vec_id", "label", shares.alias("probs"))
    )
