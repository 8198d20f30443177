"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import decontaminate, exact_dedup, ngram_join, queries, toxicity
from tagloom.llm.common import small_batches, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

SMALL = 200_000  # rows of two numbers that may be broadcast
#: Near copies: shingles of so many words, alike by so many percent; op8's values.
WIDTH, PERCENT = 4, 85


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose id and text are not among ``gone`` (``doc_id``, ``origin``: hash of the text)."""
    gone = stored(gone.select(F.col("doc_id").alias("__id"), F.col("origin").alias("__origin")).distinct(), "dropped-rows")
    if gone.count() <= SMALL:
        gone = F.broadcast(gone)
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__origin"))
    return docs.join(gone, same, "left_anti")


def _bounded(stage: Stage) -> Stage:
    """The stage with small batches, as whole rows with their texts go through Python in several of them."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@_bounded
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the machine learns from the labelled ones among them.

    A null or empty text gets the score of a text without terms. Repeated rows stay or go together.
    """
    machine = queries.machine(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, machine, out="__score")
    return scored.filter(F.col("__score") < 0.5).select(*docs.columns)


@_bounded
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts; of rows that repeat with id and text, one as well. A null text equals an empty one."""
    judged = stored(exact_dedup.dedup(docs), "judged-copies")
    kept = _without(docs, judged.filter(~F.col("kept")))
    again = judged.filter("kept").groupBy("doc_id", "origin").count().filter("count > 1")
    return kept if again.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


@_bounded
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of links, of rows that share it the first.

    Links follow op8's rule. Each row is judged by its own text, also where rows share an id. Texts without words link with
    nothing and stay. A column named like one made here keeps its values.
    """
    whole = F.struct(*docs.columns).alias("__doc")
    rows = stored(docs.select(whole, "doc_id", "text", F.monotonically_increasing_id().alias("__row")), "numbered-documents")
    joined = ngram_join.join(rows, key="__row", width=WIDTH, percent=PERCENT).select(F.col("doc_id").alias("__row"), "component_id")
    joined = stored(joined.join(rows.select("__row", "doc_id"), "__row"), "judged-near-copies")
    first = joined.groupBy("component_id").agg(F.min(F.struct("doc_id", "__row")).alias("first")).select("first.__row")
    gone = stored(joined.join(first, "__row", "left_anti").select("__row"), "dropped-rows")
    if gone.count() <= SMALL:
        gone = F.broadcast(gone)
    return rows.join(gone, "__row", "left_anti").select("__doc.*")


@_bounded
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which hit words of benchmark items make less than a twentieth; a text without words is such a one."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    packed = docs.select(F.struct(*docs.columns).alias("__row"))
    judged = decontaminate.judge(decontaminate.scan(packed, benchmark, text="__row.text", keep=["__row"]))
    return judged.filter(~F.col("contaminated")).select("__row.*")


@_bounded
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences. A null or empty text is packed as its end mark alone; repeated rows each for itself."""
    return queries.pieces(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("packing", pack),
]

#: A trained machine and a tokenizer cannot be put as SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
