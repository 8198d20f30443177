"""``spark-submit`` or ``python -m tagloom <step>``: the corpus steps, table in and table out."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import text
from tagloom.operators import language, rows, split
from tagloom.plans import prepare, train
from tagloom.sources import stores, tsv

TITLED = "sdg string, author string, faculty string, year string, title string, citation2 string, abstract string"
VOTED = (
    "doi string, text_id string, text string, sdg int, labels_negative int, labels_positive int, agreement double"
)


def _language_filter(spark: SparkSession, args: argparse.Namespace):
    """Keep English texts by the profile of a labelled table, where one is given."""
    if not args.language_table:
        return None
    labelled = spark.read.parquet(args.language_table)
    labelled = labelled.filter("lang is not null")
    languages = sorted(row["lang"] for row in labelled.select("lang").distinct().collect())  # one row per language
    profile = language.language_profile(labelled)
    return lambda df: language.keep_language(df, profile, languages, "en", "abstract")


def _numbered(df: DataFrame) -> DataFrame:
    """Rows numbered in the order of their contents, so ids do not depend on how rows lie in files."""
    return rows.dense_index(df, F.md5(F.to_json(F.struct(*df.columns))), *[F.asc(name) for name in df.columns], out="row_id")


def prepare_titled(spark: SparkSession, args: argparse.Namespace) -> None:
    raw = _numbered(tsv.read_tsv(spark, args.input, TITLED, multi_line=True))
    prepare.rejected_labels(raw).write.mode("overwrite").parquet(f"{args.output.rstrip('/')}-rejected")
    corpus = prepare.prepare_titled(raw, _language_filter(spark, args))
    corpus.write.mode("overwrite").parquet(args.output)


def prepare_voted(spark: SparkSession, args: argparse.Namespace) -> None:
    lines = spark.read.text(args.input).select(text.strip_quotes(F.col("value")).alias("value"))
    voted = tsv.parse_tsv_lines(lines.filter(~F.col("value").startswith("doi\t")), VOTED)
    corpus = prepare.prepare_voted(_numbered(voted), _language_filter(spark, args))
    corpus.select("row_id", "sdg", "abstract").write.mode("overwrite").parquet(args.output)


def split_corpus(spark: SparkSession, args: argparse.Namespace) -> None:
    flagged = split.train_dev_test(spark.read.parquet(args.input), seed=args.seed)
    cleaned = prepare.clean_corpus(flagged, tokens="tokens")
    cleaned.write.mode("overwrite").partitionBy("split").parquet(args.output)


def merge(spark: SparkSession, args: argparse.Namespace) -> None:
    parts = [(name, spark.read.parquet(path)) for name, path in (part.split("=", 1) for part in args.input.split(","))]
    prepare.merge_corpora(parts, na_rep="NA").write.mode("overwrite").parquet(args.output)


def merge_split(spark: SparkSession, args: argparse.Namespace) -> None:
    """Merge corpora that are split already; every row keeps its part."""
    parts = [(name, spark.read.parquet(path)) for name, path in (part.split("=", 1) for part in args.input.split(","))]
    merged = prepare.merge_split_corpora(parts, na_rep="NA")
    merged.write.mode("overwrite").partitionBy("split").parquet(args.output)


def label_docs(spark: SparkSession, args: argparse.Namespace) -> None:
    corpus = spark.read.parquet(args.input).select("row_id", "sdg", "abstract", "split")
    named = corpus.withColumn("dataset", F.lit(args.name))
    stores.write_label_docs(named, args.output, range(1, args.classes + 1))


def train_linear(spark: SparkSession, args: argparse.Namespace) -> None:
    corpus = spark.read.parquet(args.input).withColumn("is_test", F.col("split") == "test")
    conditions = {
        name: used for name, used in train.model.CONDITIONS.items() if all(column in corpus.columns for column in used)
    }
    train.run_ablation(corpus, args.output, range(1, args.classes + 1), args.name, conditions, seed=args.seed)


def train_ngrams(spark: SparkSession, args: argparse.Namespace) -> None:
    """Dev rows are not trained on; they choose among the sizes. Further corpora, name=path, are tested on."""
    own, *others = args.input.split(",")
    corpus = spark.read.parquet(own).withColumns({"is_test": F.col("split") == "test", "is_dev": F.col("split") == "dev"})
    tested = {name: spark.read.parquet(path).filter("split = 'test'") for name, path in (o.split("=", 1) for o in others)}
    sizes = [int(n) for n in args.sizes.split(",")]
    train.run_ngrams(corpus, args.output, range(1, args.classes + 1), args.name, n=sizes, seed=args.seed, dev="is_dev", others=tested)


def score(spark: SparkSession, args: argparse.Namespace) -> None:
    """Predictions of a stored n-gram model (its folder ends in n=..) for rows of row_id, sdg, tokens."""
    fitted = train.sparse.load(spark, args.model)
    n = int(args.model.rstrip("/").rpartition("n=")[2])
    train.score_ngrams(fitted, spark.read.parquet(args.input), n).write.mode("overwrite").parquet(args.output)


def cross_corpus(spark: SparkSession, args: argparse.Namespace) -> None:
    """``--input`` names the corpus trained on and the one tested on: name=path,name=path."""
    (own, path), (other, other_path) = (part.split("=", 1) for part in args.input.split(","))
    corpus = spark.read.parquet(path).withColumn("is_test", F.col("split") == "test")
    tested = spark.read.parquet(other_path).filter("split = 'test'")
    train.run_cross_corpus(corpus, tested, args.output, range(1, args.classes + 1), own, other, seed=args.seed)


def evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    matrix = train.stored_confusion(spark, args.input, range(1, args.classes + 1))
    matrix.write.mode("overwrite").parquet(args.output)


STEPS = {
    "prepare-titled": prepare_titled,
    "prepare-voted": prepare_voted,
    "split": split_corpus,
    "merge": merge,
    "merge-split": merge_split,
    "label-docs": label_docs,
    "train": train_linear,
    "train-ngrams": train_ngrams,
    "score": score,
    "cross-corpus": cross_corpus,
    "evaluate": evaluate,
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tagloom", description=__doc__)
    parser.add_argument("step", choices=STEPS)
    parser.add_argument("--input", required=True, help="a path; for merge, merge-split and cross-corpus: name=path,name=path; for train-ngrams: path,name=path")
    parser.add_argument("--output", required=True)
    parser.add_argument("--name", default="corpus", help="the data set's name in stored results")
    parser.add_argument("--classes", type=int, default=17)
    parser.add_argument("--seed", type=int, default=13)
    parser.add_argument("--sizes", default="1", help="train-ngrams: the n to choose from, such as 1,2,3")
    parser.add_argument("--model", help="score: the folder of a stored n-gram model")
    parser.add_argument("--language-table", help="Parquet table (text, lang) that teaches the language filter")
    args = parser.parse_args(argv)
    STEPS[args.step](SparkSession.builder.appName(f"tagloom-{args.step}").getOrCreate(), args)


if __name__ == "__main__":
    main()
