"""Token, category and vector features."""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, OneHotEncoder, StringIndexer, Word2Vec, Word2VecModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tagloom.functions.text import ngrams, spans
from tagloom.operators.rows import dense_index
from tagloom.session import pin_small, scratch_path, store

if TYPE_CHECKING:
    from tagloom.operators.vectors import WordVectors


def each(df: DataFrame, items: Column, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per array item.

    A plain explode makes Catalyst test the array for emptiness first, which computes a long text
    expression twice; the outer form computes it once, and its null row for an empty array goes here.
    """
    return df.select(*keys, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def vocabulary(df: DataFrame, tokens: str = "tokens", min_count: int = 3) -> DataFrame:
    """``(token, n)`` for the tokens seen at least ``min_count`` times."""
    return (
        each(df, F.col(tokens), "token")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= min_count)
    )


def ngram_counts(df: DataFrame, n: int, tokens: str = "tokens", keys: Sequence[str] = ()) -> DataFrame:
    """n-gram frequencies over the corpus, or per group when keys are given."""
    return (
        each(df, ngrams(F.col(tokens), n), "ngram", keys)
        .groupBy(*keys, "ngram")
        .agg(F.count("*").alias("n"))
    )


def item_counts(df: DataFrame, items: Column, name: str, keys: Sequence[str]) -> DataFrame:
    """``(keys, name, n)``: how often each array item occurs in its own row. Nothing is shuffled."""
    return listed_counts(item_count_lists(df, items, name, keys, "_counts"), name, keys, "_counts")


def item_count_lists(df: DataFrame, items: Column, name: str, keys: Sequence[str], out: str) -> DataFrame:
    """``(keys, out)``: the counts of each row's items as one list of ``(name, n)``.

    Sorting a row's items brings equal ones together, and the places where the value changes give
    the counts.
    """
    sorted_items = df.select(*keys, F.sort_array(items).alias("_items"))
    size = F.size("_items")
    places = F.when(size > 0, F.sequence(F.lit(1), size))
    begins = F.filter(places, lambda i: (i == 1) | (F.get("_items", i - 1) != F.get("_items", i - 2)))
    ends = F.concat(F.slice("_begins", 2, size), F.array(size + 1))
    counted = F.zip_with(
        "_begins",
        ends,
        lambda begin, end: F.struct(F.get("_items", begin - 1).alias(name), (end - begin).cast("bigint").alias("n")),
    )
    with_begins = sorted_items.withColumn("_begins", begins)
    return with_begins.select(*keys, counted.alias(out))


def listed_counts(df: DataFrame, name: str, keys: Sequence[str], lists: str) -> DataFrame:
    """``(keys, name, n)`` of the lists that ``item_count_lists`` made."""
    return df.select(*keys, F.inline_outer(lists)).filter(F.col(name).isNotNull())


def document_ngrams(df: DataFrame, n: int, tokens: str = "tokens", keys: Sequence[str] = ("row_id",)) -> DataFrame:
    """``(keys, ngram, n)`` for a table with one document per row."""
    return item_counts(df, ngrams(F.col(tokens), n), "ngram", keys)


def span_chunks(
    df: DataFrame, tokens: str = "tokens", window: int = 128, stride: int = 96, keys: Sequence[str] = ("row_id",)
) -> DataFrame:
    """One row per overlapping token span: ``(keys, span, start, tokens)``."""
    # an empty token list still has one, empty, span
    chunked = df.select(*keys, F.posexplode_outer(spans(F.col(tokens), window, stride)).alias("span", "_chunk"))
    return chunked.select(*keys, "span", "_chunk.start", "_chunk.tokens")


def mean_pool_long(df: DataFrame, vector: str, keys: Sequence[str]) -> DataFrame:
    """``(keys, dim, value)``: the mean of each vector component per group."""
    parts = df.select(*keys, F.posexplode(vector).alias("dim", "value"))
    return parts.groupBy(*keys, "dim").agg(F.avg(F.col("value").cast("double")).alias("value"))


def mean_pool(df: DataFrame, vector: str, keys: Sequence[str]) -> DataFrame:
    """``(keys, pooled)``: the mean vector per group. What is gathered is one value per component."""
    pairs = F.sort_array(F.collect_list(F.struct("dim", "value")))
    pooled = mean_pool_long(df, vector, keys).groupBy(*keys).agg(pairs.alias("_pairs"))
    return pooled.select(*keys, F.col("_pairs.value").alias("pooled"))


def string_index(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """``(column, n, index)``: categories numbered from 0, most frequent first, ties by name."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return dense_index(counts, F.desc("n"), F.asc(column), out=out or f"{column}_indexed")


def category_encoder(columns: Sequence[str], handle_invalid: str = "error") -> Pipeline:
    """Index and one-hot encode several category columns with one fit each.

    ``error`` raises on null and unseen categories; ``keep`` gives them a slot of their own.
    """
    indexed = [f"{name}_indexed" for name in columns]
    encoded = [f"{name}_encoded" for name in columns]
    return Pipeline(
        stages=[
            StringIndexer(inputCols=list(columns), outputCols=indexed, handleInvalid=handle_invalid),
            OneHotEncoder(inputCols=indexed, outputCols=encoded, handleInvalid=handle_invalid),
        ]
    )


def _one_hot(df: DataFrame, index: str, out: str, categories: int) -> DataFrame:
    """``out``: the vectors of ``OneHotEncoder`` for an index, the last category being all zeros, written as vectors are stored and read as such."""
    known, kind = F.col(index) < categories - 1, VectorUDT().sqlType()
    entry = [F.when(known, F.array(item)).otherwise(F.array().cast(f"array<{t}>")) for item, t in ((F.col(index), "int"), (F.lit(1.0), "double"))]
    parts = [F.lit(0).cast("tinyint"), F.lit(categories - 1).cast("int"), *entry]
    stored = df.withColumn(out, F.struct(*[part.alias(f.name) for part, f in zip(parts, kind)]))
    path = scratch_path(df.sparkSession, "one-hot")
    stored.write.parquet(path)
    schema = StructType([*[f for f in stored.schema if f.name != out], StructField(out, VectorUDT())])
    return df.sparkSession.read.schema(schema).parquet(path)


def encode_categories(
    df: DataFrame, columns: Sequence[str], na_rep: str | None = None, max_categories: int = 100_000
) -> DataFrame:
    """Replace category columns by their one-hot vectors ``<column>_encoded``.

    With ``na_rep`` missing and empty values are one category of that name; without it a null raises
    here, however many categories there are. Both ways below give the same rows and vectors.
    A fitted indexer keeps its categories on the driver, so it takes only the columns that have few
    of them. A column with many, such as author keys, is numbered by a distributed sort and joined, and its vectors
    carry no names: Spark's encoder would list one for each category in the schema, on the driver and in every stored file.
    """
    if na_rep is not None:
        df = df.withColumns({name: F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(na_rep)) for name in columns})
    seen = df.agg(
        *[F.approx_count_distinct(name).alias(name) for name in columns],
        *[F.count_if(F.col(name).isNull()).alias(f"_holes_{name}") for name in columns],
    ).first()
    if holes := [name for name in columns if seen[f"_holes_{name}"]]:
        raise ValueError(f"null categories in {holes}; na_rep gives them a name")
    few = [name for name in columns if seen[name] <= max_categories]
    if few:
        df = category_encoder(few).fit(df).transform(df)
    for name in sorted(set(columns) - set(few)):
        index = store(string_index(df, name).withColumn(f"{name}_indexed", F.col(f"{name}_indexed").cast("int")), "category-index")
        categories = index.count()
        # a category of over a thousandth of the rows is broadcast: there are fewer than a thousand of them
        hot = F.col("n") * 1000 > df.count()
        common, rare = F.broadcast(index.filter(hot).drop("n")), index.filter(~hot).drop("n")
        df = df.join(common, name).unionByName(df.join(common, name, "left_anti").join(rare, name))
        df = _one_hot(df, f"{name}_indexed", f"{name}_encoded", categories)
    return df.drop(*columns, *[f"{name}_indexed" for name in columns])


def fit_embedding(
    df: DataFrame,
    tokens: str,
    out: str,
    key: str = "row_id",
    vector_size: int = 10,
    min_count: int = 3,
    seed: int = 0,
    partitions: int = 8,
    max_iter: int = 1,
    max_words: int = 10_000_000,
    spark_words: int | None = 1_500_000,
) -> Word2VecModel | WordVectors:
    """Fit word vectors; a document's vector is the mean over its words.

    Training runs over ``partitions`` tasks, a number that does not follow the cluster; more of them
    want more passes (``max_iter``). Spark's tasks train on shared arrays, so two fits differ a
    little. One task, fed in key order, always gives the same vectors whatever the files look like;
    that is for corpora that a single task can train on. More than ``max_words`` words of ``min_count``
    occurrences raise before the fit. Spark holds the vocabulary on the driver, with two lists of 40
    numbers for each word: more than ``spark_words`` are trained by ``vectors.skip_gram``, which holds none
    there; it learns from negative samples in place of a code tree. ``None`` is always Spark's.
    """
    rows = df.select(key, tokens)
    words = vocabulary(rows, tokens, min_count).count()
    if words > max_words:
        raise ValueError(f"{words} words occur {min_count} times; raise min_count or max_words")
    if spark_words is not None and words > spark_words:
        from tagloom.operators import vectors  # it imports this module

        table = vectors.skip_gram(rows, tokens, key, vector_size, min_count, seed, max_iter, least_shards=partitions)
        return vectors.WordVectors(table, tokens, out, vector_size)
    placed = rows.repartition(1).sortWithinPartitions(key) if partitions == 1 else rows
    word2vec = Word2Vec(
        vectorSize=vector_size, minCount=min_count, numPartitions=partitions, maxIter=max_iter,
        inputCol=tokens, outputCol=out, seed=seed,
    )
    return word2vec.fit(placed)


def word_vectors(model: Word2VecModel | WordVectors) -> DataFrame:
    """The fitted vocabulary as ``(word, vector)``."""
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def ngram_vectors(df: DataFrame, tokens: str, out: str, n: int = 1, num_features: int = 1 << 18) -> DataFrame:
    """Counts of all 1..n-grams in a hashed vector of fixed length, without a vocabulary."""
    grams = F.concat(*[ngrams(F.col(tokens), size) for size in range(1, n + 1)])
    hashing = HashingTF(numFeatures=num_features, inputCol="_grams", outputCol=out)
    return hashing.transform(df.withColumn("_grams", grams)).drop("_grams")
