"""The registered queries. Each reads whole tables from a folder and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import labels as lab
from tagloom.functions import text
from tagloom.operators import features, filters, floor, language, metrics, model, rows, sparse, split, vectors
from tagloom.plans import prepare, train
from tagloom.session import scratch_path, spread, store
from tagloom.sources import records, stores, tables, tsv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LABELS = range(1, 18)
PRED_LABELS = range(1, 9)  # two of the ten observed labels stay off the list
PROB_LABELS = range(1, 11)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return spread(tables.documents(spark, folder).select("doc_id", "text"), "doc_id")


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).select("doc_id", text.clean_tokens(F.col("text")).alias("tokens"))


def _stored_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """For steps that read the tokens more than once."""
    return store(_tokens(spark, folder), "tokens")


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in names})


# --- labels, filters ---------------------------------------------------------------------------


@query
def label_parse(spark, folder):
    docs = tables.docs(spark, folder)
    return docs.select("row_id", text.parse_label(F.col("raw_label")).alias("sdg"))


@query
def drop_missing(spark, folder):
    docs = tables.docs(spark, folder).select("row_id", "abstract")
    holes = F.when(F.col("row_id") % 13 == 0, F.lit(None)).when(F.col("row_id") % 13 == 1, "unknown")
    docs = docs.withColumn("abstract", F.when(F.col("row_id") % 13 > 1, F.col("abstract")).otherwise(holes))
    return filters.drop_missing_text(docs)


@query
def agreement_filter(spark, folder):
    kept = filters.keep_agreed(tables.votes(spark, folder))
    return _rounded(kept, "agreement")


@query
def negative_filter(spark, folder):
    kept = filters.keep_likely_positive(tables.votes(spark, folder))
    return _rounded(kept.drop("agreement"), "prob_neg")


@query
def class_filter(spark, folder):
    return filters.keep_class(tables.docs(spark, folder), 4).select("row_id", "sdg", "faculty", "year")


@query
def lang_filter_column(spark, folder):
    kept = language.keep_language_column(tables.documents(spark, folder), "en")
    return kept.select("doc_id", "source", "n_chars")


# --- text --------------------------------------------------------------------------------------


@query
def strip_quotes(spark, folder):
    wrapped = F.concat(F.lit('""'), F.col("text"), F.lit('"'), F.lit("\n"))
    return _texts(spark, folder).select("doc_id", text.strip_quotes(wrapped).alias("line"))


@query
def collapse_ws(spark, folder):
    return _texts(spark, folder).select("doc_id", text.collapse_whitespace(F.col("text")).alias("text"))


@query
def lower_text(spark, folder):
    return _texts(spark, folder).select("doc_id", F.lower("text").alias("text"))


@query
def drop_digits(spark, folder):
    return _texts(spark, folder).select("doc_id", text.remove_digits(F.col("text")).alias("text"))


@query
def drop_punct(spark, folder):
    return _texts(spark, folder).select("doc_id", text.remove_punctuation(F.col("text")).alias("text"))


@query
def link_removal(spark, folder):
    linked = F.concat_ws(" ", "html", "url", "page_id")
    return tables.table(spark, folder, "pages").select("page_id", text.remove_links(linked).alias("text"))


@query
def clean_text(spark, folder):
    return _texts(spark, folder).select("doc_id", text.clean_text(F.col("text")).alias("text"))


@query
def clean_author(spark, folder):
    written = F.concat(F.col("c_name"), F.lit(", A. B.; "), F.col("c_mktsegment"), F.lit(" x"))
    return tables.table(spark, folder, "customer").select("c_custkey", text.clean_author(written).alias("author"))


@query
def title_concat(spark, folder):
    docs = tables.docs(spark, folder)
    title = text.extract_title(F.col("title"))
    compat = text.extract_title(F.col("title"), strict_compat=True)
    return docs.select(
        "row_id",
        title.alias("title"),
        compat.alias("title_compat"),
        text.join_title(title, F.col("abstract")).alias("abstract"),
    )


@query
def tokens_no_stop(spark, folder):
    return _tokens(spark, folder).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query
def token_array_parse(spark, folder):
    printed = F.concat(F.lit("['"), F.array_join("tokens", "', '"), F.lit("']"))
    printed = F.when(F.size("tokens") == 0, "[]").otherwise(printed)
    parsed = text.parse_token_list(printed)
    return _tokens(spark, folder).select("doc_id", F.size(parsed).alias("n"), F.array_join(parsed, "|").alias("tokens"))


@query
def label_format(spark, folder):
    preds = tables.preds(spark, folder)
    shifted = (F.col("label") - 2).cast("int")
    return preds.select("vec_id", lab.label_name(F.col("label")).alias("name"), lab.label_name(shifted).alias("shifted"))


@query
def prepared_titled(spark, folder):
    """The whole preparation of a titled corpus, its language filter learned from the documents."""
    labelled = _texts_with_language(spark, folder)
    profile = language.language_profile(labelled)
    raw = spread(tables.docs(spark, folder), "row_id").withColumn("sdg", F.col("raw_label")).drop("raw_label")
    english = lambda df: language.keep_language(df, profile, LANGUAGES, "en", "abstract")
    return prepare.prepare_titled(raw, english)


@query
def rejected_rows(spark, folder):
    label = F.when(F.col("row_id") % 14 == 0, "no label").when(F.col("row_id") % 7 != 0, F.col("raw_label"))
    raw = tables.docs(spark, folder).select("row_id", label.alias("sdg"))
    return prepare.rejected_labels(raw)


@query
def prepared_voted(spark, folder):
    """The whole preparation of a voted corpus: agreement, votes against, language."""
    docs = tables.docs(spark, folder).select(F.col("row_id").alias("user_id"), "sdg", F.col("abstract").alias("text"), "faculty")
    raw = docs.join(tables.votes(spark, folder), "user_id")
    kept = prepare.prepare_voted(raw, lambda df: language.keep_language_column(df, "en", "faculty"))
    return _rounded(kept, "agreement", "prob_neg")


# --- row identity ------------------------------------------------------------------------------


@query
def index_anti(spark, folder):
    docs = tables.docs(spark, folder).select("row_id", "sdg")
    keys = tables.table(spark, folder, "labels").select(F.col("doc_id").alias("row_id"))
    return rows.drop_keys(docs, keys)


@query
def project_cast(spark, folder):
    docs = tables.docs(spark, folder).drop("abstract", "title")
    docs = docs.withColumnRenamed("sdg", "label").withColumn("subset", F.lit("a"))
    return docs.select("row_id", F.col("label").cast("bigint"), F.col("year").cast("int"), "subset", "faculty")


@query
def drop_if_present(spark, folder):
    docs = tables.docs(spark, folder).select("row_id", "sdg", "faculty", "year")
    return tsv.without(docs, "faculty", "year", "author")


@query
def union_flag_resplit(spark, folder):
    docs = tables.docs(spark, folder).select("row_id", "sdg")
    train, test = docs.filter("row_id % 3 > 0"), docs.filter("row_id % 3 = 0")
    train, test = rows.split_by_flag(rows.flag_union(train, test))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query
def append_back(spark, folder):
    docs = tables.docs_skewed(spark, folder).select("row_id", "sdg")
    single = docs.filter("sdg = 1")
    return rows.append_rows(rows.drop_keys(docs, single), single.select("sdg", "row_id"))


@query
def head_per_class(spark, folder):
    docs = tables.docs_skewed(spark, folder).select("row_id", "sdg", "faculty")
    return rows.head_per_class(docs, 2)


@query
def head_rows(spark, folder):
    return rows.head(tables.docs(spark, folder).select("row_id", "sdg"), 121)


@query
def corpus_concat(spark, folder):
    parts = [("a", tables.corpus_a(spark, folder)), ("b", tables.corpus_b(spark, folder))]
    merged = rows.concat_corpora([(name, df.drop("abstract")) for name, df in parts])
    return merged.select("row_id", "subset", "subset_index", "sdg", "faculty", "year")


@query
def provenance_slice(spark, folder):
    parts = [("a", tables.corpus_a(spark, folder)), ("b", tables.corpus_b(spark, folder))]
    merged = prepare.merge_corpora([(name, df.drop("abstract")) for name, df in parts], na_rep="NA")
    return filters.keep_provenance(merged, "b").select("row_id", "subset", "subset_index", "sdg", "faculty", "year")


# --- splits ------------------------------------------------------------------------------------


@query
def strat_split_rows(spark, folder):
    return split.stratified_split(tables.docs_skewed(spark, folder).select("row_id", "sdg"))


@query
def strat_split_sizes(spark, folder):
    flagged = split.stratified_split(tables.docs(spark, folder).select("row_id", "sdg"))
    return flagged.groupBy("sdg").agg(
        F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test")
    )


@query
def dev_split_rare(spark, folder):
    return split.dev_split(tables.docs_skewed(spark, folder).select("row_id", "sdg"))


@query
def train_dev_test(spark, folder):
    return split.train_dev_test(tables.docs_skewed(spark, folder).select("row_id", "sdg"))


@query
def class_distribution(spark, folder):
    flagged = split.stratified_split(tables.docs_skewed(spark, folder).select("row_id", "sdg"))
    return metrics.class_distribution(flagged)


@query
def corpus_profile(spark, folder):
    """Class distribution of a cleaned and split corpus, with the tokens that cleaning leaves."""
    docs = filters.drop_missing_text(spread(tables.docs(spark, folder).select("row_id", "sdg", "abstract"), "row_id"))
    flagged = split.stratified_split(docs)
    cleaned = flagged.withColumn("n_tokens", F.size(text.clean_tokens(F.col("abstract"))).cast("bigint"))
    return metrics.class_distribution(cleaned, more=[F.sum("n_tokens").alias("n_tokens")])


# --- token and vector features -----------------------------------------------------------------


@query
def vocab_min3(spark, folder):
    return features.vocabulary(_tokens(spark, folder))


@query
def ngram_counts(spark, folder):
    return features.ngram_counts(_tokens(spark, folder), 2)


@query
def doc_ngram_counts(spark, folder):
    return features.document_ngrams(_tokens(spark, folder), 3, keys=("doc_id",))


@query
def source_ngram_counts(spark, folder):
    docs = spread(tables.documents(spark, folder).select("doc_id", "source", "text"), "doc_id")
    tokens = docs.select("source", text.clean_tokens(F.col("text")).alias("tokens"))
    return features.ngram_counts(tokens, 1, keys=("source",))


@query
def span_chunks(spark, folder):
    chunks = features.span_chunks(_tokens(spark, folder), keys=("doc_id",))
    return chunks.select("doc_id", "span", "start", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("tokens"))


@query
def mean_pool(spark, folder):
    pooled = features.mean_pool(tables.table(spark, folder, "embeddings"), "embedding", ["label"])
    parts = pooled.select("label", F.posexplode("pooled").alias("dim", "value"))
    return _rounded(parts, "value")


@query
def string_index(spark, folder):
    return features.string_index(tables.docs(spark, folder), "faculty")


def _slots(spark: SparkSession, folder: str, **options) -> DataFrame:
    docs = tables.docs(spark, folder).select("row_id", "faculty", "year")
    encoded = features.encode_categories(docs, ["faculty", "year"], **options)
    slots = {name: features.vector_to_array(f"{name}_encoded") for name in ("faculty", "year")}
    return encoded.select(
        "row_id",
        *[(F.array_position(slots[name], 1.0) - 1).cast("int").alias(f"{name}_slot") for name in slots],
        *[F.size(slots[name]).alias(f"{name}_width") for name in slots],
    )


@query
def one_hot_index(spark, folder):
    return _slots(spark, folder)


@query
def encode_many(spark, folder):
    """The same by the way for columns of many categories."""
    return _slots(spark, folder, max_categories=0)


# --- language ----------------------------------------------------------------------------------


LANGUAGES = ("de", "en", "es", "fr")


def _texts_with_language(spark: SparkSession, folder: str) -> DataFrame:
    return spread(tables.documents(spark, folder), "doc_id")


@query
def lang_profile(spark, folder):
    return language.language_profile(_texts_with_language(spark, folder))


@query
def lang_detect(spark, folder):
    docs = _texts_with_language(spark, folder)
    return language.detect_language(docs, language.language_profile(docs), LANGUAGES).select("doc_id", "detected")


@query
def lang_detect_join(spark, folder):
    """The same by a join with the profile, as for profiles that no task can hold."""
    docs = _texts_with_language(spark, folder)
    found = language.detect_language(docs, language.language_profile(docs), LANGUAGES, max_grams=0)
    return found.select("doc_id", "detected")


@query
def lang_filter_detected(spark, folder):
    docs = _texts_with_language(spark, folder)
    kept = language.keep_language(docs, language.language_profile(docs), LANGUAGES, "en")
    return kept.select("doc_id", "lang", "source")


# --- labels and probabilities ------------------------------------------------------------------


@query
def label_map(spark, folder):
    docs = tables.docs(spark, folder)
    return docs.select("row_id", F.explode(lab.label_map(F.col("sdg"), LABELS)).alias("label", "hit"))


@query
def argmax_label(spark, folder):
    best = lab.argmax_array(F.col("probs"), PROB_LABELS)
    return tables.probs(spark, folder).select("vec_id", "label", best["prediction"].alias("prediction"), best["probability"].alias("probability"))


@query
def argmax_label_map(spark, folder):
    names = F.array(*[F.lit(str(value)) for value in PROB_LABELS])
    best = lab.argmax_map(F.map_from_arrays(names, "probs"))
    return tables.probs(spark, folder).select("vec_id", best["prediction"].alias("prediction"), best["probability"].alias("probability"))


@query
def predictions_table(spark, folder):
    docs = tables.docs(spark, folder).select("row_id", "abstract", "sdg")
    probs = tables.probs(spark, folder).select(F.col("vec_id").alias("row_id"), "probs")
    return lab.predictions_table(docs, probs, PROB_LABELS)


# --- metrics -----------------------------------------------------------------------------------


@query
def confusion_long(spark, folder):
    return metrics.confusion_matrix(tables.preds(spark, folder), PRED_LABELS)


@query
def confusion_wide(spark, folder):
    return metrics.confusion_table(tables.preds(spark, folder), PRED_LABELS)


@query
def class_report(spark, folder):
    return _rounded(metrics.class_report(tables.preds(spark, folder), LABELS), "precision", "recall", "f1")


@query
def report_averages(spark, folder):
    return _rounded(metrics.averages(tables.preds(spark, folder), LABELS), "precision", "recall", "f1")


@query
def report_micro(spark, folder):
    preds = tables.preds(spark, folder)
    listed = metrics.overall(preds, LABELS, ["condition"]).withColumn("listed", F.lit("all"))
    some = metrics.overall(preds, PRED_LABELS, ["condition"]).withColumn("listed", F.lit("some"))
    return _rounded(listed.unionByName(some), "precision", "recall", "f1")


@query
def eval_grid(spark, folder):
    preds = tables.preds(spark, folder, tables.SEEDS)
    return _rounded(metrics.class_report(preds, LABELS, ["condition", "model", "seed"]), "precision", "recall", "f1")


@query
def eval_grid_confusion(spark, folder):
    preds = tables.preds(spark, folder, tables.SEEDS)
    return metrics.confusion_matrix(preds, PROB_LABELS, ["condition", "model", "seed"])


@query
def eval_grid_lists(spark, folder):
    """One condition lacks the last class, so its matrix is one class smaller."""
    preds = tables.preds(spark, folder, tables.SEEDS)
    return metrics.confusion_by_condition(preds, {0: range(1, 10), 1: PROB_LABELS, 2: PROB_LABELS}, ["model", "seed"])


@query
def macro_auc(spark, folder):
    auc = metrics.label_auc(tables.probs(spark, folder), PROB_LABELS)
    return _rounded(auc, "auc")


@query
def category_scores(spark, folder):
    scores = metrics.category_scores(tables.probs(spark, folder), PROB_LABELS)
    return _rounded(scores, "precision", "recall", "f1", "auc")


@query
def report_text(spark, folder):
    report = metrics.report_text(metrics.full_report(tables.preds(spark, folder), PRED_LABELS))
    return report.select("line", "text")


# --- sources and sinks -------------------------------------------------------------------------


@query
def tsv_round_trip(spark, folder):
    path = scratch_path(spark, "votes-tsv")
    tsv.write_tsv(tables.votes(spark, folder), path, na_rep="NA")
    back = tsv.read_tsv(spark, path, "user_id bigint, labels_positive int, labels_negative int, agreement double")
    return _rounded(back, "agreement")


@query
def text_round_trip(spark, folder):
    """Whole texts with blanks at their ends, quotes, tabs and line breaks."""
    path = scratch_path(spark, "texts-tsv")
    turn, body = F.col("doc_id") % 4, F.col("text")
    padded = F.when(turn == 0, F.concat(F.lit("  "), body, F.lit(" "))).when(turn == 1, F.concat(F.lit('"'), body, F.lit('" "q"')))
    padded = padded.when(turn == 2, F.concat(F.lit("\t"), body)).otherwise(body)
    tsv.write_tsv(tables.documents(spark, folder).select("doc_id", padded.alias("text")), path, rows_per_file=10_000)
    return tsv.read_tsv(spark, path, "doc_id bigint, text string", keep_default_na=False, multi_line=True)


@query
def quoted_lines_scan(spark, folder):
    path = scratch_path(spark, "quoted-lines")
    votes = tables.votes(spark, folder)
    line = F.concat(F.lit('""'), F.concat_ws("\t", "user_id", "labels_positive", "labels_negative"), F.lit('"'))
    votes.select(line.alias("value")).write.text(f"{path}/raw")
    tsv.strip_quoted_lines(spark, f"{path}/raw", f"{path}/stripped")
    lines = spark.read.text(f"{path}/stripped")
    return tsv.parse_tsv_lines(lines, "user_id bigint, labels_positive int, labels_negative int")


@query
def null_token(spark, folder):
    path = scratch_path(spark, "merged-tsv")
    parts = [("a", tables.corpus_a(spark, folder)), ("b", tables.corpus_b(spark, folder))]
    merged = rows.concat_corpora([(name, df.drop("abstract")) for name, df in parts])
    tsv.write_tsv(merged.select("row_id", "faculty", "year", "subset"), path, na_rep="NA")
    schema = "row_id bigint, faculty string, year string, subset string"
    kept = tsv.read_tsv(spark, path, schema, keep_default_na=False)
    nulled = tsv.read_tsv(spark, path, schema, keep_default_na=True)
    nulled = nulled.select("row_id", F.col("faculty").isNull().cast("int").alias("missing"))
    return kept.join(nulled, "row_id")


@query
def predictions_scan(spark, folder):
    path = scratch_path(spark, "preds-tsv")
    preds = tables.preds(spark, folder).select(
        "vec_id", F.col("label").cast("double").alias("label"), F.col("prediction").cast("double").alias("prediction")
    )
    tsv.write_tsv(preds, path)
    back = tsv.read_predictions(spark, path, "vec_id bigint, label double, prediction double")
    return metrics.pair_counts(back)


@query
def json_report(spark, folder):
    path = scratch_path(spark, "reports")
    preds = tables.preds(spark, folder).withColumns(
        {
            "model": F.concat(F.lit("m"), "model"),
            "train_set": F.lit("a"),
            "test_set": F.concat(F.lit("t"), "condition"),
            "seed": F.col("seed").cast("string"),
        }
    )
    stores.write_report(metrics.full_report(preds, LABELS, stores.REPORT_KEYS), path)
    return _rounded(stores.read_report(spark, path), "precision", "recall", "f1")


@query
def label_docs_sink(spark, folder):
    path = scratch_path(spark, "label-docs")
    docs = tables.docs_skewed(spark, folder).select("row_id", "sdg", "abstract")
    named = split.train_dev_test(docs).withColumn("dataset", F.lit("a"))
    stores.write_label_docs(named, path, LABELS)
    back = spark.read.parquet(path)
    return back.select("row_id", "dataset", "split", F.length("abstract").alias("n_chars"), F.explode("cats").alias("label", "hit"))


# --- models (checked by rows here and by properties in the tests) ------------------------------


def _split_tokens(df: DataFrame) -> DataFrame:
    return split.stratified_split(prepare.clean_corpus(df, tokens="tokens")).drop("abstract")


@query
def w2v_embed(spark, folder):
    embedded, _ = model.embed(_split_tokens(spread(tables.docs(spark, folder).select("row_id", "sdg", "abstract"), "row_id")))
    return embedded.select("row_id", features.vector_to_array("abstract_vectorized").alias("vector"))


@query
def w2v_vocabulary(spark, folder):
    docs = spread(tables.docs(spark, folder).select("row_id", "abstract"), "row_id")
    tokens = store(docs.select("row_id", text.clean_tokens(F.col("abstract")).alias("tokens")), "tokens")
    words = features.word_vectors(features.fit_embedding(tokens, "tokens", "vector"))
    return words.select("word", F.size("vector").alias("dims"))


def _lr_predictions(spark: SparkSession, folder: str) -> DataFrame:
    vectors = tables.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("row_id"), (F.col("label") + 1).alias("sdg"), features.array_to_vector("embedding").alias("vector")
    )
    flagged = split.stratified_split(vectors)
    fitted = model.fit_classifier(flagged.filter("not is_test"), ["vector"])
    return model.predict(fitted, flagged.filter("is_test"))


@query
def lr_predict(spark, folder):
    return _lr_predictions(spark, folder)


@query
def lr_predict_rules(spark, folder):
    """What holds for every prediction: which rows are scored, and how the probabilities relate."""
    rows = _lr_predictions(spark, folder)
    total = F.aggregate("probability", F.lit(0.0), lambda acc, value: acc + value)
    return rows.select(
        "row_id",
        "label",
        F.size("probability").alias("slots"),
        (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        (F.get("probability", F.col("prediction")) == F.col("max_prob")).alias("is_best"),
    )


@query
def ablation(spark, folder):
    return model.feature_ablation(_split_tokens(spread(tables.authored_docs(spark, folder), "row_id")))


@query
def cross_corpus(spark, folder):
    trained = _split_tokens(spread(tables.corpus_b(spark, folder), "row_id"))
    other = _split_tokens(spread(tables.corpus_a(spark, folder).select("row_id", "sdg", "abstract"), "row_id"))
    return model.cross_corpus(trained, other.filter("is_test"))


@query
def bow_classifier(spark, folder):
    docs = spread(tables.docs(spark, folder).select("row_id", "sdg", "abstract"), "row_id")
    return model.bag_of_ngrams(_split_tokens(docs), n=2)


# --- what holds for every prediction, whatever the fitted numbers ------------------------------


def _prediction_rules(predictions: DataFrame, *keys: str) -> DataFrame:
    total = F.aggregate("probability", F.lit(0.0), lambda acc, value: acc + value)
    return predictions.select(
        "row_id",
        "label",
        *keys,
        (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        (F.get("probability", F.col("prediction")) == F.col("max_prob")).alias("is_best"),
    )


@query
def ablation_rules(spark, folder):
    return _prediction_rules(ablation(spark, folder), "condition")


@query
def cross_corpus_rules(spark, folder):
    return _prediction_rules(cross_corpus(spark, folder), "test_set")


@query
def bow_rules(spark, folder):
    return _prediction_rules(bow_classifier(spark, folder))


@query
def bow_first_order(spark, folder):
    """What an unregularized fit with intercepts has to satisfy: over the rows it learned from, each class's probabilities sum to its rows."""
    docs = spread(tables.docs(spark, folder).select("row_id", "sdg", "abstract"), "row_id")
    fitted, hashed = model.fit_ngrams(_split_tokens(docs), n=2, max_iter=20)
    learned = sparse.predict(fitted, hashed.filter("not is_test"))
    sums = learned.select(F.posexplode("probability").alias("label", "share")).groupBy("label").agg(F.sum("share").alias("total"))
    rows = learned.groupBy("label").agg(F.count("*").alias("n"))
    met = (F.abs(F.col("total") - F.col("n")) < 1e-3).alias("sums_to_rows")
    return rows.join(sums, "label").select("label", "n", met)


@query
def w2v_rules(spark, folder):
    """Every document's vector is the mean over its words: sums of word vectors by a join, over the token count."""
    flagged = _split_tokens(spread(tables.docs(spark, folder).select("row_id", "sdg", "abstract"), "row_id"))
    flagged = flagged.select("row_id", "sdg", "is_test", "tokens")
    embedded, vectors = model.embed(flagged)
    got = embedded.select("row_id", features.vector_to_array("abstract_vectorized").alias("got"))
    # a vector travels as one row, not as one for each entry
    each = flagged.select("row_id", F.explode("tokens").alias("word")).join(features.word_vectors(vectors), "word")
    sums = each.groupBy("row_id").agg(F.array(*[F.sum(F.get("vector", F.lit(dim))) for dim in range(10)]).alias("sums"))
    sizes = flagged.select("row_id", F.size("tokens").alias("n"))
    joined = got.join(sizes, "row_id").join(sums, "row_id", "left")
    want = F.transform(F.coalesce("sums", F.array_repeat(F.lit(0.0), 10)), lambda s: s / F.greatest(F.col("n"), F.lit(1)))
    gaps = F.zip_with("got", "want", lambda a, b: F.abs(a - b))
    near = F.array_max(gaps) < 1e-6
    return joined.withColumn("want", want).select("row_id", F.size("got").alias("dims"), near.alias("is_mean"))


@query
def vocab_floor(spark, folder):
    """The words found three times; rarer ones are not shuffled."""
    return floor.floor_counts(_stored_tokens(spark, folder), F.col("tokens"), "token", 3)


@query
def ngram_floor(spark, folder):
    """Pairs of words found twice."""
    return floor.floor_counts(_stored_tokens(spark, folder), text.ngrams(F.col("tokens"), 2), "ngram", 2)


def _marked_file(spark: SparkSession, folder: str) -> str:
    """The documents as lines of a file: texts in quotes, with their breaks; some lines lack the text, some have a bad number."""
    path = scratch_path(spark, "marked-lines")
    n = F.col("doc_id")
    body = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.when(n % 17 == 0, n.cast("string")).when(n % 19 == 0, F.concat(F.lit("x"), n, F.lit('\t5" disk'))).otherwise(F.concat(n, F.lit("\t"), body))
    tables.documents(spark, folder).select(line.alias("value")).write.text(path)
    return path


@query
def record_scan(spark, folder):
    """Good rows of a file with quoted line breaks, read in parallel."""
    good, _ = records.read_records(spark, _marked_file(spark, folder), "doc_id bigint, text string", header=False, most_bad=0.5)
    return good.select("doc_id", "text")


@query
def record_rejects(spark, folder):
    """The lines of the same file that fit the table's columns in no way, with the cause."""
    _, bad = records.read_records(spark, _marked_file(spark, folder), "doc_id bigint, text string", header=False, most_bad=0.5)
    return bad.select("cause", "record")


def _digit_vectors(words: DataFrame) -> DataFrame:
    """Vectors that SQL can give too: four bytes of each word's digest, as 256ths, so sums are exact."""
    part = lambda d: F.conv(F.substring(F.md5("word"), 2 * d + 1, 2), 16, 10).cast("double") / 256 - 0.5
    return words.select("word", F.array(*map(part, range(4))).alias("vector"))


@query
def span_pool(spark, folder):
    """Document vectors pooled over overlapping spans of the token vectors of all words found three times."""
    tokens = _stored_tokens(spark, folder)
    words = _digit_vectors(features.vocabulary(tokens).withColumnRenamed("token", "word"))
    return vectors.pool_spans(tokens, words, keys=["doc_id"])


@query
def span_vectors(spark, folder):
    """The same per span."""
    tokens = _stored_tokens(spark, folder)
    words = _digit_vectors(features.vocabulary(tokens).withColumnRenamed("token", "word"))
    return vectors.span_vectors(tokens, words, window=64, stride=48, keys=["doc_id"])


@query
def word_vectors_by_layout(spark, folder):
    """Skip-gram vectors of all texts, trained from two layouts of the rows: every word has equal vectors in both."""
    tokens = _stored_tokens(spark, folder)
    layouts = tokens.repartition(3), tokens.repartition(11, "tokens")
    with ThreadPool(2) as pool:  # a training has as many tasks as shards, which may be fewer than the cores
        one, two = pool.map(inheritable_thread_target(spark)(lambda rows: vectors.skip_gram(rows, key="doc_id", rounds=2)), layouts)
    joined = one.join(two.select("word", F.col("vector").alias("again")), "word", "full")
    moved = F.exists("vector", lambda v: F.abs(v) > 0)
    return joined.select("word", "n", (F.col("vector") == F.col("again")).alias("equal"), moved.alias("trained"))


@query
def stored_runs(spark, folder):
    """The five test conditions as stored runs of two seeds, and one count over all of them."""
    root = scratch_path(spark, "runs")
    preds = tables.preds(spark, folder, (0, 13)).withColumnRenamed("vec_id", "row_id")
    corpus = preds.select("row_id", F.when(F.col("row_id") % 2 == 0, "a").otherwise("b").alias("subset")).distinct()
    for seed in (0, 13):
        rows_of = preds.filter(F.col("seed") == seed)
        run = lambda part, *sets: train.store_predictions(part.select("row_id", "label", "prediction"), root, "linear", *sets, seed)  # noqa: B023, E731
        run(rows_of.filter("condition = 0"), "a", "a")
        run(rows_of.filter("condition = 1"), "b", "a")
        train.by_source(run(rows_of, "ab", "ab"), corpus, root, "linear", "ab", seed)
    return train.stored_confusion(spark, root, LABELS).filter("n > 0")
