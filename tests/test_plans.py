"""Physical plans of the registered queries, and the command line from raw files to scores."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from tagloom.__main__ import main  # noqa: E402
from tagloom.plans.queries import QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
MODELS = {"w2v_embed", "w2v_vocabulary", "lr_predict", "lr_predict_rules", "ablation", "cross_corpus", "bow_classifier"}
MODELS |= {"w2v_rules", "ablation_rules", "cross_corpus_rules", "bow_rules"}
IN_PLACE = {"lang_detect", "lang_filter_detected", "prepared_titled"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODELS))
def test_no_row_wise_python_and_no_cross_join(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "BatchEvalPython" not in text
    assert ("ArrowEvalPython" in text) == (name in IN_PLACE)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_read_only_what_is_used(spark):
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plan(entry.queries()["label_parse"](spark, FOLDER))
    text = plan(entry.queries()["lang_filter_column"](spark, FOLDER))
    assert "EqualTo(lang,en)" in text and "text:string" not in text


def test_long_text_is_tokenized_once(spark):
    assert plan(entry.queries()["vocab_min3"](spark, FOLDER)).count("regexp_replace(lower(") == 1


def test_counts_are_combined_before_the_shuffle(spark):
    for name in ("vocab_min3", "confusion_long", "eval_grid", "lang_profile"):
        assert "partial_count" in plan(entry.queries()[name](spark, FOLDER))


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 20 and sum(r["n_train"] + r["n_test"] for r in rows) == 200


def test_command_line_from_raw_files_to_scores(spark, tmp_path):
    docs = [r for r in entry.queries()["title_concat"](spark, FOLDER).limit(120).collect()]
    titled = ["sdg\tauthor\tfaculty\tyear\ttitle\tcitation2\tabstract"]
    voted = ["doi\ttext_id\ttext\tsdg\tlabels_negative\tlabels_positive\tagreement"]
    for i, r in enumerate(docs):
        words = " ".join(r["abstract"].replace('"', "").split())[:400]
        titled.append(f"SDG{i % 3 + 1}.00\tDoe, J.\tf{i % 2}\t20{10 + i % 5}\tA title {i}.\tc\t{words}")
        voted.append(f'"d{i}\tt{i}\t{words}\t{i % 3 + 1}\t{i % 4}\t3\t0.9"')
    (tmp_path / "a.tsv").write_text("\n".join(titled) + "\n", encoding="utf-8")
    (tmp_path / "b.tsv").write_text("\n".join(voted) + "\n", encoding="utf-8")
    path = lambda name: str(tmp_path / name)
    main(["prepare-titled", "--input", path("a.tsv"), "--output", path("a")])
    main(["prepare-voted", "--input", path("b.tsv"), "--output", path("b")])
    assert spark.read.parquet(path("a")).count() == 120 and spark.read.parquet(path("b")).count() == 120
    main(["merge", "--input", f"a={path('a')},b={path('b')}", "--output", path("ab")])
    assert spark.read.parquet(path("ab")).select("row_id").distinct().count() == 240
    main(["split", "--input", path("ab"), "--output", path("parts")])
    main(["label-docs", "--input", path("parts"), "--output", path("docs"), "--classes", "3"])
    assert spark.read.parquet(path("docs")).count() == 240
    main(["train", "--input", path("parts"), "--output", path("runs"), "--classes", "3", "--name", "ab"])
    main(["evaluate", "--input", path("runs"), "--output", path("matrix"), "--classes", "3"])
    matrix = spark.read.parquet(path("matrix"))
    tests = spark.read.parquet(path("parts")).filter("split = 'test'").count()
    sums = {r["test_set"]: r["n"] for r in matrix.groupBy("test_set").agg(F.sum("n").alias("n")).collect()}
    assert sums["default"] == sums["none"] == tests == sums["a"] + sums["b"]
    assert set(sums) == {"default", "none", "a", "b"}  # the merged model on all, without categories, and on each source
    assert spark.read.text(path("runs") + "/reports/linear-ab-13").count() == 4


def test_text_steps_apply_to_a_stream(spark, tmp_path):
    from tagloom.functions import text
    from tagloom.operators import filters

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumnRenamed("text", "abstract")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    steps = lambda df: filters.drop_missing_text(df).select(
        "doc_id", text.clean_tokens(F.col("abstract")).alias("tokens")
    )
    run = steps(stream).writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(spark.table("cleaned").collect()) == sorted(steps(docs).collect())
