import json
import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tagloom.operators import metrics
from tagloom.session import checkpoint_dir, collect_small, pin_small, scratch_path
from tagloom.sources import stores, tsv


def test_null_tokens(spark, tmp_path):
    path = tmp_path / "in.tsv"
    path.write_text("h1\th2\th3\nNA\t1\tx\n\t2\tnull\nok\t3\tNaN\n", encoding="utf-8")
    schema = "a string, n int, c string"
    rows = [tuple(r) for r in tsv.read_tsv(spark, str(path), schema).collect()]
    assert rows == [(None, 1, "x"), (None, 2, None), ("ok", 3, None)]
    rows = [tuple(r) for r in tsv.read_tsv(spark, str(path), schema, keep_default_na=False).collect()]
    assert rows == [("NA", 1, "x"), ("", 2, "null"), ("ok", 3, "NaN")]


def test_bad_number_raises_or_becomes_null(spark, tmp_path):
    path = tmp_path / "bad.tsv"
    path.write_text("n\nx\n", encoding="utf-8")
    with pytest.raises(Exception):
        tsv.read_tsv(spark, str(path), "n int").collect()
    assert tsv.read_tsv(spark, str(path), "n int", mode="PERMISSIVE").first()["n"] is None


def test_round_trip_with_line_breaks_quotes_and_tabs(spark, tmp_path):
    data = [(1, 'a\tb "c"\nd', 0.5), (2, None, None), (3, "é", math.pi)]
    df = spark.createDataFrame(data, "k int, t string, x double")
    tsv.write_tsv(df, str(tmp_path / "out"), na_rep="NA", sort_by="k")
    back = tsv.read_tsv(spark, str(tmp_path / "out"), "k int, t string, x double", multi_line=True)
    assert sorted(tuple(r) for r in back.collect()) == data


def test_without_header(spark, tmp_path):
    tsv.write_tsv(spark.createDataFrame([("w", "[1]")], "word string, vector string"), str(tmp_path / "v"), header=False)
    assert tuple(tsv.read_tsv(spark, str(tmp_path / "v"), "word string, vector string", header=False).first()) == ("w", "[1]")


def test_quoted_lines(spark, tmp_path):
    source = tmp_path / "quoted.tsv"
    source.write_text('"d1\t\'t "q" x\t3"\n""d2\ty\t4""\n', encoding="utf-8")
    tsv.strip_quoted_lines(spark, str(source), str(tmp_path / "plain"))
    lines = spark.read.text(str(tmp_path / "plain"))
    rows = tsv.parse_tsv_lines(lines, "doi string, text string, sdg int").collect()
    assert [tuple(r) for r in rows] == [("d1", "'t \"q\" x", 3), ("d2", "y", 4)]


def test_side_columns_are_dropped_if_present(spark):
    df = spark.createDataFrame([(1, 2)], "a int, faculty int")
    assert tsv.without(df, "faculty", "year").columns == ["a"]


def test_report_store(spark, tmp_path):
    df = spark.createDataFrame([(1, 1), (2, 1)], "label int, prediction int")
    keyed = df.withColumns({"model": F.lit("m"), "train_set": F.lit("a"), "test_set": F.lit("b"), "seed": F.lit("01")})
    report = metrics.full_report(keyed, [1, 2], stores.REPORT_KEYS)
    stores.write_report(report, str(tmp_path / "r"))
    (file,) = Path(tmp_path / "r/model=m/train_set=a/test_set=b/seed=01").glob("*.txt")
    stored = json.loads(file.read_text())
    assert list(stored) == ["sdg_01", "sdg_02", "accuracy", "macro avg", "weighted avg"]
    assert stored["sdg_01"] == {"precision": 0.5, "recall": 1.0, "f1-score": pytest.approx(2 / 3), "support": 1}
    assert stored["accuracy"] == 0.5
    back = {r["label"]: r for r in stores.read_report(spark, str(tmp_path / "r")).collect()}
    assert len(back) == 5 and {r["seed"] for r in back.values()} == {"01"}  # keys stay text
    assert (back["accuracy"]["f1"], back["accuracy"]["support"]) == (0.5, 2)


def test_label_docs(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, "x", "d", "train"), (2, 1, "y", "d", "dev")], "row_id int, sdg int, abstract string, dataset string, split string")
    stores.write_label_docs(df, str(tmp_path / "docs"), [1, 2])
    rows = {r["row_id"]: r for r in spark.read.parquet(str(tmp_path / "docs")).collect()}
    assert rows[1]["cats"] == {"1": 0, "2": 1} and rows[2]["split"] == "dev"
    assert (tmp_path / "docs/dataset=d/split=train").is_dir()


def test_vocabulary_store(spark, tmp_path):
    vectors = spark.createDataFrame([("w", [0.5, 1.0])], "word string, vector array<double>")
    stores.write_vocabulary(vectors, str(tmp_path / "v"))
    assert tsv.read_tsv(spark, str(tmp_path / "v"), "word string, vector string", header=False).first()["vector"] == "[0.5, 1.0]"


def test_small_tables_only(spark):
    assert collect_small(spark.range(11), max_rows=10) is None
    assert collect_small(spark.range(10), max_rows=10).count() == 10
    big = spark.range(11)
    assert pin_small(big, max_rows=10) is big


def test_scratch_is_below_the_named_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_dir(spark) == folder
    assert scratch_path(spark, "x").startswith(folder)
