"""Decontamination, the pipeline and the registered queries."""

import hashlib
import os
import random
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tagloom.llm import decontaminate, oracles, queries

from .test_dedup import plain_components, plain_copies

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text):
    return WORDS.findall((text or "").translate(LOWER))


def plain_hits(text, items, width=13):
    words, hit, found = words_of(text), set(), set()
    for item, body in items:
        own = words_of(body)
        size = min(width, len(own))
        wanted = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in wanted:
                hit.update(range(i, i + size))
                found.add(str(item) if item is not None else "")
    names = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), names, len(hit) > 0 and 20 * len(hit) >= len(words)


def tables(spark):
    rng = random.Random(2)
    items = [(k, " ".join(f"q{k}x{j}" for j in range(rng.randint(1, 40)))) for k in range(20)]
    items += [(30, "Short ÉTÉ item"), (31, None), (32, ""), (33, "-- !"), (30, "Short ÉTÉ item"), (34, items[3][1] + " tail"), (None, "null id item here")]
    rows = []
    for k in range(80):
        words = [f"d{rng.randrange(500)}" for _ in range(rng.randint(0, 400))]
        for _ in range(rng.randint(0, 3)):
            own = words_of(rng.choice(items)[1])
            begin = rng.randrange(max(1, len(own)))
            words[(at := rng.randint(0, len(words))) : at] = own[begin:] if rng.random() < 0.5 else own
        rows.append((k, rng.choice([" ", "\n", " - "]).join(words)))
    rows += [(100, None), (101, ""), (102, "short été ITEM"), (103, "short ÉTÉ item"), (None, "x " * 50 + items[5][1]), (104, items[6][1] * 500), (100, "again")]
    docs = spark.createDataFrame([(i, t, "a", 1, "c") for i, t in rows], "doc_id long, text string, items string, n_words int, spans string").repartition(3)
    return docs, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int"), rows, items


@pytest.mark.parametrize("block", [2 << 20, 300])
def test_scan(spark, block):
    docs, benchmark, rows, items = tables(spark)
    judged = decontaminate.judge(decontaminate.scan(docs, benchmark, keep=["doc_id"], block_bytes=block))
    named = F.sha2(F.array_join("items", ","), 256)
    got = judged.select("doc_id", "n_words", "n_hit", "n_items", named, "contaminated").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *plain_hits(t, items)) for i, t in rows), key=repr)


def test_scan_of_empty_tables(spark):
    docs, benchmark, _, _ = tables(spark)
    assert decontaminate.scan(docs.limit(0), benchmark).collect() == []
    assert decontaminate.judge(decontaminate.scan(docs, benchmark.limit(0))).filter("contaminated or n_hit > 0").count() == 0


def test_spans_are_cut_out(spark):
    benchmark = spark.createDataFrame([(1, "bad words here")], "item_id long, text string")
    rows = [(1, "Keep this: BAD words, here! And this."), (2, "bad words here"), (3, None), (4, "bad words"), (5, "bad words here bad words here é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(map(tuple, decontaminate.without_hits(docs, benchmark).collect()))
    assert got == {1: "Keep this: ! And this.", 2: "", 3: None, 4: "bad words", 5: " é"}


# --- queries -----------------------------------------------------------------------------------

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    want = con.sql(oracles.ORACLES[name])
    got = queries.QUERIES[name](spark, FOLDER).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


# --- pipeline ----------------------------------------------------------------------------------


def test_stages_take_effect(spark, tmp_path):
    """Each stage on a small corpus with planted cases, against plain versions on the same input."""
    folder = "/root/testdata/sf0.001"
    real = spark.read.parquet(f"{folder}/documents.parquet")
    body = " ".join(f"w{k}" for k in range(60))
    extra = [(10_000, body), (10_001, body + " \n"), (10_002, body + " z"), (None, "null id"), (10_004, None), (10_004, None), (10_005, "")]
    docs = real.unionByName(spark.createDataFrame([(i, t, "en", "src0", 5) for i, t in extra], real.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    before = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, str(tmp_path))
        assert after.columns == before.columns
        path = str(tmp_path / name)
        after.write.parquet(path)
        after = spark.read.parquet(path)
        rows = [(r["doc_id"], r["text"]) for r in before.collect()]
        left = {(r["doc_id"], r["text"]) for r in after.collect()}
        if name == "exact_dedup":
            want = {(i, t) for (i, t), judged in zip(rows, plain_copies(rows)) if judged[3]}
        elif name == "ngram_jaccard":
            want = {(i, t) for (i, t), judged in zip(rows, plain_components(rows)) if judged[2] == i}
        elif name == "decontaminate":
            want = {(i, t) for i, t in rows if not plain_hits(t, items)[4]}
        else:
            want = left
            assert 0.8 * len(rows) < len(left) <= len(rows)
        assert left == want and (name == "toxicity" or after.count() == len(want))
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, str(tmp_path)).toPandas()
    assert packed.groupby("doc_id")["length"].sum().to_dict() == packed.groupby("doc_id")["doc_tokens"].first().to_dict()


def test_near_copies_are_judged_by_their_own_text(spark):
    """Of rows that share an id, the one unlike all others stays."""
    body = " ".join(f"w{k}" for k in range(60))
    rows = [(3, body + " z"), (9, body), (9, "unlike all others of the table"), (None, "null id here"), (12, ""), (12, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert got == {r for r in rows if r != (9, body)}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_keep_columns_with_clashing_names_and_texts_of_any_kind(spark, sf_dir):
    long = " ".join(f"z{k}" for k in range(60_000))
    near = " ".join(f"n{k}" for k in range(200))
    rows = [(1, None, "en", "a", 0, "p", "q", 7), (2, "", "en", "a", 0, "r", "s", 8), (3, long, None, None, None, None, None, None), (4, near, "en", "a", 1, "t", "u", 9), (5, near + " x", "en", "a", 1, "v", "w", 10), (4, near, "en", "a", 1, "t", "u", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __row string, __doc string, component_id int")
    kept = {"toxicity": {1, 2, 3, 4, 5}, "exact_dedup": {1, 3, 4, 5}, "ngram_jaccard": {1, 2, 3, 4}, "decontaminate": {1, 2, 3, 4, 5}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        got = out.collect()
        assert out.columns == docs.columns and {r["doc_id"] for r in got} == kept[name], name
        assert all(tuple(r) in rows for r in got)
        assert stage(spark, docs.limit(0), sf_dir).collect() == []


def test_texts_alone_travel_to_the_scan(spark):
    """Kept columns stay in the JVM, a text is sent once, and neither a filter nor several columns make a plan scan twice."""
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, None, "y")], "doc_id long, text string, more string")
    benchmark = spark.createDataFrame([("i", "a b")], "item_id string, text string")
    packed = docs.select(F.struct("*").alias("row"))
    found = decontaminate.judge(decontaminate.scan(packed, benchmark, text="row.text", keep=["row"]))
    kept = found.filter("not contaminated").select("row.*")
    for plan in (found, kept):
        shown = plan._jdf.queryExecution().executedPlan().toString()
        assert shown.count("ArrowEvalPython") == 1 and "MapInArrow" not in shown
    assert [tuple(r) for r in kept.collect()] == [(2, None, "y")]
    assert [(r["row"]["more"], r["n_words"], r["n_hit"], r["items"]) for r in found.orderBy("n_words").collect()] == [("y", 0, 0, []), ("x", 3, 2, ["i"])]
