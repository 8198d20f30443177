"""Records with quoted line breaks against the reader that takes a file as a whole, and rejected ones."""

import random

import pytest

from tagloom.sources import records, tsv


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def body(rng):
    words = [rng.choice(["plain", '"', '""', "\n", "\n\n", "\t", "é", " ", 'a"b', ","]) for _ in range(rng.randint(0, 40))]
    return " ".join(words)


def quoted(text):
    return '"' + text.replace('"', '""') + '"'


def table(rng, n):
    rows = [(k, body(rng) * rng.choice([1, 1, 1, 60])) for k in range(n)]
    lines = [f"{k}\t{quoted(t)}" if rng.random() < 0.9 or any(c in t for c in '\n\t"') or not t else f"{k}\t{t}" for k, t in rows]
    return rows, "id\tbody\n" + "\n".join(lines) + "\n"


def test_lines_end_inside_a_field_or_not():
    cases = {'a\t"b': True, 'a\t"b"': False, 'a\t"b""': True, 'a"b\tc': False, '"a"\t"': True, '""\tx': False, "": False, '"': True, '"x"y\t"': True}
    for line, want in cases.items():
        assert records.ends_inside(line, False) is want, line
    assert records.ends_inside('x"\t"y', True) and not records.ends_inside('x""y"', True) and records.ends_inside("x", True)


def test_equals_the_reader_of_whole_files(spark, tmp_path, small_splits):
    want = []
    for f in range(3):
        rows, text = table(random.Random(f), 300)
        (tmp_path / f"f{f}.tsv").write_text(text)
        want += rows
    want.append((7777, "x\n" * 9000))  # longer than several splits
    (tmp_path / "long.tsv").write_text("id\tbody\n" + "\n".join(f"{k}\t{quoted(t)}" for k, t in want[-1:]))
    scanned = records.scan_records(spark, str(tmp_path))
    assert scanned.filter("closed").count() == len(want) == scanned.count()
    got = [tuple(r) for r in tsv.read_tsv(spark, str(tmp_path), "id int, body string", keep_default_na=False, multi_line=True).collect()]
    assert sorted(got) == sorted(want)
    whole = spark.read.schema("id int, body string").options(sep="\t", header=True, escape='"', multiLine=True, maxCharsPerColumn=-1, emptyValue="")
    whole = whole.options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(str(tmp_path))
    assert sorted((r[0], r[1] or "") for r in whole.collect()) == sorted(want)
    assert records._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 20


def test_split_table_too_large_to_broadcast(spark, tmp_path, small_splits, monkeypatch):
    rows, text = table(random.Random(9), 400)
    (tmp_path / "f.tsv").write_text(text)
    monkeypatch.setattr(records, "collect_small", lambda df: None)
    got = [tuple(r) for r in tsv.read_tsv(spark, str(tmp_path), "id int, body string", keep_default_na=False, multi_line=True).collect()]
    assert sorted(got) == sorted(rows)


def test_good_and_bad_rows(spark, tmp_path, small_splits):
    text = 'k\tt\n1\t"a\nb"\n2\n\n3\tx\ty\nfour\tz\n5\t\r\n6\t"never\nclosed\n7\tc\n'
    (tmp_path / "f.tsv").write_text(text)
    good, bad = records.read_records(spark, str(tmp_path), "k int, t string", most_bad=0.9)
    assert sorted(tuple(r)[1:] for r in good.collect()) == [(2, 1, "a\nb"), (8, 5, None)]
    assert sorted(tuple(r)[1:] for r in bad.collect()) == [
        (4, "number of fields", "2"), (6, "number of fields", "3\tx\ty"), (7, "k is no int", "four\tz"), (9, "quote not closed", '6\t"never\nclosed\n7\tc'),
    ]
    with pytest.raises(ValueError, match="4 of 6 records are bad, such as line 4"):
        records.read_records(spark, str(tmp_path), "k int, t string", most_bad=0.5)
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "f.tsv").write_text("k\tt\n")
    good, bad = records.read_records(spark, f"{tmp_path}/none", "k int, t string")
    assert good.collect() == [] and bad.collect() == []


def test_endless_record_is_bounded(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(records, "LONGEST", 3000)
    (tmp_path / "f.tsv").write_text('k\tt\n1\ta\n2\t"' + "word word\n" * 3000)
    found = {r["line"]: r for r in records.scan_records(spark, str(tmp_path)).collect()}
    assert found[2]["closed"] and not found[3]["closed"] and len(found[3]["record"]) < 12_000


def test_open_quote_in_one_column_raises(spark, tmp_path):
    (tmp_path / "f.tsv").write_text('t\n"a\nb"\nplain\n')
    with pytest.raises(Exception, match="open at the end of line 2"):
        tsv.read_tsv(spark, str(tmp_path), "t string").collect()
    assert [r["t"] for r in tsv.read_tsv(spark, str(tmp_path), "t string", multi_line=True).collect()] == ["a\nb", "plain"]
