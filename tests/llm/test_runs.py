"""Periodic runs against a plain version."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tagloom.llm import queries, runs

BLANKS = " \t\n\x0b\f\r"


def plain_runs(words, least=12):
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, length, q) for (s, length), q in out.items())


def words_of(text):
    for c in BLANKS[1:]:
        text = (text or "").replace(c, " ")
    return [w for w in (text or "").split(" ") if w]


def plain_row(doc_id, text):
    words = words_of(text)
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = ["".join(f"{s},{length},{q}\n" for s, length, q in found), " ".join(w for i, w in enumerate(words) if i not in gone)]
    shas = [hashlib.sha256(d.encode()).hexdigest() for d in digest]
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(found), *head, *shas


def texts():
    rng = random.Random(5)
    out = [None, "", " \n\t", "one", "a " * 11, "a " * 12, "a " * 500, "x\x0by " * 6, "a b " * 6 + "a", "a b " * 5 + "a", "é è ç " * 40]
    fib = ["a", "b"]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    out += [" ".join(fib[-1]), " ".join("abaab" * 30 + "c" + "abaab" * 30), " ".join(f"w{i}" for i in range(400))]
    for k in range(120):
        words = []
        while len(words) < rng.randint(0, 300):
            unit = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(1, 30))]
            words += (unit * 9)[: rng.randint(1, 4 * len(unit))]
        out.append(rng.choice([" ", "\n", "  \t"]).join(words))
    return out


def test_extensions_are_those_of_a_plain_comparison():
    rng = np.random.default_rng(3)
    for letters, size in ((1, 200), (2, 500), (3, 1000), (50, 300)):
        body = np.tile(rng.integers(0, letters, 40), 40)[:size]
        words = np.concatenate((body, [letters], body, [letters + 1]))
        owner = np.repeat([0, 1], size + 1)
        table = runs.Extensions(words, owner)
        i = rng.integers(0, size, 2000)
        j = rng.integers(0, size, 2000)
        i, j = i[i != j], j[i != j]
        for shift in (0, size + 1):
            got = table.common(i + shift, j + shift)
            for a, b, n in zip((i + shift).tolist(), (j + shift).tolist(), got.tolist()):
                assert (words[a : a + n] == words[b : b + n]).all() and words[a + n] != words[b + n]


@pytest.mark.parametrize("points", [1 << 20, 64])
def test_runs_of_many_texts_at_once(monkeypatch, points):
    monkeypatch.setattr(runs, "POINTS", points)
    lists = [words_of(t) for t in texts()]
    code = {w: i for i, w in enumerate(sorted({w for t in lists for w in t}))}
    which, *run = runs.runs_of([np.array([code[w] for w in t], np.int64) for t in lists], 12)
    got = [[] for _ in lists]
    for k, *row in zip(which.tolist(), *(c.tolist() for c in run)):
        got[k].append(tuple(row))
    assert got == [plain_runs(t) for t in lists]


def test_rows_of_any_kind(spark, tmp_path):
    rows = [(k, t, "x") for k, t in enumerate(texts())] + [(None, "p q r " * 20, "y"), (None, None, "y"), (3, "one", None), (3, "one", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((plain_row(i, t) for i, t, _ in rows), key=repr)
    kept = runs.find_runs(docs)
    assert kept.columns == ["doc_id", "text", "n_words", "runs", "collapsed"] and kept.count() == len(rows)
    assert runs.find_runs(docs.limit(0)).collect() == []


def test_very_long_text(spark):
    text = " ".join(f"v{i % 97}" for i in range(60_000)) + " " + " ".join(f"u{i * i % 1009}" for i in range(40_000))
    row = runs.find_runs(spark.createDataFrame([(text,)], "text string")).first()
    assert (0, 60_000, 97) in [tuple(r) for r in row["runs"]] and row["n_words"] == 100_000
    assert (60_000, 40_000, 1009) in [tuple(r) for r in row["runs"]]


def test_registered_query_on_the_table(spark, sf_dir):
    got = {tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert got == {plain_row(r["doc_id"], r["text"]) for r in docs if len(r["text"] or "") < 20_000} | {
        g for g in got if g[0] in {r["doc_id"] for r in docs if len(r["text"] or "") >= 20_000}
    }
