"""Language model, toxicity, URL filter and license scan against plain versions."""

import math
import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import licenses, lm, queries, toxicity, url_filter
from tagloom.llm.common import stored

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w] + [None]


# --- language model ----------------------------------------------------------------------------


def model_of(states, outcomes, seed=1):
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.dirichlet(np.ones(shape[-1]), shape[:-1] or None)
    return lm.Model(*(np.asarray(x, np.float32) for x in (draw(states), draw(states, states), draw(states, outcomes).T)))


def all_paths(model, text):
    """Probability of every path of states, by enumeration."""
    for path in product(range(len(model.start)), repeat=len(text)):
        p = float(model.start[path[0]]) * float(model.emits[text[0], path[0]])
        for a, b, w in zip(path, path[1:], text[1:]):
            p *= float(model.moves[a, b]) * float(model.emits[w, b])
        yield path, p


TEXTS = [np.array(t, np.int32) for t in ([0], [2, 0], [1, 3, 2, 2, 0], [3, 3, 0], [1, 1, 1, 1, 0])]


def test_forward_sums_over_all_paths():
    model = model_of(3, 4)
    got = lm._Steps(TEXTS).forward(model)[0]
    assert got == pytest.approx([math.log(sum(p for _, p in all_paths(model, t))) for t in TEXTS], rel=1e-5)


def test_expected_counts_are_those_of_all_paths():
    model = model_of(2, 4)
    start, moves, emits = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for text in TEXTS:
        total = sum(p for _, p in all_paths(model, text))
        for path, p in all_paths(model, text):
            start[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                moves[a, b] += p / total
            for w, s in zip(text, path):
                emits[w, s] += p / total
    for got, want in zip(lm._Steps(TEXTS).expected(model), (start, moves, emits)):
        assert got == pytest.approx(want, rel=1e-4)


def lm_rows():
    rng = random.Random(4)
    tongues = [[f"a{k}" for k in range(30)], [f"b{k}" for k in range(30)]]
    rows = [(i, " ".join(rng.choice(tongues[i % 2]) for _ in range(rng.randint(1, 60)))) for i in range(120)]
    return rows + [(200, None), (201, ""), (202, " \n\t"), (203, "unseen Words é É"), (None, "A1 b1"), (204, "a1\x0ba2\x0ca3"), (204, "a1"), (205, "a1 " * 4000)]


@pytest.mark.parametrize("most", [1 << 15, 0])
def test_language_model(spark, most):
    rows = lm_rows()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, score string, n_tokens int").repartition(3)
    held = F.col("doc_id") % 5 == 1
    got = lm.score(docs, held, often=1, max_words=most, rounds=3).collect()
    train = Counter(w for i, t in rows if i is not None and i % 5 != 1 for w in words_of(t))
    n, v = sum(train.values()), len(train)
    want = []
    for i, t in rows:
        words = words_of(t)
        base = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        want.append((i, i is None or i % 5 == 1, len(words), sum(w in train for w in words), n, round(base, 5)))
    assert sorted([(*r[:5], round(r[5], 5)) for r in got], key=repr) == sorted(want, key=repr)
    if most:  # two languages that a base of single words cannot tell apart
        both = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 120]
        assert sum(r["score"] for r in both) > sum(r["base_score"] for r in both)
    else:
        assert all(math.isfinite(r["score"]) for r in got)


def test_probabilities_of_one_word_texts_add_up(spark):
    """All known words, the unknown one and the empty text, as first of a text: the scores are a distribution."""
    rows = [(i, t) for i, t in lm_rows() if i is not None and i < 120]
    seen = sorted({w for i, t in rows if i % 5 != 1 for w in words_of(t) if w})
    probes = [(1001 + 5 * k, w) for k, w in enumerate([*seen, "unknown"])]
    docs = spark.createDataFrame(rows + probes, "doc_id long, text string")
    got = lm.score(docs, F.col("doc_id") % 5 == 1, often=3, max_words=20, rounds=2).filter("doc_id > 1000")
    first = sum(10 ** r["score"] for r in got.collect())
    docs = spark.createDataFrame(rows + [(1001, "")], "doc_id long, text string")
    # P(word, end) summed over words is P(two outcomes, the second the end), below one and above zero.
    assert 0 < first < 1
    assert lm.score(docs, F.col("doc_id") % 5 == 1, rounds=1).count() == len(rows) + 1


def test_language_model_without_training_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (6, None)], "doc_id long, text string")
    got = sorted(lm.score(docs, F.lit(True)).collect())
    assert [r[:5] for r in got] == [(1, True, 3, 0, 0), (6, True, 1, 0, 0)]
    assert [r["base_score"] for r in got] == [0.0, 0.0]
    assert lm.score(docs.limit(0), F.lit(True)).collect() == []


def test_vocabulary_does_not_follow_the_file_layout(spark):
    """Few texts a partition: words are counted over all of them, with the production threshold."""
    docs = spark.createDataFrame(lm_rows(), "doc_id long, text string")
    train = docs.filter("doc_id % 5 != 1")
    counts = Counter(w for i, t in lm_rows() if i is not None and i % 5 != 1 for w in words_of(t)[:-1])
    want = sorted(w for w, n in counts.items() if n >= 8)
    assert len(want) > 50
    for rows in (train.coalesce(1), train.repartition(40)):
        assert [w for w, _ in lm._frequent(rows, 8, 1 << 15)] == want
        assert [w for w, _ in lm._frequent(rows, 8, 1 << 15, hold=10)] == want


def test_long_word_in_many_rows_is_not_gathered(spark):
    """Words too long for an outcome of their own may be in every text: counts are summed, rows stay spread."""
    url = "https://example.org/" + "a" * 60
    rows = [(k, f"{url} x{k % 7} " + f"{url} " * (k % 3)) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumn("held_out", F.col("doc_id") % 5 == 1)
    encoded = stored(lm._encode(docs, ["x0", "x1"]), "encoded")
    rare, words, times = lm._rare_counts(encoded)
    spread = rare._jdf.queryExecution().toString()
    assert "MapInArrow" not in spread and "BroadcastHashJoin" in spread
    train = Counter(w for i, t in rows if i % 5 != 1 for w in words_of(t)[:-1] if w not in ("x0", "x1"))
    assert (words, times) == (len(train), sum(train.values()))
    got = {r["row"]: (r["known"], round(r["logs"], 4)) for r in rare.collect()}
    for row, i in encoded.select("row", "doc_id").collect():
        odd = [w for w in words_of(rows[i][1])[:-1] if w not in ("x0", "x1")]
        assert got[row] == (len(odd), round(sum(math.log10(train[w] + 0.5) for w in odd), 4))


def test_language_model_beats_single_words_on_held_out_documents(spark):
    rows = queries.op4_hmm_lm(spark, "/root/testdata/sf0.01").filter("held_out").toPandas()
    assert rows["score"].sum() > rows["base_score"].sum()


# --- toxicity ----------------------------------------------------------------------------------


def test_machine_scores_pairs_of_terms():
    rng = np.random.default_rng(2)
    machine = toxicity.Machine(np.arange(5), -0.3, rng.normal(size=5), rng.normal(size=(5, 3)))
    lists = [[0, 1, 1, 4], [], [2, 3]]
    got = machine.score(*toxicity._triples(lists), 3)
    for places, score in zip(lists, got):
        x = np.bincount(places, minlength=5)
        total = -0.3 + x @ machine.linear
        for i in range(5):
            for j in range(i):
                total += machine.factors[i] @ machine.factors[j] * x[i] * x[j]
        assert score == pytest.approx(1 / (1 + math.exp(-total)))


def test_machine_learns_what_a_sum_of_weights_cannot(spark):
    """Toxic is an insult together with a group; each alone is clean."""
    rng = random.Random(3)
    rows = []
    for i in range(800):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randint(3, 12))] + ["blockhead"] * insult + ["gnomes"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group)))
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.fit(data.select("doc_id", "text"), data.select("doc_id", "toxic").filter("doc_id < 600"), rounds=300, shrink=0.01)
    got = toxicity.score(data, machine).filter("doc_id >= 600").select("toxic", (F.col("score") >= 0.5).cast("int")).collect()
    assert sum(a == b for a, b in got) >= 0.97 * len(got)


def test_production_machine_uses_pairs(spark):
    """Toxic is exactly both or neither of two words, which no sum of weights separates; the defaults find it."""
    rng = random.Random(5)
    rows = []
    for i in range(1600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randint(3, 6))] + ["blockhead"] * a + ["gnomes"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(a == b)))
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.fit(data.select("doc_id", "text"), data.select("doc_id", "toxic").filter("doc_id < 1200"))
    got = toxicity.score(data, machine).filter("doc_id >= 1200").select("toxic", (F.col("score") >= 0.5).cast("int")).collect()
    assert np.any(machine.factors) and sum(x == y for x, y in got) >= 0.9 * len(got)


def test_production_machine_keeps_factors_on_labelled_documents(spark):
    folder = "/root/testdata/sf0.1"
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    assert np.any(queries.machine(read("documents"), read("labels")).factors)


def test_toxicity_edge_rows(spark):
    docs = spark.createDataFrame(
        [(1, "bad bad word", "s"), (2, None, "s"), (3, "", None), (None, "bad", "s"), (1, "repeated id", "s"), (4, "bad " * 50_000, "s")],
        "doc_id long, text string, score string",
    )
    labels = spark.createDataFrame([(1, 1, "a"), (2, None, "b"), (None, 1, "c"), (3, 0, "d"), (9, 0, "e")], "doc_id long, toxic int, text string")
    for marks in (labels, labels.limit(0), labels.filter("toxic = 1")):
        got = toxicity.score(docs, toxicity.fit(docs, marks, min_rows=1), out="toxicity")
        assert got.columns == ["doc_id", "text", "score", "toxicity"] and got.count() == 6
        assert all(0 <= r["toxicity"] <= 1 for r in got.collect())
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    marks = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    got = queries.op10_toxicity(spark, folder).filter("held_out").join(marks, "doc_id").toPandas()
    toxic, said = got["toxic"] == 1, got["predicted"] == 1
    assert (said & toxic).sum() >= 0.8 * toxic.sum()
    assert (said & ~toxic).sum() <= 0.01 * (~toxic).sum()


# --- URLs --------------------------------------------------------------------------------------

URLS = [
    ("http://WWW.Example.com/en/1?x=/en/", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("https://m.www.example.com/en/", "m.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://a.example.com/en/x#t", "a.example.com", "/en/x", "example.com/en/", "block"),
    ("https://notexample.com/en/x", "notexample.com", "/en/x", "com/", "allow"),
    ("ftp://b.net/es/", "b.net", "/es/", "net/es/", "block"),
    ("ftp://b.net/fr/a://c.com/", "b.net", "/fr/a://c.com/", "net/fr/", "block"),
    ("https://x.com", "x.com", "", None, None), ("https://x.com?a/b", "x.com", "", None, None),
    ("https://b.net/es", "b.net", "/es", None, None), ("https://ÉCOLE.org/É", "École.org".replace("É", "É").replace("cole", "cole"), "/É", None, None),
    ("no scheme.com/en/", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("://", "", "", None, None),
    ("https://org/" + "a" * 30_000, "org", "/" + "a" * 30_000, None, None), ("http://c.com/a\nb", "c.com", "/a\nb", "com/", "allow"),
]


def test_rules(spark):
    pages = spark.createDataFrame([(k, u[0], "x", "y") for k, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: r[1:] for r in url_filter.judge(pages, queries.RULES, "allow").collect()}
    for k, (_, host, path, rule, verdict) in enumerate(URLS):
        assert got[k] == (host, path, rule, verdict or "allow")
    assert url_filter.judge(pages.limit(0), queries.RULES, "block").collect() == []


def test_ngrams(spark):
    row = spark.range(1).select(url_filter.ngrams(F.lit("ab"), F.lit("/é"), (2, 4)).alias("g")).first()
    assert row["g"] == ["h^a", "hab", "hb$", "h^ab$", "p/é"]


def test_regression_learns_urls(spark):
    rng = random.Random(1)
    rows = []
    for k in range(600):
        bad = k % 2 == 0
        host = ("pills" if bad else "news") + f"{rng.randrange(10**6)}.example.org"
        rows.append((k, f"https://{host}/{rng.randrange(10**6)}", bad))
    data = spark.createDataFrame(rows, "page_id long, url string, blocked boolean")
    model = url_filter.fit(data.filter("page_id < 400"))
    got = url_filter.judge(data.filter("page_id >= 400"), [], model, keep=("page_id", "blocked")).collect()
    assert sum((r["verdict"] == "block") == r["blocked"] for r in got) >= 0.99 * len(got)
    assert url_filter.fit(data.limit(0)) == "allow"
    assert url_filter.fit(data.filter("blocked")) == "block"
    assert url_filter.fit(data.withColumn("blocked", F.lit(None).cast("boolean"))) == "allow"


# --- licences ----------------------------------------------------------------------------------

MIT = "Released under the MIT License."
GPL = "This work is licensed under the GNU General Public License, version 3."


def test_license_scan(spark):
    rows = [
        ("a/LICENSE", MIT), ("a/b/c/x.py", "import y"), ("a/b/COPYING.txt", "Preface\n" + GPL), ("a/z.py", f"# {GPL}\ncode"),
        ("abc/x.py", "none"), ("LICENSE-0", None), ("x.py", "none"), (None, MIT), (None, None), ("a/b/c/x.py", "import y"),
        ("d/LICENSE", "no notice"), ("d/e/f.c", "text"), ("/abs/LICENSE.md", MIT), ("/abs/q/r.c", ""), ("a/licenses.py", "v"),
        ("a//b/y.c", "t"), ("big/x.c", "word " * 60_000 + "\n" + MIT),
    ]
    files = spark.createDataFrame([(k, p, t, "c", "d") for k, (p, t) in enumerate(rows)], "doc_id long, path string, text string, license string, directory string")
    got = {r["doc_id"]: r[2:] for r in licenses.scan(files, queries.NOTICES).collect()}
    own = {k: v[0] for k, v in got.items()}
    assert own == {k: {0: "MIT", 2: "GPL-3.0", 3: "GPL-3.0", 7: "MIT", 12: "MIT", 16: "MIT"}.get(k) for k in range(len(rows))}
    inherited = {k: v[2:] for k, v in got.items() if v[3]}
    assert inherited == {
        1: ("GPL-3.0", "a/b/COPYING.txt"), 9: ("GPL-3.0", "a/b/COPYING.txt"), 13: ("MIT", "/abs/LICENSE.md"), 14: ("MIT", "a/LICENSE"), 15: ("MIT", "a/LICENSE"),
    }
    assert all(v[2] is None for k, v in got.items() if own[k] is None and k not in inherited)
    assert licenses.scan(files.limit(0), queries.NOTICES).collect() == []


def test_license_file_at_the_root_covers_all(spark):
    files = spark.createDataFrame([(1, "LICENSE", MIT), (2, "x/y.c", "t"), (3, "z.c", "t")], "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["license"], r["inherited_from"]) for r in licenses.scan(files, queries.NOTICES).collect()}
    assert got == {1: ("MIT", None), 2: ("MIT", "LICENSE"), 3: ("MIT", "LICENSE")}


def plain_cosine(passage, template, bodies):
    """By document frequencies of all words."""
    tokens = lambda text: re.findall("[a-z0-9]+", text.translate(LOWER))
    sets = [set(tokens(b)) for b in bodies]
    idf = lambda w: math.log((len(sets) + 1) / (sum(w in s for s in sets) + 1)) + 1
    a, b = ({w: n * idf(w) for w, n in Counter(tokens(t)).items()} for t in (passage, template))
    return sum(v * b.get(w, 0) for w, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))


def test_license_notice_among_ordinary_words(spark):
    """Words in every file weigh little, so a notice beside them is found; rare ones weigh much."""
    filler = "this file is see below for terms"
    notice, odd = "Released, see this file, under, is below, the MIT, for terms this, License, see.", "Released zyx wvu under tsr qpo the nml kji MIT hgf edc License"
    bodies = [f"{filler} a{k}\nb{k}" for k in range(300)] + [f"{filler}\n{notice}", f"{filler}\n{odd}", f"{filler}\n{MIT}"]
    files = spark.createDataFrame([(k, f"d{k}/x.c", b) for k, b in enumerate(bodies)], "doc_id long, path string, text string").repartition(3)
    got = {r["doc_id"]: (r["own_license"], r["similarity"]) for r in licenses.scan(files, queries.NOTICES).collect() if r["own_license"]}
    want = plain_cosine(notice, MIT, bodies)
    assert want >= 0.6 and got[300] == ("MIT", pytest.approx(want, abs=2e-6)) and got[302] == ("MIT", 1.0)
    assert plain_cosine(odd, MIT, bodies) < 0.6 and set(got) == {300, 302}


def test_wrapped_headers_and_full_license_files(spark):
    """Notices over comment lines or inside a paragraph, and whole licence texts, as the registered query finds them."""
    rng = random.Random(6)
    prose = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    full = {name: max((t for n, t in licenses.texts() if n == name), key=len) for name, _ in licenses.texts()}
    apache = min((t for n, t in licenses.texts() if n == "Apache-2.0"), key=len)
    wrapped = "/* This work is licensed\n * under the GNU General\n * Public License,\n * version 3.\n */\n" + prose(80)
    rows = [(f"{name}/LICENSE", f"Copyright (c) 2020 Some Body\n\n{text}", name) for name, text in sorted(full.items())]
    rows += [(f"{name}/src/x.c", prose(30), None) for name in sorted(full)]
    rows += [
        ("y/wrapped.c", wrapped, "GPL-3.0"), ("y/paragraph.txt", f"{prose(60)} {MIT} {prose(60)}", "MIT"),
        ("y/header.py", "".join(f"# {line}\n" for line in apache.split("\n")) + prose(400), "Apache-2.0"),
        ("y/long.c", "".join(f"// {line}\n" for line in full["MIT"].split("\n")) + prose(3000), "MIT"),
        ("y/short.c", "\n".join(prose(5) for _ in range(9)), None),
    ]
    files = spark.createDataFrame([(k, p, t) for k, (p, t, _) in enumerate(rows)], "doc_id long, path string, text string").repartition(3)
    got = {r["path"]: (r["own_license"], r["license"]) for r in licenses.scan(files, [*queries.NOTICES, *licenses.texts()]).collect()}
    assert {p: own for p, (own, _) in got.items()} == {p: own for p, _, own in rows}
    assert all(got[f"{name}/src/x.c"][1] == name for name in full)
