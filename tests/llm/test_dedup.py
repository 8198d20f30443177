"""Line dedup, exact dedup and the n-gram join against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tagloom.llm import components, exact_dedup, line_dedup, ngram_join

BLANKS = " \t\n\x0b\f\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def frame(spark, rows, parts=4):
    schema = "doc_id long, text string, kept string, n string, component string, gone int, print string"
    return spark.createDataFrame([(i, t, "x", None, "y", 1, "z") for i, t in rows], schema).repartition(parts)


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


# --- lines -------------------------------------------------------------------------------------


def plain_lines(rows, least):
    def key(line):
        return line.strip(BLANKS).translate(LOWER)

    seen = Counter(k for _, t in rows for k in {key(line) for line in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [line for line in lines if not (key(line) and seen[key(line)] >= least)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def test_line_dedup(spark):
    rng = random.Random(5)
    pool = ["Common line", " common LINE\t", "École ", "école", "ÉCOLE", "", " ", "only\rhere", "x" * 3000, "nul\x00", "end\x0b"]
    rows = [(i, "\n".join(rng.choice(pool + [f"own {i} {k}"]) for k in range(rng.randint(0, 8)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n"), (None, "Common line\nmine"), (None, "École\nmine"), (103, "a\nA\n a "), (103, "a\nA\n a ")]
    for least in (2, 5, 10, 1):
        same(line_dedup.dedup_lines(frame(spark, rows), least=least).collect(), plain_lines(rows, least))
    same(line_dedup.dedup_lines(frame(spark, [])).collect(), [])


def test_line_dedup_runs_no_python(spark, sf_dir):
    from tagloom.llm import queries

    for name in ("op6_line_dedup", "op3_url_filter"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "ExistingRDD"))


# --- exact -------------------------------------------------------------------------------------


def plain_copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in t or "" if c not in BLANKS)].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        body = "".join(c for c in t or "" if c not in BLANKS)
        keep = min(groups[body])[3]
        out.append((i, keep, len(groups[body]), i == keep, hashlib.sha256(body.encode()).hexdigest()))
    return out


def test_exact_dedup(spark):
    rng = random.Random(6)
    bodies = ["one text", "one  text", "onetext ", "o netext", "été", "été", "", " \n", "z" * 70_000, "Q"]
    rows = [(i, rng.choice(bodies) if i % 3 else f"single {i}") for i in range(200)]
    rows += [(500 + i, "hot copy") for i in range(300)]  # over half of all rows
    rows += [(900, None), (None, "one text"), (None, "null id only"), (901, "again"), (901, "again"), (-5, "negative  "), (7, "negative  ")]
    same(exact_dedup.dedup(frame(spark, rows)).drop("origin").collect(), plain_copies(rows))
    same(exact_dedup.dedup(frame(spark, [])).collect(), [])


@pytest.mark.parametrize("bits", [0, 3])
def test_filters_merge_without_loss(spark, bits):
    rng = np.random.default_rng(7)
    prints = rng.integers(-(2**63), 2**63 - 1, 3000).tolist()
    prints += prints[:500] + prints[:100] + [-1, -1, 0, 0, 2**63 - 1, -(2**63), -(2**63)]
    df = spark.createDataFrame([(p,) for p in prints], "print long").repartition(5)
    for most in (1 << 22, 50):
        merged = exact_dedup.merge_filters(exact_dedup.build_filters(df, bits, most=most), bits, least=1).collect()
        assert {r["print"]: r["copies"] for r in merged} == Counter(prints)


# --- near --------------------------------------------------------------------------------------


def plain_components(rows, percent=85):
    def shingles(text):
        plain = "".join(" " if c in BLANKS else c for c in (text or "").translate(LOWER))
        words = [w for w in plain.split(" ") if w]
        if not words:
            return frozenset()
        size = min(4, len(words))
        return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))

    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and (rows[a][0] == rows[b][0] or 100 * both >= percent * len(sets[a] | sets[b])):
                up[top(a)] = top(b)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i)]
        out.append((doc, len(sets[i]), None if None in ids else min(ids)))
    return out


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def near_copies(rng):
    """Chains of edits, a crowd around one text, shared passages, short texts, and edge rows."""
    rows, n = [], 0
    passage = [f"p{k}" for k in range(40)]
    for size in (4, 5, 8, 20, 27, 60, 150, 400):
        text = [f"t{size}x{k}" for k in range(size)]
        for _ in range(12):  # each differs from the one before, so the ends of the chain differ much
            rows.append((n, " ".join(text)))
            n += 1
            text = edited(rng, text, max(1, size // 60))
    crowd = [f"c{k}" for k in range(100)]
    for _ in range(300):
        rows.append((n, " ".join(edited(rng, crowd, rng.randint(0, 3)))))
        n += 1
    for k in range(60):
        own = [f"o{k}x{j}" for j in range(rng.randint(0, 60))]
        rows.append((n, " ".join(own + passage)))
        n += 1
    rows += [(n + k, t) for k, t in enumerate(["", None, " \n", "one", "ONE", "one two three", "one  Two\tthree", "a b c d", "a b c d e", "É b c d", "é b c d"])]
    rng.shuffle(rows)
    return rows


def test_ngram_join(spark):
    rows = near_copies(random.Random(8))
    same(ngram_join.join(frame(spark, rows)).drop("origin").collect(), plain_components(rows))


def test_ngram_join_is_exact_without_its_helpers(spark, monkeypatch):
    """Few hash rounds, tiny groups and ranges, no frequent tokens: the matrix alone finds what is left."""
    monkeypatch.setattr(ngram_join, "MEMBERS", 4)
    rows = near_copies(random.Random(9))
    same(
        ngram_join.join(frame(spark, rows), rounds=1, max_common=0).drop("origin").collect(),
        plain_components(rows),
    )


def test_ngram_join_edge_rows(spark):
    body = " ".join(f"w{k}" for k in range(30))
    rows = [(5, body), (None, body + " x"), (3, body + " y"), (9, "far away text here now"), (9, body + " z"), (8, None), (8, "")]
    rows += [(20, "far away text here now"), (2, "quite alone in here"), (2, "quite alone in here")]
    same(ngram_join.join(frame(spark, rows)).drop("origin").collect(), plain_components(rows))
    rows = [(5, body), (7, "far away text here now"), (7, body + " z"), (4, "far away text here now")]
    same(ngram_join.join(frame(spark, rows)).drop("origin").collect(), plain_components(rows))
    same(ngram_join.join(frame(spark, [])).collect(), [])
    same(ngram_join.join(frame(spark, [(1, None), (2, "")])).drop("origin").collect(), [(1, 0, 1), (2, 0, 2)])


def test_components(spark):
    rng = random.Random(10)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000, k) for k in range(400, 600)] + [(5, 5)]
    edges += [(700 + k, 701 + k) for k in range(50)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {n: c for n, c in label.items() if n != c}


def passages(rng, n):
    """Texts of their own words that share passages of a common stock, and a few near copies."""
    stock = [" ".join(f"p{k}x{i}" for i in range(60)) for k in range(n // 20)]
    rows = []
    for k in range(n):
        parts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 160)))]
        parts += rng.sample(stock, 2)
        rng.shuffle(parts)
        rows.append((k, " ".join(parts)))
    return rows + [(n + k, rows[k][1] + " tail") for k in range(0, n, 50)]


def test_candidates_grow_in_proportion(spark, monkeypatch):
    """Shared passages alone make no candidates, at one size as at five times that."""
    found = []
    real = ngram_join._candidates

    def counted(*args):
        out = real(*args)
        found.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_candidates", counted)
    for n in (100, 500):
        rows = passages(random.Random(n), n)
        same(ngram_join.join(frame(spark, rows), rounds=0).drop("origin").collect(), plain_components(rows))
    assert found[0] <= 2 * 2 and found[1] <= 2 * 10


def test_a_crowd_of_near_copies_makes_few_candidates(spark, monkeypatch):
    """Near copies whose shared shingles are all frequent meet by minimum hashes, at one size as at five times that."""
    found = []
    real = ngram_join._candidates

    def counted(*args):
        out = real(*args)
        found.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_candidates", counted)
    body = [f"c{k}" for k in range(240)]
    for n in (60, 300):
        rng = random.Random(n)
        rows = [(k, " ".join(edited(rng, body, rng.randint(1, 3)))) for k in range(n)]
        same(ngram_join.join(frame(spark, rows)).drop("origin").collect(), plain_components(rows))
    assert found[0] <= 60 and found[1] <= 300
