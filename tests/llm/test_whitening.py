"""Whitening against a plain version."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import queries, whitening


def plain(vectors, weights=None):
    """Mean, eigenvalues, eigenvectors and exact deviations of integer vectors."""
    weights = weights or [1] * len(vectors)
    n, d = sum(weights), len(vectors[0])
    sums = [sum(w * v[i] for v, w in zip(vectors, weights)) for i in range(d)]
    centred = np.array([[float(Fraction(n * v[i] - sums[i], n)) for i in range(d)] for v in vectors])
    values, axes = np.linalg.eigh((centred * np.array(weights)[:, None]).T @ centred / n)
    deviation = [sum((n * v[i] - sums[i]) ** 2 for i in range(d)) for v in vectors]
    return n, centred, values[::-1], axes[:, ::-1], deviation


def check(rows, fit, vectors, weights=None, components=32):
    """``rows``: vector and whitened, deviation by vector."""
    n, centred, values, axes, deviation = plain(vectors, weights)
    k = min(components, len(values))
    assert fit.n == n and np.allclose(fit.values, values[:k]) and math.isclose(fit.trace, values.sum())
    assert fit.error < 1e-9 and np.allclose(np.abs((fit.vectors * axes[:, :k]).sum(axis=0)), 1, atol=1e-9)
    for v, c, dev in zip(vectors, centred, deviation):
        for whitened, got in rows[tuple(v)]:
            assert got == dev and np.allclose(np.abs(whitened), np.abs(c @ axes[:, :k] / np.sqrt(values[:k])), atol=1e-7)


def gathered(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(tuple(r["v"]), []).append((r["whitened"], int(r["deviation"])))
    return out


def cases(rng, copies=40):
    vectors = (rng.normal(0, 30, (60, 6)) * np.arange(1, 7) + 1_000_000).astype(int).tolist()
    return vectors + [vectors[0]] * copies


@pytest.mark.parametrize("shared", [False, True])
def test_weights_copies_and_shared_digests(spark, monkeypatch, shared):
    if shared:
        monkeypatch.setattr(whitening, "_digest", lambda x: [F.lit(1).cast("long"), F.lit(2).cast("long")])
    vectors = cases(np.random.default_rng(1))
    rows = spark.createDataFrame([(v, v, k, 1, 2) for k, v in enumerate(vectors)], "x array<long>, v array<long>, copies int, h1 int, weight int")
    out, fit = whitening.whiten(rows.repartition(5))
    assert out.columns == ["v", "h1", "weight", "copies", "deviation", "whitened"] and out.count() == len(vectors)
    check(gathered(out), fit, vectors)
    assert {r["copies"] for r in out.filter(F.col("v") == F.lit(vectors[0])).collect()} == {41}
    out, fit = whitening.whiten(rows, weights="one", components=3)
    distinct = [list(v) for v in Counter(map(tuple, vectors))]
    check(gathered(out), fit, distinct, components=3)


def test_large_numbers_are_exact(spark):
    vectors = [[(k * 7919) % 1000 - (1 << 60), k * k] for k in range(50)]
    out, fit = whitening.whiten(spark.createDataFrame([(v, v) for v in vectors], "x array<long>, v array<long>"))
    check(gathered(out), fit, vectors)
    wide = [[-(1 << 61), 5], [1 << 61, 7], [3, 9]]
    out, fit = whitening.whiten(spark.createDataFrame([(v, v) for v in wide], "x array<long>, v array<long>"))
    n, _, _, _, deviation = plain(wide)
    assert {k: v[0][1] for k, v in gathered(out).items()} == {tuple(v): d for v, d in zip(wide, deviation)}


def test_rows_without_a_usable_vector_and_directions_without_variance(spark):
    rows = [([1, 2, 5], 1), ([3, 4, 5], 2), ([9, 1, 5], 3), (None, 4), ([], 5), ([1, None, 2], 6), ([1, 2], 7), ([1, 2, 5], 1)]
    out, fit = whitening.whiten(spark.createDataFrame(rows, "x array<long>, id int"))
    assert sorted(r["id"] for r in out.collect()) == [1, 1, 2, 3]
    assert all(len(r["whitened"]) == 3 and r["whitened"][2] is None and None not in r["whitened"][:2] for r in out.collect())
    assert fit.explained[2] == pytest.approx(0, abs=1e-12) and fit.error < 1e-9
    one, fit = whitening.whiten(spark.createDataFrame([([4, 4], 1), ([4, 4], 2)], "x array<long>, id int"))
    assert [r["whitened"] for r in one.collect()] == [[None, None]] * 2 and fit.explained == [0.0, 0.0]
    for nothing in (spark.createDataFrame([], "x array<long>, id int"), spark.createDataFrame([(None, 1)], "x array<long>, id int")):
        out, fit = whitening.whiten(nothing)
        assert out.collect() == [] and fit is None and out.columns == ["id", "copies", "deviation", "whitened"]
    with pytest.raises(ValueError):
        whitening.whiten(one, weights="two")


def test_registered_query(spark, sf_dir, tmp_path):
    query = queries.QUERIES["op12_embedding_whitening"]
    source = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    odd = [(7, None), (None, list(source[0]["embedding"])), (8, [float("nan")] * 64), (9, [float("inf")] * 64), (10, [3e38] * 64)]
    odd += [(11, [None] + list(source[1]["embedding"])[1:]), (12, []), (13, [0.5]), (14, list(source[0]["embedding"]))]
    rows = [tuple(r) for r in source] + odd
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    usable = [(k, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for k, v in rows if v and len(v) == 64 and None not in v and max(map(abs, v)) < 1e30]
    n, centred, values, axes, deviation = plain([v for _, v in usable])
    want = {}
    for (k, _), c, dev in zip(usable, centred, deviation):
        want.setdefault(k, []).append((np.abs(c @ axes[:, :32] / np.sqrt(values[:32])), dev))
    got = query(spark, str(tmp_path)).collect()
    assert len(got) == 32 * len(usable) and {r["n"] for r in got} == {n} and all(r["identity_error"] < 1e-9 for r in got)
    for r in got:
        assert any(abs(abs(r["whitened"]) - w[r["component"] - 1]) < 1e-6 and r["deviation"] == dev for w, dev in want[r["vec_id"]])
        assert math.isclose(r["explained"], values[r["component"] - 1] / values.sum(), rel_tol=1e-9)
    empty = tmp_path / "empty"
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{empty}/embeddings.parquet")
    assert query(spark, str(empty)).collect() == [] and query(spark, str(empty)).schema == query(spark, str(tmp_path)).schema
