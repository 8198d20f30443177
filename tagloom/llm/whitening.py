"""Whitening of integer vectors by the covariance of their distinct values, weighted by multiplicity.

Equal vectors are grouped first. Sums and centred products run over the distinct vectors with their counts
(or one each) as weights: every task multiplies its own block of vectors, and only one value per cell of
the matrix and task is shuffled. Each distinct vector is whitened once, and the answers join the rows again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import join_by_weight, portable, stored

#: Eigenvalues up to this share of their sum are rounding errors of a direction without variance.
NOTHING = 1e-12


@dataclass
class Whitening:
    """``n``: weight of the fit list; ``sums``: per dimension, exact; ``values``, ``vectors``: of the kept components, by falling
    eigenvalue; ``trace``: sum of all eigenvalues; ``error``: largest entry of the whitened covariance minus the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float

    @property
    def explained(self) -> list[float]:
        """Each component's share of the trace; 0 where nothing varies."""
        return [float(v) / self.trace if self.trace > 0 else 0.0 for v in self.values]

    def offsets(self, x: np.ndarray) -> tuple[np.ndarray, list[int], list[float]]:
        """``x`` without the whole part of the mean, and what the mean has besides: exact (times ``n``) and as a fraction."""
        whole = [s // self.n for s in self.sums]
        rest = [s - w * self.n for s, w in zip(self.sums, whole)]
        return x - np.array(whole, np.int64), rest, [r / self.n for r in rest]

    def centred(self, x: np.ndarray) -> np.ndarray:
        delta, _, fraction = self.offsets(x)
        return delta.astype(float) - np.array(fraction)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over the dimensions of ``(n * x - S) ** 2``, exact at any size."""
        delta, rest, _ = self.offsets(x)
        most = self.n * (int(np.abs(delta).max(initial=0)) + 1)
        if most * most * max(1, x.shape[1]) < 1 << 63:
            return ((delta * self.n - np.array(rest, np.int64)) ** 2).sum(axis=1)
        return ((delta.astype(object) * self.n - np.array(rest, object)) ** 2).sum(axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _digest(x: str) -> list[Column]:
    """Two numbers that name a vector, unless two vectors share both."""
    return [F.xxhash64(x), F.xxhash64(F.lit(1), x)]


def _summed(rows: DataFrame, column: str, kind: str, cells: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list:
    """Cells of vectors and weights, added up within tasks and then by cell."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = cells(_matrix(batch.column(column)), batch.column("weight").to_numpy())
                total = part if total is None else total + part
        if total is not None:
            parts = pa.array(total.tolist(), pa.float64() if kind == "double" else pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), parts], names=["cell", "part"])

    found = rows.select(column, "weight").mapInArrow(add, f"cell int, part {kind}").groupBy("cell").agg(F.sum("part").alias("part"))
    return [r["part"] for r in sorted(found.collect(), key=lambda r: r["cell"])]


def _exact(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    if int(np.abs(x).max(initial=0)) * int(weight.sum()) < 1 << 62:
        return (x * weight[:, None]).sum(axis=0).astype(object)
    return (x.astype(object) * weight[:, None]).sum(axis=0)


def _products(vectors: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The upper triangle of the weighted products of centred vectors."""
    return ((vectors * weight[:, None]).T @ vectors)[np.triu_indices(vectors.shape[1])]


def _square(cells: list, d: int) -> np.ndarray:
    out = np.zeros((d, d))
    out[np.triu_indices(d)] = cells
    return out + np.triu(out, 1).T


def whiten(
    rows: DataFrame, vector: str = "x", components: int = 32, weights: str = "count", keep: list[str] | None = None
) -> tuple[DataFrame, Whitening | None]:
    """The columns ``keep`` (default: all but the vector), ``copies``, ``deviation`` and ``whitened`` of each row; the fit.

    ``vector`` holds longs. Rows whose vector is null, empty, holds a null, or is not of the commonest
    length (of ties the greatest) are dropped. The fit list holds each distinct vector with the weight of its copies, or
    with one each where ``weights`` is ``"one"``. ``copies`` is how many rows have the vector; ``deviation`` the exact
    sum of ``(n * x - S) ** 2``; ``whitened`` has an entry for each of at most ``components`` components:
    the centred vector along the unit eigenvector over the root of the eigenvalue, null where the
    component has no variance. Signs are such that the largest entry of an eigenvector is positive.

    Repeated rows stay repeated. Input columns named like the new ones give way to them. Without a
    usable row the result is empty and the fit None. The matrix and its eigenvectors stand on the driver:
    they need 8 bytes a pair of dimensions, whatever the number of rows.
    """
    if weights not in ("count", "one"):
        raise ValueError(f"weights must be 'count' or 'one', not {weights!r}")
    new = ("copies", "deviation", "whitened")
    keep = [c for c in (rows.columns if keep is None else keep) if c not in new and c != vector]
    named = [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)]
    usable = rows.select(*named, F.col(f"`{vector}`").cast("array<bigint>").alias("x"))
    usable = usable.filter(F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull()))
    common = usable.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    back = [F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)]
    if common is None:
        empty = usable.select(*back, *(F.lit(None).cast(t).alias(c) for c, t in zip(new, ("bigint", "decimal(38,0)", "array<double>"))))
        return empty, None
    d = common["d"]
    usable = usable.filter(F.size("x") == d)
    distinct = usable.groupBy("x").agg(F.count("*").alias("copies"))
    weight = F.col("copies") if weights == "count" else F.lit(1).cast("bigint")
    distinct = stored(distinct.select("x", "copies", weight.alias("weight")), "distinct-vectors")

    n = distinct.agg(F.sum("weight").alias("n")).first()["n"]
    sums = [int(s) for s in _summed(distinct, "x", "decimal(38,0)", _exact)]
    fit = Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0, 0.0)
    cells = _summed(distinct, "x", "double", lambda x, w: _products(fit.centred(x), w))
    values, vectors = np.linalg.eigh(_square(cells, d) / n)
    order = np.argsort(-values, kind="stable")[:components]
    fit.trace = float(np.maximum(values, 0).sum())
    fit.values, vectors = np.maximum(values[order], 0), vectors[:, order]
    fit.vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    varies = fit.values > NOTHING * fit.trace
    scale = fit.vectors[:, varies] / np.sqrt(fit.values[varies])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            deviation = pa.array(fit.deviation(x).tolist(), pa.decimal128(38, 0))
            flat = pa.array((fit.centred(x) @ scale).ravel())
            edges = pa.array(np.arange(len(x) + 1, dtype=np.int32) * scale.shape[1])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("x", "copies", "weight")), deviation, pa.ListArray.from_arrays(edges, flat)],
                names=["x", "copies", "weight", "deviation", "whitened"],
            )

    schema = "x array<bigint>, copies bigint, weight bigint, deviation decimal(38,0), whitened array<double>"
    first, second = _digest("x")
    answers = distinct.mapInArrow(apply, schema).withColumns({"h1": first, "h2": second})
    answers = stored(answers, "whitened-vectors")
    if scale.shape[1]:
        mean = np.array(_summed(answers, "whitened", "double", lambda y, w: w @ y)) / n
        cells = _summed(answers, "whitened", "double", lambda y, w: _products(y - mean, w))
        fit.error = float(np.abs(_square(cells, scale.shape[1]) / n - np.eye(scale.shape[1])).max())

    shared = answers.groupBy("h1", "h2").count().filter("count > 1").isEmpty()
    on = ["h1", "h2"] if shared else ["x"]
    usable = usable.withColumns({"h1": first, "h2": second}).select(*(f"__k{i}" for i in range(len(keep))), *on)
    joined = join_by_weight(usable, answers.select(*on, *new), on, "copies", common["count"], how="inner")
    if not varies.all():  # the last components only: eigenvalues fall
        nothing = F.array_repeat(F.lit(None).cast("double"), int((~varies).sum()))
        joined = joined.withColumn("whitened", F.concat("whitened", nothing))
    return joined.select(*back, *new), fit


portable(__name__)
