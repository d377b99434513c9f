"""Whitening of embeddings by an exact integer scatter matrix.

A component x is the whole number floor(scale * x). The fit list is each distinct vector
once. Its sums S and cross-products are gathered without rounding: each task subtracts
a shift (one of the vectors, so that the numbers stay small), multiplies in doubles
while every sum is under 2^53 and in Python's integers beyond, and gives its totals in
limbs of 32 bits, which Spark adds up as longs. So the totals are exact at any size, and
a matrix of one number for each pair of dimensions is all that the driver gets. It forms
n * X'X - S S' in whole numbers, which is n^2 times the covariance; only then this is
turned into doubles, each rounded once, and decomposed by eigh.

``deviation`` is the exact sum over the dimensions of (n * x - S)^2; where it does not fit
a long it is null, and ``deviation_exact``, a decimal of 38 digits, has it (null beyond
these too).

Rows whose vector is null or holds a null or a component that is not finite are left
out. Shorter vectors count as filled up with zeros. Repeated rows get a result each and count
once in the fit. A component whose eigenvalue is not over rounding (1e-12 of the
greatest), as in lists of few vectors, has no whitened value (null) and explains 0.0; the
identity error is of the others, null if there are none. Equal eigenvalues may give any
basis of their plane. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import written
from spanweave.llm.vectors import matrix, whole_vectors

#: Totals have so many limbs of 32 bits, the last one signed: enough for squares of longs, 2^32 rows and 2^31 tasks.
LIMBS = 6
ROWS = 4096


def products(y: np.ndarray) -> np.ndarray:
    """y'y without rounding, as Python's integers."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), ROWS):
        some = y[at : at + ROWS]
        most = max(abs(int(some.max())), abs(int(some.min())))
        if most * most * len(some) < 1 << 53:
            some = some.astype(np.float64)
            total += (some.T @ some).astype(np.int64).astype(object)
        else:
            some = some.astype(object)
            total += some.T @ some
    return total


def _limbs(values: list[int]) -> list[int]:
    """Each whole number's limbs, the lowest first, one number after the other."""
    return [v >> 32 * i & 0xFFFFFFFF if i < LIMBS - 1 else v >> 32 * i for v in values for i in range(LIMBS)]


def _most(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def _totals(shift: list[int]):
    """Rows (x) to the limbs of a task's products of (1, x - shift) with itself, a row for each line from the diagonal on.

    So line 0 has the number of rows and the sums.
    """
    d = len(shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1), object)
        for b in batches:
            x = matrix(b.column("x"), d)
            kind = np.int64 if max(_most(x), *map(abs, shift), 0) < 1 << 61 else object
            total += products(np.column_stack((np.ones(len(x), kind), x.astype(kind) - np.array(shift, kind))))
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array([_limbs(total[i, i:].tolist()) for i in range(d + 1)], pa.list_(pa.int64()))], ["i", "limbs"])

    return run


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors of sums S; covariance V; its eigenvalues, the greatest first, and their unit vectors in columns."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    def live(self, k: int) -> list[bool]:
        """Whether each of the first k components has any variance."""
        return [bool(e > 0 and e > 1e-12 * self.values[0]) for e in self.values[:k]]

    def whitened(self, x: np.ndarray, k: int) -> np.ndarray:
        """x's first k components; NaN where there is no variance."""
        centred = x.astype(np.float64) - np.array([s / self.n for s in self.sums])
        scale = [1 / np.sqrt(e) if ok else np.nan for e, ok in zip(self.values, self.live(k))]
        return centred @ self.vectors[:, : len(scale)] * np.array(scale)

    def explained(self, k: int) -> list[float]:
        """Share of the trace, 0 for components without variance."""
        trace = float(np.trace(self.covariance))
        return [float(e) / trace if ok else 0.0 for e, ok in zip(self.values, self.live(k))]

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sum of (n * x - S)^2 of each row, as n^2 * sum(x^2) - 2 * n * sum(x * S) + sum(S^2)."""
        kind = np.int64 if _most(x) ** 2 * max(1, x.shape[1]) < 1 << 62 else object
        x, n, limbs = x.astype(kind), self.n, max((s.bit_length() for s in self.sums), default=0) // 24 + 1
        with_sums = np.zeros(len(x), object)
        for i in range(limbs):  # 24 bits of the sums at a time keep the products in longs
            part = np.array([s >> 24 * i & 0xFFFFFF if i < limbs - 1 else s >> 24 * i for s in self.sums], kind)
            with_sums += (x @ part).astype(object) * (1 << 24 * i)
        return (n * n * (x * x).sum(1).astype(object) - 2 * n * with_sums + sum(s * s for s in self.sums)).tolist()


def fitted(vectors: DataFrame, dim: int) -> Whitening | None:
    """Of the distinct vectors(x); None if there are none."""
    one = vectors.first()
    if one is None:
        return None
    shift = one["x"]
    totals = vectors.select("x").mapInArrow(_totals(shift), "i int, limbs array<long>")
    cells = totals.select("i", F.posexplode("limbs").alias("at", "v")).groupBy("i", "at").agg(F.sum("v").alias("v"))
    found: dict[tuple[int, int], int] = {}
    for r in cells.collect():  # the limbs of one number for each pair of dimensions
        key = (r["i"], r["at"] // LIMBS)
        found[key] = found.get(key, 0) + (r["v"] << 32 * (r["at"] % LIMBS))
    n, y = found[0, 0], [found[0, 1 + i] for i in range(dim)]
    # x - shift and x have the same n * X'X - S S'
    scatter = [[n * found[1 + min(i, j), abs(i - j)] - y[i] * y[j] for j in range(dim)] for i in range(dim)]
    covariance = np.array([[v / (n * n) for v in row] for row in scatter], np.float64).reshape(dim, dim)
    values, axes = np.linalg.eigh(covariance)
    return Whitening(n, [a + n * s for a, s in zip(y, shift)], covariance, values[::-1], axes[:, ::-1])


def identity_error(vectors: DataFrame, model: Whitening, dim: int, components: int) -> float | None:
    """Greatest absolute entry of the whitened vectors' covariance less the identity, over the components that have variance."""
    live = [i for i, ok in enumerate(model.live(components)) if ok]
    names = [f"c{i}" for i in live]
    if not names:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = model.whitened(matrix(b.column("x"), dim), components)
            yield pa.RecordBatch.from_arrays([pa.array(w[:, i]) for i in live], names)

    own = vectors.select("x").mapInArrow(run, ", ".join(f"{c} double" for c in names))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    got = own.agg(*[F.covar_pop(a, b).alias(f"v{k}") for k, (a, b) in enumerate(pairs)]).first()
    return max(abs(v - (a == b)) for v, (a, b) in zip(got, pairs))


_RESULT = "component int, n long, deviation long, deviation_exact decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, components: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, deviation_exact, whitened, explained, identity_error): a row for each vector and component."""
    rows, dim = whole_vectors(vectors, scale, vec_col, vec_id=id_col)
    fit = written(rows.select("x").distinct(), "fit")
    model = fitted(fit, dim)
    kind = rows.schema["vec_id"].dataType.simpleString()
    if model is None:
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, {_RESULT}")
    error = identity_error(fit, model, dim, components)
    k = min(components, dim)
    explained = model.explained(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            x = matrix(b.column("x"), dim)
            far = model.deviations(x)
            fits = pa.array([v if v < 1 << 63 else None for v in far], pa.int64())
            exact = pa.array([Decimal(v) if v < 10**38 else None for v in far], pa.decimal128(38, 0))
            w = model.whitened(x, k)
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), fits.take(pa.array(each)), exact.take(pa.array(each)),
                    pa.array(w.reshape(-1), from_pandas=True), pa.array(np.tile(np.array(explained, np.float64), m)), pa.array([error] * (m * k), pa.float64()),
                ],
                ["vec_id", *[f.strip().split(" ")[0] for f in _RESULT.replace("(38,0)", "").split(",")]],
            )

    return rows.mapInArrow(run, f"vec_id {kind}, {_RESULT}")
