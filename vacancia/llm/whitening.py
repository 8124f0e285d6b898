"""Operator 13: whitening of vectors from an exact integer scatter matrix.

Entries become integers x. Each task subtracts a shift and adds up sums and cross-products of its rows: a batch's product is formed in doubles,
64-bit or arbitrary-precision integers, whichever is surely exact, and added to arbitrary-precision totals. A task hands its totals on as limbs of
32 bits, which Spark adds as longs, so nothing is rounded and no order matters; d * (d + 3) / 2 + 1 totals reach the driver,
d the length of vectors. There n * X'X - SS' is formed exactly; only then it is divided by n * n, turned into doubles and decomposed by eigh.
A second pass projects n * x - S, again exact up to its last division.

Defined results: vectors that are null or empty, hold a null or non-finite entry, or one of a size over 2**62 after scaling, are left out; if
lengths differ, those of the commonest length (of equally common ones the smallest) are taken; repeated rows are vectors of their own and a
null vec_id is carried; directions without variance are no components, so a single vector or equal ones have none; no rows give no rows.
The order of components of equal eigenvalues is eigh's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import map_arrow

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
LIMB = 32
#: Bound of an entry's size after scaling.
MOST = 2.0**62


@dataclass
class Whitening:
    """What a fit yields: count and sums of the vectors, components as columns, their eigenvalues and shares of the trace, and the largest error of the whitened covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float


def integer_vectors(df: DataFrame, scale: int = SCALE, shift: int = SHIFT, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, x): floor(scale * entry) + shift of the vectors that are kept."""
    finite = F.forall("v", lambda c: c.isNotNull() & (F.abs(c * scale) <= MOST))  # NaN is larger than any number
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v")).where((F.size("v") > 0) & finite)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (lengths[0]["d"] if lengths else 0)).select("vec_id", F.transform("v", lambda c: F.floor(c * scale) + F.lit(shift)).alias("x"))


def product(rows: np.ndarray) -> np.ndarray:
    """rows' x rows of 64-bit integers, exactly: in doubles or 64-bit integers where these surely hold every sum, else in Python's integers."""
    most = max(abs(int(rows.min(initial=0))), abs(int(rows.max(initial=0))))
    bound = most * most * len(rows)
    kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object
    wide = rows.astype(kind)
    out = wide.T @ wide
    return out.astype(np.int64) if kind is np.float64 else out


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, limb) of an integer: the limbs bear its sign."""
    sign, rest, place = (-1 if value < 0 else 1), abs(value), 0
    while rest:
        yield place, sign * (rest & ((1 << LIMB) - 1))
        rest >>= LIMB
        place += 1


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def scatter(vectors: DataFrame, shift: int = SHIFT) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, cross-products) of x - shift over all ``vectors`` (vec_id, x), exact."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                y = _matrix(batch.column(0), batch.num_rows) - shift
                n, sums, cross = n + len(y), sums + y.astype(object).sum(0), cross + product(y).astype(object)
        if n:
            d = len(sums)
            whole = [(-2, 0, n), *((-1, i, sums[i]) for i in range(d)), *((i, j, cross[i, j]) for i in range(d) for j in range(i, d))]
            found = [(i, j, place, limb) for i, j, value in whole for place, limb in limbs(int(value))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["i", "j", "place", "value"])

    parts = vectors.select("x").mapInArrow(totals, "i int, j int, place int, value long")
    whole: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("i", "j", "place").agg(F.sum("value").alias("value")).collect():
        key = r["i"], r["j"]
        whole[key] = whole.get(key, 0) + (r["value"] << (LIMB * r["place"]))
    n = whole.get((-2, 0), 0)
    d = vectors.select(F.size("x")).head() if n else None
    d = d[0] if d else 0
    return n, [whole.get((-1, i), 0) for i in range(d)], [[whole.get((min(i, j), max(i, j)), 0) for j in range(d)] for i in range(d)]


def fit(vectors: DataFrame, components: int = COMPONENTS, shift: int = SHIFT) -> Whitening | None:
    """Whitening of ``vectors`` (vec_id, x); None if there are none."""
    n, sums, cross = scatter(vectors, shift)
    if not n:
        return None
    exact = [[n * cross[i][j] - sums[i] * sums[j] for j in range(len(sums))] for i in range(len(sums))]
    covariance = np.array([[v / (n * n) for v in row] for row in exact])
    trace = sum(exact[i][i] for i in range(len(sums))) / (n * n)
    values, vectors_ = np.linalg.eigh(covariance)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    own = np.flatnonzero(values > len(sums) * np.finfo(float).eps * max(values[0], 0))[:components]
    scaled = vectors_[:, own] / np.sqrt(values[own])
    error = float(np.abs(scaled.T @ covariance @ scaled - np.eye(len(own))).max(initial=0))
    return Whitening(n, np.array(sums, object), vectors_[:, own], values[own], values[own] / trace if trace else values[own], error)


def whiten(vectors: DataFrame, fitted: Whitening, shift: int = SHIFT) -> DataFrame:
    """Per vector: vec_id, deviation (decimal: the sum of (n * x - S)**2), whitened (array: its components, by falling eigenvalue)."""
    n, sums, scaled = fitted.n, fitted.sums, fitted.components / np.sqrt(fitted.eigenvalues)
    size = max(abs(int(s)) for s in sums)

    def make():
        def step(batch: pa.RecordBatch):
            if not batch.num_rows:
                return None
            y = _matrix(batch.column(1), batch.num_rows) - shift
            most = n * max(abs(int(y.min())), abs(int(y.max()))) + size
            small = most < 1 << 62
            gap = n * y - sums.astype(np.int64) if small else n * y.astype(object) - sums
            if most * most * y.shape[1] < 1 << 63:
                deviation = np.einsum("ij,ij->i", gap, gap).tolist()
            else:
                deviation = (gap.astype(object) ** 2).sum(1).tolist()
            white = (gap.astype(np.float64) / n) @ scaled
            fits = [Decimal(v) if v < 10**38 else None for v in deviation]
            return [batch.column(0), pa.array(fits, pa.decimal128(38, 0)), pa.array(list(white), pa.list_(pa.float64()))]

        return step

    return map_arrow(vectors.select("vec_id", "x"), make, "vec_id long, deviation decimal(38,0), whitened array<double>")


def whitened_rows(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation (null where it is no long), whitened, explained, identity_error."""
    vectors = integer_vectors(df)
    fitted = fit(vectors, components)
    if fitted is None:
        return vectors.where("false").selectExpr("vec_id", "0 component", "0L n", "0L deviation", "0D whitened", "0D explained", "0D identity_error")
    shares = F.array(*map(F.lit, fitted.explained.tolist())) if len(fitted.explained) else F.array().cast("array<double>")
    long = whiten(vectors, fitted).select("vec_id", F.expr("try_cast(deviation as long)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return long.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("at")].alias("explained"), F.lit(fitted.identity_error).alias("identity_error"))
