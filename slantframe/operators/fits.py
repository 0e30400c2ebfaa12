"""Least-squares fits per group by a tree of orthogonal factors: rows are never squared, so no digits are lost.

A task turns its rows of a group into a triangle of as many rows as there are
unknowns, and goes on from it with the next batch; triangles of a group are
joined in buckets and then once more.  A group's size doesn't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups that a task holds triangles of, and buckets in which triangles are joined first.
HELD, BUCKETS = 1000, 32

Rows = Callable[[np.ndarray], np.ndarray]


def _triangle(rows: np.ndarray) -> np.ndarray:
    """The triangle with the products of the rows; at most as many rows as columns."""
    return np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows


def _triangles(df: DataFrame, key: str, inputs: Sequence[str], design: Rows, width: int) -> DataFrame:
    """(key, data): one triangle a group; design turns rows of inputs into rows of ``width`` numbers, the last of them the right side."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, data binary"

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        arrow = None

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), arrow), pa.array([t.tobytes() for t in held.values()], pa.binary())], [key, "data"])

        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            arrow, numbers = batch.column(0).type, coded.indices.fill_null(-1).to_numpy()
            values = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1).astype(float)
            names = coded.dictionary.to_pylist()
            for k in np.unique(numbers):
                own = design(values[numbers == k])
                name = names[k] if k >= 0 else None
                held[name] = _triangle(np.concatenate([held[name], own]) if name in held else own)
            if len(held) >= HELD:
                yield flush()
                held.clear()
        if held:
            yield flush()

    def join(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x, dtype=np.float64).reshape(-1, width) for x in table.column("data").to_pylist()])
        return pa.table({key: table.column(key).slice(0, 1), "data": pa.array([_triangle(rows).tobytes()], pa.binary())})

    made = df.select(key, *(F.col(c).cast("double").alias(f"in{i}_") for i, c in enumerate(inputs))).mapInArrow(factor, schema)
    bucket = F.pmod(F.xxhash64("data"), F.lit(BUCKETS)).alias("bucket_")
    return made.groupBy(key, bucket).applyInArrow(lambda t: join(t.select([key, "data"])), schema).groupBy(key).applyInArrow(join, schema)


def _solved(triangle: bytes, width: int) -> tuple[np.ndarray, float]:
    """(shortest solution, condition number) of a triangle; infinite if it doesn't determine the solution."""
    rows = np.frombuffer(triangle, dtype=np.float64).reshape(-1, width)
    left, right = rows[:, :-1], rows[:, -1]
    found, _, rank, sizes = np.linalg.lstsq(left, right, rcond=None)
    return found, float(sizes[0] / sizes[-1]) if rank == width - 1 and len(sizes) == width - 1 else float("inf")


def _scaled(df: DataFrame, key: str, x: str, y: str, z: str) -> DataFrame:
    """(key, sx_, sy_, u_, w_, z_): x and y by their largest size in the group; rows with a null take no part."""
    scale = lambda c: F.nullif(F.max(F.abs(c)), F.lit(0.0))
    use = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    limits = use.groupBy(key).agg(F.coalesce(scale(x), F.lit(1.0)).alias("sx_"), F.coalesce(scale(y), F.lit(1.0)).alias("sy_")).withColumnRenamed(key, "key_")
    met = use.join(limits, F.col(key).eqNullSafe(F.col("key_")))
    return met.select(F.col(key), F.col("sx_").cast("double").alias("sx_"), F.col("sy_").cast("double").alias("sy_"), (F.col(x) / F.col("sx_")).cast("double").alias("u_"), (F.col(y) / F.col("sy_")).cast("double").alias("w_"), F.col(z).cast("double").alias("z_"))


def fit_plane_polynomial(df: DataFrame, key: str, x: str, y: str, z: str, degree_x: int, degree_y: int) -> DataFrame:
    """(key, coefficients, condition): the polynomial in x and y that is closest to z, rows of coefficients by powers of x.

    x and y are scaled by their largest size in between; condition is that of
    the scaled problem, infinite where a group doesn't determine the
    polynomial, which then is the shortest solution.  Rows with a null take no
    part.
    """
    terms = [(a, b) for a in range(degree_x + 1) for b in range(degree_y + 1)]
    width = len(terms) + 1

    def design(v: np.ndarray) -> np.ndarray:
        u, w, z = v.T
        return np.stack([*(u**a * w**b for a, b in terms), z], axis=1)

    scaled = _scaled(df, key, x, y, z)
    triangles = _triangles(scaled, key, ("u_", "w_", "z_"), design, width)
    limits = scaled.groupBy(key).agg(F.max("sx_").alias("sx_"), F.max("sy_").alias("sy_")).withColumnRenamed(key, "key_")
    kind = df.schema[key].dataType.simpleString()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, conditions = [], []
            for data, sx, sy in zip(*(c.to_pylist() for c in batch.columns[1:])):
                found, condition = _solved(data, width)
                out.append((found.reshape(degree_x + 1, degree_y + 1) / np.outer(sx ** np.arange(degree_x + 1), sy ** np.arange(degree_y + 1))).tolist())
                conditions.append(condition)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.list_(pa.float64()))), pa.array(conditions, pa.float64())], [key, "coefficients", "condition"])

    met = triangles.join(limits, F.col(key).eqNullSafe(F.col("key_"))).select(key, "data", "sx_", "sy_")
    return met.mapInArrow(solve, f"`{key}` {kind}, coefficients array<array<double>>, condition double")


def powers(degree: int) -> list[tuple[int, int]]:
    """Powers of both variables up to a degree together, the constant first."""
    return sorted(((a, b) for a in range(degree + 1) for b in range(degree + 1 - a)), key=lambda p: (p[0] + p[1], -p[0]))


def fit_rational(df: DataFrame, key: str, x: str, y: str, z: str, top: int, bottom: int, rounds: int = 3) -> DataFrame:
    """(key, scale_x, scale_y, numerator, denominator, condition): P / Q closest to z, with Q's constant 1.

    P and Q are polynomials in x / scale_x and y / scale_y up to the degrees
    top and bottom together, coefficients in the order of ``powers``.  Each
    round solves P - z Q = 0 with rows weighted by the last Q, so that the
    last one is close to the least squares of P / Q.  Rows with a null take no
    part.
    """
    above, below = powers(top), powers(bottom)[1:]
    width = len(above) + len(below) + 1
    scaled = _scaled(df, key, x, y, z)
    kind = df.schema[key].dataType.simpleString()
    names = [f"q{i}_" for i in range(len(below))]

    def design(v: np.ndarray) -> np.ndarray:
        u, w, z, last = v[:, 0], v[:, 1], v[:, 2], v[:, 3:]
        under = [u**a * w**b for a, b in below]
        weight = 1 / np.abs(1 + sum((last[:, i] * t for i, t in enumerate(under)), np.zeros(len(u))))
        return np.stack([*(u**a * w**b * weight for a, b in above), *(-z * t * weight for t in under), z * weight], axis=1)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_solved(x, width) for x in batch.column(1).to_pylist()]
            lists = [pa.array([c[at].tolist() for c, _ in found], pa.list_(pa.float64())) for at in (slice(0, len(above)), slice(len(above), None))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array([c for _, c in found], pa.float64())], [key, "numerator", "rest", "condition"])

    given = scaled.select(key, "u_", "w_", "z_", *(F.lit(0.0).alias(n) for n in names))
    for k in range(rounds):
        solved = _triangles(given, key, ("u_", "w_", "z_", *names), design, width).mapInArrow(solve, f"`{key}` {kind}, numerator array<double>, rest array<double>, condition double")
        if k + 1 < rounds:
            last = solved.select(F.col(key).alias("key_"), *(F.col("rest")[i].alias(n) for i, n in enumerate(names)))
            given = scaled.join(last, F.col(key).eqNullSafe(F.col("key_"))).select(key, "u_", "w_", "z_", *names)
    limits = scaled.groupBy(F.col(key).alias("key_")).agg(F.max("sx_").alias("scale_x"), F.max("sy_").alias("scale_y"))
    met = solved.join(limits, F.col(key).eqNullSafe(F.col("key_")))
    return met.select(key, "scale_x", "scale_y", "numerator", F.concat(F.array(F.lit(1.0)), "rest").alias("denominator"), "condition")
