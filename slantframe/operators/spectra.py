"""Two-dimensional spectra of images that are larger than a task.

Lines are transformed where they lie, cut into column blocks, and dealt by
block; a block's columns are transformed and cut into row blocks, which become
lines again.  A task holds a block of a few columns, or of a few lines, never an
image; every sample is shuffled twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns, and lines, of a block.
BLOCK = 64
LINES = "image int, r int, re array<double>, im array<double>"


def _transformed(x: np.ndarray, axis: int, sign: int, inverse: bool, centred: bool) -> np.ndarray:
    """The transform along an axis; with sign 1 the exponent of the forward transform is positive."""
    backwards = inverse != (sign > 0)
    if inverse and centred:
        x = np.fft.ifftshift(x, axes=axis)
    y = np.fft.ifft(x, axis=axis) if backwards else np.fft.fft(x, axis=axis)
    if backwards != inverse:
        y = y * x.shape[axis] if backwards else y / x.shape[axis]
    return np.fft.fftshift(y, axes=axis) if centred and not inverse else y


def _matrix(batch, re: int, im: int) -> np.ndarray:
    real, imaginary = (batch.column(i).combine_chunks() if isinstance(batch, pa.Table) else batch.column(i) for i in (re, im))
    return (real.flatten().to_numpy() + 1j * imaginary.flatten().to_numpy()).reshape(len(real), -1)


def _lists(x: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(x)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, max(1, x.shape[1]), dtype=np.int32)), pa.array(flat.ravel()))


def fft2(lines: DataFrame, inverse: bool = False, signs: tuple[int, int] = (-1, -1), centred: bool = True, block: int = BLOCK) -> DataFrame:
    """(image, r, re, im): the spectra of images as lines, or with inverse the images of spectra.

    lines (image, r, re, im) are whole images: each has all its lines from 0
    on, equally long.  signs are those of the exponents along rows and
    columns; centred has the zero frequency in the middle.  An image that
    lacks a line, or has one twice, is an error.
    """
    schema = "image int, k int, r int, re array<double>, im array<double>"

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(2)], dtype=np.int64)
            for n in np.unique(sizes[sizes > 0]):
                part = batch.filter(pa.array(sizes == n))
                y = _transformed(_matrix(part, 2, 3), 1, signs[1], inverse, centred)
                for k in range(0, y.shape[1], block):
                    own = y[:, k : k + block]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(y), k // block, np.int32)), part.column(1), _lists(own.real), _lists(own.imag)], ["image", "k", "r", "re", "im"])

    def across(table: pa.Table) -> pa.Table:
        rows = table.column("r").to_numpy()
        order = np.argsort(rows, kind="stable")
        if not np.array_equal(rows[order], np.arange(len(rows))):
            raise ValueError(f"image {table.column('image')[0]} lacks lines, or has some twice")
        y = _transformed(_matrix(table, 3, 4)[order], 0, signs[0], inverse, centred)
        return pa.table({"image": table.column("image"), "k": table.column("k"), "r": np.arange(len(y), dtype=np.int32), "re": _lists(y.real), "im": _lists(y.imag)})

    def whole(table: pa.Table) -> pa.Table:
        rows, ks = table.column("r").to_numpy(), table.column("k").to_numpy()
        order = np.lexsort((ks, rows))
        first = np.flatnonzero(np.r_[True, np.diff(rows[order]) > 0])
        out = {"image": table.column("image").slice(0, 1).to_pylist() * len(first), "r": rows[order][first]}
        for name in ("re", "im"):
            pieces = table.column(name).combine_chunks().take(pa.array(order))
            out[name] = _lists(pieces.flatten().to_numpy().reshape(len(first), -1))
        return pa.table({"image": pa.array(out["image"], pa.int32()), "r": pa.array(out["r"], pa.int32()), "re": out["re"], "im": out["im"]})

    own = lines.select(F.col("image").cast("int"), F.col("r").cast("int"), F.col("re").cast("array<double>"), F.col("im").cast("array<double>"))
    cut = own.mapInArrow(along, schema).groupBy("image", "k").applyInArrow(across, schema)
    return cut.withColumn("line", F.floor(F.col("r") / block)).groupBy("image", "line").applyInArrow(lambda t: whole(t.select(["image", "k", "r", "re", "im"])), LINES)


def phase_ramp(lines: DataFrame, turns: list[list[float]], row_step: float, col_step: float, origin: tuple[float, float] = (0.0, 0.0), backwards: bool = False) -> DataFrame:
    """lines turned by a polynomial of turns over metres from an origin (row, column): what deskews a spectrum, or with backwards skews it again.

    turns[i][j] belongs to row metres to the i and column metres to the j.
    """
    table = np.array(turns, dtype=float)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            re, im = [], []
            for r, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                z = x.values.to_numpy() + 1j * y.values.to_numpy()
                u, w = (r - origin[0]) * row_step, (np.arange(len(z)) - origin[1]) * col_step
                z = z * np.exp((-2j if backwards else 2j) * np.pi * np.polynomial.polynomial.polyval2d(np.full(len(w), u), w, table))
                re.append(z.real)
                im.append(z.imag)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(re, pa.list_(pa.float64())), pa.array(im, pa.list_(pa.float64()))], ["image", "r", "re", "im"])

    return lines.select(F.col("image").cast("int"), F.col("r").cast("int"), F.col("re").cast("array<double>"), F.col("im").cast("array<double>")).mapInArrow(turn, LINES)
