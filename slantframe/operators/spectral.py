"""Signal vectors as arrays: one row a vector, transformed in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for the vectors of each length of a list column; null vectors are left out."""
    lengths = np.array([-1 if x is None else x for x in pc.list_value_length(column).to_pylist()], dtype=np.int64)
    for n in np.unique(lengths[lengths >= 0]):
        rows = np.flatnonzero(lengths == n)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield rows, flat.reshape(len(rows), n)


def spectrum_power(df: DataFrame, vector: str, key: str, size: int | None = None) -> DataFrame:
    """(key, power): squared magnitudes of the discrete Fourier transform of each real vector.

    size pads with zeros or cuts; a null vector gives a null spectrum.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out: list = [None] * batch.num_rows
            for rows, matrix in _matrices(batch.column(1)):
                power = np.abs(np.fft.fft(matrix, n=size, axis=1)) ** 2 if matrix.shape[1] else matrix
                for i, p in zip(rows, power):
                    out[i] = p
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], [key, "power"])

    return df.select(key, vector).mapInArrow(run, f"`{key}` {kind}, power array<double>")


def taper(name: str, i: Column, n: Column, coefficient: float = 0.43) -> Column:
    """Weight of sample i of n: uniform, hanning, hamming, or a general raised cosine."""
    turn = F.cos(2 * 3.141592653589793 * i / F.nullif(n - 1, F.lit(0)))
    if name == "uniform":
        return F.lit(1.0)
    a = {"hanning": 0.5, "hamming": 0.54, "general_hamming": coefficient}[name]
    return F.coalesce(a - (1 - a) * turn, F.lit(1.0))


def half_power_width(weights: DataFrame, key: str = "name", oversample: int = 64) -> DataFrame:
    """(key, width): where the response of a weighting (array) falls to 1 / sqrt 2, in samples, both sides together."""

    def run(batches):
        for batch in batches:
            out: list = [None] * batch.num_rows
            for rows, matrix in _matrices(batch.column(1)):
                n = matrix.shape[1]
                response = np.abs(np.fft.fft(matrix, n=n * oversample, axis=1))
                response /= response[:, :1]
                for i, r in zip(rows, response):
                    k = int(np.argmax(r < np.sqrt(0.5)))
                    out[i] = 2 * (k - 1 + (r[k - 1] - np.sqrt(0.5)) / (r[k - 1] - r[k])) / oversample if k else None
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], [key, "width"])

    return weights.select(key, "weights").mapInArrow(run, f"{key} string, width double")


def frames(size: int, count: int, fraction: float = 1.0, fill: float = 1.0) -> list[tuple[int, int]]:
    """(start, stop) of count sub-apertures that step evenly through the filled middle of size samples.

    fraction is the part of the filled samples that one frame takes; widths
    are rounded up and steps down.
    """
    if not (0 < fraction <= 1 and fill >= 1 and count > 0):
        raise ValueError("fraction in (0, 1], fill of 1 or more, one frame or more")
    first = round((size - size / fill) / 2)
    filled = size - 2 * first
    width = math.ceil(fraction * filled)
    step = (filled - width) // (count - 1) if count > 1 else 0
    return [(first + k * step, first + k * step + width) for k in range(count)]


def frame_spans(size: Column, count: Column, fraction: Column, fill: Column) -> Column:
    """``frames`` of each row: an array of (start, stop)."""
    first = F.bround((size - size / fill) / 2, 0).cast("int")
    filled = size - 2 * first
    width = F.ceil(fraction * filled).cast("int")
    step = F.when(count > 1, F.floor((filled - width) / (count - 1)).cast("int")).otherwise(0)
    at = lambda k: (first + k * step).cast("int")
    return F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda k: F.struct(at(k).alias("start"), (at(k) + width).cast("int").alias("stop")))


def subaperture(df: DataFrame, vector: str, key: str, count: int, fraction: float = 0.5) -> DataFrame:
    """(key, frame, power): spectra cut into frames and transformed back, as mean power."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, frame, power = [], [], []
            for rows, matrix in _matrices(batch.column(1)):
                spectrum = np.fft.fftshift(np.fft.fft(matrix, axis=1), axes=1)
                for k, (a, b) in enumerate(frames(matrix.shape[1], count, fraction)):
                    piece = np.fft.ifft(np.fft.ifftshift(spectrum[:, a:b], axes=1), axis=1)
                    at.append(rows)
                    frame.append(np.full(len(rows), k))
                    power.append((np.abs(piece) ** 2).mean(axis=1))
            if at:
                rows = np.concatenate(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.concatenate(frame), pa.int32()), pa.array(np.concatenate(power))], [key, "frame", "power"])

    return df.select(key, vector).mapInArrow(run, f"`{key}` {kind}, frame int, power double")


def transform_complex(df: DataFrame, re: str, im: str, key: str, inverse: bool = False, centred: bool = False) -> DataFrame:
    """(key, re, im): discrete Fourier transforms of complex vectors (two arrays of equal length), or their inverses.

    centred has the zero frequency in the middle of the spectrum, both ways.
    A vector without one of its parts, or with parts of different length,
    gives nulls.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            real, imaginary = (dict((int(i), m) for rows, matrix in _matrices(c) for i, m in zip(rows, matrix)) for c in batch.columns[1:])
            out: list[list] = [[None] * batch.num_rows, [None] * batch.num_rows]
            for i in real.keys() & imaginary.keys():
                if len(real[i]) == len(imaginary[i]) and len(real[i]):
                    x = real[i] + 1j * imaginary[i]
                    if inverse:
                        y = np.fft.ifft(np.fft.ifftshift(x) if centred else x)
                    else:
                        y = np.fft.fft(x)
                        y = np.fft.fftshift(y) if centred else y
                    out[0][i], out[1][i] = y.real, y.imag
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o, pa.list_(pa.float64())) for o in out)], [key, "re", "im"])

    return df.select(key, re, im).mapInArrow(run, f"`{key}` {kind}, re array<double>, im array<double>")


def taylor(i: Column, n: Column, lobes: int = 4, level: float = -30.0) -> Column:
    """Weight of sample i of n of the Taylor window with near-in sidelobes of a level in decibels; the middle has weight 1.

    The cosine coefficients depend on lobes and level only, so they are
    numbers worked out once; the window is a sum of lobes - 1 cosines.
    """
    a = math.acosh(10 ** (abs(level) / 20)) / math.pi
    wide = lobes**2 / (a * a + (lobes - 0.5) ** 2)
    coefficients = []
    for m in range(1, lobes):
        near = math.prod(1 - m * m / (wide * (a * a + (k - 0.5) ** 2)) for k in range(1, lobes))
        far = math.prod(1 - m * m / (k * k) for k in range(1, lobes) if k != m)
        coefficients.append(-((-1) ** m) * near / far / 2)
    # Samples lie in the middles of n cells.
    angle = 2 * math.pi * (i - n / 2 + 0.5) / n
    weight = lambda x: sum((F.lit(2 * f) * F.cos(m * x) for m, f in enumerate(coefficients, 1)), F.lit(1.0))
    top = 1 + 2 * sum(coefficients)
    return weight(angle) / top


def kaiser(i: Column, n: Column, beta: float, terms: int = 40) -> Column:
    """Weight of sample i of n of the Kaiser window; the Bessel function is its power series by Horner's scheme."""
    edge = 2 * i / F.nullif(n - 1, F.lit(0)) - 1
    q = F.coalesce((1 - edge * edge) * (beta * beta / 4), F.lit(beta * beta / 4))

    def series(x):
        out = F.lit(1.0)
        for k in range(terms, 0, -1):
            out = 1 + out * x / (k * k)
        return out

    top = 1.0
    for k in range(terms, 0, -1):
        top = 1 + top * (beta * beta / 4) / (k * k)
    return series(q) / top
