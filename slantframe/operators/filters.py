"""Spectral filters of whole images along one axis: tapers, apertures, colours by sub-aperture, added noise.

Along columns a line is filtered where it lies, without a shuffle.  Along rows
lines are cut into column blocks, dealt by block, filtered and put together
again, so that a task holds a few columns of an image and never an image.

Images come as lines (image, r, re, im), whole, from line 0 on and equally
long.  ``fill`` is the part of the spectrum that an image's band fills
(bandwidth times sample spacing); it is a number, or the name of a column of
the lines, for images that differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantframe.operators.spectra import BLOCK, LINES, _lists, _matrix

#: A filter: complex vectors in rows, and the band's part, to as many real matrices of that shape as there are names.
Filter = Callable[[np.ndarray, float], list[np.ndarray]]
#: Existing weights below this part of the largest are taken to be that part, so that noise outside a window isn't blown up.
LEAST = 0.01


def along(lines: DataFrame, axis: int, run: Filter, fill: float | str = 1.0, names: Sequence[str] = ("re", "im"), block: int = BLOCK) -> DataFrame:
    """(image, r, names) after a filter along rows (axis 0) or columns (axis 1).

    A line without samples, or whose two parts differ in length, is an error,
    as is an image that lacks a line or has one twice (axis 0).
    """
    if axis not in (0, 1):
        raise ValueError("axis is 0 or 1")
    out = ", ".join(f"{n} array<double>" for n in names)
    part = F.col(fill) if isinstance(fill, str) else F.lit(float(fill))
    own = lines.select(F.col("image").cast("int").alias("image"), F.col("r").cast("int").alias("r"), part.cast("double").alias("fill"), F.col("re").cast("array<double>").alias("re"), F.col("im").cast("array<double>").alias("im"))

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(3)], dtype=np.int64)
            fills = batch.column(2).to_numpy()
            for n, f in sorted(set(zip(sizes.tolist(), fills.tolist()))):
                same = batch.filter(pa.array((sizes == n) & (fills == f)))
                if not n:
                    raise ValueError(f"image {same.column(0)[0]} has a line without samples")
                yield pa.RecordBatch.from_arrays([same.column(0), same.column(1), *map(_lists, run(_matrix(same, 3, 4), f))], ["image", "r", *names])

    if axis == 1:
        return own.mapInArrow(flat, f"image int, r int, {out}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(3)], dtype=np.int64)
            for n in np.unique(sizes):
                same = batch.filter(pa.array(sizes == n))
                z = _matrix(same, 3, 4)
                for k in range(0, int(n), block):
                    yield pa.RecordBatch.from_arrays([same.column(0), pa.array(np.full(len(z), k // block, np.int32)), same.column(1), same.column(2), _lists(z[:, k : k + block].real), _lists(z[:, k : k + block].imag)], ["image", "k", "r", "fill", "re", "im"])

    def across(table: pa.Table) -> pa.Table:
        rows = table.column("r").to_numpy()
        order = np.argsort(rows, kind="stable")
        if not np.array_equal(rows[order], np.arange(len(rows))):
            raise ValueError(f"image {table.column('image')[0]} lacks lines, or has some twice")
        done = run(_matrix(table, 4, 5)[order].T, table.column("fill")[0].as_py())
        return pa.table({"image": table.column("image"), "k": table.column("k"), "r": np.arange(len(rows), dtype=np.int32), **{n: _lists(y.T) for n, y in zip(names, done)}})

    def whole(table: pa.Table) -> pa.Table:
        rows, ks = table.column("r").to_numpy(), table.column("k").to_numpy()
        order = np.lexsort((ks, rows))
        first = np.flatnonzero(np.r_[True, np.diff(rows[order]) > 0])
        joined = {n: _lists(table.column(n).combine_chunks().take(pa.array(order)).flatten().to_numpy().reshape(len(first), -1)) for n in names}
        return pa.table({"image": table.column("image").take(pa.array(np.zeros(len(first), np.int64))), "r": pa.array(rows[order][first], pa.int32()), **joined})

    dealt = own.mapInArrow(cut, "image int, k int, r int, fill double, re array<double>, im array<double>")
    done = dealt.groupBy("image", "k").applyInArrow(across, f"image int, k int, r int, {out}")
    return done.withColumn("line", F.floor(F.col("r") / block)).groupBy("image", "line").applyInArrow(lambda t: whole(t.drop_columns(["line"])), f"image int, r int, {out}")


def weights(window: str | Sequence[float], u: np.ndarray, **of: float) -> np.ndarray:
    """A window's weights at places u of its band, -0.5 to 0.5; beyond them, those of its ends.

    window is uniform, hamming, hann, general_hamming (alpha), kaiser (beta),
    taylor (nbar, sll), or sampled weights from end to end, read linearly.
    """
    u = np.clip(u, -0.5, 0.5)
    if not isinstance(window, str):
        given = np.asarray(window, dtype=float)
        return np.interp(u, np.linspace(-0.5, 0.5, len(given)), given)
    name = window.lower()
    if name == "uniform":
        return np.ones_like(u)
    if name in ("hamming", "hann", "hanning", "general_hamming"):
        a = {"hamming": 0.54, "general_hamming": of.get("alpha", 0.5)}.get(name, 0.5)
        return a + (1 - a) * np.cos(2 * np.pi * u)
    if name == "kaiser":
        beta = of.get("beta", 4.0)
        return np.i0(beta * np.sqrt(np.maximum(0.0, 1 - 4 * u * u))) / np.i0(beta)
    if name == "taylor":
        lobes, level = int(of.get("nbar", 4)), 10 ** (abs(of.get("sll", -30.0)) / 20)
        a = (np.arccosh(level) / np.pi) ** 2
        k = np.arange(1, lobes)
        spread = lobes**2 / (a + (lobes - 0.5) ** 2)
        out = np.ones_like(u)
        for m in k:
            above = np.prod(1 - m * m / (spread * (a + (k - 0.5) ** 2)))
            out = out - (-1) ** m * above / np.prod(1 - (m / k[k != m]) ** 2) * np.cos(2 * np.pi * m * u)
        return out / (1 - sum((-1) ** m * np.prod(1 - m * m / (spread * (a + (k - 0.5) ** 2))) / np.prod(1 - (m / k[k != m]) ** 2) for m in k))
    raise ValueError(f"no window {window}")


def _good(size: int) -> int:
    """The least length from size on without a prime factor above 5."""
    while True:
        left = size
        for p in (2, 3, 5):
            while left % p == 0:
                left //= p
        if left == 1:
            return size
        size += 1


def retaper(lines: DataFrame, axis: int, window: str | Sequence[float], fill: float | str = 1.0, old: str | Sequence[float] = "uniform", sign: int = -1, **of: float) -> DataFrame:
    """(image, r, re, im) with another spectral taper along an axis; the taper that was there is taken off.

    Lines are padded by a tenth of their length, or by 200 resolution cells
    where that is less, so that side lobes don't come in again at the other
    end.  sign is that of the exponent into the spectrum.
    """

    def run(z: np.ndarray, part: float) -> list[np.ndarray]:
        n = z.shape[1]
        size = _good(n + int(min(200 / part, 0.1 * n)))
        u = np.fft.fftfreq(size) / part
        was = weights(old, u)
        factor = weights(window, u, **of) / np.maximum(was, LEAST * was.max())
        there, back = (np.fft.fft, np.fft.ifft) if sign < 0 else (np.fft.ifft, np.fft.fft)
        y = back(there(z, n=size, axis=1) * factor, axis=1)[:, :n]
        return [y.real, y.imag]

    return along(lines, axis, run, fill)


def taper_gains(window: str | Sequence[float], old: str | Sequence[float] = "uniform", samples: int = 513, **of: float) -> tuple[float, float]:
    """(coherent, incoherent) gain in power when both axes go from an old window to a new one.

    Noise levels in power are multiplied by the incoherent gain; factors to
    radar cross section are divided by the coherent one, factors per area by
    the incoherent one.
    """
    u = np.linspace(-0.5, 0.5, samples)
    new, was = weights(window, u, **of), weights(old, u)
    return float((new.mean() / was.mean()) ** 4), float(((new**2).mean() / (was**2).mean()) ** 2)


def aperture(lines: DataFrame, axis: int, first: int, stop: int, fill: float | str = 1.0, window: str | Sequence[float] = "uniform", old: str | Sequence[float] = "uniform", **of: float) -> DataFrame:
    """(image, r, re, im) of the samples first to stop of the centred spectrum alone, weighted anew: a lower resolution on the same grid.

    What the old window did within its band is taken off first.  Samples
    outside the spectrum or the band are zero.
    """

    def run(z: np.ndarray, part: float) -> list[np.ndarray]:
        n = z.shape[1]
        k = np.arange(n)
        low, high = max(first, int(np.floor(0.5 * n * (1 - part)))), min(stop, int(np.ceil(0.5 * n * (1 + part))))
        inside = (k >= low) & (k < high)
        centre = (k - n // 2) / (n * part)
        was = weights(old, centre)
        anew = weights(window, (k - low) / max(1, high - 1 - low) - 0.5, **of)
        y = np.fft.ifft(np.fft.ifftshift(np.fft.fftshift(np.fft.fft(z, axis=1), axes=1) * np.where(inside, anew / np.maximum(was, LEAST * was.max()), 0.0), axes=1), axis=1)
        return [y.real, y.imag]

    return along(lines, axis, run, fill)


def aperture_noise(size: int, first: int, stop: int, window: str | Sequence[float] = "uniform", old: str | Sequence[float] = "uniform", **of: float) -> float:
    """What the noise power of a band of size samples is multiplied by if first to stop of them are kept and weighted anew."""
    was = weights(old, np.linspace(-0.5, 0.5, size))
    anew = weights(window, np.linspace(-0.5, 0.5, stop - first), **of)
    return float(((anew / np.maximum(was, LEAST * was.max())[first:stop]) ** 2).sum() / size)


def colour_bands(size: int) -> np.ndarray:
    """(size, 3): weights of red, green and blue over a spectrum: trapezoids, a quarter apart, that close around the ends."""
    if size < 4:
        raise ValueError("a spectrum of fewer than 4 samples has no three bands")
    step = int(np.ceil(size / 4))
    ramp = np.minimum(np.minimum(np.arange(1, 3 * step), step), np.arange(3 * step - 1, 0, -1)) / step
    start = round((size - len(ramp)) / 2)
    out = np.zeros((size, 3))
    for band, shift in enumerate((step, 0, -step)):
        out[(start + shift + np.arange(len(ramp))) % size, band] = ramp
    return out


def colours(lines: DataFrame, axis: int = 0, direction: str = "R", fill: float | str = 1.0) -> DataFrame:
    """(image, r, red, green, blue): where in the aperture a pixel's power comes from, as colour; the brightest band has the pixel's magnitude.

    Bands are cut from the filled middle of the spectrum.  The outer two are
    turned about it so that each lies in one piece, line by line; the picture
    of each keeps its place in a spectrum of the image's size.  direction is
    the platform's, R or L: with R red and blue change places.  A pixel
    whose three bands are zero is black.
    """
    turned = direction.upper()[:1]
    if turned not in ("R", "L"):
        raise ValueError("direction is R or L")

    def run(z: np.ndarray, part: float) -> list[np.ndarray]:
        n = z.shape[1]
        maps = colour_bands(int(round(n * min(1.0, part))))
        m = len(maps)
        first = (n - m) // 2
        band = np.fft.fftshift(np.fft.ifft(z, axis=1), axes=1)[:, first : first + m]
        shift = int(np.ceil(m / 4))
        out = []
        for k, by in enumerate((-shift, 0, shift)):
            wide = np.zeros_like(z)
            wide[:, first : first + m] = np.roll(band * maps[:, k], by, axis=1)
            out.append(np.abs(np.fft.fft(np.fft.ifftshift(wide, axes=1), axis=1)))
        most = np.maximum(np.maximum(out[0], out[1]), out[2])
        scale = np.divide(np.abs(z), most, out=np.zeros_like(most), where=most > 0)
        return [x * scale for x in (out[::-1] if turned == "R" else out)]

    return along(lines, axis, run, fill, ("red", "green", "blue"))


def noisy(lines: DataFrame, variance: float, seed: int = 0) -> DataFrame:
    """(image, r, re, im) with circular Gaussian noise of a power; a line's noise follows from (seed, image, r), so a task that runs again gives the same."""
    if not variance > 0:
        raise ValueError("the noise's power is above zero")
    sigma = float(np.sqrt(variance / 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = [[], []]
            for image, r, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                own = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, image & 0xFFFFFFFF, r & 0xFFFFFFFF]))).normal(0.0, sigma, (2, len(x)))
                for k, v in enumerate((x, y)):
                    parts[k].append(v.values.to_numpy() + own[k])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(p, pa.list_(pa.float64())) for p in parts)], ["image", "r", "re", "im"])

    own = lines.select(F.col("image").cast("int"), F.col("r").cast("int"), F.col("re").cast("array<double>"), F.col("im").cast("array<double>"))
    return own.mapInArrow(run, LINES)
