import numpy as np
import pytest
from pyspark.sql import functions as F

from slantframe.functions import projection
from slantframe.operators.ortho import GroundGrid, resample
from slantframe.operators.spectra import fft2, phase_ramp
from slantframe.plans.imaging import _images

RNG = np.random.default_rng(4)


def lines_of(spark, images, parts=3):
    rows = [(k, r, x[r].real.tolist(), x[r].imag.tolist()) for k, x in enumerate(images) for r in range(len(x))]
    return spark.createDataFrame(rows, "image int, r int, re array<double>, im array<double>").repartition(parts)


def images_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.image, {})[r.r] = np.array(r.re) + 1j * np.array(r.im)
    return {k: np.stack([v[i] for i in range(len(v))]) for k, v in out.items()}


@pytest.mark.parametrize("block", [1, 7, 64])
def test_spectra_and_back(spark, block):
    images = [RNG.standard_normal((n, m)) + 1j * RNG.standard_normal((n, m)) for n, m in ((64, 64), (33, 20), (1, 5))]
    lines = lines_of(spark, images)
    there = fft2(lines, block=block)
    for k, x in images_of(there).items():
        assert np.allclose(x, np.fft.fftshift(np.fft.fft2(images[k])))
    for k, x in images_of(fft2(there, inverse=True, block=block)).items():
        assert np.allclose(x, images[k])
    signed = images_of(fft2(lines, signs=(1, -1), centred=False, block=block))
    for k, x in signed.items():
        assert np.allclose(x, np.fft.fft(np.fft.ifft(images[k], axis=0) * len(images[k]), axis=1))
    turned = fft2(fft2(lines, signs=(1, -1), block=block), inverse=True, signs=(1, -1), block=block)
    assert all(np.allclose(x, images[k]) for k, x in images_of(turned).items())


def test_missing_lines_are_an_error(spark):
    lines = lines_of(spark, [np.ones((4, 4))])
    for bad in (lines.where("r <> 2"), lines.unionAll(lines.where("r = 1"))):
        with pytest.raises(Exception, match="lacks lines"):
            fft2(bad).collect()
    assert fft2(lines.limit(0)).count() == 0


def test_a_skewed_spectrum_is_straightened(spark):
    """A quadratic phase spreads a point's spectrum; without it the spectrum is flat again."""
    u, w = np.meshgrid((np.arange(32) - 16) * 0.5, (np.arange(24) - 12) * 0.25, indexing="ij")
    plain = np.exp(2j * np.pi * 0.1 * u)
    skewed = plain * np.exp(-2j * np.pi * (0.02 * u * w + 0.03 * w * w))
    turns = [[0.0, 0.0, 0.03], [0.0, 0.02, 0.0]]
    got = phase_ramp(lines_of(spark, [skewed]), turns, 0.5, 0.25, (16.0, 12.0))
    assert np.allclose(images_of(got)[0], plain)
    assert np.allclose(images_of(phase_ramp(got, turns, 0.5, 0.25, (16.0, 12.0), backwards=True))[0], skewed)


@pytest.mark.parametrize("nearest", [False, True])
def test_tiles_equal_the_whole_image(spark, nearest):
    a = RNG.standard_normal((40, 30))
    a[5:8, 10:12] = np.nan
    rows = [(0, r, c, float(a[r, c])) for r in range(40) for c in range(30) if np.isfinite(a[r, c])]
    pixels = spark.createDataFrame(rows, "image int, r int, c int, amplitude double")
    mapping = lambda _, r, c: (np.where(r == 3, np.nan, 0.9 * r + 0.3 * c - 2), 1.1 * c - 0.2 * r + 3.0)
    got = {(r.r, r.c): r.amplitude for r in resample(pixels, spark.createDataFrame([(0,)], "image int"), (45, 33), mapping, nearest=nearest, tile=8).collect()}
    assert len(got) == 45 * 33
    r, c = np.meshgrid(np.arange(45), np.arange(33), indexing="ij")
    x, y = mapping(None, r.astype(float), c.astype(float))
    if nearest:
        x, y = np.floor(x + 0.5), np.floor(y + 0.5)
    for i in range(45):
        for j in range(33):
            want, p, q = 0.0, x[i, j], y[i, j]
            for di in (0, 1):
                for dj in (0, 1):
                    if not np.isfinite(p):
                        want = np.nan
                        continue
                    k, m = int(np.floor(p)) + di, int(np.floor(q)) + dj
                    weight = (p - np.floor(p) if di else 1 - p + np.floor(p)) * (q - np.floor(q) if dj else 1 - q + np.floor(q))
                    if weight > 0:
                        want += weight * (a[k, m] if 0 <= k < 40 and 0 <= m < 30 else np.nan)
            assert (got[i, j] is None) == bool(np.isnan(want)) and (np.isnan(want) or abs(got[i, j] - want) < 1e-9), (i, j)


def test_an_image_on_the_ground(spark):
    """Pixels that hold their own place on the ground plane come out as the grid's places."""
    images = _images(spark)
    cells = spark.range(240 * 200).select((F.col("id") / 200).cast("int").alias("r"), (F.col("id") % 200).cast("int").alias("c")).crossJoin(images)
    placed = projection.image_to_plane(cells.withColumns({"row": F.col("r") + 380.0, "col": F.col("c") + 300.0}), "at")
    grid = GroundGrid((6378137.0, -3.0, -2.0), (0.0, 0.4, 0.0), (0.0, 0.0, 0.3))
    for axis, (row, col) in {"at_y": (0.4, 0.0), "at_z": (0.0, 0.3)}.items():
        pixels = placed.select("image", (F.col("r") + 380).alias("r"), (F.col("c") + 300).alias("c"), F.col(axis).alias("amplitude"))
        got = resample(pixels, images, (16, 15), grid.mapping, tile=32).where("amplitude is not null and image <> 2").collect()
        assert len(got) == 3 * 16 * 15  # the scene of image 2 lies elsewhere
        start = -3.0 if axis == "at_y" else -2.0
        assert all(abs(r.amplitude - (start + row * r.r + col * r.c)) < 1e-2 for r in got)
