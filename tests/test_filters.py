"""Spectral filters against transforms of the whole image."""

import numpy as np
import pytest

from slantframe.operators import filters


def lines(spark, images):
    return spark.createDataFrame([(i, r, row.real.tolist(), row.imag.tolist()) for i, z in enumerate(images) for r, row in enumerate(z)], "image int, r int, re array<double>, im array<double>")


def arrays(df, *names):
    out = {}
    for row in df.orderBy("image", "r").collect():
        out.setdefault(row.image, []).append([row[n] for n in names])
    return [np.array(x).transpose(1, 0, 2) for _, x in sorted(out.items())]


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(5)
    return [rng.normal(size=s) + 1j * rng.normal(size=s) for s in ((40, 9), (7, 130))]


@pytest.mark.parametrize("axis", [0, 1])
def test_retaper_and_back(spark, images, axis):
    there = filters.retaper(lines(spark, images), axis, "hamming", 0.8)
    for z, (re, im) in zip(images, arrays(there, "re", "im")):
        n = z.shape[axis]
        size = filters._good(n + int(0.1 * n))
        w = filters.weights("hamming", np.fft.fftfreq(size) / 0.8)
        want = np.fft.ifft(np.fft.fft(z, n=size, axis=axis) * (w[:, None] if axis == 0 else w), axis=axis)
        want = want[:n] if axis == 0 else want[:, :n]
        assert np.allclose(re + 1j * im, want)


def test_band_of_each_image_is_a_column(spark, images):
    from pyspark.sql import functions as F

    df = lines(spark, images).withColumn("band", F.when(F.col("image") == 0, 0.5).otherwise(0.9))
    both = arrays(filters.retaper(df, 0, "kaiser", "band", beta=3.0), "re", "im")
    for k, f in enumerate((0.5, 0.9)):
        alone = arrays(filters.retaper(lines(spark, images), 0, "kaiser", f, beta=3.0).where(F.col("image") == k), "re", "im")
        assert np.allclose(both[k], alone[0])


def test_same_window_changes_nothing(spark, images):
    same = filters.retaper(lines(spark, images), 1, "taylor", 0.7, old=filters.weights("taylor", np.linspace(-0.5, 0.5, 4097)))
    for z, (re, im) in zip(images, arrays(same, "re", "im")):
        assert np.abs(re + 1j * im - z).max() < 1e-5


def test_windows():
    u = np.linspace(-0.5, 0.5, 101)
    assert np.allclose(filters.weights("hamming", u), 0.54 + 0.46 * np.cos(2 * np.pi * u))
    assert np.allclose(filters.weights("kaiser", u), np.kaiser(101, 4.0))
    assert filters.weights("taylor", np.zeros(1))[0] == pytest.approx(1)
    assert filters.weights("hann", np.array([3.0]))[0] == pytest.approx(0)
    level = np.abs(np.fft.fft(filters.weights("taylor", u), 8192))
    level /= level[0]
    null = int(np.argmax(np.diff(level) > 0))
    assert 20 * np.log10(level[null:4096].max()) == pytest.approx(-30, abs=1.0)
    with pytest.raises(ValueError):
        filters.weights("none", u)


def test_gains():
    assert filters.taper_gains("uniform") == (1.0, 1.0)
    coherent, incoherent = filters.taper_gains("hann", samples=200001)
    assert coherent == pytest.approx(0.5**4, rel=1e-4) and incoherent == pytest.approx(0.375**2, rel=1e-4)
    assert filters.aperture_noise(100, 0, 50) == pytest.approx(0.5)


def test_aperture_keeps_part_of_the_spectrum(spark, images):
    kept = arrays(filters.aperture(lines(spark, images), 1, 2, 6), "re", "im")
    for z, (re, im) in zip(images, kept):
        s = np.fft.fftshift(np.fft.fft(z, axis=1), axes=1)
        s[:, :2] = s[:, 6:] = 0
        assert np.allclose(re + 1j * im, np.fft.ifft(np.fft.ifftshift(s, axes=1), axis=1))


def test_whole_aperture_changes_nothing(spark, images):
    for z, (re, im) in zip(images, arrays(filters.aperture(lines(spark, images), 0, 0, 1000), "re", "im")):
        assert np.allclose(re + 1j * im, z)


def test_colour_bands_close_around():
    maps = filters.colour_bands(256)
    assert maps.max() == 1 and (np.count_nonzero(maps, axis=0) == 191).all()
    assert np.allclose(np.roll(maps[:, 1], 64), maps[:, 0]) and np.allclose(np.roll(maps[:, 1], -64), maps[:, 2])
    with pytest.raises(ValueError):
        filters.colour_bands(3)


def test_colours_keep_magnitude(spark, images):
    out = arrays(filters.colours(lines(spark, images[:1] + [np.zeros((5, 8))]), 0, "L"), "red", "green", "blue")
    assert np.allclose(out[0].max(axis=0), np.abs(images[0])) and (out[1] == 0).all()
    left, right = (arrays(filters.colours(lines(spark, images[:1]), 0, d, 0.6), "red", "green", "blue")[0] for d in "LR")
    assert np.allclose(left, right[::-1])
    with pytest.raises(ValueError):
        filters.colours(lines(spark, images), 0, "up")


def test_tone_has_the_colour_of_its_place(spark):
    n = 64
    tone = np.exp(-2j * np.pi * np.arange(n) * 14 / n)[None, :]
    red, green, blue = (x.mean() for x in arrays(filters.colours(lines(spark, [tone]), 1, "L"), "red", "green", "blue")[0])
    assert red == pytest.approx(1) and blue < 0.2 < green


def test_noise_is_the_same_again_and_has_its_power(spark):
    z = [np.zeros((200, 300), complex)]
    a, b = (arrays(filters.noisy(lines(spark, z).repartition(k), 0.25, seed=3), "re", "im")[0] for k in (1, 5))
    assert np.array_equal(a, b) and (a**2).sum(axis=0).mean() == pytest.approx(0.25, rel=0.02)
    with pytest.raises(ValueError):
        filters.noisy(lines(spark, z), 0.0)


def test_lacking_lines_are_an_error(spark, images):
    with pytest.raises(Exception, match="lacks lines"):
        filters.retaper(lines(spark, images).where("r <> 3"), 0, "hamming").collect()


def test_no_images(spark):
    assert filters.colours(lines(spark, [np.ones((1, 8))]).limit(0), 0).collect() == []
