import json

import numpy as np

from slantframe.functions import projection
from slantframe.functions.scenes import Scene
from slantframe.operators.fits import fit_plane_polynomial, fit_rational, powers
from slantframe.plans.imaging import _images

RNG = np.random.default_rng(11)


def frame(spark, rows, schema="k string, x double, y double, z double"):
    return spark.createDataFrame([tuple(v if isinstance(v, (str, type(None))) else float(v) for v in r) for r in rows], schema).repartition(6)


def test_high_degrees_keep_their_digits(spark):
    """Degree 7 in both on a narrow strip far from 0: normal equations would lose all digits."""
    c = RNG.standard_normal((8, 8))
    x, y = 100 + RNG.uniform(0, 60, 4000), RNG.uniform(-3, 3, 4000)
    z = np.polynomial.polynomial.polyval2d(x / 160, y / 3, c)
    (r,) = fit_plane_polynomial(frame(spark, [("a", *p) for p in zip(x, y, z)]), "k", "x", "y", "z", 7, 7).collect()
    assert 1e8 < r.condition < 1e16
    assert np.abs(np.polynomial.polynomial.polyval2d(x, y, np.array(r.coefficients)) - z).max() < 1e-8


def test_groups_nulls_and_too_few_rows(spark):
    rows = [(k, x, y, s + 2 * x - 3 * y) for k, s in (("a", 1.0), ("b", 5.0), (None, 9.0)) for x in range(5) for y in range(4)]
    rows += [("a", None, 1.0, 2.0), ("a", 1.0, 1.0, None), ("few", 2.0, 3.0, 4.0)]
    got = {r.k: r for r in fit_plane_polynomial(frame(spark, rows), "k", "x", "y", "z", 1, 1).collect()}
    for k, s in (("a", 1.0), ("b", 5.0), (None, 9.0)):
        assert np.allclose(got[k].coefficients, [[s, -3], [2, 0]], atol=1e-10) and got[k].condition < 1e3
    assert got["few"].condition == float("inf") and abs(np.polynomial.polynomial.polyval2d(2, 3, np.array(got["few"].coefficients)) - 4) < 1e-9
    assert fit_plane_polynomial(frame(spark, rows).limit(0), "k", "x", "y", "z", 1, 1).count() == 0


def quotient(r, x, y, top, bottom):
    u, w = x / r.scale_x, y / r.scale_y
    value = lambda terms, c: sum(ci * u**a * w**b for (a, b), ci in zip(terms, c))
    return value(powers(top), r.numerator) / value(powers(bottom), r.denominator)


def test_quotients(spark):
    x, y = RNG.uniform(-4, 4, (2, 3000))
    z = (1 + x - 2 * y + 0.5 * x * y) / (1 + 0.1 * x + 0.05 * y * y)
    (r,) = fit_rational(frame(spark, [("a", *p) for p in zip(x, y, z)]), "k", "x", "y", "z", 2, 2).collect()
    assert np.abs(quotient(r, x, y, 2, 2) - z).max() < 1e-9 and len(r.numerator) == 6 and r.denominator[0] == 1
    noisy = z + 0.01 * RNG.standard_normal(len(z))
    (r,) = fit_rational(frame(spark, [("a", *p) for p in zip(x, y, noisy)]), "k", "x", "y", "z", 2, 2, rounds=4).collect()
    assert np.sqrt(np.mean((quotient(r, x, y, 2, 2) - z) ** 2)) < 0.002


def test_places_to_pixels(spark):
    """Degree 5 stands for the projection of ground places to a thousandth of a pixel."""
    images = _images(spark)
    scenes = {r.image: Scene(json.loads(r.s)) for r in images.select("image", projection.packed(images).alias("s")).collect()}
    y, z = (a.ravel() for a in np.meshgrid(np.linspace(-400, 400, 40), np.linspace(-300, 300, 40)))
    rows = []
    for k, s in scenes.items():
        row, _, _ = s.to_pixel(np.stack([np.full(len(y), 6378137.0), y, z]))
        rows += [(str(k), *p) for p in zip(y, z, row)]
    for r in fit_plane_polynomial(frame(spark, rows), "k", "x", "y", "z", 5, 5).collect():
        own = np.array([p[1:] for p in rows if p[0] == r.k])
        assert np.abs(np.polynomial.polynomial.polyval2d(own[:, 0], own[:, 1], np.array(r.coefficients)) - own[:, 2]).max() < 1e-3
