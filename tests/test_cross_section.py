import random

import numpy as np

from slantframe.operators.cross_section import cross_sections, spans

AREAS = "image int, feature int, part int, ring int, vtx int, x double, y double"


def inside(rings, r, c):
    """On a side, or within an odd number of rings."""
    odd = False
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            cross = (x1 - x0) * (c - y0) - (r - x0) * (y1 - y0)
            if cross == 0 and min(x0, x1) <= r <= max(x0, x1) and min(y0, y1) <= c <= max(y0, y1):
                return True
            if (x0 <= r) != (x1 <= r) and ((x1 > x0) == (cross < 0)) and cross != 0:
                odd = not odd
    return odd


def rows_of(parts):
    return [(0, f, p, k, v, x, y) for (f, p), rings in parts.items() for k, ring in enumerate(rings) for v, (x, y) in enumerate(ring)]


def test_spans(spark):
    """Polygons on a coarse grid, with holes, spikes, flat sides and vertices in lines, against every pixel."""
    rng = random.Random(9)
    parts = {(f, 0): [[(rng.randrange(48) / 4, rng.randrange(48) / 4) for _ in range(rng.randint(3, 7))] for _ in range(rng.randint(1, 2))] for f in range(30)}
    parts[100, 0] = [[(0.0, 0.0), (0.0, 8.0), (8.0, 8.0), (8.0, 0.0)], [(2.0, 2.0), (2.0, 6.0), (6.0, 6.0), (6.0, 2.0)]]
    parts[100, 1] = [[(3.5, 3.5), (3.5, 4.5), (4.5, 4.0)]]
    odd = [(0, 100, 2, 0, 0, None, 1.0), (0, 100, 2, 0, 1, float("nan"), 1.0), (0, 100, 2, 0, 2, float("inf"), 1.0)]
    got: dict = {}
    for s in spans(spark.createDataFrame(rows_of(parts) + odd, AREAS)).collect():
        own = got.setdefault((s.feature, s.part), [])
        own += [(s.r, c) for c in range(s.low, s.high + 1)]
    for key, rings in parts.items():
        want = {(r, c) for r in range(13) for c in range(13) if inside(rings, r, c)}
        assert len(got.get(key, [])) == len(set(got.get(key, []))) and set(got.get(key, [])) == want, key
    assert spans(spark.createDataFrame([], AREAS)).count() == 0


def test_statistics(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(12, 12)) + 1j * rng.normal(size=(12, 12))
    pixels = [(0, r, c, float(z[r, c].real), float(z[r, c].imag)) for r in range(12) for c in range(12)] + [(0, 20, 1, None, 1.0), (1, 3, 3, 1.0, 1.0)]
    parts = {(7, 0): [[(1.0, 1.0), (1.0, 5.0), (6.0, 3.0)]], (7, 1): [[(8.0, 8.0), (8.0, 11.0), (10.0, 8.0)]], (8, 0): [[(30.0, 30.0), (30.0, 31.0), (31.0, 30.0)]]}
    meta = [(0, 5.0, 4.0, None, None, 0.5, 2.0, 1.25, 1.5, [[2.0, 0.1], [0.3, 0.0]], [[1.0]], None, None, [[-10.0, 0.5]])]
    schema = "image int, scp_row double, scp_col double, first_row double, first_col double, row_ss double, col_ss double, row_oversample double, col_oversample double, rcs_sf array<array<double>>, beta_sf array<array<double>>, sigma_sf array<array<double>>, gamma_sf array<array<double>>, noise_db array<array<double>>"
    got = {(r.feature, r.unit): r for r in cross_sections(spark.createDataFrame(pixels, "image int, r int, c int, re double, im double"), spark.createDataFrame(rows_of(parts), AREAS), spark.createDataFrame(meta, schema)).collect()}
    assert set(got) == {(7, "PixelPower"), (7, "RCS"), (7, "BetaZero")}
    at = np.array([(r, c) for p in (0, 1) for r in range(12) for c in range(12) if inside(parts[7, p], r, c)])
    x, y = (at[:, 0] - 5) * 0.5, (at[:, 1] - 4) * 2.0
    power, noise = np.abs(z[at[:, 0], at[:, 1]]) ** 2, 10 ** ((-10 + 0.5 * y) / 10)
    for unit, scale in (("PixelPower", 1.0), ("RCS", 2 + 0.1 * y + 0.3 * x), ("BetaZero", 1.0)):
        r = got[7, unit]
        over = 1.25 * 1.5 if unit == "RCS" else 1.0
        for prefix, v in (("", power * scale), ("noise_", noise * scale)):
            assert np.allclose([r[prefix + n] for n in ("total", "mean", "std", "low", "high")], [v.sum() / over, v.mean(), v.std(), v.min(), v.max()])
        assert r.n == len(at)
