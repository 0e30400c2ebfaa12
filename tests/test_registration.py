import numpy as np

from slantframe.operators.registration import correlation, grid_points, register, vote

RNG = np.random.default_rng(8)
WAVES = [(RNG.uniform(0.02, 0.3, 2) * RNG.choice([-1, 1], 2), RNG.uniform(0, 6), RNG.uniform(0.5, 1)) for _ in range(60)]


def ground(r, c):
    """A smooth scene that is known at any place."""
    return sum(a * np.cos(2 * np.pi * (k[0] * r + k[1] * c) + p) for k, p, a in WAVES)


def table(spark, a):
    rows = [(r, c, float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1]) if np.isfinite(a[r, c])]
    return spark.createDataFrame(rows, "r int, c int, value double")


def test_windows():
    r, c = np.meshgrid(np.arange(33.0), np.arange(33.0), indexing="ij")
    for dr, dc in ((0, 0), (3.37, -2.81), (-5.5, 4.02), (0.13, 0.96)):
        y, x = np.meshgrid(np.arange(-8.0, 41), np.arange(-8.0, 41), indexing="ij")
        found = correlation(ground(r, c), 2 * ground(y - dr, x - dc) + 7)
        assert abs(found[0] - dr) < 0.05 and abs(found[1] - dc) < 0.05 and found[2] > 0.85


def test_planted_shifts_on_a_grid(spark):
    """A shift that grows over the image, and a corner that shows something else."""
    r, c = np.meshgrid(np.arange(200.0), np.arange(180.0), indexing="ij")
    dr, dc = 12.3 + 0.01 * r, -9.6 + 0.008 * c
    fixed = ground(r, c)
    # Where a cell of fixed is found in moving: solve for the cell that lies at each place of moving.
    y, x = (r - 12.3) / 1.01, (c + 9.6) / 1.008
    moving = ground(y, x)
    moving[150:, 130:] = RNG.standard_normal(moving[150:, 130:].shape)
    got = register(table(spark, fixed), table(spark, moving), fixed.shape, spacing=24, half=14, reach=20, coarse=2, tile=64).collect()
    good = [g for g in got if g.good]
    assert len(good) > 12
    for g in good:
        assert abs(g.dr - (12.3 + 0.01 * g.r)) < 0.05 and abs(g.dc - (-9.6 + 0.008 * g.c)) < 0.05, g
    assert all(not g.good for g in got if g.r + g.dr > 165 and g.c + g.dc > 145)


def test_votes_and_edges(spark):
    rows = [(k, float(10 * (k % 4)), float(10 * (k // 4)), 1.0, 2.0 + (k == 5) * 9, 1.0) for k in range(16)] + [(99, 900.0, 900.0, 1.0, 2.0, 1.0)]
    got = {r.point: r.good for r in vote(spark.createDataFrame(rows, "point long, r double, c double, dr double, dc double, peak double"), 12.0, 0.5).collect()}
    assert not got[5] and not got[99] and all(v for k, v in got.items() if k not in (5, 99))
    assert grid_points(spark, (10, 10), 5, 8).count() == 0
    flat = table(spark, np.ones((80, 80)))
    assert register(flat, flat, (80, 80), spacing=16, half=8, reach=4, coarse=1).count() == 0
    assert register(flat.limit(0), flat, (80, 80), spacing=16, half=8, reach=4, coarse=1).count() == 0
