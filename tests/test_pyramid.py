import numpy as np
import pytest

from slantframe.operators.pyramid import pyramid


def test_levels_are_means_of_pixels(spark):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((37, 21))
    a[3:9, 4:7] = np.nan
    rows = [(0, r, c, float(a[r, c])) for r in range(37) for c in range(21)] + [(1, 0, 0, 5.0), (1, 1, 1, 7.0), (1, 1, 0, None)]
    got = {}
    for r in pyramid(spark.createDataFrame(rows, "image int, r int, c int, amplitude double"), 8).collect():
        assert (r.tile_r, r.tile_c) == (r.r // 8, r.c // 8)
        got[r.image, r.level, r.r, r.c] = r.amplitude
    assert max(k[1] for k in got) == 3 and {k[2] // 8 for k in got if k[1] == 3} == {0}
    for level in range(4):
        side = 2**level
        for i in range(-(-37 // side)):
            for j in range(-(-21 // side)):
                block = a[i * side : (i + 1) * side, j * side : (j + 1) * side]
                own = got.pop((0, level, i, j), None)
                assert (own is None) == bool(np.isnan(block).all()) and (own is None or abs(own - np.nanmean(block)) < 1e-12)
    assert got == {(1, 0, 0, 0): 5.0, (1, 0, 1, 1): 7.0, (1, 1, 0, 0): 6.0, (1, 2, 0, 0): 6.0, (1, 3, 0, 0): 6.0}


def test_empty_and_negative(spark):
    none = spark.createDataFrame([], "image int, r int, c int, amplitude double")
    assert pyramid(none).count() == 0
    with pytest.raises(ValueError, match="begin at 0"):
        pyramid(spark.createDataFrame([(0, -1, 0, 1.0)], none.schema))
