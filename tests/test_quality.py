"""Image quality: round trips, limits and null cases."""

import pytest
from pyspark.sql import functions as F

from slantframe.functions import collection, quality


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_rating_and_back(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1e-4, 0.01, 0.5, 3.0, 400.0)], "x double").select("x", quality.density_for_rniirs(collection.rniirs(F.col("x"))).alias("y"))
    assert all(r.y == pytest.approx(r.x) for r in df.collect())


def test_signal_and_noise(spark):
    df = spark.createDataFrame([("V:V", 1.0), ("H:V", 0.25), ("OTHER", 1.0), (None, 1.0)], "p string, want double").select("want", quality.default_signal(F.col("p")).alias("got"))
    assert all(r.want == r.got for r in df.collect())
    got = one(spark, quality.sigma_zero_noise(F.lit(-20.0), F.lit("ABSOLUTE"), F.lit(2.0)), quality.sigma_zero_noise(F.lit(-20.0), F.lit("RELATIVE"), F.lit(2.0)))
    assert got[0] == pytest.approx(0.02) and got[1] is None


def test_steps_end_at_one_sample(spark):
    steps = one(spark, quality.bandwidth_steps(F.lit(40), F.lit(2.0), F.lit(10), F.lit(1.0)))[0]
    assert len(steps) == 20 and steps[0] == (1.0, 1.0) and steps[-1].row == pytest.approx(0.05) and steps[-1].col == pytest.approx(0.1)
    assert one(spark, quality.bandwidth_steps(F.lit(1), F.lit(1.0), F.lit(1), F.lit(1.0)))[0] == [(1.0, 1.0)]


def test_degradation_reaches_what_is_wanted(spark):
    area, signal, noise = F.lit(0.5), F.lit(1.0), F.lit(0.02)
    steps = quality.bandwidth_steps(F.lit(4000), F.lit(1.2), F.lit(3000), F.lit(1.1))
    want = 1.1
    for share in (0.0, 0.3, 1.0):
        d = one(spark, quality.degradation(area, signal, noise, steps, F.lit(want), F.lit(share)).alias("d")).d
        kept = 0.5 * d.row * d.col
        import math

        assert kept * math.log2(1 + 1 / (0.02 * d.noise)) == pytest.approx(want, rel=2e-3)
    assert d.row == d.col == 1.0 and d.noise > 2
    none = lambda density, share: one(spark, quality.degradation(area, signal, noise, steps, F.lit(density), F.lit(share)).alias("d")).d
    assert none(99.0, 0.0) is None and none(0.0, 0.0) is None and none(want, 1.5) is None


def test_span_and_broadening(spark):
    got = one(spark, quality.aperture_span(F.lit(1000), F.lit(1.0), F.lit(0.8), F.lit(0.4)), quality.aperture_span(F.lit(1000), F.lit(1.0), F.lit(0.8), F.lit(0.8)), quality.broadening(F.lit(1.0)), quality.broadening(F.lit(0.5)), quality.broadening(F.lit(0.2)))
    assert got[0] == (300, 700) and got[1] is None
    assert got[2] == pytest.approx(0.88589, abs=1e-5) and got[3] == pytest.approx(1.44, abs=5e-3) and got[4] is None
