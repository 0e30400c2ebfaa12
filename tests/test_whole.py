"""Queries that leave no part of their input out."""

from pyspark.sql import functions as F

from slantframe.plans import catalogue
from slantframe.plans import views as v

SF = "/root/testdata/sf0.001"


def _run(spark, name):
    return catalogue.queries()[name](spark, SF)


def test_mosaic_has_every_pixel(spark):
    pixels = v.px(spark, SF).select("image", "r", "c")
    got = _run(spark, "q_block_mosaic_whole")
    assert got.count() == pixels.select("image").distinct().count() * 264 * 10
    assert pixels.join(got, ["image", "r", "c"], "left_anti").count() == 0


def test_spectrum_has_every_bin(spark):
    vectors = v.table(spark, SF, "embeddings")
    got = _run(spark, "q_dft_spectrum")
    assert got.count() == vectors.select(F.sum(F.size("embedding"))).first()[0]
    # Parseval: the bins' mean power is the sum of squares.
    power = {r.vec_id: r.p for r in got.groupBy("vec_id").agg((F.sum("power") / 64).alias("p")).collect()}
    for r in vectors.collect():
        assert abs(power[r.vec_id] - sum(x * x for x in r.embedding)) < 1e-4
