import json

import numpy as np
from pyspark.sql import functions as F

from slantframe.functions import projection
from slantframe.functions.scenes import Scene, dot, geodetic
from slantframe.operators.terrain import PostGrid, Raster, image_to_dem
from slantframe.plans.imaging import _images

GRID = PostGrid(-0.2, -0.2, 0.004, 0.004)


def ridges(n=101):
    ix, iy = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    elev = 80 + 60 * ((ix * 3 + iy * 5) % 7 == 0) + 0.3 * ix
    return ix.ravel(), iy.ravel(), elev.ravel().astype(float)


def test_first_meeting_from_above(spark):
    """Against a dense search: a metre apart in height, over every ridge of one post."""
    ix, iy, elev = ridges()
    raster = Raster(ix, iy, elev)
    posts = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(ix, iy, elev)], "ix int, iy int, elev double")
    images = _images(spark)
    pixels = spark.range(240).select("id", (F.col("id") * 37 % 1000).cast("double").alias("row"), (F.col("id") * 53 % 800).cast("double").alias("col"), (F.col("id") % 4).cast("int").alias("image")).join(images, "image")
    pixels = pixels.unionByName(pixels.where("id < 4").withColumns({"id": F.col("id") + 1000, "row": F.lit(None).cast("double")}))
    got = {r.id: np.array([r.at_x, r.at_y, r.at_z]) for r in image_to_dem(pixels, posts, GRID, (0.0, 250.0, 6), tile=16, crowd=20).collect()}
    scenes = {r.image: Scene(json.loads(r.s)) for r in images.select("image", projection.packed(images).alias("s")).collect()}
    rows = pixels.where("row is not null").select("id", "image", "row", "col").collect()
    assert set(got) == {r.id for r in rows}
    levels = np.arange(250.0, -1.0, -0.25)
    for r in rows:
        s = scenes[r.image]
        n = len(levels)
        line = s.to_height(np.full(n, r.row), np.full(n, r["col"]), levels)
        over = levels - raster.bilinear(*GRID.at(line))
        k = int(np.argmax(over <= 0))
        lat, lon, height = geodetic(got[r.id][:, None])
        assert levels[k] - 0.01 <= height[0] <= levels[k - 1] + 0.01
        assert abs(height[0] - raster.bilinear(*GRID.at(got[r.id][:, None]))[0]) < 0.01
        _, rng, rdot, arp, varp = s.coa(np.array([r.row]), np.array([r["col"]]))
        back = arp - got[r.id][:, None]
        assert abs(np.sqrt(dot(back, back)) - rng)[0] < 1e-3 and abs(dot(varp, back) / rng - rdot)[0] < 1e-3


def test_pixels_that_miss(spark):
    posts = spark.createDataFrame([(0, 0, 1.0), (1, 1, 2.0)], "ix int, iy int, elev double")
    pixels = spark.range(3).select("id", F.lit(0.0).alias("row"), F.lit(0.0).alias("col"), F.lit(0).alias("image")).join(_images(spark), "image")
    assert image_to_dem(pixels, posts, PostGrid(50.0, 50.0, 0.01, 0.01), (0.0, 10.0, 3)).count() == 0
    assert image_to_dem(pixels.limit(0), posts, GRID, (0.0, 10.0, 3)).count() == 0


def test_round_trip_and_missing_values(spark):
    images = _images(spark)
    pixels = spark.range(40).select("id", (F.col("id") * 31 % 1000).cast("double").alias("row"), (F.col("id") * 57 % 800).cast("double").alias("col"), (F.col("id") % 4).cast("int").alias("image"), (F.col("id") * 100.0).alias("h")).join(images, "image")
    there = projection.image_to_hae(pixels, "h", "p").withColumnsRenamed({"row": "row0", "col": "col0"})
    back = projection.ground_to_image(there, "p").collect()
    assert all(abs(r.row - r.row0) < 1e-4 and abs(r["col"] - r.col0) < 1e-4 and r.miss < 1e-4 for r in back)
    odd = pixels.withColumns({"kind": F.when(F.col("id") % 2 == 0, "OTHER"), "h": F.lit(None).cast("double")})
    assert all(r.r is None and r.time_coa_at is not None for r in projection.coa_projection(odd).collect())
    assert all(r.p_x is None for r in projection.image_to_hae(pixels.withColumn("h", F.lit(None).cast("double")), "h", "p").collect())


def test_crowded_tiles_are_broadcast(spark):
    """Pixels of a crowded tile aren't gathered in one task to learn how many copies it has."""
    ix, iy, elev = ridges(21)
    posts = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(ix, iy, elev)], "ix int, iy int, elev double")
    pixels = spark.range(60).select("id", (F.col("id") * 37 % 1000).cast("double").alias("row"), (F.col("id") * 53 % 800).cast("double").alias("col"), (F.col("id") % 4).cast("int").alias("image")).join(_images(spark), "image")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = image_to_dem(pixels, posts, GRID, (0.0, 250.0, 6), crowd=20)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin [tx#" in plan


def test_workers_get_no_column_they_dont_need(spark):
    """Neither an image's metadata nor a pixel's other columns pass the workers beside the text of the metadata."""
    pixels = spark.range(8).select("id", F.lit(1.0).alias("row"), F.lit(2.0).alias("col"), (F.col("id") % 4).cast("int").alias("image")).join(_images(spark), "image")
    out = projection.image_to_hae(pixels.withColumn("h", F.lit(10.0)), "h").select("id", "at_x").where("at_x is not null")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1 and out.count() == 8
