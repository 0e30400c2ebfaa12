import math

from pyspark.sql import functions as F

from slantframe.functions import projection
from slantframe.operators.adjustment import adjust_sensors, locate_features
from slantframe.plans.imaging import _images, stereo_images


def tie_points(spark, images, planted):
    pixels = spark.range(160).select("id", (F.col("id") * 37 % 1000).cast("double").alias("row"), (F.col("id") * 53 % 800).cast("double").alias("col"), (F.col("id") % 4).cast("int").alias("image"), (F.col("id") % 9 * 40.0).alias("h"))
    moved = images.withColumns(planted)
    return projection.image_to_hae(pixels.join(moved, "image"), "h", "place").select("image", "row", "col", "place_x", "place_y", "place_z")


def test_planted_offsets(spark):
    """Offsets along an image's axes and of its velocity come back; points with nulls and images without points do no harm."""
    images = _images(spark)
    off = F.col("image") + 1.0
    planted = {f"delta_arp_{a}": F.col(f"urow_{a}") * (off * 9) - F.col(f"ucol_{a}") * 14.0 for a in "xyz"} | {"delta_varp_x": off * 0.05}
    points = tie_points(spark, images, planted)
    odd = spark.createDataFrame([(0, None, 1.0, 1.0, 1.0, 1.0), (1, 1.0, 1.0, None, 1.0, 1.0), (77, 1.0, 1.0, 1.0, 1.0, 1.0)], points.schema)
    found = {r.image: r for r in adjust_sensors(points.unionAll(odd), images.unionByName(images.where("image = 3").withColumn("image", F.lit(9))), unknowns=("row", "col", "varp_x")).collect()}
    want = {r.image: r for r in images.withColumns(planted).collect()}
    assert set(found) == {0, 1, 2, 3, 9}
    for k in range(4):
        assert found[k].n == 40 and found[k].residue < 1e-10 and math.isfinite(found[k].condition)
        for name in ("delta_arp_x", "delta_arp_y", "delta_arp_z"):
            assert abs(found[k][name] - want[k][name]) < 2e-2
        assert abs(found[k].delta_varp_x - want[k].delta_varp_x) < 1e-3
        assert found[k].range_bias == 0
    assert found[9].n == 0 and found[9].residue is None and found[9].delta_arp_x == 0


def test_all_unknowns_project_right(spark):
    """Unknowns that points don't tell apart: what is found isn't what was planted, but places project onto their pixels."""
    images = _images(spark)
    points = tie_points(spark, images, {"delta_arp_x": F.lit(20.0), "delta_arp_z": F.lit(-5.0), "delta_varp_y": F.lit(0.2), "range_bias": F.lit(7.0)})
    found = adjust_sensors(points, images, unknowns=("arp_x", "arp_y", "arp_z", "varp_x", "varp_y", "varp_z", "bias"))
    assert all(r.residue < 1e-6 for r in found.collect())
    back = projection.ground_to_image(points.withColumnsRenamed({"row": "row0", "col": "col0"}).join(images.join(found, "image"), "image"), "place")
    assert all(abs(r.row - r.row0) < 1e-3 and abs(r["col"] - r.col0) < 1e-3 for r in back.collect())


def test_adjustments_in_radial_axes(spark):
    """A shift along radial axes is that shift turned; nothing changes without one."""
    images = _images(spark)
    pixels = spark.range(8).select((F.col("id") % 4).cast("int").alias("image"), (F.col("id") * 90.0).alias("row"), (F.col("id") * 70.0).alias("col"))
    plain = projection.coa_projection(pixels.join(images, "image")).collect()
    for frame in ("RIC_ECF", "RIC_ECI"):
        moved = projection.coa_projection(pixels.join(images.withColumns({"delta_arp_x": F.lit(3.0), "delta_varp_z": F.lit(0.5), "range_bias": F.lit(2.0), "delta_frame": F.lit(frame)}), "image")).collect()
        a, b = ({(r.image, r.row): r for r in rows} for rows in (plain, moved))
        for k, r in a.items():
            shift = [b[k][f"arp_{x}"] - r[f"arp_{x}"] for x in "xyz"]
            turn = [b[k][f"varp_{x}"] - r[f"varp_{x}"] for x in "xyz"]
            assert abs(math.hypot(*shift) - 3) < 1e-6 and abs(math.hypot(*turn) - 0.5) < 1e-6 and abs(b[k].r - r.r - 2) < 1e-6
            place = [r[f"arp_{x}"] for x in "xyz"]
            assert abs(sum(s * p for s, p in zip(shift, place)) / math.hypot(*place) - 3) < 1e-3
            assert abs(sum(s * t for s, t in zip(shift, turn))) < 1e-6


def test_features(spark):
    """Places are found again from the pixels of three tracks; one sight of a feature isn't enough."""
    k = F.col("feature")
    place = {"place_x": 6378137.0 + k % 5 * 30.0, "place_y": k % 7 * 40.0 - 100.0, "place_z": k % 11 * 35.0 - 150.0}
    truth = spark.range(60).select(F.col("id").alias("feature")).withColumns(place)
    images = stereo_images(spark)
    seen = projection.ground_to_image(truth.withColumn("image", F.explode(F.array(*map(F.lit, range(3))))).join(images, "image"), "place").drop("place_x", "place_y", "place_z", "miss")
    odd = seen.where("feature = 0 and image = 0").withColumn("feature", F.lit(1000).cast("long"))
    nulls = seen.where("feature = 1 and image = 0").withColumn("row", F.lit(None).cast("double"))
    found = {r.feature: r for r in locate_features(seen.unionByName(odd).unionByName(nulls)).collect()}
    want = {r.feature: r for r in truth.collect()}
    assert set(found) == set(want)
    for f, r in found.items():
        assert r.n == 3 and r.residue < 1e-4
        assert math.hypot(*(r[c] - want[f][c] for c in place)) < 0.01
    assert locate_features(seen.limit(0)).count() == 0
