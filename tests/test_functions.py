import math

import pytest
from pyspark.sql import functions as F

from slantframe.functions import collection, geodesy, pixels, polynomials, remap
from slantframe.functions.vectors import Vec
from slantframe.operators import annotation, elevation, inside, planar, raster, rules, spectral

ANCHORS = [(0, 0, 0), (0, 180, 0), (90, 0, 0), (-90, 0, 0), (0, 90, 0), (37.5, -122.25, 1500.0)]


def test_geodetic_round_trip_and_axes(spark):
    df = spark.createDataFrame([tuple(map(float, a)) for a in ANCHORS], "lat0 double, lon0 double, h0 double")
    df = geodesy.geodetic_to_ecf(F.col("lat0"), F.col("lon0"), F.col("h0")).attach(df, "p")
    rows = geodesy.ecf_to_geodetic(df, "p").collect()
    assert abs(rows[0].p_x - 6378137.0) < 1e-6 and abs(rows[2].p_z - 6356752.314245179) < 1e-6
    for r in rows:
        assert abs(r.lat - r.lat0) < 1e-8 and abs(r.hae - r.h0) < 1e-6
        assert abs(r.lat0) == 90 or abs((r.lon - r.lon0 + 180) % 360 - 180) < 1e-8
    at = Vec.literal(6378137.0, 0, 0)
    e = geodesy.ecf_to_enu(Vec.literal(6378138.0, 2, 3), at, F.lit(0.0), F.lit(0.0))
    assert [round(x, 9) for x in spark.range(1).select(e.x, e.y, e.z).first()] == [2, 3, 1]
    assert geodesy.ecf_to_geodetic(spark.createDataFrame([(0.0, 0.0, 0.0)], "p_x double, p_y double, p_z double"), "p").first().lat is None


def test_coordinate_text(spark):
    df = spark.createDataFrame([(10.5,), (-0.25,), (59.9999999,), (0.0,), (None,)], "d double")
    got = [tuple(r) for r in df.select(geodesy.dms_text(F.col("d"), "lat"), geodesy.parse_dms(geodesy.dms_text(F.col("d"), "lat"))).collect()]
    assert got[0] == ("10°30'00\"N", 10.5) and got[1] == ("00°15'00\"S", -0.25) and got[2][0] == "60°00'00\"N" and got[4] == (None, None)
    bad = spark.createDataFrame([("x",), ("1 2 3 4",), ("-12.5",), ("12 30 W",), ("-12 S",)], "t string")
    assert [r[0] for r in bad.select(geodesy.parse_dms(F.col("t"))).collect()] == [None, None, -12.5, -12.5, 12.0]


def test_polynomials(spark):
    c = F.array(*[F.lit(float(x)) for x in (1, 2, 3)])
    row = spark.range(1).select(polynomials.poly1d(c, F.lit(2.0)), polynomials.derivative(c), polynomials.shift(c, F.lit(1.0)), polynomials.trim(F.array(*[F.lit(float(x)) for x in (1, 0, 0)]))).first()
    assert row[0] == 17 and row[1] == [2, 6] and [round(x, 9) for x in row[2]] == [2, -4, 3] and row[3] == [1]


def test_pixels_and_remaps(spark):
    df = spark.createDataFrame([(3.0, 4.0)], "re double, im double")
    amp, angle = pixels.encode_amp_phase(F.col("re"), F.col("im"))
    r = df.select(pixels.magnitude(F.col("re"), F.col("im")), amp, angle).first()
    assert r[0] == 5 and r[1] == 5 and abs(r[2] - math.atan2(4, 3) * 256 / (2 * math.pi)) <= 0.5
    image = spark.createDataFrame([(0, float(i)) for i in range(101)] + [(0, float("inf")), (1, 5.0), (1, 5.0), (2, 0.0)], "image int, amplitude double")
    for name in remap.names():
        for bits in (8, 16):
            rows = remap.get(name, bits)(image, "image").collect()
            assert len(rows) == 105 and all(0 <= r.level < 1 << bits for r in rows)
    levels = {r.amplitude: r.level for r in remap.get("linear")(image, "image").where("image = 0").collect()}
    assert levels[0.0] == 0 and levels[100.0] == 255 and levels[float("inf")] == 255
    with pytest.raises(ValueError):
        remap.register("linear", 8, None)


def test_slices():
    assert raster.check_slice(None, None, None, 5) == (0, 5, 1)
    assert raster.check_slice(None, None, -2, 5) == (4, -1, -2)
    assert raster.check_slice(-3, None, 1, 5) == (2, 5, 1)
    for bad in ((3, 1, 1, 5), (0, 9, 1, 5), (0, 5, 0, 5), (1, 3, -1, 5)):
        with pytest.raises(ValueError):
            raster.check_slice(*bad)


def test_collection_geometry(spark):
    df = spark.createDataFrame([(6378137.0, 0.0, 0.0, 6878137.0, 500000.0, 0.0, 0.0, 0.0, 7500.0)], "scp_x double, scp_y double, scp_z double, arp_x double, arp_y double, arp_z double, vel_x double, vel_y double, vel_z double")
    r = collection.scene_geometry(df).first()
    assert abs(r.graze - 45) < 1e-9 and abs(r.incidence - 45) < 1e-9 and abs(r.doppler_cone - 90) < 1e-9
    assert abs(r.slope - 45) < 1e-9 and abs(r.azimuth - 90) < 1e-9 and r.side_of_track == "L" and abs(r.squint - 90) < 1e-9


def test_polygons(spark):
    square = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 4.0, 0.0), (0, 2, 4.0, 4.0), (0, 3, 0.0, 4.0)], "ring int, vtx int, x double, y double")
    m = planar.ring_measures(square).first()
    assert (m.area, m.perimeter, m.cx, m.cy) == (16, 16, 2, 2)
    points = spark.createDataFrame([(1, 2.0, 2.0), (2, 4.0, 1.0), (3, 5.0, 2.0), (4, 0.0, 0.0), (5, -1.0, 4.0)], "pt_id long, x double, y double")
    assert sorted(r.pt_id for r in inside.points_in_rings(points, square, 1.5).collect()) == [1, 2, 4]
    hole = square.withColumn("x", F.col("x") / 4 + 1.5).withColumn("y", F.col("y") / 4 + 1.5).withColumn("hole", F.lit(1))
    assert sorted(r.pt_id for r in inside.points_in_polygon(points, square, hole, 1.5).collect()) == [2, 4]


def test_elevation_is_exact_on_a_plane(spark):
    posts = spark.createDataFrame([(i, j, i + 1000.0 * j) for i in range(5) for j in range(4)], "ix int, iy int, elev double")
    points = spark.createDataFrame([(1, 1.25, 2.5), (2, 4.0, 3.0), (3, 4.5, 0.0)], "pt_id long, gx double, gy double")
    assert {r.pt_id: r.elev for r in elevation.bilinear(points, posts).collect()} == {1: 2501.25, 2: 3004.0}
    raw = spark.createDataFrame([(0x8005,), (5,)], "v int")
    assert [r[0] for r in raw.select(elevation.sign_magnitude(F.col("v"))).collect()] == [-5, 5]


def test_coherence_of_equal_images_is_one(spark):
    px = spark.createDataFrame([(0, r, c, float(r + 1), float(c - 2), float(r + 1), float(c - 2)) for r in range(5) for c in range(6)], "image int, r int, c int, re_a double, im_a double, re_b double, im_b double")
    assert all(abs(x.coherence - 1) < 1e-12 and abs(x.coherence_phase) < 1e-12 for x in raster.coherence(px, 1).collect())
    a = px.select("image", "r", "c", (F.col("re_a") * 7 + F.col("im_a") * F.col("im_a") * 3).alias("amplitude"))
    moved = a.withColumn("r", F.col("r") - 1)
    best = raster.best_shift(a, moved, 2).first()
    assert (best.dr, best.dc) == (1, 0) and abs(best.score - 1) < 1e-12


def test_spectra(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [1.0, 1.0]), (3, None)], "k long, x array<double>")
    got = {r.k: r.power for r in spectral.spectrum_power(df, "x", "k").collect()}
    assert got == {1: [1, 1, 1, 1], 2: [4, 0], 3: None}
    assert spectral.frames(100, 3, 0.5) == [(0, 50), (25, 75), (50, 100)]
    total = {r.k: r.power for r in spectral.subaperture(df.where("x is not null"), "x", "k", 1, 1.0).collect()}
    assert abs(total[1] - 0.25) < 1e-12 and abs(total[2] - 1) < 1e-12


def test_rules(spark):
    pvp = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 2.0), ("b", 2, 1.0), ("c", 1, None)], "channel string, vector int, TxTime double")
    assert {r.object: r.passed for r in rules.time_monotonic(pvp).collect()} == {"a": True, "b": False}
    links = spark.createDataFrame([("r", "a"), ("a", "b"), ("x", "y")], "parent string, child string")
    spark.sparkContext.setCheckpointDir("/tmp/slantframe-tests")
    nodes = links.select(F.col("parent").alias("id")).union(links.select("child"))
    assert sorted(r.id for r in rules.unreachable(nodes, links, spark.createDataFrame([("r",)], "id string")).collect()) == ["x", "y"]
    assert {r.id: r.path for r in annotation.label_paths(spark, links).collect()} == {"r": "r", "a": "r/a", "b": "r/a/b", "x": "x", "y": "x/y"}


def test_first_tile_among_many(spark):
    """Tiles with the same box, and some that hold whole cells, against all pairs; a point meets one of those, not all."""
    tiles = [(k, (k * 7) % 5, (k * 3) % 4 - 2 + (k % 3) / 2, (k * 3) % 4 + 1.0, (k * 5) % 6 - 3.0, (k * 5) % 6 + (k % 2) / 4) for k in range(1, 60)]
    points = [(i, -2 + (i % 13) / 2, -3.5 + (i // 13) / 2) for i in range(13 * 20)]
    t = spark.createDataFrame(tiles + [(900, 0, None, 1.0, 0.0, 1.0)], "tile int, priority int, lat_low double, lat_high double, lon_low double, lon_high double")
    p = spark.createDataFrame(points, "pt_id int, lat double, lon double")
    want = {}
    for i, lat, lon in points:
        over = [(q, k) for k, q, a, b, c, d in tiles if a <= lat <= b and c <= lon <= d]
        if over:
            want[i] = min(over)[1]
    assert {r.pt_id: r.tile for r in elevation.first_tile(p, t).collect()} == want
    same = spark.createDataFrame([(k, k % 5, -2.0, 3.0, -4.0, 8.0) for k in range(300)], t.schema)
    out = elevation.first_tile(p, same)
    assert {r.tile for r in out.collect()} == {0}
    assert "Aggregate [lat_low#" in out._jdf.queryExecution().optimizedPlan().toString()
