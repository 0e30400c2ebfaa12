"""TIFF files and elevation tiles made here, read back by byte ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slantframe.operators import dem_tiles
from slantframe.sources import tiff
from slantframe.sources.ranged import Ranges

RNG = np.random.default_rng(3)
IMAGES = {
    "u1": (RNG.integers(0, 255, (33, 21)).astype("u1"), {}),
    "u2_big_endian_strips": (RNG.integers(0, 60000, (33, 21)).astype("u2"), {"order": ">", "strip": 7}),
    "i2_bands_tiles": (RNG.integers(-9000, 9000, (33, 21, 3)).astype("i2"), {"tile": (16, 16)}),
    "f4_deflated": (RNG.normal(size=(33, 21)).astype("f4"), {"strip": 10, "deflate": True}),
    "u2_predicted": (RNG.integers(0, 60000, (33, 21, 2)).astype("u2"), {"strip": 10, "deflate": True, "predictor": 2}),
    "f8_big": (RNG.normal(size=(33, 21)), {"big": True, "tile": (32, 16), "deflate": True}),
    "c8": ((RNG.normal(size=(33, 21)) + 1j * RNG.normal(size=(33, 21))).astype("c8"), {"order": ">", "big": True}),
}


def bands(image):
    x = image if image.ndim == 3 else image[:, :, None]
    if np.iscomplexobj(x):
        x = np.stack([x.real, x.imag], axis=3).reshape(*x.shape[:2], -1)
    return x.astype(float).transpose(0, 2, 1)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("tiff")
    for name, (image, how) in IMAGES.items():
        (path / f"{name}.tif").write_bytes(tiff.encode(image, **how))
    return str(path)


def test_all_forms(spark, folder):
    rows = tiff.read_tiff(spark, folder).orderBy("path", "r").collect()
    for name, (image, _) in IMAGES.items():
        own = [r for r in rows if r.path.endswith(f"/{name}.tif")]
        assert np.array_equal(np.array([r.bands for r in own]), bands(image)), name


def test_window(spark, folder):
    rows = tiff.read_tiff(spark, folder, cols=(14, 19)).where("r between 9 and 17").orderBy("path", "r").collect()
    for name, (image, _) in IMAGES.items():
        own = [r for r in rows if r.path.endswith(f"/{name}.tif")]
        assert [r.r for r in own] == list(range(9, 18)) and {r.c0 for r in own} == {14}
        assert np.array_equal(np.array([r.bands for r in own]), bands(image)[9:18, :, 14:19]), name
    assert tiff.read_tiff(spark, folder).where("r > 900").count() == 0


def test_window_of_a_large_file_reads_its_lines_only(spark, tmp_path):
    rows, cols, high = 60_000, 50_000, 500
    data = tiff.encode(np.zeros((1, 1), "f4"), big=True)
    layout, reason = tiff._layout({0: "<", 256: [cols], 257: [rows], 258: [32], 277: [1], 278: [high], 339: [3], 273: 4096 + np.arange(rows // high) * (high * cols * 4), 279: np.full(rows // high, high * cols * 4)})
    assert reason is None and len(data) < 4096
    path = tmp_path / "large.tif"
    line = np.arange(cols, dtype="<f4")
    with open(path, "wb") as f:
        f.seek(4096 + 31_234 * cols * 4)
        f.write(line.tobytes())
        f.truncate(4096 + rows * cols * 4)
    reader = tiff._LineReader({"path": str(path)})
    reader.bounds.low["r"] = reader.bounds.high["r"] = 31_234
    (piece,) = reader._cut(str(path), 0, {0: "<", 256: [cols], 257: [rows], 258: [32], 277: [1], 278: [high], 339: [3], 273: layout["places"], 279: layout["sizes"]})
    with Ranges(str(path)) as file:
        got = tiff.window_of(piece, file)
        assert file.taken == cols * 4 and np.array_equal(got[0, :, 0], line)


def test_packed_bytes():
    assert tiff._unpacked(bytes([2, 7, 8, 9, 254, 5, 128, 0, 1])) == bytes([7, 8, 9, 5, 5, 5, 1])


def test_undecodable_has_a_reason(spark, tmp_path):
    data = bytearray(tiff.encode(np.zeros((4, 4), "u1")))
    at = data.index(b"\x03\x01\x03\x00\x01\x00\x00\x00\x01")
    data[at + 8] = 5
    (tmp_path / "a.tif").write_bytes(bytes(data))
    (row,) = tiff.read_tiff(spark, str(tmp_path)).collect()
    assert row.bands is None and row.reason == "compression 5"


def test_breaks_of_the_format(tmp_path):
    good = tiff.encode(np.zeros((4, 4), "u1"))
    for name, data in (("head", b"GIF89a" + good), ("cut", good[:-20]), ("none", b"")):
        (tmp_path / name).write_bytes(data)
        with Ranges(str(tmp_path / name)) as file, pytest.raises(tiff.TiffError):
            tiff.pages(file)


def test_tags(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(tiff.encode(np.zeros((4, 6), "u1"), texts={34737: "WGS 84 / EGM-2008|"}, numbers={33550: [0.5, 0.25, 0.0]}))
    tags = {r.name: r for r in tiff.read_tags(spark, str(tmp_path)).collect()}
    assert tags["ImageWidth"].numbers == [6.0] and tags["ModelPixelScaleTag"].numbers == [0.5, 0.25, 0.0] and tags["GeoAsciiParamsTag"].text == "WGS 84 / EGM-2008|"
    names = spark.createDataFrame([("WGS 84|",), ("x EGM-2008",), ("egm96",), (None,)], "t string").select(dem_tiles.surface(F.col("t")).alias("s"))
    assert [r.s for r in names.collect()] == ["WGS84", "EGM2008", "EGM96", "Unknown"]


PATTERN = "{ns}{lat:02d}{EW}{lon:03d}.tif"


def test_names_and_corners():
    for corner in ((0, 0), (-1, -180), (89, 179), (-90, 12)):
        assert dem_tiles.tile_corner(PATTERN, "x/y/" + dem_tiles.tile_name(PATTERN, *corner)) == corner
    assert dem_tiles.tile_corner(PATTERN, "x/readme.tif") is None


@pytest.fixture(scope="module")
def tiles(tmp_path_factory):
    folder = tmp_path_factory.mktemp("dem")
    grids = {c: RNG.normal(100, 30, (200, 151)).astype("f4") for c in ((10, 20), (10, 21), (-1, -180), (89, 5))}
    for c, grid in grids.items():
        (folder / dem_tiles.tile_name(PATTERN, *c)).write_bytes(tiff.encode(grid, strip=33, deflate=c[0] > 0))
    return str(folder), grids


def brute(grids, lat, lon):
    if lat is None or lon is None or not abs(lat) <= 90:
        return None
    lon = (lon + 180) % 360 - 180
    c = (min(int(np.floor(lat)), 89), int(np.floor(lon)))
    if c not in grids:
        return 0.0
    g = grids[c].astype(float)
    y, x = (c[0] + 1 - lat) * (g.shape[0] - 1), (lon - c[1]) * (g.shape[1] - 1)
    i, j = min(int(y), g.shape[0] - 2), min(int(x), g.shape[1] - 2)
    fy, fx = y - i, x - j
    return (g[i, j] * (1 - fx) + g[i, j + 1] * fx) * (1 - fy) + (g[i + 1, j] * (1 - fx) + g[i + 1, j + 1] * fx) * fy


def test_elevations(spark, tiles):
    folder, grids = tiles
    rng = np.random.default_rng(1)
    points = [(10 + float(a), 20 + 2 * float(b)) for a, b in rng.random((500, 2))] + [(10.0, 20.0), (11.0, 20.5), (10.5, 21.0), (-0.25, 180.0), (-0.25, 539.5), (90.0, 5.25), (50.0, 50.0), (None, 1.0), (91.0, 5.0), (float("nan"), 1.0)] + [(10.5, 20.5)] * 300
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "id long, lat double, lon double")
    got = {r.id: r.elev for r in dem_tiles.tile_elevations(df, folder, PATTERN, tasks=5).collect()}
    assert len(got) == len(points)
    for k, p in enumerate(points):
        want = brute(grids, *p)
        assert got[k] == (want if want is None else pytest.approx(want, abs=1e-6)), p
    null = {r.id: r.elev for r in dem_tiles.tile_elevations(df, folder, PATTERN, missing="null").collect()}
    assert null[506] is None and null[0] == got[0]
    with pytest.raises(Exception, match="FileNotFound"):
        dem_tiles.tile_elevations(df, folder, PATTERN, missing="error").collect()
    assert dem_tiles.tile_elevations(df.limit(0), folder, PATTERN).collect() == []


def test_tiles_of_a_box(tiles):
    folder, _ = tiles
    assert [x[1:] for x in dem_tiles.tiles_in(folder, PATTERN, (9.5, 10.2, 20.5, 21.0))] == [(10, 20), (10, 21)]


def test_surfaces(spark):
    posts = spark.range(37 * 72).select((F.col("id") % 72).cast("int").alias("ix"), (F.col("id") / 72).cast("int").alias("iy"), F.lit(30.0).alias("elev"))
    points = spark.createDataFrame([(1, 10.0, 20.0)], "id int, lat double, lon double")
    elev = spark.createDataFrame([(1, 100.0)], "id int, elev double")
    for reference, want in (("EGM2008", (130.0, 100.0)), ("WGS84", (100.0, 70.0))):
        row = dem_tiles.ellipsoid_and_geoid(elev, points, posts, 5.0, reference).first()
        assert (row.hae, row.geoid) == pytest.approx(want)
    with pytest.raises(ValueError):
        dem_tiles.ellipsoid_and_geoid(elev, points, posts, 5.0, "NAVD88")


def test_written_tiles(spark, tmp_path):
    grid = RNG.normal(size=(70, 9)).astype("f4")
    rows = [(3, -4, r, c, float(grid[r, c])) for r in range(70) for c in range(9) if (r, c) != (5, 5)]
    posts = spark.createDataFrame(rows, "tile_lat int, tile_lon int, r int, c int, elev double")
    (done,) = dem_tiles.write_tiles(posts, str(tmp_path / "new"), PATTERN, 70, 9).collect()
    assert done.posts == 629 and done.path.endswith("n03W004.tif")
    got = np.array([r.bands[0] for r in tiff.read_tiff(spark, done.path).orderBy("r").collect()])
    grid[5, 5] = np.nan
    assert np.array_equal(got, grid.astype(float), equal_nan=True)
    with pytest.raises(Exception, match="twice"):
        dem_tiles.write_tiles(posts.unionAll(posts.limit(1)), str(tmp_path / "new"), PATTERN, 70, 9).collect()
