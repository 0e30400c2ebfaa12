"""Elevation from tiles of one degree kept as TIFF files.

Points are sorted by tile and line across tasks, so a crowded tile is many
tasks' work; a task opens the tiles of its points and reads the lines around
them, by byte ranges.  Neither tiles nor points pass through the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slantframe.sources.ranged import Ranges, files_of, located
from slantframe.sources.tiff import Piece, TiffError, _layout, pages, window_of

#: Lines of a tile that are read at once.
LINES = 64


def tile_name(pattern: str, lat: int, lon: int) -> str:
    """The name of the tile with a south-west corner: {lat} and {lon} are the degrees without their sign, {ns} and {ew} their hemispheres in small letters, {NS} and {EW} in capitals."""
    ns, ew = "ns"[lat < 0], "ew"[lon < 0]
    return pattern.format(lat=abs(lat), lon=abs(lon), ns=ns, ew=ew, NS=ns.upper(), EW=ew.upper())


def tile_corner(pattern: str, path: str) -> tuple[int, int] | None:
    """(latitude, longitude) of the corner that a name says; None for a name that isn't a tile's."""
    parts = re.split(r"(\{(?:lat|lon|ns|ew|NS|EW)(?::[^}]*)?\})", pattern)
    fields = {"lat": r"(?P<lat>\d+)", "lon": r"(?P<lon>\d+)", "ns": "(?P<ns>[ns])", "ew": "(?P<ew>[ew])", "NS": "(?P<NS>[NS])", "EW": "(?P<EW>[EW])"}
    form = "".join(fields[re.split("[:}]", x[1:])[0]] if x.startswith("{") else re.escape(x) for x in parts)
    found = re.search(form + "$", path)
    if not found:
        return None
    got = found.groupdict()
    south, west = (got.get("ns") or got.get("NS") or "n").lower() == "s", (got.get("ew") or got.get("EW") or "e").lower() == "w"
    return -int(got["lat"]) if south else int(got["lat"]), -int(got["lon"]) if west else int(got["lon"])


def write_tiles(posts: DataFrame, folder: str, pattern: str, rows: int, cols: int) -> DataFrame:
    """(path, posts) of the tiles written from posts (tile_lat, tile_lon, r, c, elev), as 32-bit floats in deflated strips.

    r counts from a tile's north edge, c from its west edge; posts that aren't
    there are not numbers, a post that comes twice or lies outside is an
    error.  A task holds a tile of rows by cols posts.  A file gets its name
    when it is whole, so a task that runs again does no harm; files are
    written when the result is read.
    """
    import uuid

    from slantframe.sources.tiff import encode

    def write(table: pa.Table) -> pa.Table:
        lat, lon = (int(table.column(k)[0].as_py()) for k in ("tile_lat", "tile_lon"))
        r, c = (table.column(k).to_numpy().astype(np.int64) for k in ("r", "c"))
        if ((r < 0) | (r >= rows) | (c < 0) | (c >= cols)).any() or len(np.unique(r * cols + c)) < len(r):
            raise ValueError(f"tile {lat}, {lon} has posts outside, or some twice")
        grid = np.full((rows, cols), np.nan, np.float32)
        grid[r, c] = table.column("elev").to_numpy()
        uri = f"{folder.rstrip('/')}/{tile_name(pattern, lat, lon)}"
        system, path = located(uri)
        parent, _, name = path.rpartition("/")
        system.create_dir(parent, recursive=True)
        half = f"{parent}/_{uuid.uuid4().hex}-{name}"
        with system.open_output_stream(half) as out:
            out.write(encode(grid, strip=LINES, deflate=True, numbers={33550: [1 / max(1, cols - 1), 1 / max(1, rows - 1), 0.0], 33922: [0.0, 0.0, 0.0, float(lon), lat + 1.0, 0.0]}))
        system.move(half, path)
        return pa.table({"path": [uri], "posts": pa.array([len(r)], pa.int64())})

    own = posts.where("elev is not null").select(*(F.col(k).cast("int").alias(k) for k in ("tile_lat", "tile_lon", "r", "c")), F.col("elev").cast("double").alias("elev"))
    return own.groupBy("tile_lat", "tile_lon").applyInArrow(write, "path string, posts bigint")


def surface(text: Column) -> Column:
    """The surface that a file's text about its coordinates names: EGM84, EGM96, EGM2008, EGM2020, WGS84, or Unknown."""
    flat = F.regexp_replace(F.upper(text), "[ -]", "")
    out = F.when(flat.contains("EGM84"), "EGM84")
    for name in ("EGM96", "EGM2008", "EGM2020", "WGS84"):
        out = out.when(flat.contains(name), name)
    return out.otherwise("Unknown")


class _Tile:
    """A tile whose lines are read in groups as they are asked for."""

    def __init__(self, uri: str) -> None:
        self.file = Ranges(uri)
        own, reason = _layout(pages(self.file)[0])
        if reason:
            raise TiffError(f"{uri}: {reason}")
        self.uri, self.own, self.kept = uri, own, {}

    def lines(self, k: int) -> np.ndarray:
        """Lines k * LINES and on, one more than LINES, so that a point finds both of its lines in one group."""
        if k not in self.kept:
            own = dict(self.own)
            high, wide = own["block"]
            across = -(-own["width"] // wide)
            first, last = k * LINES, min(own["height"], (k + 1) * LINES + 1)
            a, b = first // high, -(-last // high)
            places, sizes = (own.pop(x).astype(np.int64).reshape(own["planes"], -1, across)[:, a:b].ravel() for x in ("places", "sizes"))
            # Points come line by line, so groups behind them aren't asked for again.
            self.kept = {k: window_of(Piece(self.uri, 0, first, last, a, places=places, sizes=sizes, window=(0, own["width"]), **own), self.file)[:, :, 0]}
        return self.kept[k]

    def at(self, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Linear between the four posts around each place (in posts from the north-west corner)."""
        out = np.empty(len(row))
        r0 = np.minimum(np.floor(row), max(0, self.own["height"] - 2)).astype(np.int64)
        c0 = np.minimum(np.floor(col), max(0, self.own["width"] - 2)).astype(np.int64)
        for k in np.unique(r0 // LINES):
            own = r0 // LINES == k
            x = self.lines(int(k))
            r, c = r0[own] - k * LINES, c0[own]
            below, right = np.minimum(r + 1, len(x) - 1), np.minimum(c + 1, x.shape[1] - 1)
            fr, fc = row[own] - r0[own], col[own] - c
            out[own] = (1 - fr) * ((1 - fc) * x[r, c] + fc * x[r, right]) + fr * ((1 - fc) * x[below, c] + fc * x[below, right])
        return out


def tile_elevations(points: DataFrame, folder: str, pattern: str, key: str = "id", missing: str = "zero", tasks: int | None = None) -> DataFrame:
    """(key, elev): elevation of points (key, lat, lon in degrees) from tiles of one degree, linear between posts.

    Rows of posts go from a tile's north edge to its south edge, columns from
    west to east, edges included.  Longitudes are taken around the earth, the
    north pole belongs to the tiles below it.  Where there is no tile, or its
    post is not a number, the elevation is 0, null (missing="null"), or an
    error (missing="error", tiles only).  Points without finite coordinates,
    or beyond the poles, have null.
    """
    if missing not in ("zero", "null", "error"):
        raise ValueError("missing is zero, null or error")
    kind = points.schema[key].dataType.simpleString()
    lat = F.col("lat").cast("double")
    lon = F.pmod(F.col("lon").cast("double") + 180, F.lit(360.0)) - 180
    ok = F.abs("lat").cast("double").between(0, 90) & (F.abs(F.col("lon").cast("double")) < float("inf"))
    placed = points.select(key, F.when(ok, lat).alias("lat"), F.when(ok, lon).alias("lon")).withColumns({"tile_lat": F.least(F.floor("lat"), F.lit(89)).cast("int"), "tile_lon": F.floor("lon").cast("int")})
    count = tasks or int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["tile_lat", "tile_lon", F.desc("lat")]
    # The coordinates break ties of a crowded place; equal points beyond that stay together, one read serves them.
    dealt = placed.repartitionByRange(count, *order, "lon", key).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_tile: tuple | None = None
        try:
            for batch in batches:
                la, lo = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (1, 2))
                corner = np.stack([batch.column(k).fill_null(-999).to_numpy(zero_copy_only=False) for k in (3, 4)], axis=1)
                out = np.full(len(la), np.nan)
                known = ~np.isnan(la)
                for tile in np.unique(corner[known], axis=0):
                    own = known & (corner == tile).all(axis=1)
                    uri = f"{folder.rstrip('/')}/{tile_name(pattern, int(tile[0]), int(tile[1]))}"
                    if open_tile is None or open_tile[0] != uri:
                        if open_tile and open_tile[1]:
                            open_tile[1].file.file.close()
                        open_tile = (uri, _opened(uri, missing))
                    if open_tile[1]:
                        size = open_tile[1].own
                        out[own] = open_tile[1].at((tile[0] + 1 - la[own]) * (size["height"] - 1), (lo[own] - tile[1]) * (size["width"] - 1))
                if missing != "null":
                    out[known & np.isnan(out)] = 0.0
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, from_pandas=True)], [key, "elev"])
        finally:
            if open_tile and open_tile[1]:
                open_tile[1].file.file.close()

    return dealt.mapInArrow(run, f"`{key}` {kind}, elev double")


def _opened(uri: str, missing: str) -> _Tile | None:
    system, path = located(uri)
    if not system.get_file_info(path).is_file:
        if missing == "error":
            raise FileNotFoundError(uri)
        return None
    return _Tile(uri)


def ellipsoid_and_geoid(elevations: DataFrame, points: DataFrame, posts: DataFrame, spacing: float, reference: str, key: str = "id") -> DataFrame:
    """(key, hae, geoid): elevations (key, elev) above the ellipsoid and above the geoid, whatever surface they refer to.

    reference begins with WGS or EGM; posts and spacing are those of
    ``elevation.geoid_heights``.
    """
    from slantframe.operators.elevation import geoid_heights

    above = reference.upper()[:3]
    if above not in ("WGS", "EGM"):
        raise ValueError(f"elevations above {reference} aren't known")
    met = elevations.join(geoid_heights(points, posts, spacing, key), key, "left")
    hae, geoid = (F.col("elev"), F.col("elev") - F.col("height")) if above == "WGS" else (F.col("elev") + F.col("height"), F.col("elev"))
    return met.select(key, hae.alias("hae"), geoid.alias("geoid"))


def tiles_in(folder: str, pattern: str, box: tuple[float, float, float, float]) -> list[tuple[str, int, int]]:
    """(path, latitude, longitude) of the tiles of a folder that meet a box (south, north, west, east), in order of their corners."""
    south, north, west, east = box
    out = [(f, *c) for f in files_of(folder) if (c := tile_corner(pattern, f)) and np.floor(south) <= c[0] <= np.floor(north) and np.floor(west) <= c[1] <= np.floor(east)]
    return sorted(out, key=lambda x: x[1:])
