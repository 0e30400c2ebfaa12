"""Elevation tiles: fixed-length headers, then a record a longitude line of sign-and-magnitude posts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the format: sizes of the headers and of what surrounds a record's posts, and the mark of a missing post.
UHL, DSI, ACC, BEFORE, AFTER, MISSING = 80, 648, 2700, 8, 4, -32767


class DtedError(ValueError):
    """A tile that breaks the format."""


def _degrees(text: bytes) -> float:
    """DDDMMSSH as degrees."""
    value = int(text[:3]) + int(text[3:5]) / 60 + int(text[5:7]) / 3600
    return -value if text[7:8] in (b"S", b"W") else value


def decode(data: bytes | memoryview) -> tuple[float, float, float, float, np.ndarray]:
    """(longitude and latitude of the corner, their steps in degrees, posts by longitude and latitude; missing posts are NaN)."""
    head = bytes(data[:UHL])
    if head[:4] != b"UHL1":
        raise DtedError("no UHL1 header")
    lon, lat = _degrees(head[4:12]), _degrees(head[12:20])
    steps = int(head[20:24]) / 36000, int(head[24:28]) / 36000
    lines, posts = int(head[47:51]), int(head[51:55])
    size = BEFORE + 2 * posts + AFTER
    at = UHL + DSI + ACC
    if len(data) < at + lines * size:
        raise DtedError("the posts are cut off")
    raw = np.frombuffer(data, dtype=np.uint8, count=lines * size, offset=at).reshape(lines, size)
    if (raw[:, 0] != 0xAA).any():
        raise DtedError("a record without its mark")
    own = raw[:, BEFORE : BEFORE + 2 * posts].copy().view(">u2").astype(np.int32)
    values = np.where(own & 0x8000, -(own & 0x7FFF), own)
    return lon, lat, steps[0], steps[1], np.where(values == MISSING, np.nan, values.astype(np.float64))


def encode(lon: int, lat: int, posts: np.ndarray) -> bytes:
    """A one-degree tile of whole metres with its corner at a whole degree."""
    lines, n = posts.shape
    corner = lambda x, ends: f"{abs(x):03d}0000{ends[x < 0]}".encode()
    step = lambda k: f"{round(36000 / (k - 1)):04d}".encode()
    head = b"UHL1" + corner(lon, "EW") + corner(lat, "NS") + step(lines) + step(n)
    head = head.ljust(47, b" ") + f"{lines:04d}{n:04d}".encode()
    whole = np.where(np.isnan(posts), MISSING, posts).astype(np.int64)
    raw = np.where(whole < 0, 0x8000 | -whole, whole).astype(">u2")
    body = b"".join(b"\xaa" + k.to_bytes(3, "big") + k.to_bytes(2, "big") + b"\0\0" + raw[k].tobytes() + b"\0\0\0\0" for k in range(lines))
    return head.ljust(UHL, b" ") + b" " * (DSI + ACC) + body


def read_dted(spark: SparkSession, path: str) -> DataFrame:
    """(path, tile_lat, tile_lon, ix, iy, lat, lon, elev): a row a post; missing posts have a null elevation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                lon, lat, dx, dy, posts = decode(memoryview(content.as_buffer()))
                for x in range(len(posts)):
                    n = posts.shape[1]
                    iy = np.arange(n, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name.as_py()] * n), pa.array(np.full(n, lat)), pa.array(np.full(n, lon)), pa.array(np.full(n, x, dtype=np.int32)), pa.array(iy), pa.array(lat + dy * iy), pa.array(np.full(n, lon + dx * x)), pa.array(posts[x], from_pandas=True)],
                        ["path", "tile_lat", "tile_lon", "ix", "iy", "lat", "lon", "elev"],
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, tile_lat double, tile_lon double, ix int, iy int, lat double, lon double, elev double")
