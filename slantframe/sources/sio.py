"""Simple image files: a 20-byte header, optional named values, then lines of samples.

Files are read whole by the binary-file source, which any store that Spark
reaches can serve, and decoded in tasks to one row a line.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: magic number (read big-endian) to byte order and presence of named values.
MAGIC = {0xFF017FFE: (">", False), 0xFE7F01FF: ("<", False), 0xFF027FFD: (">", True), 0xFD7F02FF: ("<", True)}
# Fixed values of the format: (data type, bytes a sample) to the sample's kind.
KINDS = {(1, 1): "u1", (1, 2): "u2", (1, 4): "u4", (2, 1): "i1", (2, 2): "i2", (2, 4): "i4", (3, 4): "f4", (3, 8): "f8", (11, 2): "ci1", (12, 4): "ci2", (12, 2): "ci1", (11, 4): "ci2", (13, 8): "cf4", (13, 16): "cf8"}
SCHEMA = "path string, r int, re array<float>, im array<float>"


class SioError(ValueError):
    """A file that breaks the format."""


def header(data: bytes | memoryview) -> tuple[str, int, int, str, dict[str, bytes], int]:
    """(byte order, lines, samples a line, sample kind, named values, place of the first sample)."""
    if len(data) < 20:
        raise SioError("no header")
    magic = struct.unpack_from(">I", data)[0]
    if magic not in MAGIC:
        raise SioError(f"magic number {magic:#x}")
    order, named = MAGIC[magic]
    lines, samples, kind, size = struct.unpack_from(f"{order}4I", data, 4)
    if (kind, size) not in KINDS:
        raise SioError(f"data type {kind} of {size} bytes")
    at, values = 20, {}
    if named:
        (n,) = struct.unpack_from(f"{order}I", data, at)
        at += 4
        for _ in range(n):
            pair = []
            for _ in range(2):
                (length,) = struct.unpack_from(f"{order}I", data, at)
                pair.append(bytes(data[at + 4 : at + 4 + length]))
                at += 4 + length
            values[pair[0].decode("utf-8")] = pair[1]
    return order, lines, samples, KINDS[kind, size], values, at


def decode(data: bytes | memoryview) -> tuple[np.ndarray, np.ndarray]:
    """(re, im) matrices of a file; im is 0 for real samples."""
    order, lines, samples, kind, _, at = header(data)
    base = np.dtype(order + kind.removeprefix("c"))
    width = 2 if kind[0] == "c" else 1
    if len(data) - at < lines * samples * width * base.itemsize:
        raise SioError("the samples are cut off")
    raw = np.frombuffer(data, dtype=base, count=lines * samples * width, offset=at).reshape(lines, samples, width).astype(np.float32)
    return raw[:, :, 0], raw[:, :, 1] if width == 2 else np.zeros((lines, samples), np.float32)


def encode(re: np.ndarray, im: np.ndarray, values: dict[str, bytes] | None = None) -> bytes:
    """A little-endian file of 32-bit float pairs."""
    named = values or {}
    out = [struct.pack(">I", 0xFD7F02FF if named else 0xFE7F01FF), struct.pack("<4I", re.shape[0], re.shape[1], 13, 8)]
    if named:
        out.append(struct.pack("<I", len(named)))
        for name, value in named.items():
            for x in (name.encode("utf-8"), value):
                out += [struct.pack("<I", len(x)), x]
    out.append(np.stack([re, im], axis=2).astype("<f4").tobytes())
    return b"".join(out)


def read_sio(spark: SparkSession, path: str, rows: tuple[int, int] | None = None) -> DataFrame:
    """(path, r, re, im): a row a line of every file under path; rows bounds the lines that are decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                re, im = decode(memoryview(content.as_buffer()))
                a, b = rows or (0, len(re))
                for x in range(a, min(b, len(re)), 256):
                    y = min(x + 256, b, len(re))
                    lists = [pa.array(list(m[x:y]), pa.list_(pa.float32())) for m in (re, im)]
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * (y - x)), pa.array(np.arange(x, y, dtype=np.int32)), *lists], ["path", "r", "re", "im"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, SCHEMA)


def pixels(lines: DataFrame) -> DataFrame:
    """One row a pixel (path, r, c, re, im) of decoded lines."""
    both = F.posexplode(F.arrays_zip("re", "im")).alias("c", "s")
    return lines.select("path", "r", both).select("path", "r", "c", F.col("s.re").alias("re"), F.col("s.im").alias("im"))


def image_files(lines: DataFrame, key: str = "path") -> DataFrame:
    """(key, content): each image's lines as a file; an image must fit into a task."""
    kind = lines.schema[key].dataType.simpleString()

    def build(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("r").to_numpy(), kind="stable")
        re, im = (np.array([table.column(c)[int(i)].as_py() for i in order], dtype=np.float32) for c in ("re", "im"))
        return pa.table({key: table.column(key).slice(0, 1), "content": pa.array([encode(re, im)], pa.binary())})

    return lines.groupBy(key).applyInArrow(build, f"`{key}` {kind}, content binary")
