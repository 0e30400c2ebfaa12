"""Phase history files and files of received signals (1.x) by byte ranges: parameters as typed columns, samples of a window, support arrays.

Filters on path, channel and vector decide which bytes are read.  Whole numbers
stay whole numbers: a parameter's column has its own type, unsigned 64-bit ones
are decimals.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from slantframe.sources.cphd import HEADER, SCALARS, SIGNALS, CphdError, _parameters, _tree
from slantframe.sources.ranged import RangedReader, Ranges, files_of, registered

#: Bytes that one piece reads at most, but for a single vector.
PIECE = 64 << 20
# Column types of the format's scalars.
TYPES = {">f8": ("double", pa.float64()), ">f4": ("float", pa.float32()), ">i8": ("bigint", pa.int64()), ">i4": ("int", pa.int32()), ">i2": ("smallint", pa.int16()), ">i1": ("tinyint", pa.int8()), ">u8": ("decimal(20,0)", pa.decimal128(20, 0)), ">u4": ("bigint", pa.int64()), ">u2": ("int", pa.int32()), ">u1": ("smallint", pa.int16())}


def head(file: Ranges) -> tuple[dict[str, str], ET.Element]:
    """(header lines by name, root of the XML) from their own bytes alone."""
    lines, end, _ = file.read(0, HEADER).partition(b"\f\n")
    if not lines.startswith((b"CPHD/1", b"CRSD/1")) or not end:
        raise CphdError("no file header")
    values = dict(x.split(" := ", 1) for x in lines.decode("utf-8").splitlines() if " := " in x)
    return values, _tree(file.read(int(values["XML_BLOCK_BYTE_OFFSET"]), int(values["XML_BLOCK_SIZE"])).decode("utf-8"))


@dataclass
class Vectors(InputPartition):
    """Vectors of a channel whose records lie one after the other."""

    path: str
    channel: str
    at: int
    width: int
    first: int
    last: int
    detail: tuple


class _VectorReader(RangedReader):
    """Plans pieces of each channel's records."""

    def records(self, values: dict[str, str], root: ET.Element, channel: ET.Element) -> tuple[int, int, tuple]:
        """(place of a channel's first record, bytes a record, what reading needs besides)."""
        raise NotImplementedError

    def pieces(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.files():
            with Ranges(path) as file:
                values, root = head(file)
                for channel in root.findall("Data/Channel"):
                    name = channel.findtext("Identifier")
                    if not self.bounds.has("channel", name):
                        continue
                    at, width, detail = self.records(values, root, channel)
                    n = int(channel.findtext("NumVectors"))
                    if at + n * width > file.size:
                        raise CphdError(f"channel {name} is cut off")
                    a, b = self.bounds.span("vector", 0, n)
                    step = max(1, PIECE // max(1, width))
                    out += [Vectors(path, name, at, width, x, min(b, x + step), detail) for x in range(a, b, step)]
        return out

    def heading(self, piece: Vectors, a: int, b: int) -> list[pa.Array]:
        return [pa.array([piece.path] * (b - a)), pa.array([piece.channel] * (b - a)), pa.array(np.arange(a, b, dtype=np.int32))]


def _chosen(root: ET.Element, names: str | None) -> list[tuple[str, int, str]]:
    found, _ = _parameters(root)
    if not names:
        return found
    by = {n.lower(): (n, at, kind) for n, at, kind in found}
    missing = [n for n in names.split(",") if n.lower() not in by]
    if missing:
        raise CphdError(f"no parameter {', '.join(missing)}")
    return [by[n.lower()] for n in names.split(",")]


class _PvpReader(_VectorReader):
    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.names = options.get("names")

    def records(self, values, root, channel):
        return int(values["PVP_BLOCK_BYTE_OFFSET"]) + int(channel.findtext("PVPArrayByteOffset")), int(root.findtext("Data/NumBytesPVP")), tuple(_chosen(root, self.names))

    def read(self, piece: Vectors) -> Iterator[pa.RecordBatch]:
        if not isinstance(piece, Vectors):
            return
        with Ranges(piece.path) as file:
            for a in range(piece.first, piece.last, 8192):
                b = min(piece.last, a + 8192)
                raw = np.frombuffer(file.read(piece.at + a * piece.width, (b - a) * piece.width), np.uint8).reshape(b - a, piece.width)
                columns = []
                for _, place, kind in piece.detail:
                    x = raw[:, place : place + np.dtype(kind).itemsize].copy().view(kind)[:, 0]
                    columns.append(pa.array([Decimal(int(v)) for v in x], TYPES[kind][1]) if kind == ">u8" else pa.array(x.astype(x.dtype.newbyteorder("="))).cast(TYPES[kind][1]))
                yield pa.RecordBatch.from_arrays([*self.heading(piece, a, b), *columns], ["path", "channel", "vector", *(n for n, _, _ in piece.detail)])


class CphdPvp(DataSource):
    """Format cphd_pvp: options path and names (parameters, separated by commas); columns are those of the first file."""

    @classmethod
    def name(cls) -> str:
        return "cphd_pvp"

    def schema(self) -> str:
        files = files_of(self.options["path"])
        if not files:
            raise CphdError("no files")
        with Ranges(files[0]) as file:
            _, root = head(file)
        return ", ".join(["path string, channel string, vector int", *(f"`{n}` {TYPES[kind][0]}" for n, _, kind in _chosen(root, self.options.get("names")))])

    def reader(self, schema) -> DataSourceReader:
        return _PvpReader(self.options)


class _SignalReader(_VectorReader):
    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.samples = tuple(int(x) for x in options["samples"].split(":")) if options.get("samples") else None
        self.scaled = options.get("scaled") == "true"

    def records(self, values, root, channel):
        if root.find("Data/SignalCompressionID") is not None:
            raise CphdError("the signal is compressed")
        kind = root.findtext("Data/SignalArrayFormat")
        if kind not in SIGNALS:
            raise CphdError(f"signal format {kind}")
        n = int(channel.findtext("NumSamples"))
        low, high = self.samples or (0, n)
        return int(values["SIGNAL_BLOCK_BYTE_OFFSET"]) + int(channel.findtext("SignalArrayByteOffset")), n * 2 * np.dtype(SIGNALS[kind]).itemsize, (SIGNALS[kind], max(0, low), max(0, low, min(n, high)), self._scale(values, root, channel))

    def _scale(self, values, root, channel) -> tuple[int, int, int, str] | None:
        """(place of a channel's first parameters, bytes a vector, place of the amplitude factor in them, its kind)."""
        own = [(at, kind) for name, at, kind in _parameters(root)[0] if name == "AmpSF"] if self.scaled else []
        return (int(values["PVP_BLOCK_BYTE_OFFSET"]) + int(channel.findtext("PVPArrayByteOffset")), int(root.findtext("Data/NumBytesPVP")), *own[0]) if own else None

    def read(self, piece: Vectors) -> Iterator[pa.RecordBatch]:
        if not isinstance(piece, Vectors):
            return
        kind, low, high, scale = piece.detail
        size, count = 2 * np.dtype(kind).itemsize, 2 * (high - low)
        # A narrow window is read vector by vector, a wide one with what lies between.
        narrow = 4 * count * np.dtype(kind).itemsize < piece.width
        step = max(1, (4 << 20) // max(1, piece.width))
        with Ranges(piece.path) as file:
            for a in range(piece.first, piece.last, step):
                b = min(piece.last, a + step)
                if narrow:
                    raw = np.stack([np.frombuffer(file.read(piece.at + v * piece.width + low * size, (high - low) * size), kind) for v in range(a, b)])
                else:
                    raw = np.frombuffer(file.read(piece.at + a * piece.width, (b - a) * piece.width), kind).reshape(b - a, -1)[:, 2 * low : 2 * high]
                pairs = raw.reshape(b - a, -1, 2).astype(np.float32)
                if scale:
                    start, width, at, of = scale
                    factors = np.frombuffer(file.read(start + a * width, (b - a) * width), np.uint8).reshape(b - a, width)[:, at : at + np.dtype(of).itemsize].copy().view(of)
                    pairs = pairs * factors.astype(np.float32)[:, :, None]
                offsets = pa.array(np.arange(b - a + 1, dtype=np.int32) * (high - low))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(pairs[:, :, k]).ravel())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*self.heading(piece, a, b), *lists], ["path", "channel", "vector", "re", "im"])


class CphdSignal(DataSource):
    """Format cphd_signal: options path, samples (first:behind), and scaled (true: times the amplitude factor)."""

    @classmethod
    def name(cls) -> str:
        return "cphd_signal"

    def schema(self) -> str:
        return "path string, channel string, vector int, re array<float>, im array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _SignalReader(self.options)


@dataclass
class ArrayRows(InputPartition):
    path: str
    identifier: str
    at: int
    cols: int
    first: int
    last: int
    parts: tuple


class _SupportReader(RangedReader):
    def pieces(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.files():
            with Ranges(path) as file:
                values, root = head(file)
                forms = {e.findtext("Identifier"): e.findtext("ElementFormat") for e in (root.find("SupportArray") if root.find("SupportArray") is not None else ())}
                for e in root.findall("Data/SupportArray"):
                    name = e.findtext("Identifier")
                    if not self.bounds.has("identifier", name):
                        continue
                    form = forms.get(name) or ""
                    parts = tuple((p or "value", SCALARS[k]) for p, k in (re.findall(r"(\w+)=(\w+);", form) or [("", form)]) if k in SCALARS)
                    rows, cols, size = (int(e.findtext(k)) for k in ("NumRows", "NumCols", "BytesPerElement"))
                    if sum(np.dtype(k).itemsize for _, k in parts) != size:
                        raise CphdError(f"support array {name} has elements of format {form!r}")
                    at = int(values["SUPPORT_BLOCK_BYTE_OFFSET"]) + int(e.findtext("ArrayByteOffset"))
                    if at + rows * cols * size > file.size:
                        raise CphdError(f"support array {name} is cut off")
                    a, b = self.bounds.span("r", 0, rows)
                    step = max(1, PIECE // max(1, cols * size))
                    out += [ArrayRows(path, name, at, cols, x, min(b, x + step), parts) for x in range(a, b, step)]
        return out

    def read(self, piece: ArrayRows) -> Iterator[tuple]:
        if isinstance(piece, ArrayRows):
            kind = np.dtype([(n, k) for n, k in piece.parts])
            with Ranges(piece.path) as file:
                for r in range(piece.first, piece.last):
                    row = np.frombuffer(file.read(piece.at + r * piece.cols * kind.itemsize, piece.cols * kind.itemsize), kind)
                    for part, _ in piece.parts:
                        yield piece.path, piece.identifier, r, part, row[part].astype(float).tolist()


class CphdSupport(DataSource):
    """Format cphd_support: option path."""

    @classmethod
    def name(cls) -> str:
        return "cphd_support"

    def schema(self) -> str:
        return "path string, identifier string, r int, part string, values array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _SupportReader(self.options)


def read_pvp(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """(path, channel, vector and the named parameters, or all): a row a vector; parts of places are <name>_x and so on."""
    registered(spark, CphdPvp)
    read = spark.read.format("cphd_pvp").option("path", path)
    return (read.option("names", ",".join(names)) if names else read).load()


def read_signal(spark: SparkSession, path: str, samples: tuple[int, int] | None = None, scaled: bool = False) -> DataFrame:
    """(path, channel, vector, re, im): samples first:behind of every vector, as stored or times the vector's amplitude factor (AmpSF) where files have one."""
    registered(spark, CphdSignal)
    read = spark.read.format("cphd_signal").option("path", path).option("scaled", str(scaled).lower())
    return (read.option("samples", f"{samples[0]}:{samples[1]}") if samples else read).load()


def read_support(spark: SparkSession, path: str) -> DataFrame:
    """(path, identifier, r, part, values): a row a line of every support array and part of its elements."""
    registered(spark, CphdSupport)
    return spark.read.format("cphd_support").option("path", path).load()
