"""Images of NITF files by byte ranges: blocked, masked and segmented ones, as lines of a window.

``read_image`` gives a DataFrame whose filters on path, image and r decide
which blocks are read; columns are bounded by an option, since a line is a row.
Segments that are attached to each other are one image: a segment lies where
its ILOC says, from the place of the segment whose display level it is attached
to.  Blocks that a mask leaves out have the mask's pad value, or 0.  Images
whose samples can't be decoded (compressed ones, odd sample sizes) come as one
row a segment with the reason and without samples.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from slantframe.sources.nitf import BLOCKS, EXTENSION, FILE, IMAGE, KINDS, SEGMENTS, NitfError
from slantframe.sources.ranged import RangedReader, Ranges, registered

SCHEMA = "path string, image int, r int, c0 int, bands array<array<float>>, reason string"
#: Fixed value of the format: the offset of a block that isn't there.
ABSENT = 0xFFFFFFFF
#: Bytes that one piece reads at most, unless a row of blocks is larger.
PIECE = 64 << 20


def named(data: bytes, layout, at: int = 0) -> tuple[dict[str, str], int]:
    """({field: text}, place behind) of a layout."""
    out = {}
    for name, size in layout:
        out[name] = data[at : at + size].decode("latin-1").strip()
        at += size
    return out, at


@dataclass(frozen=True)
class Segment:
    """A segment of a file: where its subheader and its body lie."""

    kind: str
    index: int
    header: int
    header_size: int
    body: int
    size: int


def segments(file: Ranges) -> list[Segment]:
    """The segments of a file in their order, from its file header alone."""
    size = sum(n for _, n in FILE)
    head, at = named(file.read(0, size), FILE)
    if head["FHDR"] not in ("NITF", "NSIF") or not head["HL"].isdigit():
        raise NitfError("no file header")
    lists = file.read(at, int(head["HL"]) - at)
    place, at, out = int(head["HL"]), 0, []
    for kind, first, second in SEGMENTS:
        count, at = int(lists[at : at + 3]), at + 3
        for index in range(count if first else 0):
            a, b = int(lists[at : at + first]), int(lists[at + first : at + first + second])
            out.append(Segment(kind, index, place, a, place + a, b))
            place, at = place + a + b, at + first + second
    return out


@dataclass(frozen=True)
class ImageSegment:
    """What is needed to read a segment's samples; row and col are its place in its image."""

    index: int
    body: int
    size: int
    rows: int
    cols: int
    bands: int
    kind: str
    bits: int
    compression: str
    mode: str
    down: int
    across: int
    height: int
    width: int
    level: int
    attached: int
    iloc: tuple[int, int]
    image: int = 0
    row: int = 0
    col: int = 0
    offsets: tuple[int, ...] | None = None
    start: int = 0
    pad: float = 0.0

    @property
    def reason(self) -> str | None:
        if self.compression not in ("NC", "NM"):
            return f"compression {self.compression}"
        if (self.kind, self.bits) not in KINDS:
            return f"samples {self.kind} of {self.bits} bits"
        return None if self.mode in "BPRS" else f"mode {self.mode}"


def _subheader(data: bytes) -> tuple[dict[str, str], str, int, dict[str, str], int]:
    """(fields, compression, number of bands, block fields, place behind them) of an image subheader."""
    head, at = named(data, IMAGE)
    at += 60 if head["ICORDS"] else 0
    at += 1 + 80 * int(data[at : at + 1])
    compression, at = data[at : at + 2].decode("latin-1"), at + 2
    at += 0 if compression in ("NC", "NM") else 4
    bands, at = int(data[at : at + 1]), at + 1
    if not bands:
        bands, at = int(data[at : at + 5]), at + 5
    for _ in range(bands):
        tables, at = int(data[at + 12 : at + 13]), at + 13
        if tables:
            at += 5 + tables * int(data[at : at + 5])
    block, at = named(data, BLOCKS, at)
    return head, compression, bands, block, at


def image_fields_end(data: bytes) -> int:
    """Where the record areas of an image subheader begin."""
    return _subheader(data)[4]


def image_segment(file: Ranges, segment: Segment) -> ImageSegment:
    head, compression, bands, block, _ = _subheader(file.read(segment.header, segment.header_size))
    n = lambda name: int(block[name] or 0)
    rows, cols = int(head["NROWS"]), int(head["NCOLS"])
    iloc = block["ILOC"].rjust(10)
    return ImageSegment(
        segment.index, segment.body, segment.size, rows, cols, bands, head["PVTYPE"], n("NBPP"), compression, block["IMODE"], n("NBPC"), n("NBPR"), n("NPPBV") or rows, n("NPPBH") or cols,
        n("IDLVL"), n("IALVL"), (int(iloc[:5] or 0), int(iloc[5:] or 0)),
    )


def attached(parts: list[ImageSegment]) -> list[ImageSegment]:
    """The segments with their image and their place in it; images are numbered by their first segment.

    A segment attached to level 0, or to a level that no segment has, begins an image.
    """
    levels = {p.level: i for i, p in enumerate(parts)}
    up = [levels.get(p.attached) if p.attached and levels.get(p.attached) != i else None for i, p in enumerate(parts)]

    def place(i: int) -> tuple[int, int, int]:
        row = col = 0
        seen = set()
        while up[i] is not None:
            if i in seen:
                raise NitfError("segments are attached in a circle")
            seen.add(i)
            row, col, i = row + parts[i].iloc[0], col + parts[i].iloc[1], up[i]
        return i, row, col

    found = [place(i) for i in range(len(parts))]
    numbers = {root: k for k, root in enumerate(dict.fromkeys(root for root, _, _ in found))}
    return [replace(p, image=numbers[root], row=row, col=col) for p, (root, row, col) in zip(parts, found)]


def masked(file: Ranges, p: ImageSegment) -> ImageSegment:
    """The segment with the offsets of its blocks, where a mask table has them."""
    if p.compression[0] != "M" and p.compression != "NM":
        return p
    start, blocks, pads, code = struct.unpack(">IHHH", file.read(p.body, 10))
    size = -(-code // 8)
    raw = file.read(p.body + 10, size)
    pad = 0.0
    if size and (p.kind, p.bits) in KINDS and p.bits == code:
        pad = float(np.frombuffer(raw, KINDS[p.kind, p.bits])[0])
    offsets = None
    if blocks:
        count = p.down * p.across * (p.bands if p.mode == "S" else 1)
        offsets = tuple(struct.unpack(f">{count}I", file.read(p.body + 10 + size, 4 * count)))
    return replace(p, offsets=offsets, start=start, pad=pad)


def image_segments(file: Ranges) -> list[ImageSegment]:
    """Every image segment of a file, in place."""
    return [masked(file, p) for p in attached([image_segment(file, s) for s in segments(file) if s.kind == "image"])]


def block_place(p: ImageSegment, number: int, band: int) -> int | None:
    """Where a block begins (a band's, in mode S); None if it isn't there."""
    size = p.height * p.width * np.dtype(KINDS[p.kind, p.bits]).itemsize * (1 if p.mode == "S" else p.bands)
    k = band * p.down * p.across + number if p.mode == "S" else number
    if p.offsets is None:
        return p.body + p.start + k * size
    return None if p.offsets[k] == ABSENT else p.body + p.start + p.offsets[k]


def _block(file: Ranges, p: ImageSegment, number: int, band: int, lines: tuple[int, int]) -> np.ndarray:
    """(lines, width, bands) of a block's lines; bands is 1 in mode S."""
    base, (a, b) = np.dtype(KINDS[p.kind, p.bits]), lines
    bands = 1 if p.mode == "S" else p.bands
    at = block_place(p, number, band)
    if at is None:
        return np.full((b - a, p.width, bands), p.pad)

    def read(place: int, count: int) -> np.ndarray:
        data = file.read(place, count * base.itemsize)
        if len(data) < count * base.itemsize or place + count * base.itemsize > p.body + p.size:
            raise NitfError("the samples are cut off")
        return np.frombuffer(data, base)

    if p.mode == "B":
        whole = p.height * p.width * base.itemsize
        return np.stack([read(at + k * whole + a * p.width * base.itemsize, (b - a) * p.width).reshape(b - a, p.width) for k in range(bands)], axis=2)
    flat = read(at + a * p.width * bands * base.itemsize, (b - a) * p.width * bands)
    return flat.reshape(b - a, bands, p.width).transpose(0, 2, 1) if p.mode == "R" else flat.reshape(b - a, p.width, bands)


def read_window(file: Ranges, p: ImageSegment, rows: tuple[int, int], cols: tuple[int, int]) -> np.ndarray:
    """(bands, rows, cols) of a window of a segment; only the lines of the blocks that it touches are read."""
    out = np.empty((p.bands, rows[1] - rows[0], cols[1] - cols[0]), dtype=np.float32)
    for i in range(rows[0] // p.height, -(-rows[1] // p.height)):
        a, b = max(rows[0], i * p.height), min(rows[1], (i + 1) * p.height)
        for j in range(cols[0] // p.width, -(-cols[1] // p.width)):
            x, y = max(cols[0], j * p.width), min(cols[1], (j + 1) * p.width)
            for band in range(p.bands if p.mode == "S" else 1):
                part = _block(file, p, i * p.across + j, band, (a - i * p.height, b - i * p.height))[:, x - j * p.width : y - j * p.width]
                own = slice(band, band + 1) if p.mode == "S" else slice(None)
                out[own, a - rows[0] : b - rows[0], x - cols[0] : y - cols[0]] = part.transpose(2, 0, 1)
    return out


@dataclass
class Piece(InputPartition):
    """Lines of a segment that a task reads."""

    path: str
    part: ImageSegment
    rows: tuple[int, int]
    cols: tuple[int, int]


class _ImageReader(RangedReader):
    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.cols = tuple(int(x) for x in options["cols"].split(":")) if options.get("cols") else None

    def pieces(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.files():
            with Ranges(path) as file:
                for p in image_segments(file):
                    if not self.bounds.has("image", p.image):
                        continue
                    a, b = (x - p.row for x in self.bounds.span("r", p.row, p.row + p.rows))
                    low, high = self.cols or (p.col, p.col + p.cols)
                    x, y = max(0, low - p.col), min(p.cols, high - p.col)
                    if p.reason:
                        out.append(Piece(path, p, (0, 0), (0, 0)))
                        continue
                    if x >= y:
                        continue
                    # A piece has whole rows of blocks, as many as PIECE bytes hold, or lines of one.
                    line = max(1, (y - x) * p.bands * p.bits // 8)
                    step = max(1, PIECE // line)
                    step = step // p.height * p.height or step
                    at = a
                    while at < b:
                        stop = min(b, (at // step + 1) * step)
                        out.append(Piece(path, p, (at, stop), (x, y)))
                        at = stop
        return out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if not isinstance(piece, Piece):
            return
        p, names = piece.part, ["path", "image", "r", "c0", "bands", "reason"]
        if p.reason:
            yield pa.RecordBatch.from_arrays([pa.array([piece.path]), pa.array([p.image], pa.int32()), pa.array([None], pa.int32()), pa.array([None], pa.int32()), pa.array([None], pa.list_(pa.list_(pa.float32()))), pa.array([p.reason])], names)
            return
        with Ranges(piece.path) as file:
            a, b = piece.rows
            width = piece.cols[1] - piece.cols[0]
            step = max(1, (4 << 20) // max(1, width * p.bands))
            for at in range(a, b, step):
                stop = min(b, at + step)
                n = stop - at
                lines = np.ascontiguousarray(read_window(file, p, (at, stop), piece.cols).transpose(1, 0, 2))
                inner = pa.ListArray.from_arrays(pa.array(np.arange(0, n * p.bands * width + 1, width, dtype=np.int32)), pa.array(lines.ravel()))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, n * p.bands + 1, p.bands, dtype=np.int32)), inner)
                rows = pa.array(np.arange(at, stop, dtype=np.int32) + np.int32(p.row))
                yield pa.RecordBatch.from_arrays([pa.array([piece.path] * n), pa.array(np.full(n, p.image, np.int32)), rows, pa.array(np.full(n, p.col + piece.cols[0], np.int32)), bands, pa.nulls(n, pa.string())], names)


class NitfImages(DataSource):
    """Format nitf_image: options path and cols (first:behind, in the image's columns)."""

    @classmethod
    def name(cls) -> str:
        return "nitf_image"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _ImageReader(self.options)


def read_image(spark: SparkSession, path: str, cols: tuple[int, int] | None = None) -> DataFrame:
    """(path, image, r, c0, bands, reason): the lines of all images under a path, from column c0 on.

    A segment's lines are its own rows: segments side by side give several
    rows with one r.  Filter on path, image and r to read less.
    """
    registered(spark, NitfImages)
    read = spark.read.format("nitf_image").option("path", path)
    return (read.option("cols", f"{cols[0]}:{cols[1]}") if cols else read).load()


@dataclass
class TextPiece(InputPartition):
    path: str
    index: int
    name: str
    at: int
    size: int


class _TextReader(RangedReader):
    def pieces(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.files():
            with Ranges(path) as file:
                for s in segments(file):
                    if s.kind == "extension":
                        head, _ = named(file.read(s.header, sum(n for _, n in EXTENSION)), EXTENSION)
                        if self.bounds.has("name", head["DESID"]):
                            out.append(TextPiece(path, s.index, head["DESID"], s.body, s.size))
        return out

    def read(self, piece: TextPiece) -> Iterator[tuple]:
        if isinstance(piece, TextPiece):
            with Ranges(piece.path) as file:
                yield piece.path, piece.index, piece.name, file.read(piece.at, piece.size)


class NitfExtensions(DataSource):
    """Format nitf_extension: the data extension segments of files; option path."""

    @classmethod
    def name(cls) -> str:
        return "nitf_extension"

    def schema(self) -> str:
        return "path string, index int, name string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _TextReader(self.options)


def header_areas(file: Ranges) -> list[tuple[str, int, bytes]]:
    """(header, index, bytes) of the record areas of the file header and of the image subheaders, user-defined before extended."""
    out: list[tuple[str, int, bytes]] = []

    def take(kind: str, index: int, data: bytes, at: int) -> None:
        for _ in range(2):
            size, at = int(data[at : at + 5] or 0), at + 5
            if size:
                # The first three bytes name the segment that the area goes on in.
                out.append((kind, index, data[at + 3 : at + size]))
                at += size

    size = sum(n for _, n in FILE)
    head, at = named(file.read(0, size), FILE)
    data = file.read(0, int(head["HL"]))
    for kind, first, second in SEGMENTS:
        at += 3 + int(data[at : at + 3]) * (first + second)
    take("file", 0, data, at)
    for s in segments(file):
        if s.kind == "image":
            data = file.read(s.header, s.header_size)
            take("image", s.index, data, image_fields_end(data))
    return out


class _AreaReader(RangedReader):
    def pieces(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.files()]

    def read(self, piece: InputPartition) -> Iterator[tuple]:
        if piece.value is not None:
            with Ranges(piece.value) as file:
                for kind, index, data in header_areas(file):
                    yield piece.value, kind, index, data


class NitfAreas(DataSource):
    """Format nitf_area: the areas of tagged records in headers; option path."""

    @classmethod
    def name(cls) -> str:
        return "nitf_area"

    def schema(self) -> str:
        return "path string, header string, index int, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _AreaReader(self.options)


def read_areas(spark: SparkSession, path: str) -> DataFrame:
    """(path, header, index, content) of every record area; records.read_records takes them apart."""
    registered(spark, NitfAreas)
    return spark.read.format("nitf_area").option("path", path).load()


def read_extensions(spark: SparkSession, path: str) -> DataFrame:
    """(path, index, name, content) of every data extension segment, read by its own bytes."""
    registered(spark, NitfExtensions)
    return spark.read.format("nitf_extension").option("path", path).load()
