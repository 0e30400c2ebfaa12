"""TIFF images by byte ranges: classic and big files of both byte orders, in strips or tiles, and their tags.

``read_tiff`` gives lines of a window; filters on path, page and r decide which
strips or tiles are read.  Samples are whole numbers, floats, or complex ones of
either, which come as two bands.  Uncompressed images, deflated and run-length
ones are read, with or without a predictor; others come as one row a page with
the reason and without samples.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from slantframe.sources.ranged import RangedReader, Ranges, registered

# Fixed values of the format: types of values, the tags that reading needs, and names of common ones.
TYPES = {1: "u1", 3: "u2", 4: "u4", 6: "i1", 7: "u1", 8: "i2", 9: "i4", 11: "f4", 12: "f8", 13: "u4", 16: "u8", 17: "i8", 18: "u8"}
ASCII, RATIONALS = 2, {5: "u4", 10: "i4"}
NAMES = {
    256: "ImageWidth", 257: "ImageLength", 258: "BitsPerSample", 259: "Compression", 262: "PhotometricInterpretation", 266: "FillOrder", 269: "DocumentName", 270: "ImageDescription", 271: "Make", 272: "Model", 273: "StripOffsets", 274: "Orientation",
    277: "SamplesPerPixel", 278: "RowsPerStrip", 279: "StripByteCounts", 282: "XResolution", 283: "YResolution", 284: "PlanarConfiguration", 296: "ResolutionUnit", 305: "Software", 306: "DateTime", 317: "Predictor", 320: "ColorMap",
    322: "TileWidth", 323: "TileLength", 324: "TileOffsets", 325: "TileByteCounts", 338: "ExtraSamples", 339: "SampleFormat", 33550: "ModelPixelScaleTag", 33922: "ModelTiepointTag", 34264: "ModelTransformationTag", 34735: "GeoKeyDirectoryTag", 34736: "GeoDoubleParamsTag", 34737: "GeoAsciiParamsTag", 42112: "GDAL_METADATA", 42113: "GDAL_NODATA",
}
PLAIN, DEFLATE, OLD_DEFLATE, PACKED = 1, 8, 32946, 32773
SCHEMA = "path string, page int, r int, c0 int, bands array<array<double>>, reason string"
#: Bytes that one piece reads at most, unless a row of tiles is larger.
PIECE = 64 << 20


class TiffError(ValueError):
    """A file that breaks the format."""


Tags = dict[int, str | np.ndarray]


def pages(file: Ranges) -> list[Tags]:
    """The tags of each page: texts, or arrays of numbers; values of unknown types are left out."""
    start = file.read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    kind = struct.unpack(order + "H", start[2:4])[0] if order and len(start) >= 8 else 0
    if kind not in (42, 43):
        raise TiffError("no TIFF header")
    big = kind == 43
    word, count_size, entry = ("Q", 8, 20) if big else ("I", 2, 12)
    size = struct.calcsize(word)
    at = struct.unpack(order + word, start[8:16] if big else start[4:8])[0]
    out, seen = [], set()
    while at:
        if at in seen:
            raise TiffError("the pages close a ring")
        seen.add(at)
        head = file.read(at, count_size)
        if len(head) < count_size:
            raise TiffError("a page is cut off")
        n = struct.unpack(order + ("Q" if big else "H"), head)[0]
        body = file.read(at + count_size, n * entry + size)
        if len(body) < n * entry + size:
            raise TiffError("a page is cut off")
        tags: Tags = {}
        for k in range(n):
            tag, form, length = struct.unpack_from(f"{order}HH{word}", body, k * entry)
            each = 1 if form == ASCII else 8 if form in RATIONALS else np.dtype(TYPES[form]).itemsize if form in TYPES else 0
            if not each:
                continue
            inside = k * entry + 4 + size
            data = body[inside : inside + each * length] if each * length <= size else file.read(struct.unpack_from(order + word, body, inside)[0], each * length)
            if len(data) < each * length:
                raise TiffError(f"the values of tag {tag} are cut off")
            if form == ASCII:
                tags[tag] = data.split(b"\0")[0].decode("latin-1")
            elif form in RATIONALS:
                top, bottom = np.frombuffer(data, order + RATIONALS[form]).astype(float).reshape(-1, 2).T
                tags[tag] = np.divide(top, bottom, out=np.full(len(top), np.nan), where=bottom != 0)
            else:
                tags[tag] = np.frombuffer(data, order + TYPES[form])
        tags[0] = order
        out.append(tags)
        at = struct.unpack_from(order + word, body, n * entry)[0]
    return out


@dataclass
class Piece(InputPartition):
    """Rows first to last of a page, and where the strips or tiles that hold them lie: (plane, block row, block column) in order."""

    path: str
    page: int
    first: int
    last: int
    block_row: int
    width: int
    height: int
    block: tuple[int, int]
    samples: int
    planes: int
    dtype: str
    compression: int
    predictor: int
    places: np.ndarray
    sizes: np.ndarray
    window: tuple[int, int]
    reason: str | None = None


def _one(tags: Tags, tag: int, default: int) -> int:
    return int(tags[tag][0]) if tag in tags and len(tags[tag]) else default


def _layout(tags: Tags) -> tuple[dict, str | None]:
    """(what decoding a page needs, why it can't be decoded)."""
    if 256 not in tags or 257 not in tags:
        return {}, "no size"
    width, height, samples = _one(tags, 256, 0), _one(tags, 257, 0), _one(tags, 277, 1)
    bits, form = {int(b) for b in tags.get(258, [1])}, {int(f) for f in tags.get(339, [1])}
    tiled = 324 in tags
    if not (tiled or 273 in tags) or not (325 if tiled else 279) in tags:
        return {}, "no places of strips or tiles"
    block = (_one(tags, 323, height), _one(tags, 322, width)) if tiled else (min(max(1, _one(tags, 278, height)), max(1, height)), width)
    own = dict(width=width, height=height, block=block, samples=samples, planes=samples if _one(tags, 284, 1) == 2 else 1, compression=_one(tags, 259, PLAIN), predictor=_one(tags, 317, 1))
    if own["compression"] not in (PLAIN, DEFLATE, OLD_DEFLATE, PACKED):
        return own, f"compression {own['compression']}"
    kind = {1: "u", 2: "i", 3: "f", 5: "i", 6: "f"}.get(next(iter(form)))
    whole = len(bits) == len(form) == 1 and kind and next(iter(bits)) in ({1: (8, 16, 32, 64), 2: (8, 16, 32, 64), 3: (32, 64), 5: (16, 32, 64), 6: (64, 128)}[next(iter(form))])
    if not whole:
        return own, f"samples of {sorted(bits)} bits, format {sorted(form)}"
    each = next(iter(bits)) // 8
    paired = next(iter(form)) in (5, 6)
    own["dtype"] = f"{tags[0]}2{kind}{each // 2}" if paired else f"{tags[0]}{kind}{each}"
    if own["predictor"] not in ((1,) if paired else (1, 3) if kind == "f" else (1, 2)):
        return own, f"predictor {own['predictor']}"
    own["places"], own["sizes"] = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    down, wide = -(-height // block[0]), -(-width // block[1])
    if not min(block) or len(own["places"]) != down * wide * own["planes"] or len(own["sizes"]) != len(own["places"]):
        return own, "another number of strips or tiles than the size asks for"
    return own, None


def _unpacked(data: bytes) -> bytes:
    """Run-length coded bytes."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def _decoded(data: bytes, piece: Piece, rows: int) -> np.ndarray:
    """(rows, columns, samples of a plane, parts) of a strip or tile."""
    if piece.compression in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompress(data)
    elif piece.compression == PACKED:
        data = _unpacked(data)
    pair = piece.dtype[1] == "2"
    dtype = np.dtype(piece.dtype[0] + piece.dtype[2:]) if pair else np.dtype(piece.dtype)
    shape = (rows, piece.block[1], piece.samples // piece.planes, 2 if pair else 1)
    need = int(np.prod(shape)) * dtype.itemsize
    if len(data) < need:
        raise TiffError(f"{piece.path}: a strip or tile is cut off")
    if piece.predictor == 3:
        lines = np.frombuffer(data, np.uint8, need).reshape(rows, -1, shape[2])
        planes = np.cumsum(lines, axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, -1)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(shape)
    x = np.frombuffer(data, dtype, need // dtype.itemsize).reshape(shape)
    return np.cumsum(x, axis=1, dtype=dtype.newbyteorder("=")) if piece.predictor == 2 else x


def window_of(piece: Piece, file: Ranges) -> np.ndarray:
    """(rows, columns of the window, bands) of a piece; of plain strips and tiles only the lines that are asked for are read."""
    left, right = piece.window
    high, wide = piece.block
    across = -(-piece.width // wide)
    own = piece.samples // piece.planes
    parts = 2 if piece.dtype[1] == "2" else 1
    out = np.empty((piece.last - piece.first, right - left, piece.samples, parts))
    line = wide * own * parts * int(np.dtype(piece.dtype[0] + piece.dtype[2:] if parts == 2 else piece.dtype).itemsize)
    blocks = piece.places.reshape(piece.planes, -1, across)
    sizes = piece.sizes.reshape(blocks.shape)
    for k in range(blocks.shape[1]):
        top = (piece.block_row + k) * high
        a, b = max(piece.first, top), min(piece.last, top + high)
        for plane in range(piece.planes):
            for c in range(left // wide, -(-right // wide)):
                at, size = int(blocks[plane, k, c]), int(sizes[plane, k, c])
                if piece.compression == PLAIN:
                    got = _decoded(file.read(at + (a - top) * line, (b - a) * line), piece, b - a)
                else:
                    # A last strip has only the rows that are left.
                    got = _decoded(file.read(at, size), piece, min(high, piece.height - top))[a - top : b - top]
                x, y = max(left, c * wide), min(right, (c + 1) * wide)
                out[a - piece.first : b - piece.first, x - left : y - left, plane * own : (plane + 1) * own] = got[:, x - c * wide : y - c * wide]
    return out.reshape(len(out), right - left, -1)


class _LineReader(RangedReader):
    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.cols = tuple(int(x) for x in options["cols"].split(",")) if options.get("cols") else None

    def pieces(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.files():
            with Ranges(path) as file:
                for page, tags in enumerate(pages(file)):
                    if self.bounds.has("page", page):
                        out += self._cut(path, page, tags)
        return out

    def _cut(self, path: str, page: int, tags: Tags) -> list[Piece]:
        own, reason = _layout(tags)
        if reason:
            return [Piece(path, page, 0, 0, 0, 0, 0, (1, 1), 1, 1, "", 1, 1, np.zeros(0), np.zeros(0), (0, 0), reason)]
        first, last = self.bounds.span("r", 0, own["height"])
        left, right = self.cols or (0, own["width"])
        left, right = max(0, left), min(own["width"], right)
        if first >= last or left >= right:
            return []
        high, wide = own["block"]
        across = -(-own["width"] // wide)
        places, sizes = (own.pop(x).astype(np.int64).reshape(own["planes"], -1, across) for x in ("places", "sizes"))
        item = np.dtype(own["dtype"][0] + own["dtype"][2:]).itemsize * 2 if own["dtype"][1] == "2" else np.dtype(own["dtype"]).itemsize
        step = max(1, PIECE // max(1, high * wide * across * own["samples"] * item))
        rows = range(first // high, -(-last // high), step)
        return [
            Piece(path, page, max(first, k * high), min(last, (k + step) * high), k, places=places[:, k : min(k + step, -(-last // high))].ravel(), sizes=sizes[:, k : min(k + step, -(-last // high))].ravel(), window=(left, right), **own)
            for k in rows
        ]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        names = ["path", "page", "r", "c0", "bands", "reason"]
        kinds = pa.list_(pa.list_(pa.float64()))
        if not isinstance(piece, Piece):
            return
        if piece.reason:
            yield pa.RecordBatch.from_arrays([pa.array([piece.path]), pa.array([piece.page], pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, kinds), pa.array([piece.reason])], names)
            return
        with Ranges(piece.path) as file:
            lines = window_of(piece, file).transpose(0, 2, 1)
        n, bands, wide = lines.shape
        for a in range(0, n, max(1, (8 << 20) // (8 * bands * wide))):
            part = np.ascontiguousarray(lines[a : a + max(1, (8 << 20) // (8 * bands * wide))])
            inner = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, wide, dtype=np.int32)), pa.array(part.ravel()))
            value = pa.ListArray.from_arrays(pa.array(np.arange(0, len(part) * bands + 1, bands, dtype=np.int32)), inner)
            yield pa.RecordBatch.from_arrays(
                [pa.array([piece.path] * len(part)), pa.array([piece.page] * len(part), pa.int32()), pa.array(np.arange(piece.first + a, piece.first + a + len(part), dtype=np.int32)), pa.array(np.full(len(part), piece.window[0], np.int32)), value, pa.nulls(len(part), pa.string())], names
            )


class TiffLines(DataSource):
    """Lines of TIFF images."""

    @classmethod
    def name(cls) -> str:
        return "tiff_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(self.options)


def read_tiff(spark: SparkSession, path: str, cols: tuple[int, int] | None = None) -> DataFrame:
    """(path, page, r, c0, bands, reason): lines of all pages of a file, or of the files in a folder; cols (from, to) bounds the columns."""
    registered(spark, TiffLines)
    reader = spark.read.format("tiff_lines").option("path", path)
    return (reader.option("cols", f"{cols[0]},{cols[1]}") if cols else reader).load()


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, tag, name, text, numbers): the tags of every page; a file that breaks the format is an error."""
    from slantframe.sources.ranged import files_of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with Ranges(uri) as file:
                    rows = [(uri, k, tag, NAMES.get(tag), value if isinstance(value, str) else None, None if isinstance(value, str) else value.astype(float)) for k, tags in enumerate(pages(file)) for tag, value in tags.items() if tag]
                fields = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f) for x, f in zip(zip(*rows), fields)] if rows else [pa.array([], f) for f in fields], ["path", "page", "tag", "name", "text", "numbers"])

    files = files_of(path)
    listed = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, min(len(files), spark.sparkContext.defaultParallelism * 4)))
    return listed.mapInArrow(run, "path string, page int, tag int, name string, text string, numbers array<double>")


def encode(image: np.ndarray, tile: tuple[int, int] | None = None, strip: int | None = None, big: bool = False, order: str = "<", deflate: bool = False, predictor: int = 1, texts: dict[int, str] | None = None, numbers: dict[int, list[float]] | None = None) -> bytes:
    """A file of one page from (rows, columns) or (rows, columns, bands); texts and numbers are further tags."""
    x = image if image.ndim == 3 else image[:, :, None]
    rows, cols, bands = x.shape
    own = x.astype(x.dtype.newbyteorder(order))
    high, wide = tile or (strip or rows, cols)
    bodies = []
    for a in range(0, rows, high):
        for b in range(0, cols, wide):
            part = own[a : a + high, b : b + wide]
            if tile:
                part = np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=part[:, :1] * 0).astype(own.dtype)
            data = np.ascontiguousarray(part).tobytes()
            bodies.append(zlib.compress(data) if deflate else data)
    word, size = ("Q", 8) if big else ("I", 4)
    form = {"u": 1, "i": 2, "f": 3, "c": 6}[x.dtype.kind]
    start = 16 if big else 8
    places = np.cumsum([start, *(len(b) for b in bodies)])
    values: dict[int, tuple[int, bytes, int]] = {}

    def put(tag: int, kind: int, items) -> None:
        array = np.asarray(items, dtype=order + TYPES[kind])
        values[tag] = (kind, array.tobytes(), array.size)

    for tag, value in ((256, cols), (257, rows), (278, high), (322, wide), (323, high)):
        if tag < 278 or (tag > 278) == bool(tile):
            put(tag, 4, [value])
    for tag, items in ((258, [x.dtype.itemsize * 8] * bands), (259, [DEFLATE if deflate else PLAIN]), (262, [1]), (277, [bands]), (317, [predictor]), (339, [form] * bands)):
        put(tag, 3, items)
    put(324 if tile else 273, 16 if big else 4, places[:-1])
    put(325 if tile else 279, 16 if big else 4, [len(b) for b in bodies])
    for tag, items in (numbers or {}).items():
        put(tag, 12, items)
    for tag, text in (texts or {}).items():
        values[tag] = (ASCII, text.encode("latin-1") + b"\0", len(text) + 1)
    at = int(places[-1]) + int(places[-1]) % 2
    behind = at + (8 if big else 2) + len(values) * (20 if big else 12) + size
    table, extra = b"", b""
    for tag, (kind, data, n) in sorted(values.items()):
        table += struct.pack(f"{order}HH{word}", tag, kind, n)
        if len(data) <= size:
            table += data.ljust(size, b"\0")
        else:
            table += struct.pack(order + word, behind + len(extra))
            extra += data + b"\0" * (len(data) % 2)
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    body = b"".join(bodies)
    return head + body + b"\0" * (at - start - len(body)) + struct.pack(order + ("Q" if big else "H"), len(values)) + table + struct.pack(order + word, 0) + extra
