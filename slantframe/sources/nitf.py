"""NITF 2.1 and NSIF files: headers and segments as tables, complex images as lines, XML segments as text.

Header fields are substrings at fixed places or after counted lists, so they
are Columns over the file's bytes; only samples are decoded in Arrow batches.
Files are read whole by the binary-file source, which serves any store.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: fields in their order, with their lengths in bytes.
SECURITY = (("CLAS", 1), ("CLSY", 2), ("CODE", 11), ("CTLH", 2), ("REL", 20), ("DCTP", 2), ("DCDT", 8), ("DCXM", 4), ("DG", 1), ("DGDT", 8), ("CLTX", 43), ("CATP", 1), ("CAUT", 40), ("CRSN", 1), ("SRDT", 8), ("CTLN", 15))
FILE = (("FHDR", 4), ("FVER", 5), ("CLEVEL", 2), ("STYPE", 4), ("OSTAID", 10), ("FDT", 14), ("FTITLE", 80), *((f"FS{n}", k) for n, k in SECURITY), ("FSCOP", 5), ("FSCPYS", 5), ("ENCRYP", 1), ("FBKGC", 3), ("ONAME", 24), ("OPHONE", 18), ("FL", 12), ("HL", 6))
IMAGE = (("IM", 2), ("IID1", 10), ("IDATIM", 14), ("TGTID", 17), ("IID2", 80), *((f"IS{n}", k) for n, k in SECURITY), ("ENCRYP", 1), ("ISORCE", 42), ("NROWS", 8), ("NCOLS", 8), ("PVTYPE", 3), ("IREP", 8), ("ICAT", 8), ("ABPP", 2), ("PJUST", 1), ("ICORDS", 1))
BLOCKS = (("ISYNC", 1), ("IMODE", 1), ("NBPR", 4), ("NBPC", 4), ("NPPBH", 4), ("NPPBV", 4), ("NBPP", 2), ("IDLVL", 3), ("IALVL", 3), ("ILOC", 10), ("IMAG", 4))
EXTENSION = (("DE", 2), ("DESID", 25), ("DESVER", 2), *((f"DES{n}", k) for n, k in SECURITY), ("DESSHL", 4))
#: Kinds of segments in the file header: name, digits of a subheader's length, digits of a segment's length.
SEGMENTS = (("image", 6, 10), ("graphic", 4, 6), ("reserved", 0, 0), ("text", 4, 5), ("extension", 4, 9), ("reserve", 4, 7))


def _text(content: Column, at: Column | int, size: Column | int) -> Column:
    at, size = (x if isinstance(x, Column) else F.lit(x) for x in (at, size))
    return F.substring(content, at + 1, size).cast("string")


def fields(content: Column, layout: Sequence[tuple[str, int]], at: Column | int = 0) -> Column:
    """A struct of a layout's fields, trimmed, from a place in the bytes on."""
    out = []
    for name, size in layout:
        out.append(F.trim(_text(content, at, size)).alias(name))
        at = at + size
    return F.struct(*out)


def _size(layout: Sequence[tuple[str, int]]) -> int:
    return sum(n for _, n in layout)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, file): every file under path with its file header's fields."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.withColumn("file", fields(F.col("content"), FILE))


def _sizes(content: Column, kind: str, head: int, body: int) -> Column:
    """Structs of the n_ segments of a kind whose list starts at at_: their numbers and the bytes of subheader and segment."""

    def one(i: Column) -> Column:
        at = F.col("at_") + 3 + i * (head + body)
        return F.struct(F.lit(kind).alias("kind"), i.alias("index"), _text(content, at, head).cast("long").alias("header"), _text(content, at + head, body).cast("long").alias("body"))

    some = F.when(F.col("n_") > 0, F.sequence(F.lit(0), F.col("n_") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(some, one)


def segments(files: DataFrame) -> DataFrame:
    """(path, kind, index, header_offset, header_size, offset, size) of the segments of files (read_files), in the file's order."""
    df = files.withColumns({"at_": F.lit(_size(FILE)), "all_": F.array().cast("array<struct<kind:string,index:int,header:long,body:long>>")})
    content = F.col("content")
    for kind, head, body in SEGMENTS:
        df = df.withColumn("n_", _text(content, F.col("at_"), 3).cast("int"))
        if head:
            df = df.withColumn("all_", F.concat("all_", _sizes(content, kind, head, body)))
        df = df.withColumn("at_", F.col("at_") + 3 + F.col("n_") * (head + body))
    # A segment lies after the file header and all segments before it.
    start = F.col("file.HL").cast("long")
    before = lambda i: F.aggregate(F.slice("all_", F.lit(1), i), start, lambda a, s: a + s["header"] + s["body"])
    out = df.select("path", F.posexplode(F.transform("all_", lambda s, i: F.struct(s.alias("s"), before(i).alias("begin")))).alias("k", "x"))
    s = F.col("x.s")
    return out.select("path", s["kind"].alias("kind"), s["index"].alias("index"), F.col("x.begin").alias("header_offset"), s["header"].alias("header_size"), (F.col("x.begin") + s["header"]).alias("offset"), s["body"].alias("size"))


def image_headers(files: DataFrame) -> DataFrame:
    """(path, index, offset, size, image, bands, blocks): the subheaders of image segments."""
    met = files.select("path", "content").join(segments(files).where("kind = 'image'"), "path")
    c, at = F.col("content"), F.col("header_offset").cast("int")
    df = met.withColumn("image", fields(c, IMAGE, at)).withColumn("at_", at + _size(IMAGE))
    df = df.withColumn("corners", F.when(F.col("image.ICORDS") != "", _text(c, F.col("at_"), 60)))
    df = df.withColumn("at_", F.col("at_") + F.when(F.col("corners").isNull(), 0).otherwise(60))
    df = df.withColumn("at_", F.col("at_") + 1 + 80 * _text(c, F.col("at_"), 1).cast("int"))
    df = df.withColumn("compression", _text(c, F.col("at_"), 2))
    df = df.withColumn("at_", F.col("at_") + F.when(F.col("compression").isin("NC", "NM"), 2).otherwise(6))
    few = _text(c, F.col("at_"), 1).cast("int")
    df = df.withColumn("n_", F.when(few > 0, few).otherwise(_text(c, F.col("at_") + 1, 5).cast("int")))
    df = df.withColumn("at_", F.col("at_") + F.when(few > 0, 1).otherwise(6))
    # Bands without lookup tables have 13 bytes each; those with tables aren't followed here.
    band = lambda i: F.trim(_text(c, F.col("at_") + i * 13 + 2, 6))
    df = df.withColumn("bands", F.transform(F.sequence(F.lit(0), F.col("n_") - 1), band))
    df = df.withColumn("blocks", fields(c, BLOCKS, F.col("at_") + 13 * F.col("n_")))
    return df.select("path", "index", "offset", "size", "image", "corners", "compression", "bands", "blocks")


def xml_segments(files: DataFrame) -> DataFrame:
    """(path, index, name, xml): data extension segments that hold XML."""
    met = files.select("path", "content").join(segments(files).where("kind = 'extension'"), "path")
    c = F.col("content")
    body = F.substring(c, (F.col("offset") + 1).cast("int"), F.col("size").cast("int")).cast("string")
    out = met.select("path", "index", fields(c, EXTENSION, F.col("header_offset").cast("int"))["DESID"].alias("name"), body.alias("xml"))
    return out.where(F.ltrim("xml").startswith("<"))


# Fixed values of the format: bits a sample and pixel value type to the sample's kind.
KINDS = {("R", 32): ">f4", ("R", 64): ">f8", ("SI", 16): ">i2", ("SI", 8): ">i1", ("INT", 8): ">u1", ("INT", 16): ">u2"}


class NitfError(ValueError):
    """An image whose samples can't be read."""


def samples(data: memoryview, offset: int, rows: int, cols: int, bands: int, kind: str, bits: int, mode: str, block: tuple[int, int]) -> np.ndarray:
    """(rows, cols, bands) of an uncompressed image without a mask, whose blocks of (height, width) lie row by row."""
    if (kind, bits) not in KINDS:
        raise NitfError(f"samples {kind} of {bits} bits")
    base = np.dtype(KINDS[kind, bits])
    height, width = block[0] or rows, block[1] or cols
    down, across = -(-rows // height), -(-cols // width)
    count = down * across * height * width * bands
    if len(data) - offset < count * base.itemsize:
        raise NitfError("the samples are cut off")
    flat = np.frombuffer(data, base, count, offset)
    order = {"P": ((down, across, height, width, bands), (0, 2, 1, 3, 4)), "B": ((down, across, bands, height, width), (0, 3, 1, 4, 2)), "R": ((down, across, height, bands, width), (0, 2, 1, 4, 3)), "S": ((bands, down, across, height, width), (1, 3, 2, 4, 0))}
    if mode not in order:
        raise NitfError(f"mode {mode}")
    shape, axes = order[mode]
    return flat.reshape(shape).transpose(axes).reshape(down * height, across * width, bands)[:rows, :cols]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, index, r, bands): a row a line of every uncompressed image; bands has an array of samples a band.

    Images of one file (a large image is cut into several) come as their own
    index, each with rows from 0.
    """
    files = read_files(spark, path)
    h = image_headers(files).where(F.col("compression") == "NC")
    number = lambda x: F.col(x).cast("int")
    h = h.select("path", "index", "offset", number("image.NROWS").alias("rows"), number("image.NCOLS").alias("cols"), F.size("bands").alias("n"), F.col("image.PVTYPE").alias("kind"), number("blocks.NBPP").alias("bits"), F.col("blocks.IMODE").alias("mode"), number("blocks.NPPBV").alias("height"), number("blocks.NPPBH").alias("width"))
    met = files.select("path", "content").join(h, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, index, offset, rows, cols, n, kind, bits, mode, height, width = (batch.column(c)[i].as_py() for c in (0, *range(2, 12)))
                data = memoryview(batch.column(1)[i].as_buffer())
                image = samples(data, offset, rows, cols, n, kind, bits, mode, (height, width))
                for x in range(0, rows, 256):
                    part = image[x : x + 256].astype(np.float32).transpose(0, 2, 1)
                    lines = pa.array([list(line) for line in part], pa.list_(pa.list_(pa.float32())))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array([index] * len(part), pa.int32()), pa.array(np.arange(x, x + len(part), dtype=np.int32)), lines], ["path", "index", "r", "bands"])

    return met.select("path", "content", "index", "offset", "rows", "cols", "n", "kind", "bits", "mode", "height", "width").mapInArrow(run, "path string, index int, r int, bands array<array<float>>")


def encode(images: Sequence[np.ndarray], xml: Sequence[str] = (), title: str = "") -> bytes:
    """A file of complex images (two bands of 32-bit floats, one block each) and XML segments; for tests and small products."""

    def packed(layout, **values):
        return "".join(str(values.get(n, "")).ljust(k)[:k] for n, k in layout).encode("ascii")

    heads, bodies = [], []
    for a in images:
        rows, cols = a.shape
        head = packed(IMAGE, IM="IM", IID1="SICD000", ISCLAS="U", ENCRYP="0", NROWS=f"{rows:08d}", NCOLS=f"{cols:08d}", PVTYPE="R", IREP="NODISPLY", ICAT="SAR", ABPP="32", PJUST="R", ICORDS="")
        head += b"0NC2" + b"".join(x.ljust(8).encode() + b"N   0" for x in ("  I", "  Q"))
        block = (rows if rows <= 8192 else 0, cols if cols <= 8192 else 0)
        head += packed(BLOCKS, ISYNC="0", IMODE="P", NBPR="0001", NBPC="0001", NPPBH=f"{block[1]:04d}", NPPBV=f"{block[0]:04d}", NBPP="32", IDLVL="001", IALVL="000", ILOC="0000000000", IMAG="1.0 ") + b"0000000000"
        heads.append(head)
        bodies.append(np.stack([a.real, a.imag], axis=2).astype(">f4").tobytes())
    texts = [x.encode("utf-8") for x in xml]
    head = packed(EXTENSION, DE="DE", DESID="XML_DATA_CONTENT", DESVER="01", DESCLAS="U", DESSHL="0000")
    lists = f"{len(images):03d}".encode() + b"".join(f"{len(h):06d}{len(b):010d}".encode() for h, b in zip(heads, bodies))
    lists += b"000000000" + f"{len(texts):03d}".encode() + b"".join(f"{len(head):04d}{len(t):09d}".encode() for t in texts) + b"000" + b"0000000000"
    size = _size(FILE) + len(lists)
    total = size + sum(map(len, heads)) + sum(map(len, bodies)) + sum(len(head) + len(t) for t in texts)
    first = packed(FILE, FHDR="NITF", FVER="02.10", CLEVEL="03", STYPE="BF01", OSTAID="slantframe", FDT="20000101000000", FTITLE=title, FSCLAS="U", FSCOP="00000", FSCPYS="00000", ENCRYP="0", FL=f"{total:012d}", HL=f"{size:06d}")
    return first + lists + b"".join(h + b for h, b in zip(heads, bodies)) + b"".join(head + t for t in texts)
