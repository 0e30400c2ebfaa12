"""Compensated phase history files (1.x): header, XML, per-vector parameters and signals as tables.

Header lines and the XML block are Columns over the file's bytes; parameters
and samples are decoded in Arrow batches, a row a vector.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes at the start of a file in which its header lines lie.
HEADER = 1 << 14
# Fixed values of the format: names of samples and parameters, as big-endian kinds.
SIGNALS = {"CI2": ">i1", "CI4": ">i2", "CF8": ">f4"}
SCALARS = {"F8": ">f8", "F4": ">f4", "I8": ">i8", "I4": ">i4", "I2": ">i2", "I1": ">i1", "U8": ">u8", "U4": ">u4", "U2": ">u2", "U1": ">u1"}


class CphdError(ValueError):
    """A file that breaks the format."""


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content, header, xml): header lines as a map, the XML block as text."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    lines = F.substring_index(F.substring("content", 1, HEADER).cast("string"), "\f\n", 1)
    df = files.withColumn("header", F.str_to_map(lines, F.lit("\n"), F.lit(" := ")))
    number = lambda n: F.col("header")[n].cast("int")
    return df.withColumn("xml", F.substring("content", number("XML_BLOCK_BYTE_OFFSET") + 1, number("XML_BLOCK_SIZE")).cast("string"))


def layout(headers: DataFrame) -> DataFrame:
    """Blocks of each file in the columns that operators.phase_rules.layout_rules reads."""
    number = lambda n: F.col("header")[n].cast("long")
    out = [number(f"{b}_BLOCK_{w}").alias(f"{b.lower()}_{w.split('_')[-1].lower()}") for b in ("XML", "SUPPORT", "PVP", "SIGNAL") for w in ("BYTE_OFFSET", "SIZE")]
    return headers.select(F.col("path").alias("file"), *out, F.col("length").alias("file_size"))


def _tree(text: str) -> ET.Element:
    root = ET.fromstring(text)
    for e in root.iter():
        e.tag = e.tag.rsplit("}", 1)[-1]
    return root


def _parameters(root: ET.Element) -> tuple[list[tuple[str, int, str]], int]:
    """(names, places in a vector's bytes and kinds of all scalar parts, bytes a vector)."""
    out = []
    for e in root.find("PVP").iter():
        place, form = e.find("Offset"), e.find("Format")
        if place is None or form is None:
            continue
        name, at = e.findtext("Name") or e.tag, 8 * int(place.text)
        parts = re.findall(r"(\w+)=(\w+);", form.text) or [("", form.text)]
        for part, kind in parts:
            if kind in SCALARS:
                out.append((f"{name}_{part.lower()}" if part else name, at, SCALARS[kind]))
                at += np.dtype(SCALARS[kind]).itemsize
    return out, int(root.findtext("Data/NumBytesPVP"))


def _decoded(headers: DataFrame, schema: str, rows: Callable[[str, memoryview, dict, ET.Element], Iterator[pa.RecordBatch]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                header = dict(batch.column(2)[i].as_py())
                yield from rows(batch.column(0)[i].as_py(), memoryview(batch.column(1)[i].as_buffer()), header, _tree(batch.column(3)[i].as_py()))

    return headers.select("path", "content", "header", "xml").mapInArrow(run, schema)


def read_pvp(headers: DataFrame) -> DataFrame:
    """(path, channel, vector, values): the parameters of every vector by name; parts of places are <name>_x and so on."""

    def rows(path, data, header, root):
        parameters, width = _parameters(root)
        first = int(header["PVP_BLOCK_BYTE_OFFSET"])
        for channel in root.findall("Data/Channel"):
            n, at = int(channel.findtext("NumVectors")), first + int(channel.findtext("PVPArrayByteOffset"))
            if len(data) < at + n * width:
                raise CphdError("the vector parameters are cut off")
            raw = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
            values = np.stack([raw[:, p : p + np.dtype(k).itemsize].copy().view(k)[:, 0].astype(np.float64) for _, p, k in parameters], axis=1)
            for x in range(0, n, 4096):
                part = values[x : x + 4096]
                offsets = np.arange(len(part) + 1, dtype=np.int32) * len(parameters)
                maps = pa.MapArray.from_arrays(offsets, pa.array([name for name, _, _ in parameters] * len(part)), pa.array(part.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array([channel.findtext("Identifier")] * len(part)), pa.array(np.arange(x, x + len(part), dtype=np.int32)), maps], ["path", "channel", "vector", "values"])

    return _decoded(headers, "path string, channel string, vector int, values map<string,double>", rows)


def vectors(pvp: DataFrame, *names: str) -> DataFrame:
    """(path, channel, vector and the named parameters as columns) of read_pvp's rows."""
    return pvp.select("path", "channel", "vector", *(F.col("values")[n].alias(n) for n in names))


def read_signal(headers: DataFrame) -> DataFrame:
    """(path, channel, vector, re, im): the samples of every vector as stored, without the amplitude factor."""

    def rows(path, data, header, root):
        kind = root.findtext("Data/SignalArrayFormat")
        if kind not in SIGNALS:
            raise CphdError(f"signal format {kind}")
        base, first = np.dtype(SIGNALS[kind]), int(header["SIGNAL_BLOCK_BYTE_OFFSET"])
        for channel in root.findall("Data/Channel"):
            n, m = int(channel.findtext("NumVectors")), int(channel.findtext("NumSamples"))
            at = first + int(channel.findtext("SignalArrayByteOffset"))
            if len(data) < at + n * m * 2 * base.itemsize:
                raise CphdError("the signal is cut off")
            raw = np.frombuffer(data, base, n * m * 2, at).reshape(n, m, 2)
            for x in range(0, n, 256):
                part = raw[x : x + 256].astype(np.float32)
                lists = [pa.array(list(part[:, :, k]), pa.list_(pa.float32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array([channel.findtext("Identifier")] * len(part)), pa.array(np.arange(x, x + len(part), dtype=np.int32)), *lists], ["path", "channel", "vector", "re", "im"])

    return _decoded(headers, "path string, channel string, vector int, re array<float>, im array<float>", rows)


def scaled_signal(signal: DataFrame, pvp: DataFrame) -> DataFrame:
    """The samples times their vector's amplitude factor (AmpSF; 1 where there is none)."""
    factor = pvp.select("path", "channel", "vector", F.coalesce(F.col("values")["AmpSF"], F.lit(1.0)).cast("float").alias("factor_"))
    met = signal.join(factor, ["path", "channel", "vector"])
    return met.select("path", "channel", "vector", *(F.transform(c, lambda x: (x * F.col("factor_")).cast("float")).alias(c) for c in ("re", "im")))


def encode(channels: dict[str, tuple[np.ndarray, np.ndarray]], names: list[str]) -> bytes:
    """A file of channels (parameters of vectors by names, complex samples); for tests and small products."""
    body, pvp, signal = [], [], []
    for name, (values, samples) in channels.items():
        body.append(f"<Channel><Identifier>{name}</Identifier><NumVectors>{len(values)}</NumVectors><NumSamples>{samples.shape[1]}</NumSamples><SignalArrayByteOffset>{sum(map(len, signal))}</SignalArrayByteOffset><PVPArrayByteOffset>{sum(map(len, pvp))}</PVPArrayByteOffset></Channel>")
        pvp.append(values.astype(">f8").tobytes())
        signal.append(np.stack([samples.real, samples.imag], axis=2).astype(">f4").tobytes())
    fields = "".join(f"<{n}><Offset>{i}</Offset><Size>1</Size><Format>F8</Format></{n}>" for i, n in enumerate(names))
    xml = f'<CPHD xmlns="http://api.nsgreg.nga.mil/schema/cphd/1.0.1"><Data><SignalArrayFormat>CF8</SignalArrayFormat><NumBytesPVP>{8 * len(names)}</NumBytesPVP>{"".join(body)}</Data><PVP>{fields}</PVP></CPHD>'.encode()
    sizes = {"XML": len(xml), "PVP": sum(map(len, pvp)), "SIGNAL": sum(map(len, signal))}
    start = 1024
    places = {"XML": start, "PVP": start + sizes["XML"] + 2, "SIGNAL": start + sizes["XML"] + 2 + sizes["PVP"]}
    lines = ["CPHD/1.0.1", *(f"{b}_BLOCK_{w} := {v[b]}" for b in sizes for w, v in (("SIZE", sizes), ("BYTE_OFFSET", places))), "CLASSIFICATION := UNCLASSIFIED", "RELEASE_INFO := UNRESTRICTED", ""]
    head = ("\n".join(lines) + "\f\n").encode()
    return head.ljust(start, b"\0") + xml + b"\f\n" + b"".join(pvp) + b"".join(signal)
