"""Writes vectors as one file of phase history or of received signals (1.x), by many tasks at once.

A vector's parameters and samples have fixed lengths, so both places follow
from its channel and number: tasks pack vectors to bytes and write them into
one file of its final size beside the target; a vector that is written again
(a task that was tried anew) gives the same bytes.  The commit checks that
every vector came once and gives the file its name; an abort removes it.  The
folder must be one that tasks can write into at offsets.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from urllib.parse import urlparse
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from slantframe.sources.cphd import SCALARS, SIGNALS, CphdError
from slantframe.sources.ranged import registered

# The versions that are written.
VERSIONS = {"CPHD": "1.1.0", "CRSD": "1.0.0"}
#: More channels than this are an error: their sizes are in the file's XML.
MOST_CHANNELS = 10_000
PACKED = "channel int, vector int, parameters binary, samples binary"


def parameter_layout(parameters: Mapping[str, str]) -> tuple[list[tuple[str, int, str]], dict[str, tuple[int, int]], int]:
    """([(column, place, kind)] of all parts, {parameter: (words before, words)}, bytes a vector) of parameters by format; each begins at a word of 8 bytes."""
    parts, words, at = [], {}, 0
    for name, form in parameters.items():
        first = at
        for part, kind in re.findall(r"(\w+)=(\w+);", form) or [("", form)]:
            if kind not in SCALARS:
                raise CphdError(f"parameter {name} of format {form}")
            parts.append((f"{name}_{part.lower()}" if part else name, at, SCALARS[kind]))
            at += np.dtype(SCALARS[kind]).itemsize
        at = -(-at // 8) * 8
        words[name] = first // 8, (at - first) // 8
    return parts, words, at


@dataclass
class Heads:
    """Everything of a file that isn't a vector."""

    start: bytes
    xml: bytes
    xml_at: int
    pvp_at: int
    signal_at: int
    size: int


def heads(channels: list[tuple[str, int, int]], parameters: Mapping[str, str], form: str, kind: str, added: tuple[str, ...], more: str, lines: Mapping[str, str]) -> Heads:
    """The header lines and the XML of channels (name, vectors, samples)."""
    _, words, width = parameter_layout(parameters)
    each = 2 * np.dtype(SIGNALS[form]).itemsize
    body, pvp, signal = [], 0, 0
    for name, n, samples in channels:
        body.append(f"<Channel><Identifier>{escape(name)}</Identifier><NumVectors>{n}</NumVectors><NumSamples>{samples}</NumSamples><SignalArrayByteOffset>{signal}</SignalArrayByteOffset><PVPArrayByteOffset>{pvp}</PVPArrayByteOffset></Channel>")
        pvp, signal = pvp + n * width, signal + n * samples * each
    fields = []
    for name, text in parameters.items():
        own = f"<Offset>{words[name][0]}</Offset><Size>{words[name][1]}</Size><Format>{text}</Format>"
        fields.append(f"<AddedPVP><Name>{escape(name)}</Name>{own}</AddedPVP>" if name in added else f"<{name}>{own}</{name}>")
    xml = f'<{kind} xmlns="http://api.nsgreg.nga.mil/schema/{kind.lower()}/{VERSIONS[kind]}"><Data><SignalArrayFormat>{form}</SignalArrayFormat><NumBytesPVP>{width}</NumBytesPVP><Num{kind}Channels>{len(channels)}</Num{kind}Channels>{"".join(body)}</Data><PVP>{"".join(fields)}</PVP>{more}</{kind}>'.encode()
    said = {"CLASSIFICATION": "UNCLASSIFIED", "RELEASE_INFO": "UNRESTRICTED", **lines}
    # The header names places that depend on its own length, so it gets room for the longest numbers.
    room = -(-(512 + sum(len(k) + len(x.encode()) + 5 for k, x in said.items())) // 1024) * 1024
    pvp_at = -(-(room + len(xml) + 2) // 8) * 8
    values = {"XML_BLOCK_SIZE": len(xml), "XML_BLOCK_BYTE_OFFSET": room, "PVP_BLOCK_SIZE": pvp, "PVP_BLOCK_BYTE_OFFSET": pvp_at, "SIGNAL_BLOCK_SIZE": signal, "SIGNAL_BLOCK_BYTE_OFFSET": pvp_at + pvp, **said}
    start = (f"{kind}/{VERSIONS[kind]}\n" + "".join(f"{k} := {x}\n" for k, x in values.items()) + "\f\n").encode()
    return Heads(start, xml + b"\f\n", room, pvp_at, pvp_at + pvp, pvp_at + pvp + signal)


@dataclass
class Written(WriterCommitMessage):
    """Runs of vectors (channel, from, to) that a task wrote."""

    runs: list[tuple[int, int, int]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path = urlparse(options["path"]).path if options["path"].startswith("file:") else options["path"]
        # Places of each channel's first vector: (parameters, samples, vectors, bytes of samples).
        self.channels = [tuple(int(x) for x in c.split(":")) for c in options["channels"].split(",") if c]
        self.width = int(options["width"])
        if os.path.exists(self.path) and not overwrite:
            raise CphdError(f"{self.path} is there already")
        self.part = f"{os.path.dirname(self.path) or '.'}/.{os.path.basename(self.path)}.part"
        with open(self.part, "wb") as f:
            f.truncate(int(options["size"]))
            f.write(options["start"].encode())
            f.seek(int(options["xml_at"]))
            f.write(options["xml"].encode())

    def write(self, batches: Iterator) -> Written:
        seen: list[tuple[int, int]] = []
        with open(self.part, "r+b") as f:
            for batch in batches:
                for c, v, parameters, samples in zip(*(batch.column(k).to_pylist() for k in ("channel", "vector", "parameters", "samples"))):
                    pvp_at, signal_at, n, size = self.channels[c]
                    if not 0 <= v < n or len(parameters) != self.width or len(samples) != size:
                        raise CphdError(f"vector {v} of channel {c} doesn't fit")
                    f.seek(pvp_at + v * self.width)
                    f.write(parameters)
                    f.seek(signal_at + v * size)
                    f.write(samples)
                    seen.append((c, v))
        runs: list[tuple[int, int, int]] = []
        for c, v in sorted(seen):
            if runs and runs[-1][0] == c and runs[-1][2] == v:
                runs[-1] = (c, runs[-1][1], v + 1)
            else:
                runs.append((c, v, v + 1))
        return Written(runs)

    def commit(self, messages: list[Written | None]) -> None:
        at = {c: 0 for c in range(len(self.channels))}
        whole = True
        for c, a, b in sorted(x for m in messages if m for x in m.runs):
            whole &= at[c] == a
            at[c] = b
        if not whole or any(at[c] != n for c, (_, _, n, _) in enumerate(self.channels)):
            os.unlink(self.part)
            raise CphdError("vectors are missing or come twice")
        os.replace(self.part, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.part):
            os.unlink(self.part)


class PhaseFile(DataSource):
    """Format phase_file: a sink of packed vectors; its options are made by ``write_phase``."""

    @classmethod
    def name(cls) -> str:
        return "phase_file"

    def schema(self) -> str:
        return PACKED

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


def _packer(parts: list[tuple[str, int, str]], width: int, form: str, numbers: dict[str, int]):
    base, scale = np.dtype(SIGNALS[form]), [name for name, _, _ in parts].index("AmpSF") if any(n == "AmpSF" for n, _, _ in parts) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            raw = np.zeros((n, width), np.uint8)
            columns = []
            for k, (name, at, kind) in enumerate(parts):
                column = batch.column(4 + k)
                if column.null_count:
                    raise CphdError(f"parameter {name} is null")
                values = np.array([int(x) for x in column.to_pylist()], kind) if kind[1] in "iu" else column.to_numpy(zero_copy_only=False).astype(kind)
                columns.append(values)
                raw[:, at : at + values.dtype.itemsize] = np.frombuffer(values.tobytes(), np.uint8).reshape(n, -1)
            samples = []
            for i, (re_, im) in enumerate(zip(batch.column(2), batch.column(3))):
                if not re_.is_valid or not im.is_valid or len(re_) != len(im):
                    raise CphdError("a vector's parts are null or differ in length")
                z = np.stack([re_.values.to_numpy(), im.values.to_numpy()], axis=1).astype(float)
                if scale is not None:
                    z = z / float(columns[scale][i])
                if base.kind == "i":
                    z, limit = np.rint(z), np.iinfo(base)
                    if z.size and not (limit.min <= z.min() and z.max() <= limit.max):
                        raise CphdError(f"samples don't fit {form}")
                samples.append(z.astype(base).tobytes())
            index = pa.array([numbers[x] for x in batch.column(0).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([index, batch.column(1), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(samples, pa.binary())], ["channel", "vector", "parameters", "samples"])

    return run


def write_phase(vectors: DataFrame, path: str, parameters: Mapping[str, str], form: str = "CI4", kind: str = "CPHD", added: tuple[str, ...] = (), more: str = "", lines: Mapping[str, str] | None = None, overwrite: bool = False) -> None:
    """Writes vectors (channel, vector, re, im and the parameters) as one file.

    parameters are formats by name, in the file's order; the parts of a place
    are columns <name>_x and so on, and names in added are the file's own.
    Where there is an amplitude factor (AmpSF), samples are divided by it.
    kind is CPHD or CRSD, more is XML that follows the parameters, lines are
    further header lines.  A channel's vectors are numbered from 0 and equally
    long; every one must come once.  Sizes of channels take a pass of their own
    over the numbers and lengths.
    """
    if kind not in VERSIONS or form not in SIGNALS:
        raise CphdError(f"{kind} of {form} isn't known")
    parts, _, width = parameter_layout(parameters)
    sizes = vectors.groupBy(F.col("channel").cast("string").alias("channel")).agg(F.count("*").alias("n"), F.min(F.size("re")).alias("low"), F.max(F.size("re")).alias("high")).orderBy("channel").limit(MOST_CHANNELS + 1).collect()
    if len(sizes) > MOST_CHANNELS or any(r.channel is None or r.low != r.high or r.low < 0 for r in sizes):
        raise CphdError("too many channels, one without a name, or one with vectors of several lengths")
    channels = [(r.channel, r.n, r.low) for r in sizes]
    made = heads(channels, parameters, form, kind, added, more, lines or {})
    each, pvp, signal, places = 2 * np.dtype(SIGNALS[form]).itemsize, made.pvp_at, made.signal_at, []
    for _, n, samples in channels:
        places.append(f"{pvp}:{signal}:{n}:{samples * each}")
        pvp, signal = pvp + n * width, signal + n * samples * each
    registered(vectors.sparkSession, PhaseFile)
    own = vectors.select(F.col("channel").cast("string"), F.col("vector").cast("int"), F.col("re").cast("array<double>"), F.col("im").cast("array<double>"), *(F.col(name) for name, _, _ in parts))
    packed = own.mapInArrow(_packer(parts, width, form, {c[0]: k for k, c in enumerate(channels)}), PACKED)
    out = packed.write.format("phase_file").options(path=path, channels=",".join(places), width=width, size=made.size, start=made.start.decode(), xml=made.xml.decode(), xml_at=made.xml_at)
    out.mode("overwrite" if overwrite else "append").save()
