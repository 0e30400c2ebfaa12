"""Writes images as segments of one NITF file, by many tasks at once.

Lines have a fixed length, so a line's place follows from its image and row:
tasks write into one file of its final size beside the target, each line at its
own offset, and a line that is written again (a task that was tried anew) gives
the same bytes.  The commit checks that every line came and gives the file its
name; an abort removes it.  The folder must be one that all tasks can write
into at offsets (a shared file system), which object stores aren't.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from slantframe.sources.nitf import BLOCKS, EXTENSION, FILE, IMAGE, NitfError
from slantframe.sources.ranged import registered


def _packed(layout, **values) -> bytes:
    return "".join(str(values.get(n, "")).ljust(k)[:k] for n, k in layout).encode("ascii")


def file_head(images: int, rows: int, cols: int, bands: int, xml: bytes = b"") -> tuple[list[tuple[int, bytes]], list[int], int]:
    """([(place, bytes)] of all headers and the XML, places of the images' samples, size of the file)."""
    if rows > 99_999_999 or bands > 9 or images > 999:
        raise NitfError("too many rows, bands or images")
    heads = []
    for k in range(images):
        head = _packed(IMAGE, IM="IM", IID1=f"SICD{k:03d}", ISCLAS="U", ENCRYP="0", NROWS=f"{rows:08d}", NCOLS=f"{cols:08d}", PVTYPE="R", IREP="NODISPLY", ICAT="SAR", ABPP="32", PJUST="R")
        head += b"0NC" + f"{bands}".encode() + b"".join(b" " * 8 + b"N   0" for _ in range(bands))
        sides = (f"{x:04d}" if x <= 8192 else "0000" for x in (cols, rows))
        head += _packed(BLOCKS, ISYNC="0", IMODE="P", NBPR="0001", NBPC="0001", NPPBH=next(sides), NPPBV=next(sides), NBPP="32", IDLVL=f"{k + 1:03d}", IALVL="000", ILOC="0000000000", IMAG="1.0 ") + b"0000000000"
        heads.append(head)
    body = rows * cols * bands * 4
    texts = [xml] if xml else []
    extension = _packed(EXTENSION, DE="DE", DESID="XML_DATA_CONTENT", DESVER="01", DESCLAS="U", DESSHL="0000")
    lists = f"{images:03d}".encode() + b"".join(f"{len(h):06d}{body:010d}".encode() for h in heads) + b"000000000" + f"{len(texts):03d}".encode()
    lists += b"".join(f"{len(extension):04d}{len(t):09d}".encode() for t in texts) + b"000" + b"0000000000"
    size = sum(n for _, n in FILE) + len(lists)
    at, out, places = size, [], []
    for head in heads:
        out.append((at, head))
        places.append(at + len(head))
        at += len(head) + body
    for t in texts:
        out.append((at, extension + t))
        at += len(extension) + len(t)
    first = _packed(FILE, FHDR="NITF", FVER="02.10", CLEVEL="03", STYPE="BF01", OSTAID="slantframe", FDT="20000101000000", FSCLAS="U", FSCOP="00000", FSCPYS="00000", ENCRYP="0", FL=f"{at:012d}", HL=f"{size:06d}")
    return [(0, first + lists), *out], places, at


@dataclass
class Written(WriterCommitMessage):
    """Lines that a task wrote: of each image the runs of rows."""

    runs: list[tuple[int, int, int]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path = urlparse(options["path"]).path if options["path"].startswith("file:") else options["path"]
        self.shape = tuple(int(options[k]) for k in ("images", "rows", "cols", "bands"))
        if os.path.exists(self.path) and not overwrite:
            raise NitfError(f"{self.path} is there already")
        self.part = f"{os.path.dirname(self.path) or '.'}/.{os.path.basename(self.path)}.part"
        heads, self.places, size = file_head(*self.shape, options.get("xml", "").encode())
        with open(self.part, "wb") as f:
            f.truncate(size)
            for at, data in heads:
                f.seek(at)
                f.write(data)

    def write(self, batches: Iterator) -> Written:
        images, rows, cols, bands = self.shape
        seen: list[tuple[int, int]] = []
        with open(self.part, "r+b") as f:
            for batch in batches:
                for image, r, line in zip(*(batch.column(c).to_pylist() for c in ("image", "r", "bands"))):
                    samples = np.array(line, dtype=">f4")
                    if not (0 <= image < images and 0 <= r < rows) or samples.shape != (bands, cols):
                        raise NitfError(f"line {r} of image {image} with {samples.shape} samples doesn't fit {self.shape}")
                    f.seek(self.places[image] + r * cols * bands * 4)
                    f.write(samples.T.tobytes())
                    seen.append((image, r))
        runs: list[tuple[int, int, int]] = []
        for image, r in sorted(seen):
            if runs and runs[-1][0] == image and runs[-1][2] == r:
                runs[-1] = (image, runs[-1][1], r + 1)
            else:
                runs.append((image, r, r + 1))
        return Written(runs)

    def commit(self, messages: list[Written | None]) -> None:
        images, rows, _, _ = self.shape
        runs = sorted(x for m in messages if m for x in m.runs)
        at = (0, 0)
        for image, a, b in runs:
            if (image, a) != at:
                break
            at = (image, b) if b < rows else (image + 1, 0)
        if at != (images, 0) and rows or sum(b - a for _, a, b in runs) != images * rows:
            os.unlink(self.part)
            raise NitfError(f"lines are missing or come twice, at image {at[0]}, row {at[1]}")
        os.replace(self.part, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.part):
            os.unlink(self.part)


class NitfFile(DataSource):
    """Format nitf_file: a sink of lines (image, r, bands); options path, images, rows, cols, bands, xml."""

    @classmethod
    def name(cls) -> str:
        return "nitf_file"

    def schema(self) -> str:
        return "image int, r int, bands array<array<float>>"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


def write_image(lines: DataFrame, path: str, images: int, rows: int, cols: int, bands: int = 2, xml: str = "", overwrite: bool = False) -> None:
    """Writes lines (image, r, bands: an array of samples a band) as one file; every line of every image must come once."""
    registered(lines.sparkSession, NitfFile)
    own = lines.select(F.col("image").cast("int"), F.col("r").cast("int"), F.col("bands").cast("array<array<float>>"))
    out = own.write.format("nitf_file").options(path=path, images=images, rows=rows, cols=cols, bands=bands, xml=xml)
    out.mode("overwrite" if overwrite else "append").save()
