"""What data sources over large binary files share: files by URI, byte ranges, and bounds read off pushed filters.

A reader plans pieces of files on the driver from headers alone; a task reads
the byte ranges of its pieces.  Filters on the columns that pieces are cut by
narrow the plan; Spark applies them again, so a filter that isn't understood
costs reading, never rows.  Files are opened by their URI through Arrow's file
systems (local paths and file:, s3:, gs:, hdfs:), for Spark's own readers know
no ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Ranges:
    """A file that is read by byte ranges; taken counts the bytes."""

    def __init__(self, uri: str) -> None:
        system, path = located(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()
        self.taken = 0

    def read(self, at: int, size: int) -> bytes:
        """The bytes of a range; fewer at the file's end."""
        self.taken += max(0, min(size, self.size - at))
        return self.file.read_at(max(0, min(size, self.size - at)), at) if at < self.size else b""

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it)."""
    if not urlparse(uri).scheme:
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def files_of(uri: str) -> list[str]:
    """The file at a URI, or the files right below it, in order; names that begin with a dot or underscore are left out."""
    system, path = located(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [uri]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
    prefix = uri[: len(uri.rstrip("/")) - len(path.rstrip("/"))] if uri.rstrip("/").endswith(path.rstrip("/")) else ""
    return sorted(prefix + p for p in found)


@dataclass
class Bounds:
    """Inclusive bounds of whole-number columns, and the values that a column may have."""

    low: dict[str, int] = field(default_factory=dict)
    high: dict[str, int] = field(default_factory=dict)
    among: dict[str, set] = field(default_factory=dict)

    def narrow(self, f: Filter) -> None:
        name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
        if name is None:
            return
        if isinstance(f, (EqualTo, EqualNullSafe)):
            self._only(name, {f.value})
        elif isinstance(f, In):
            self._only(name, set(f.value))
        elif isinstance(f, GreaterThan):
            self._above(name, f.value + 1 if isinstance(f.value, int) else None)
        elif isinstance(f, GreaterThanOrEqual):
            self._above(name, f.value)
        elif isinstance(f, LessThan):
            self._below(name, f.value - 1 if isinstance(f.value, int) else None)
        elif isinstance(f, LessThanOrEqual):
            self._below(name, f.value)

    def _only(self, name: str, values: set) -> None:
        self.among[name] = self.among.get(name, values) & values

    def _above(self, name: str, value) -> None:
        if isinstance(value, int):
            self.low[name] = max(self.low.get(name, value), value)

    def _below(self, name: str, value) -> None:
        if isinstance(value, int):
            self.high[name] = min(self.high.get(name, value), value)

    def span(self, name: str, start: int, stop: int) -> tuple[int, int]:
        """The part of start <= x < stop that a column may take."""
        low, high = max(start, self.low.get(name, start)), min(stop, self.high.get(name, stop) + 1)
        if name in self.among:
            own = [x for x in self.among[name] if isinstance(x, int) and low <= x < high]
            low, high = (min(own), max(own) + 1) if own else (low, low)
        return low, max(low, high)

    def has(self, name: str, value) -> bool:
        if name in self.among and value not in self.among[name]:
            return False
        return not isinstance(value, int) or self.low.get(name, value) <= value <= self.high.get(name, value)


class RangedReader(DataSourceReader):
    """A reader with bounds; subclasses plan pieces and read them."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.bounds = Bounds()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            self.bounds.narrow(f)
            yield f

    def files(self) -> list[str]:
        """Files of the path that the filters on path allow."""
        return [f for f in files_of(self.path) if self.bounds.has("path", f)]

    def pieces(self) -> list[InputPartition]:
        raise NotImplementedError

    def partitions(self) -> list[InputPartition]:
        return self.pieces() or [InputPartition(None)]


def registered(spark: SparkSession, *sources: type) -> None:
    """Registers data sources in a session and lets it push filters to them."""
    spark.conf.set(PUSHDOWN, "true")
    for source in sources:
        spark.dataSource.register(source)
