"""WARC archives compressed with Zstandard and a shared dictionary.

An archive starts with a skippable frame that holds the dictionary (plain or
itself compressed); every record is one frame.  Archives are written by
Spark's own text sink, one row a frame: its line separator is an empty
skippable frame, which any reader of the format passes over, so the files are
valid archives in whatever store the cluster uses.  They are read back with
the binary-file source, in tasks, a frame at a time.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slantframe.llm.scratch import Scratch

#: Fixed values of the formats: frame magics and the version line.
SKIPPABLE = 0x184D2A50
DICTIONARY = 0x184D2A5D
FRAME = 0xFD2FB528
VERSION = b"WARC/1.1\r\n"
#: A skippable frame of no bytes, which separates the rows of an archive.
SEPARATOR = struct.pack("<II", SKIPPABLE, 0)
#: Payloads of at least so many bytes are compared.
LEAST_REVISIT = 0
#: Samples for the dictionary and its size.
SAMPLES, DICTIONARY_BYTES = 400, 32 << 10


class WarcError(ValueError):
    """An archive that breaks the format."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from sample records; empty where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = VERSION + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    return head + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """What follows the HTTP header of the block."""
        head, cut, payload = self.block.partition(b"\r\n\r\n")
        if not cut:
            raise WarcError("a block without an HTTP header")
        return payload


NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


def parse_record(raw: bytes) -> Record:
    """Validates the version line, the needed headers, the length and the end of a record."""
    if not raw.startswith(VERSION):
        raise WarcError("no version line")
    head, cut, rest = raw[len(VERSION) :].partition(b"\r\n\r\n")
    if not cut:
        raise WarcError("headers without an end")
    headers: dict[str, str] = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"bad header line {line[:60]!r}")
        headers[name.decode("utf-8")] = value.strip().decode("utf-8")
    if missing := [n for n in NEEDED if n not in headers]:
        raise WarcError(f"missing headers {missing}")
    if not headers["Content-Length"].isdigit():
        raise WarcError("bad Content-Length")
    n = int(headers["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"record of {len(rest) - 4} bytes says {n}")
    return Record(headers, rest[:n])


def frames(archive: bytes | memoryview) -> Iterator[tuple[int, memoryview]]:
    """(magic, content) of each frame: skippable frames' content, other frames whole."""
    view, at = memoryview(archive), 0
    while at < len(view):
        if len(view) - at < 8:
            raise WarcError("a frame is cut off")
        magic, size = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            if at + 8 + size > len(view):
                raise WarcError("a skippable frame is cut off")
            yield magic, view[at + 8 : at + 8 + size]
            at += 8 + size
        elif magic == FRAME:
            end = _frame_end(view, at)
            yield magic, view[at:end]
            at = end
        else:
            raise WarcError(f"no frame at {at}")


def _frame_end(view: memoryview, at: int) -> int:
    """Where the frame at at ends: after its header, its blocks and its checksum."""
    descriptor = view[at + 4]
    single, checksum = descriptor >> 5 & 1, descriptor >> 2 & 1
    header = 5 + (1 - single) + (0, 1, 2, 4)[descriptor & 3] + ((1 if single else 0), 2, 4, 8)[descriptor >> 6]
    place = at + header
    while True:
        if place + 3 > len(view):
            raise WarcError("a frame is cut off")
        block = int.from_bytes(view[place : place + 3], "little")
        place += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    place += 4 * checksum
    if place > len(view):
        raise WarcError("a frame is cut off")
    return place


def read_archive(archive: bytes) -> Iterator[Record]:
    """The records of an archive; a frame must hold one whole record."""
    decoder = None
    for k, (magic, content) in enumerate(frames(archive)):
        if magic == DICTIONARY:
            if k:
                raise WarcError("the dictionary isn't the first frame")
            raw = bytes(content)
            if raw[:4] == struct.pack("<I", FRAME):
                raw = zstandard.ZstdDecompressor().decompress(raw)
            decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        elif magic == FRAME:
            decoder = decoder or zstandard.ZstdDecompressor()
            try:
                # As a stream: a frame needn't say how long its content is.
                stream = decoder.decompressobj()
                raw = stream.decompress(bytes(content))
            except zstandard.ZstdError as error:
                raise WarcError(str(error)) from error
            if not stream.eof:
                raise WarcError("a frame's content is cut off")
            yield parse_record(raw)


def _row_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url and the html as bytes (null: empty)."""
    return pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))


def classify_pages(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, record_type and refers_to of every row.

    Of the rows with equal payloads of at least least bytes, the one with the
    smallest page_id is the response and the others revisit it.  Equal means
    equal SHA-256 and length.  Rows with a null page_id are responses, and so
    is every copy of a row with the smallest id.  Only digests that occur
    more than once are joined, so unique pages find no partner; a join whose
    keys are uneven is split by the adaptive planner.
    """
    rows = payloads(pages).withColumn("digest", F.sha2("payload", 256))
    first = (
        rows.where(F.octet_length("payload") >= least)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
        .select("digest", "first")
    )
    again = F.col("first").isNotNull() & (F.col("page_id") > F.col("first"))
    joined = rows.join(first, "digest", "left")
    return joined.select("page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, source: DataFrame | None = None) -> None:
    """Writes a record for each row of classify_pages to archives under path.

    The dictionary is trained on the driver on the heads of at most SAMPLES
    records, those with the least hashes of their ids: ids alone are ranked,
    and only the chosen payloads reach the driver.  source, if given, has the
    same payloads and is cheaper to scan.  Each
    partition of pages becomes an archive: payloads are shuffled once, by the
    join that finds revisits, and the adaptive planner sizes its partitions.
    Revisits have an empty payload and name the record they refer to.
    """
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    source = pages if source is None else source
    ids = [r[0] for r in source.select("page_id").where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLES).collect()]
    sample = source.where(F.col("page_id").isin(ids)).select("page_id", F.substring("payload", 1, 20_000).alias("p")).groupBy("page_id").agg(F.min("p").alias("p")).orderBy("page_id")
    dictionary = train_dictionary([record(_headers("response", i, None, "", b""), b"HTTP/1.1 200 OK\r\n\r\n" + bytes(r.p)) for i, r in enumerate(sample.collect())])
    shared = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = shared.value
        encoder = zstandard.ZstdCompressor(level=3, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        packed = zstandard.ZstdCompressor(level=9).compress(raw) if raw else b""
        lead: list[bytes] = [struct.pack("<II", DICTIONARY, len(packed)) + packed]
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = zip(*(c.to_pylist() for c in batch.slice(at, 200).columns))
                yield pa.RecordBatch.from_arrays([pa.array(lead + [encoder.compress(_record(*row)) for row in rows], pa.binary())], ["frame"])
                lead = []

    rows = pages.select("page_id", "url", "payload", "record_type", "refers_to")
    rows.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR.decode("ascii")).text(path)


def _headers(kind: str, page_id, refers_to, url: str | None, payload: bytes) -> list[tuple[str, str]]:
    out = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", " ".join((url or "").split()))]
    if kind == "revisit":
        out += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("X-Payload-Length", str(len(payload)))]
    return [*out, ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"), ("Content-Type", "application/http;msgtype=response")]


def _record(page_id, url, payload, kind, refers_to) -> bytes:
    return record(_headers(kind, page_id, refers_to, url, payload), b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if kind == "revisit" else payload))


def read_archives(spark: SparkSession, path: str, id_kind: str = "bigint") -> DataFrame:
    """A row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to, url and payload.

    The digest of a response is that of its payload and must be the one in
    its header; a revisit's is the header's.  A broken archive is an error.
    """

    def number(urn: str | None):
        value = None if urn is None else urn.removeprefix("<urn:page:").removesuffix(">")
        return None if value in (None, "None") else int(value) if id_kind in ("bigint", "int") else value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows: list[tuple] = []
                size = 0
                for r in read_archive(archive.as_py()):
                    h, kind, payload = r.headers, r.headers["WARC-Type"], r.payload
                    said = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and said != payload_digest(payload):
                        raise WarcError(f"digest of {h['WARC-Record-ID']}")
                    n = int(h["X-Payload-Length"]) if kind == "revisit" else len(payload)
                    rows.append((number(h["WARC-Record-ID"]), n, said, kind, number(h.get("WARC-Refers-To")), h["WARC-Target-URI"], payload))
                    size += len(payload)
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    ids = _row_type(id_kind)
    types = [ids, pa.int64(), pa.string(), pa.string(), ids, pa.string(), pa.binary()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, f"page_id {id_kind}, payload_bytes long, payload_digest string, record_type string, refers_to {id_kind}, url string, payload binary")


def archive_pages(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes pages (page_id, url, html) to archives in the shared folder and reads them back.

    A null html is empty; repeated rows give a record each; other columns are
    not looked at.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    path = scratch.path()
    write_archives(classify_pages(pages, least), path, payloads(pages))
    return read_archives(spark, path, pages.schema["page_id"].dataType.simpleString())
