"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, or a temporary one where it is unset on a single machine (tests).

    On a cluster without that setting it is an error: a local folder isn't shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isDefined():
            root = jsc.getCheckpointDir().get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="slantframe-")
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self) -> str:
        self._n += 1
        return f"{self.root}/t{self._n}"

    def save(self, df: DataFrame) -> DataFrame:
        """Writes df and returns it as read back."""
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes the files of saved tables that nothing needs any more."""
        for df in frames:
            self.drop_path(df._scratch_path)

    def drop_path(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores behind where a column has one already (names differ by more than case)."""
    taken_ = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in taken_:
            name += "_"
        taken_.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    """How many pieces a shuffled intermediate is dealt into."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a batch of whole texts.
TEXTS = 1024


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Batches of few rows for what is run inside: texts are long, and pairs carry two a row."""
    name = BATCH
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bit_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """A bit (key modulo bits, unsigned) for each 64-bit key; bits bounds what reaches the driver."""
    block = min(bits, 1 << 15)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(0, dtype=np.int64)
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64) % np.uint64(bits)
            found = np.union1d(found, own.astype(np.int64))
        if len(found):
            blocks = np.unique(found // block)
            out = []
            for b in blocks:
                flags = np.zeros(block, dtype=bool)
                flags[found[found // block == b] - b * block] = True
                out.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(out, pa.binary())], ["block", "data"])

    def either(table: pa.Table) -> pa.Table:
        flags = np.bitwise_or.reduce([np.frombuffer(x, dtype=np.uint8) for x in table.column("data").to_pylist()])
        return pa.table({"block": table.column("block").slice(0, 1), "data": pa.array([flags.tobytes()], pa.binary())})

    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in keys.where("key is not null").select("key").mapInArrow(marks, "block long, data binary").groupBy("block").applyInArrow(either, "block long, data binary").collect():
        at = r["block"] * (block // 8)
        out[at : at + block // 8] = np.frombuffer(r["data"], dtype=np.uint8)
    return out
