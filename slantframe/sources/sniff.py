"""Which format a file has, from its first bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the formats: name and the hexadecimal start of a file.
STARTS = (
    ("sio", ("FF017FFE", "FE7F01FF", "FF027FFD", "FD7F02FF")),
    ("nitf", ("4E495446", "4E534946")),
    ("tiff", ("49492A00", "4D4D002A", "49492B00", "4D4D002B")),
    ("hdf5", ("894844460D0A1A0A",)),
    ("dted", ("55484C31",)),
    ("cphd", ("435048442F",)),
    ("crsd", ("435253442F",)),
    ("jpeg", ("FFD8FF",)),
    ("jpeg2000", ("0000000C6A502020", "FF4FFF51")),
    ("zip", ("504B0304",)),
)


def format_of(content: Column) -> Column:
    """The name of the format whose start the bytes have; null if none fits."""
    start = F.hex(F.substring(content, 1, 8))
    out = F.lit(None).cast("string")
    for name, starts in reversed(STARTS):
        fits = F.lit(False)
        for s in starts:
            fits = fits | start.startswith(s)
        out = F.when(fits, name).otherwise(out)
    return out


def list_formats(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, format) of every file under path."""
    return spark.read.format("binaryFile").load(path).select("path", "length", format_of(F.col("content")).alias("format"))
