"""Complex images of a file in one call: samples by their pixel type, with the file's own metadata."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slantframe.sources import sicd
from slantframe.sources.nitf_image import read_extensions, read_image


def amplitudes(table: Column) -> Column:
    """The amplitude of each of 256 values as an array; null without a table."""
    pairs = F.map_from_entries(F.transform(table["Amplitude"], lambda a: F.struct(a["_index"], a["_VALUE"])))
    return F.when(table["Amplitude"].isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.try_element_at(pairs, i), F.lit(0.0))))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(path, sicd): the parsed metadata of each file under a path that has them."""
    text = read_extensions(spark, path).select("path", "index", F.col("content").cast("string").alias("xml"))
    found = text.where(F.col("xml").rlike(r"<(\w+:)?SICD[\s>]"))
    first = found.groupBy("path").agg(F.min_by("xml", "index").alias("xml"))
    return first.select("path", sicd.parse(F.col("xml")).alias("sicd"))


def read_sicd(spark: SparkSession, path: str, cols: tuple[int, int] | None = None, rows: tuple[int, int] | None = None) -> DataFrame:
    """(path, r, c0, re, im, sicd): the complex lines of each file's image from column c0 on, rows and cols as first:behind.

    RE32F_IM32F and RE16I_IM16I have real and imaginary bands; AMP8I_PHS8I has
    amplitudes, through the table of the metadata where there is one, and
    phases in 256ths of a turn.  Other pixel types, and images that can't be
    decoded, raise an error: a missing line would be a wrong image.  Files
    without the metadata have no rows.
    """
    lines = read_image(spark, path, cols)
    if rows is not None:
        lines = lines.where(F.col("r").isNull() | ((F.col("r") >= rows[0]) & (F.col("r") < rows[1])))
    # One row a file: the metadata go to the lines, however large those are.
    met = lines.where("image = 0").join(F.broadcast(read_metadata(spark, path)), "path")
    kind = F.coalesce(F.col("sicd.ImageData.PixelType"), F.lit("RE32F_IM32F"))
    first, second = (F.col("bands")[i] for i in (0, 1))
    table = amplitudes(F.col("sicd.ImageData.AmpTable"))
    size = lambda a: F.when(table.isNull(), a.cast("double")).otherwise(F.element_at(table, a.cast("int") + 1))
    turn = lambda p: p * (2 * math.pi / 256)
    polar = lambda f: F.zip_with(first, second, lambda a, p: (size(a) * f(turn(p))).cast("float"))
    wrong = F.raise_error(F.concat(F.lit("samples that can't be read in "), F.col("path"), F.lit(": "), F.coalesce("reason", kind)))
    sampled = lambda plain, f: F.when(F.col("reason").isNotNull(), wrong.cast("array<float>")).when(kind.isin("RE32F_IM32F", "RE16I_IM16I"), plain).when(kind == "AMP8I_PHS8I", polar(f)).otherwise(wrong.cast("array<float>"))
    return met.select("path", "r", "c0", sampled(first, F.cos).alias("re"), sampled(second, F.sin).alias("im"), "sicd")
