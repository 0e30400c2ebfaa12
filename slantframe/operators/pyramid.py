"""Image pyramids: each level halves the one below it, down to a single tile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantframe.operators.checkpoints import saved


def pyramid(pixels: DataFrame, tile: int = 256, value: str = "amplitude", keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """(keys, level, tile_r, tile_c, r, c, value): level 0 is the image; a cell above is the mean of the pixels below it.

    pixels are (keys, r, c, value) with rows and columns from 0 on.  A level
    is built from the one below by one exchange of a quarter of its rows, sums
    and counts carried along, so that every mean is that of the pixels and not
    of means.  Levels end with the first at which every image is one tile.
    Nulls and values that aren't finite take no part; cells without pixels
    have no row; several pixels of a cell count each.
    """
    v = F.col(value).cast("double")
    known = pixels.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    level = saved(known.groupBy(*keys, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).agg(F.sum(v).alias("sum_"), F.count("*").alias("n_")))
    size = level.agg(F.max(F.greatest("r", "c"))).first()[0]
    if level.where((F.col("r") < 0) | (F.col("c") < 0)).take(1):
        raise ValueError("rows and columns begin at 0")
    levels = [level]
    while size is not None and size >= tile:
        half = lambda x: F.floor(F.col(x) / 2).alias(x)
        level = saved(level.groupBy(*keys, half("r"), half("c")).agg(F.sum("sum_").alias("sum_"), F.sum("n_").alias("n_")))
        levels.append(level)
        size //= 2
    at = lambda x: F.floor(F.col(x) / tile)
    out = [x.select(*keys, F.lit(k).alias("level"), at("r").alias("tile_r"), at("c").alias("tile_c"), "r", "c", (F.col("sum_") / F.col("n_")).alias(value)) for k, x in enumerate(levels)]
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionAll(x)
    return whole
