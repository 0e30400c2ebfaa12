"""Elevation posts and tiles: regular grids keyed by tile and post."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sign_magnitude(raw: Column) -> Column:
    """A 16-bit sign-and-magnitude value read as an unsigned one."""
    return F.when(raw.bitwiseAND(0x8000) != 0, -raw.bitwiseAND(0x7FFF)).otherwise(raw)


def bilinear(points: DataFrame, posts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """points (pt_id, gx, gy in posts) and the elevation between the four posts around them.

    Points outside the posts take no part.  On the last row or column of
    posts the cell before it is used.
    """
    keys = keys or []
    by = posts.groupBy(*keys) if keys else posts.groupBy()
    edge = by.agg(F.max("ix").alias("last_x"), F.max("iy").alias("last_y"))
    at = points.join(edge, keys) if keys else points.crossJoin(F.broadcast(edge))
    at = at.where((F.col("gx").between(0, F.col("last_x"))) & F.col("gy").between(0, F.col("last_y")))
    at = at.withColumn("bx", F.least(F.floor("gx"), F.greatest(F.col("last_x") - 1, F.lit(0)))).withColumn("by", F.least(F.floor("gy"), F.greatest(F.col("last_y") - 1, F.lit(0))))
    fx, fy = F.col("gx") - F.col("bx"), F.col("gy") - F.col("by")
    corner = lambda i, j: F.struct((F.col("bx") + i).alias("ix"), (F.col("by") + j).alias("iy"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w"))
    four = at.select(*keys, "pt_id", F.inline(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)]))).where("w > 0")
    met = four.join(posts, [*keys, "ix", "iy"], "left")
    return met.groupBy(*keys, "pt_id").agg(F.when(F.count("elev") == F.count("*"), F.sum(F.col("w") * F.col("elev"))).alias("elev"))


def geoid_heights(points: DataFrame, posts: DataFrame, spacing: float, key: str = "id") -> DataFrame:
    """(key, height) between the four posts around each point (lat, lon in degrees).

    posts (ix, iy, elev) cover the earth: ix grows eastward from longitude 0
    and closes after 360 degrees, iy northward from -90.
    """
    around, top = round(360 / spacing), round(180 / spacing)
    gx, gy = F.pmod(F.col("lon"), F.lit(360.0)) / spacing, (F.col("lat") + 90) / spacing
    at = points.select(key, gx.alias("gx"), gy.alias("gy")).withColumns({"bx": F.floor("gx").cast("int"), "by": F.least(F.floor("gy").cast("int"), F.lit(top - 1))})
    fx, fy = F.col("gx") - F.col("bx"), F.col("gy") - F.col("by")
    corner = lambda i, j: F.struct(F.pmod(F.col("bx") + i, F.lit(around)).alias("ix"), (F.col("by") + j).alias("iy"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w"))
    four = at.select(key, F.inline(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)])))
    return four.join(posts, ["ix", "iy"]).groupBy(key).agg(F.sum(F.col("w") * F.col("elev")).alias("height"))


def first_tile(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """(pt_id, tile): of the tiles whose box holds a point, the one of the least priority value.

    Tiles (tile, priority, lat_low, lat_high, lon_low, lon_high) are dealt to
    the whole-degree cells they touch; a point meets the tiles of its cell.
    Of tiles with the same box, and of those that hold all of a cell, only the
    first can be a result, and what comes after the latter can't.
    """
    box, cell = ["lat_low", "lat_high", "lon_low", "lon_high"], ["clat", "clon"]
    first = F.min(F.struct("priority", "tile")).alias("first_")
    boxes = tiles.groupBy(*box).agg(first)
    cells = boxes.withColumn("clat", F.explode(F.sequence(F.floor("lat_low"), F.floor("lat_high")))).withColumn("clon", F.explode(F.sequence(F.floor("lon_low"), F.floor("lon_high"))))
    holds = (F.col("lat_low") <= F.col("clat")) & (F.col("lat_high") >= F.col("clat") + 1) & (F.col("lon_low") <= F.col("clon")) & (F.col("lon_high") >= F.col("clon") + 1)
    whole = cells.where(holds).groupBy(*cell).agg(F.min("first_").alias("whole_"))
    part = cells.where(~holds).join(whole, cell, "left").where("whole_ is null or first_ < whole_").select(*cell, *box, "first_")
    least = whole.select(*cell, *(c.cast(tiles.schema[b].dataType).alias(b) for b, c in zip(box, (F.col("clat"), F.col("clat") + 1, F.col("clon"), F.col("clon") + 1))), F.col("whole_").alias("first_"))
    met = points.withColumn("clat", F.floor("lat")).withColumn("clon", F.floor("lon")).join(part.unionAll(least), cell)
    met = met.where("lat between lat_low and lat_high and lon between lon_low and lon_high")
    return met.groupBy("pt_id").agg(F.min("first_").alias("first_")).select("pt_id", "first_.tile")


def extremes(posts: DataFrame, keys: list[str]) -> DataFrame:
    """Least and largest elevation of each tile and where they are (first by ix, iy)."""
    place = F.struct("ix", "iy")
    low, high = F.min(F.struct("elev", "ix", "iy")), F.max(F.struct("elev", (-F.col("ix")).alias("nx"), (-F.col("iy")).alias("ny")))
    out = posts.where("elev is not null").groupBy(*keys).agg(low.alias("lo"), high.alias("hi"), F.count(place).alias("n"))
    return out.select(*keys, F.col("lo.elev").alias("low"), F.col("lo.ix").alias("low_ix"), F.col("lo.iy").alias("low_iy"), F.col("hi.elev").alias("high"), (-F.col("hi.nx")).alias("high_ix"), (-F.col("hi.ny")).alias("high_iy"), "n")

