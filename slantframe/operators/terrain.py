"""Pixels on terrain: where a pixel's contour of range and range rate meets elevation posts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantframe.functions.projection import _mapped, by_scene, numbers, packed
from slantframe.functions.scenes import geodetic
from slantframe.operators.checkpoints import saved

#: Posts of a tile's side, and pixels that share a copy of a tile.
TILE, CROWD = 256, 20_000


@dataclass(frozen=True)
class PostGrid:
    """Post (ix, iy) lies at longitude lon + ix * lon_step and latitude lat + iy * lat_step (degrees)."""

    lon: float
    lat: float
    lon_step: float
    lat_step: float

    def at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lat, lon, _ = geodetic(place)
        return (lon - self.lon) / self.lon_step, (lat - self.lat) / self.lat_step


class Raster:
    """The posts of a tile and its surroundings; places without posts are NaN."""

    def __init__(self, ix: np.ndarray, iy: np.ndarray, elev: np.ndarray) -> None:
        self.x0, self.y0 = int(ix.min()), int(iy.min())
        self.posts = np.full((int(ix.max()) - self.x0 + 2, int(iy.max()) - self.y0 + 2), np.nan)
        self.posts[ix - self.x0, iy - self.y0] = elev

    def bilinear(self, gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
        x, y = gx - self.x0, gy - self.y0
        inside = (x >= 0) & (y >= 0) & (x <= self.posts.shape[0] - 2) & (y <= self.posts.shape[1] - 2)
        x, y = np.where(inside, x, 0.0), np.where(inside, y, 0.0)
        bx, by = np.floor(x).astype(int), np.floor(y).astype(int)
        out = np.zeros(len(x))
        for i in (0, 1):
            for j in (0, 1):
                w = (x - bx if i else 1 - x + bx) * (y - by if j else 1 - y + by)
                out += np.where(w > 0, w * self.posts[bx + i, by + j], 0.0)
        return np.where(inside, out, np.nan)


def image_to_dem(df: DataFrame, posts: DataFrame, grid: PostGrid, heights: tuple[float, float, int], key: str = "id", out: str = "at", tile: int = TILE, crowd: int = CROWD, tolerance: float = 1e-3) -> DataFrame:
    """(key, out_x, out_y, out_z): the first meeting, from above, of each pixel's contour with the terrain.

    df has pixels and their image's metadata, posts (ix, iy, elev); heights
    are the least, the largest and the least number of levels at which the
    contour is looked up.  Where a contour moves over more than half a post
    from level to level there are more levels, so no ridge of posts is stepped
    over; between two levels the height is halved down to the tolerance.  A
    pixel that doesn't meet the terrain has no row.

    Pixels go to the tile of posts above which their contour begins, once, and
    posts to the tiles within the farthest reach of a contour; a tile with
    many pixels is copied, one copy for ``crowd`` of them.
    """
    low, high, count = heights

    def ends(image, row: np.ndarray, col: np.ndarray) -> list[np.ndarray]:
        x, y = grid.at(image.to_height(row, col, np.full(len(row), float(high))))
        u, w = grid.at(image.to_height(row, col, np.full(len(row), float(low))))
        return [np.floor(x / tile), np.floor(y / tile), np.maximum(np.abs(x - u), np.abs(y - w))]

    pixels = _mapped(df, ["row", "col"], ["tx", "ty", "reach"], ends).where("reach is not null")
    pixels = saved(pixels.select(F.col(key), F.col("row").cast("double"), F.col("col").cast("double"), packed(pixels).alias("scene"), F.col("tx").cast("int"), F.col("ty").cast("int"), "reach"))
    halo = int(1.05 * (pixels.agg(F.max("reach")).first()[0] or 0)) + 3
    copies = pixels.groupBy("tx", "ty").agg(F.ceil(F.count("*") / crowd).cast("int").alias("copies"))
    # Crowded tiles are at most one for crowd pixels; a join that isn't a broadcast would gather each tile's pixels in one task.
    crowded = F.broadcast(copies.where("copies > 1"))
    spread = pixels.join(crowded, ["tx", "ty"], "left").withColumn("copies", F.coalesce("copies", F.lit(1))).withColumn("copy", F.pmod(F.xxhash64(key, "row", "col"), F.col("copies")).cast("int"))
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / tile).cast("int"), F.floor((F.col(c) + halo) / tile).cast("int")))
    dealt = posts.where("elev is not null").select("ix", "iy", F.col("elev").cast("double").alias("elev")).withColumn("ux", near("ix")).withColumn("uy", near("iy"))
    wanted = copies.select(F.col("tx").alias("ux"), F.col("ty").alias("uy"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("ucopy"))
    dealt = dealt.join(wanted, ["ux", "uy"])
    kind = df.schema[key].dataType.simpleString()

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column(key).combine_chunks()
        places = np.full((3, left.num_rows), np.nan)
        if left.num_rows and right.num_rows:
            raster = Raster(*(right.column(c).to_numpy() for c in ("ix", "iy", "elev")))
            over = lambda place, height: height - raster.bilinear(*grid.at(place))
            apart = lambda a, b: np.hypot(*(p - q for p, q in zip(grid.at(a), grid.at(b))))
            with np.errstate(all="ignore"):
                places = np.stack(by_scene(left.column("scene").combine_chunks(), [numbers(left.column(c).combine_chunks()) for c in ("row", "col")], 3, lambda image, row, col: image.to_terrain(row, col, low, high, over, apart, count, tolerance)))
        good = np.isfinite(places).all(axis=0)
        return pa.table({key: ids.filter(pa.array(good)), **{f"{out}_{a}": places[i, good] for i, a in enumerate("xyz")}})

    return spread.groupBy("tx", "ty", "copy").cogroup(dealt.groupBy("ux", "uy", "ucopy")).applyInArrow(meet, f"`{key}` {kind}, {out}_x double, {out}_y double, {out}_z double")
