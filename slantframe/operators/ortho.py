"""Images resampled to other grids, an output tile at a time.

Pixels are packed into source tiles once.  Each output tile works out which
source tiles its pixels fall into, their neighbours included, and fetches those;
no pixel is shuffled for another one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantframe.functions.projection import packed, scene
from slantframe.functions.scenes import Scene

#: (scene, rows, cols of the output) -> (rows, cols of the image), both as arrays of floats.
Mapping = Callable[[Scene, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
TILE = 512


@dataclass(frozen=True)
class GroundGrid:
    """Cell (row, col) lies at origin + row * down + col * across (earth-fixed metres)."""

    origin: tuple[float, float, float]
    down: tuple[float, float, float]
    across: tuple[float, float, float]

    def mapping(self, image: Scene, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pixels of an image that have the range and range rate of the cells."""
        place = np.array(self.origin)[:, None] + np.outer(self.down, rows) + np.outer(self.across, cols)
        row, col, _ = image.to_pixel(place)
        return row, col


def _cells(number: int, shape: tuple[int, int], tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the cells of an output tile."""
    wide = -(-shape[1] // tile)
    r0, c0 = number // wide * tile, number % wide * tile
    r, c = np.meshgrid(np.arange(r0, min(shape[0], r0 + tile)), np.arange(c0, min(shape[1], c0 + tile)), indexing="ij")
    return r.ravel(), c.ravel()


def _corners(row: np.ndarray, col: np.ndarray, nearest: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, weights) of the pixels that a place between them is made of; weight 0 where it isn't."""
    if nearest:
        row, col = np.floor(row + 0.5), np.floor(col + 0.5)
    good = np.isfinite(row + col) & (np.abs(row) < 2**30) & (np.abs(col) < 2**30)
    row, col = np.where(good, row, 0.0), np.where(good, col, 0.0)
    r, c = np.floor(row), np.floor(col)
    for i in (0, 1):
        for j in (0, 1):
            w = (row - r if i else 1 - row + r) * (col - c if j else 1 - col + c)
            yield (r + i).astype(np.int64), (c + j).astype(np.int64), np.where(good, w, 0.0)


def source_tiles(pixels: DataFrame, value: str, tile: int) -> DataFrame:
    """(image, sr, sc, data): tiles of pixels (image, r, c, value) as doubles, NaN where there is none."""
    kind = pixels.schema["image"].dataType.simpleString()
    dealt = pixels.where(F.col(value).isNotNull()).select("image", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col(value).cast("double").alias("v"))
    dealt = dealt.withColumns({"sr": F.floor(F.col("r") / tile), "sc": F.floor(F.col("c") / tile)})

    def pack(table: pa.Table) -> pa.Table:
        out = np.full((tile, tile), np.nan)
        sr, sc = (table.column(k)[0].as_py() for k in ("sr", "sc"))
        out[table.column("r").to_numpy() - sr * tile, table.column("c").to_numpy() - sc * tile] = table.column("v").to_numpy()
        return pa.table({"image": table.column("image").slice(0, 1), "sr": pa.array([sr]), "sc": pa.array([sc]), "data": pa.array([out.tobytes()], pa.binary())})

    return dealt.groupBy("image", "sr", "sc").applyInArrow(pack, f"image {kind}, sr long, sc long, data binary")


def resample(pixels: DataFrame, images: DataFrame, shape: tuple[int, int], mapping: Mapping, value: str = "amplitude", nearest: bool = False, tile: int = TILE) -> DataFrame:
    """(image, r, c, value) of every cell of a grid of a shape for each row of images (image and its metadata).

    mapping tells where a cell lies in the image; between pixels values are
    bilinear, or the nearest pixel's.  A cell that needs a pixel which isn't
    there, or has no place, is null.
    """
    kind = images.schema["image"].dataType.simpleString()
    count = -(-shape[0] // tile) * -(-shape[1] // tile)
    tiles = images.select("image", packed(images).alias("scene"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("tile")).repartition("image", "tile")

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (meta, number) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                with np.errstate(all="ignore"):
                    row, col = mapping(scene(meta), *(x.astype(float) for x in _cells(number, shape, tile)))
                    found = np.concatenate([np.stack([r[w > 0] // tile, c[w > 0] // tile], axis=1) for r, c, w in _corners(row, col, nearest)])
                # A tile without any pixel still gives its cells.
                own = np.unique(found, axis=0) if len(found) else np.array([[0, 0]])
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * n, batch.column(0).type), pa.array([meta] * n), pa.array(np.full(n, number, np.int32)), pa.array(own[:, 0]), pa.array(own[:, 1])], ["image", "scene", "tile", "sr", "sc"])

    needed = tiles.mapInArrow(wanted, f"image {kind}, scene string, tile int, sr long, sc long")
    met = needed.join(source_tiles(pixels, value, tile), ["image", "sr", "sc"], "left")

    def sample(table: pa.Table) -> pa.Table:
        number, meta = table.column("tile")[0].as_py(), table.column("scene")[0].as_py()
        r, c = _cells(number, shape, tile)
        blocks = {(a, b): np.frombuffer(x, dtype=np.float64) for a, b, x in zip(*(table.column(k).to_pylist() for k in ("sr", "sc", "data"))) if x is not None}
        with np.errstate(all="ignore"):
            row, col = mapping(scene(meta), r.astype(float), c.astype(float))
            out = np.where(np.isfinite(row + col), 0.0, np.nan)
            for x, y, w in _corners(row, col, nearest):
                part = np.full(len(out), np.nan)
                key = (x // tile) * (1 << 32) + y // tile
                for k in np.unique(key[w > 0]):
                    at = np.flatnonzero((key == k) & (w > 0))
                    block = blocks.get((int(x[at[0]] // tile), int(y[at[0]] // tile)))
                    if block is not None:
                        part[at] = block[(x[at] % tile) * tile + y[at] % tile]
                out += np.where(w > 0, w * part, 0.0)
        image = pa.array([table.column("image")[0].as_py()] * len(r), table.column("image").type)
        return pa.table({"image": image, "r": r.astype(np.int32), "c": c.astype(np.int32), value: pa.array(out, mask=~np.isfinite(out))})

    return met.groupBy("image", "tile").applyInArrow(sample, f"image {kind}, r int, c int, `{value}` double")
