"""Shifts between two images on a grid of points: coarse to fine, by correlation of windows, with outliers voted out.

Pixels are packed into tiles once; each point fetches the tiles under its two
windows.  The first pass looks far around a coarse grid, the second one around
what the first one found; a task holds the windows of one point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantframe.operators.checkpoints import saved
from slantframe.operators.ortho import source_tiles

TILE = 128
#: Parts of a cell that the last step of a shift is worked out to.
FINE = 100
RESULT = "point long, r double, c double, dr double, dc double, peak double"


def correlation(fixed: np.ndarray, moving: np.ndarray) -> tuple[float, float, float]:
    """(row shift, column shift, height of the peak) of a window within a larger one of the same centre.

    Normalised correlation at every whole shift by transforms; around its peak
    the correlation's spectrum is evaluated at hundredths of a cell.
    """
    h, w = fixed.shape
    reach = (moving.shape[0] - h) // 2, (moving.shape[1] - w) // 2
    a = fixed - fixed.mean()
    size = moving.shape
    spectrum = np.fft.fft2(moving - moving.mean())
    whole = np.fft.ifft2(spectrum * np.conj(np.fft.fft2(a, size))).real[: 2 * reach[0] + 1, : 2 * reach[1] + 1]
    sums = lambda x: np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    boxed = lambda s: s[h:, w:] - s[:-h, w:] - s[h:, :-w] + s[:-h, :-w]
    centred = moving - moving.mean()
    power = boxed(sums(centred**2)) - boxed(sums(centred)) ** 2 / (h * w)
    scale = np.sqrt(np.maximum(power, 0) * (a**2).sum())
    score = np.where(scale > 1e-12 * max(1.0, float((moving**2).sum())), whole / np.where(scale > 0, scale, 1), 0)
    i, j = np.unravel_index(int(np.argmax(score)), score.shape)
    peak = float(score[i, j])
    # Windows of equal size at the best whole shift, faded out at their edges.
    taper = np.outer(np.hanning(h + 2)[1:-1], np.hanning(w + 2)[1:-1])
    b = moving[i : i + h, j : j + w]
    cross = np.fft.fft2((b - b.mean()) * taper) * np.conj(np.fft.fft2(a * taper))
    rows, cols = np.fft.fftfreq(h), np.fft.fftfreq(w)
    u = v = 0.0
    for step in (0.1, 1 / FINE):
        du, dv = u + step * np.arange(-10, 11), v + step * np.arange(-10, 11)
        fine = (np.exp(2j * np.pi * np.outer(du, rows)) @ cross @ np.exp(2j * np.pi * np.outer(cols, dv))).real
        x, y = np.unravel_index(int(np.argmax(fine)), fine.shape)
        u, v = float(du[x]), float(dv[y])
    return i - reach[0] + u, j - reach[1] + v, peak


def _matched(points: DataFrame, fixed: DataFrame, moving: DataFrame, half: int, reach: int, tile: int) -> DataFrame:
    """Shifts of points (point, r, c, guess_r, guess_c): windows of 2 * half + 1 cells, looked for within reach of the guess."""

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for point, r, c, gr, gc in zip(*(x.to_pylist() for x in batch.columns)):
                for image, y, x, side in ((0, r, c, half), (1, r + gr, c + gc, half + reach)):
                    for i in range((y - side) // tile, (y + side) // tile + 1):
                        for j in range((x - side) // tile, (x + side) // tile + 1):
                            rows.append((point, r, c, gr, gc, image, i, j))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["point", "r", "c", "guess_r", "guess_c", "image", "sr", "sc"])

    both = fixed.select(F.lit(0).cast("long").alias("image"), "r", "c", "value").unionAll(moving.select(F.lit(1).cast("long").alias("image"), "r", "c", "value"))
    needed = points.select(*(F.col(x).cast("long") for x in ("point", "r", "c", "guess_r", "guess_c"))).mapInArrow(wanted, "point long, r long, c long, guess_r long, guess_c long, image long, sr long, sc long")
    met = needed.join(source_tiles(both, "value", tile), ["image", "sr", "sc"], "left")

    def window(table: pa.Table, image: int, r: int, c: int, side: int) -> np.ndarray:
        out = np.full((2 * side + 1, 2 * side + 1), np.nan)
        for k, sr, sc, data in zip(*(table.column(x).to_pylist() for x in ("image", "sr", "sc", "data"))):
            if k == image and data is not None:
                block = np.frombuffer(data, dtype=np.float64).reshape(tile, tile)
                y, x = sr * tile - (r - side), sc * tile - (c - side)
                a, b = max(0, y), min(len(out), y + tile)
                p, q = max(0, x), min(len(out), x + tile)
                out[a:b, p:q] = block[a - y : b - y, p - x : q - x]
        return out

    def match(table: pa.Table) -> pa.Table:
        point, r, c, gr, gc = (table.column(x)[0].as_py() for x in ("point", "r", "c", "guess_r", "guess_c"))
        a, b = window(table, 0, r, c, half), window(table, 1, r + gr, c + gc, half + reach)
        # A window that leaves its image can't be judged.
        found = [] if np.isnan(a).any() or np.isnan(b).any() or np.ptp(a) == 0 else [correlation(a, b)]
        return pa.table({"point": pa.array([point] * len(found), pa.int64()), "r": pa.array([float(r)] * len(found), pa.float64()), "c": pa.array([float(c)] * len(found), pa.float64()), "dr": pa.array([gr + x[0] for x in found], pa.float64()), "dc": pa.array([gc + x[1] for x in found], pa.float64()), "peak": pa.array([x[2] for x in found], pa.float64())})

    return met.groupBy("point").applyInArrow(match, RESULT)


def grid_points(spark, shape: tuple[int, int], spacing: int, margin: int) -> DataFrame:
    """(point, r, c) of a grid inside an image."""
    down, across = max(0, (shape[0] - 2 * margin - 1) // spacing + 1), max(0, (shape[1] - 2 * margin - 1) // spacing + 1)
    at = lambda x: (x * spacing + margin).cast("long")
    return spark.range(down * across).select(F.col("id").alias("point"), at(F.floor(F.col("id") / max(1, across))).alias("r"), at(F.col("id") % max(1, across)).alias("c"))


def vote(shifts: DataFrame, around: float, tolerance: float, share: float = 0.5, least: float = 0.7) -> DataFrame:
    """shifts with good: whether the peak is high and a share of the neighbours within a distance (in both axes) has nearly the same shift.

    Points meet their neighbours by cells of that size; a point without
    neighbours is not good.
    """
    cell = lambda c: F.floor(F.col(c) / around)
    own = shifts.withColumns({"cell_r": cell("r"), "cell_c": cell("c")})
    near = own.select(*(F.col(x).alias(f"n_{x}") for x in ("point", "r", "c", "dr", "dc")), F.explode(F.array(*[F.struct((F.col("cell_r") + i).alias("cell_r"), (F.col("cell_c") + j).alias("cell_c")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("x")).select("*", "x.*").drop("x")
    met = own.join(near, ["cell_r", "cell_c"]).where((F.col("point") != F.col("n_point")) & (F.abs(F.col("r") - F.col("n_r")) <= around) & (F.abs(F.col("c") - F.col("n_c")) <= around))
    alike = (F.abs(F.col("dr") - F.col("n_dr")) <= tolerance) & (F.abs(F.col("dc") - F.col("n_dc")) <= tolerance)
    votes = met.groupBy("point").agg(F.avg(alike.cast("int")).alias("agree"))
    return shifts.join(votes, "point", "left").withColumn("good", F.coalesce((F.col("agree") >= share) & (F.col("peak") >= least), F.lit(False))).drop("agree")


def register(fixed: DataFrame, moving: DataFrame, shape: tuple[int, int], spacing: int = 64, half: int = 16, reach: int = 24, fine_reach: int = 3, coarse: int = 4, tolerance: float = 1.0, tile: int = TILE) -> DataFrame:
    """(point, r, c, dr, dc, peak, good) on a grid: a cell (r, c) of fixed lies at (r + dr, c + dc) of moving.

    fixed and moving are (r, c, value).  The first pass has a point for
    ``coarse`` of the grid's in each axis and looks ``reach`` cells around;
    its good points' median near each point of the grid, or of all of them, is
    where the second pass looks, ``fine_reach`` cells around.  Points whose
    windows leave an image have no row.
    """
    spark = fixed.sparkSession
    margin = half + fine_reach + 1
    points = grid_points(spark, shape, spacing, margin)
    wide = grid_points(spark, shape, spacing * coarse, min(half + reach + 1, max(1, min(shape) // 2 - 1)))
    first = saved(vote(_matched(wide.withColumns({"guess_r": F.lit(0), "guess_c": F.lit(0)}), fixed, moving, half, reach, tile), spacing * coarse * 1.5, tolerance))
    good = first.where("good")
    middle = good.agg(F.median("dr"), F.median("dc")).first()
    if middle[0] is None:
        middle = first.agg(F.median("dr"), F.median("dc")).first()
    if middle[0] is None:
        return first
    side = spacing * coarse * 1.5
    cell = lambda c: F.floor(F.col(c) / side)
    spread = good.select(cell("r").alias("cell_r"), cell("c").alias("cell_c"), "dr", "dc")
    around = spread.select(F.explode(F.array(*[F.struct((F.col("cell_r") + i).alias("cell_r"), (F.col("cell_c") + j).alias("cell_c"), "dr", "dc") for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("x")).select("x.*")
    local = around.groupBy("cell_r", "cell_c").agg(F.median("dr").alias("near_r"), F.median("dc").alias("near_c"))
    guessed = points.withColumns({"cell_r": cell("r"), "cell_c": cell("c")}).join(local, ["cell_r", "cell_c"], "left")
    guessed = guessed.withColumns({"guess_r": F.round(F.coalesce("near_r", F.lit(middle[0]))), "guess_c": F.round(F.coalesce("near_c", F.lit(middle[1])))})
    return vote(saved(_matched(guessed, fixed, moving, half, fine_reach, tile)), spacing * 1.5, tolerance)
