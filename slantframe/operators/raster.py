"""Pixel tables: one row a cell, keyed by image, row and column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slantframe.operators.quantiles import quantiles


def check_slice(start: int | None, stop: int | None, step: int | None, size: int) -> tuple[int, int, int]:
    """Bounded (start, stop, step) of an axis of size cells; negative places count from the end.

    A place outside the axis, a step of 0, or a direction that disagrees with
    the step is an error rather than an empty result.
    """
    step = 1 if step is None else step
    if not step:
        raise ValueError("a step of 0")
    first = (0 if step > 0 else size - 1) if start is None else start + size * (start < 0)
    last = (size if step > 0 else -1) if stop is None else stop + size * (stop < 0)
    if not (0 <= first < size and -1 <= last <= size) or (last - first) * step <= 0:
        raise ValueError(f"slice {start}:{stop}:{step} of an axis of {size}")
    return first, last, step


def chip(df: DataFrame, rows: Sequence[int | None], cols: Sequence[int | None], shape: tuple[int, int], row: str = "r", col: str = "c") -> DataFrame:
    """The cells of a strided slice, with rows and columns counted anew.

    Interval predicates reach the scan; the new index follows from arithmetic.
    """
    for name, (a, b, s) in ((row, check_slice(*rows, shape[0])), (col, check_slice(*cols, shape[1]))):
        low, high = (a, b - 1) if s > 0 else (b + 1, a)
        df = df.where(F.col(name).between(low, high)).where(F.pmod(F.col(name) - a, F.lit(abs(s))) == 0)
        df = df.withColumn(name, ((F.col(name) - a) / s).cast("int"))
    return df


def reorient(df: DataFrame, shape: tuple[int, int], reverse: Sequence[int] = (), transpose: bool = False, row: str = "r", col: str = "c") -> DataFrame:
    """Mirrors the given axes (0, 1), then swaps rows and columns if asked."""
    for axis, name in enumerate((row, col)):
        if axis in reverse:
            df = df.withColumn(name, F.lit(shape[axis] - 1) - F.col(name))
    if transpose:
        df = df.withColumns({row: F.col(col), col: F.col(row)})
    return df


def band_stack(bands: Sequence[DataFrame], band: str = "band") -> DataFrame:
    """The rows of several images of one shape, numbered by band."""
    out = None
    for k, df in enumerate(bands):
        df = df.withColumn(band, F.lit(k))
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no bands")
    return out


def mosaic(blocks: DataFrame, shape: tuple[int, int], values: Sequence[str], fill: float, image: str = "image", row: str = "r", col: str = "c") -> DataFrame:
    """Every cell of every image's grid, with fill where no block has it.

    The grid is a range a row of an image, exploded in place; its size is the
    result's.
    """
    grid = blocks.select(image).distinct().select(image, F.explode(F.sequence(F.lit(0), F.lit(shape[0] - 1))).alias(row)).select(image, row, F.explode(F.sequence(F.lit(0), F.lit(shape[1] - 1))).alias(col))
    return grid.join(blocks.select(image, row, col, *values), [image, row, col], "left").fillna(fill, list(values))


def statistics(df: DataFrame, image: str = "image", value: str = "amplitude", quantile: float | None = 0.99) -> DataFrame:
    """n, mean over finite non-zero values, minimum, maximum and exact quantile of each image."""
    v = F.col(value)
    finite = ~(F.isnan(v) | (F.abs(v) == float("inf"))) & v.isNotNull()
    out = [F.count(F.when(finite, 1)).alias("n"), F.avg(F.when(finite & (v != 0), v)).alias("mean"), F.min(F.when(finite, v)).alias("low"), F.max(F.when(finite, v)).alias("high")]
    found = df.groupBy(image).agg(*out)
    if quantile is None:
        return found
    tops = quantiles(df, [image], value, {"quantile": quantile}).withColumnRenamed(image, "image_")
    return found.join(tops, F.col(image).eqNullSafe(F.col("image_")), "left").drop("image_")


def box_sums(df: DataFrame, values: Sequence[str], half: int, keys: Sequence[str] = ("image",), row: str = "r", col: str = "c") -> DataFrame:
    """Sums over the (2 half + 1)-wide square around each cell; missing cells count as 0.

    The square is a sum over columns of sums over rows: two range windows,
    each partitioned by a whole line of an image.
    """
    across = Window.partitionBy(*keys, row).orderBy(col).rangeBetween(-half, half)
    down = Window.partitionBy(*keys, col).orderBy(row).rangeBetween(-half, half)
    df = df.withColumns({f"{v}_sum": F.sum(v).over(across) for v in values})
    return df.withColumns({f"{v}_sum": F.sum(f"{v}_sum").over(down) for v in values})


def coherence(pairs: DataFrame, half: int, keys: Sequence[str] = ("image",)) -> DataFrame:
    """Coherent change of two co-registered images (re_a, im_a, re_b, im_b): coherence and its phase.

    A window whose power is 0 in either image has coherence 0.
    """
    terms = {
        "xr": F.col("re_a") * F.col("re_b") + F.col("im_a") * F.col("im_b"),
        "xi": F.col("re_a") * F.col("im_b") - F.col("im_a") * F.col("re_b"),
        "pa": F.col("re_a") * F.col("re_a") + F.col("im_a") * F.col("im_a"),
        "pb": F.col("re_b") * F.col("re_b") + F.col("im_b") * F.col("im_b"),
    }
    out = box_sums(pairs.withColumns(terms), list(terms), half, keys)
    power = F.sqrt(F.col("pa_sum") * F.col("pb_sum"))
    size = F.sqrt(F.col("xr_sum") * F.col("xr_sum") + F.col("xi_sum") * F.col("xi_sum"))
    return out.select(*keys, "r", "c", F.coalesce(size / F.nullif(power, F.lit(0.0)), F.lit(0.0)).alias("coherence"), F.atan2("xi_sum", "xr_sum").alias("coherence_phase"))


def best_shift(a: DataFrame, b: DataFrame, reach: int, value: str = "amplitude", keys: Sequence[str] = ("image",)) -> DataFrame:
    """The shift (dr, dc) of b against a, up to reach cells, with the largest normalised correlation.

    Every cell of b is taken at each of the (2 reach + 1) squared shifts and
    met with a by an equi-join; sums are formed before they are compared.
    """
    steps = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    moved = b.select(*keys, "r", "c", F.col(value).alias("vb")).withColumn("dr", steps).withColumn("dc", steps)
    moved = moved.select(*keys, (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"), "dr", "dc", "vb")
    met = a.select(*keys, "r", "c", F.col(value).alias("va")).join(moved, [*keys, "r", "c"])
    score = F.sum(F.col("va") * F.col("vb")) / F.nullif(F.sqrt(F.sum(F.col("va") * F.col("va")) * F.sum(F.col("vb") * F.col("vb"))), F.lit(0.0))
    sums = met.groupBy(*keys, "dr", "dc").agg(score.alias("score"), F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), "dr", "dc"))
    return sums.withColumn("k", first).where("k = 1").drop("k")


def resample(source: DataFrame, targets: DataFrame, method: str = "nearest", value: str = "amplitude", keys: Sequence[str] = ("image",)) -> DataFrame:
    """targets (with pixel places pr, pc) and the value there: nearest cell, or bilinear over four.

    Outside the source the value is null.  Each target meets the one or four
    cells around it by an equi-join on the cell.
    """
    cells = source.select(*keys, F.col("r").alias("sr"), F.col("c").alias("sc"), F.col(value).alias("sv"))
    if method == "nearest":
        at = targets.withColumn("sr", F.floor(F.col("pr") + 0.5).cast("int")).withColumn("sc", F.floor(F.col("pc") + 0.5).cast("int"))
        return at.join(cells, [*keys, "sr", "sc"], "left").withColumnRenamed("sv", value).drop("sr", "sc")
    if method != "bilinear":
        raise ValueError(method)
    ident = "__target"
    marked = targets.withColumn(ident, F.struct(*targets.columns))
    fr, fc = F.col("pr") - F.floor("pr"), F.col("pc") - F.floor("pc")
    corner = lambda i, j: F.struct((F.floor("pr") + i).cast("int").alias("sr"), (F.floor("pc") + j).cast("int").alias("sc"), ((fr if i else 1 - fr) * (fc if j else 1 - fc)).alias("w"))
    four = marked.select(*keys, ident, F.inline(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)]))).where("w > 0")
    sums = four.join(cells, [*keys, "sr", "sc"], "left").groupBy(ident).agg(F.when(F.count("sv") == F.count("*"), F.sum(F.col("w") * F.col("sv"))).alias(value))
    return sums.select(f"{ident}.*", value)
