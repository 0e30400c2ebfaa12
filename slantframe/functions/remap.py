"""Display remaps: amplitude to output levels, as Columns of the amplitude and of global statistics."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slantframe.functions.pixels import clip_cast
from slantframe.operators.quantiles import quantiles


def density(amplitude: Column, mean: Column, dmin: float = 30.0, mmult: float = 40.0, top: float = 255.0) -> Column:
    """Logarithmic map with dmin at 0.8 of the mean and 255 at mmult times that; a mean of 0 gives 0."""
    slope = (255.0 - dmin) / math.log10(mmult)
    level = slope * F.log10(F.greatest(amplitude, F.lit(1e-5))) + (dmin - slope * F.log10(0.8 * F.nullif(mean, F.lit(0.0))))
    return F.coalesce(level * (top / 255.0), F.lit(0.0))


# Fixed values of the named density remaps: (dmin, mmult).
DENSITIES = {"density": (30.0, 40.0), "brighter": (60.0, 40.0), "darker": (0.0, 40.0), "high_contrast": (30.0, 4.0)}


def _finite(x: Column) -> Column:
    return ~(F.isnan(x) | (F.abs(x) == float("inf")))


def linear(amplitude: Column, low: Column, high: Column, top: float = 255.0) -> Column:
    """Non-finite values go to the top, a constant image to 0."""
    part = (amplitude - low) / F.nullif(high - low, F.lit(0.0))
    return F.when(_finite(amplitude), F.coalesce(top * F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))).otherwise(top)


def logarithmic(amplitude: Column, low: Column, high: Column, top: float = 255.0) -> Column:
    """log2 of the amplitude scaled to 1..2; zero stays 0."""
    part = (F.least(F.greatest(amplitude, low), high) - low) / F.nullif(high - low, F.lit(0.0)) + 1
    level = F.coalesce(top * F.log2(part), F.lit(0.0))
    return F.when(~_finite(amplitude), top).when(amplitude == 0, 0.0).otherwise(level)


def pedf(amplitude: Column, mean: Column, top: float = 255.0) -> Column:
    """Density with the upper half of the levels compressed to half of it."""
    level, half = density(amplitude, mean, top=top), 0.5 * top
    return F.when(level > half, 0.5 * (level + half)).otherwise(level)


def nrl(amplitude: Column, low: Column, high: Column, changeover: Column, top: float = 255.0, knee: float | None = None) -> Column:
    """Linear up to the knee at the changeover, log2 above it."""
    knee = 0.8 * top if knee is None else knee
    below = F.when(changeover > low, knee * F.least(F.greatest((amplitude - low) / F.nullif(changeover - low, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    part = (F.least(F.greatest(amplitude, changeover), high) - changeover) / F.nullif(high - changeover, F.lit(0.0)) + 1
    above = F.coalesce(F.log2(part) * (top - knee) + knee, F.lit(knee))
    return F.when(low == high, 0.0).when(amplitude <= changeover, below).otherwise(above)


def lookup(level: Column, table: Column) -> Column:
    """The table's entry for a level from 0 on."""
    return F.element_at(table, level + 1)


_REGISTRY: dict[tuple[str, int], Callable[[DataFrame, str], DataFrame]] = {}


def register(name: str, bits: int, apply: Callable[[DataFrame, str], DataFrame], overwrite: bool = False) -> None:
    if (name, bits) in _REGISTRY and not overwrite:
        raise ValueError(f"remap {name} of {bits} bits exists")
    _REGISTRY[name, bits] = apply


def names() -> list[str]:
    return sorted({name for name, _ in _REGISTRY})


def get(name: str, bits: int = 8) -> Callable[[DataFrame, str], DataFrame]:
    """The function (df with column amplitude, partition column) -> df with the column level."""
    return _REGISTRY[name, bits]


def _with_statistics(df: DataFrame, image: str, *wanted: str) -> DataFrame:
    """df with the wanted statistics of its image; a row an image, so the join moves little.

    The mean is that of the finite values other than zero.
    """
    a = F.col("amplitude")
    use = F.when(_finite(a), a)
    stats = {"mean_": F.avg(F.when(_finite(a) & (a != 0), a)), "low_": F.min(use), "high_": F.max(use)}
    found = df.groupBy(image).agg(*(stats[n].alias(n) for n in wanted if n in stats))
    shares = {n: x for n, x in {"p99_": 0.99, "median_": 0.5}.items() if n in wanted}
    return df.join(found.join(quantiles(df, [image], "amplitude", shares), image) if shares else found, image)


def _registered(level: Callable[[float], Column], bits: int, *wanted: str) -> Callable[[DataFrame, str], DataFrame]:
    top = float((1 << bits) - 1)
    return lambda df, image: _with_statistics(df, image, *wanted).withColumn("level", clip_cast(level(top), 0, int(top))).drop(*wanted)


# Fixed values of the angle-dependent density remap: exponent by weighting, factor of the low cut-off, factors of
# graze and of the log of median over mean, and the range in decibels that the cut-offs may span.
GDM_EXPONENT, GDM_LOW, GDM_GRAZE, GDM_MEDIAN, GDM_SPAN = {"uniform": 1.23, "taylor": 1.33}, 0.77, -0.0422, -1.95, (24.0, 40.0)


def gdm_cutoffs(mean: Column, median: Column, graze: float, slope: float, weighting: str = "uniform") -> tuple[Column, Column]:
    """(low, high) amplitudes of the angle-dependent density remap; angles in degrees."""
    tilt = math.sin(math.radians(graze)) / math.cos(math.radians(slope))
    low = median * GDM_LOW
    high = median * F.pow(F.lit(10.0), GDM_EXPONENT[weighting] + GDM_GRAZE * tilt + GDM_MEDIAN * F.log10(median / mean))
    span = 20 * F.log10(high / low)
    over = span - F.least(F.greatest(span, F.lit(GDM_SPAN[0])), F.lit(GDM_SPAN[1]))
    beta = F.pow(F.lit(10.0), over / 40)
    return low * beta, high / beta


def gdm(graze: float, slope: float, weighting: str = "uniform", bits: int = 8) -> Callable[[DataFrame, str], DataFrame]:
    """A density remap whose cut-offs follow from the image's mean, its median and its angles in degrees."""

    def level(top: float) -> Column:
        low, high = gdm_cutoffs(F.col("mean_"), F.col("median_"), graze, slope, weighting)
        rise = 225.0 / F.log10(high / low)
        return F.coalesce((rise * (F.log10(F.greatest(F.col("amplitude"), F.lit(1e-5))) - F.log10(low)) + 30.0) * (top / 255.0), F.lit(0.0))

    return _registered(level, bits, "mean_", "median_")


for _bits in (8, 16):
    for _name, (_dmin, _mmult) in DENSITIES.items():
        register(_name, _bits, lambda df, image, d=_dmin, m=_mmult, b=_bits: _registered(lambda top: density(F.col("amplitude"), F.col("mean_"), d, m, top), b, "mean_")(df, image))
    register("linear", _bits, lambda df, image, b=_bits: _registered(lambda top: linear(F.col("amplitude"), F.col("low_"), F.col("high_"), top), b, "low_", "high_")(df, image))
    register("log", _bits, lambda df, image, b=_bits: _registered(lambda top: logarithmic(F.col("amplitude"), F.col("low_"), F.col("high_"), top), b, "low_", "high_")(df, image))
    register("pedf", _bits, lambda df, image, b=_bits: _registered(lambda top: pedf(F.col("amplitude"), F.col("mean_"), top), b, "mean_")(df, image))
    register("nrl", _bits, lambda df, image, b=_bits: _registered(lambda top: nrl(F.col("amplitude"), F.col("low_"), F.col("high_"), F.col("p99_"), top), b, "low_", "high_", "p99_")(df, image))
