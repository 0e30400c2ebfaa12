"""What an image's interpretability rests on: noise, bandwidth, information density, and how to degrade to a wanted one."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from slantframe.functions.collection import RNIIRS_OFFSET, RNIIRS_SLOPE, information_density


def sigma_zero_noise(level: Column, kind: Column, factor: Column) -> Column:
    """Noise per area from its level in decibels at the scene's centre and the factor to sigma zero; null unless the level is absolute."""
    return F.when(kind == "ABSOLUTE", F.pow(F.lit(10.0), level / 10) * factor)


def default_signal(polarization: Column) -> Column:
    """1 for like and unknown polarizations, a quarter for crossed ones (as V:H)."""
    both = F.split(polarization, ":")
    return F.when((F.size(both) > 1) & (both[0] != both[1]), 0.25).otherwise(1.0)


def bandwidth_area(row_bandwidth: Column, col_bandwidth: Column, slope_degrees: Column) -> Column:
    """Area of the spectrum's support in the ground plane."""
    return F.abs(row_bandwidth * col_bandwidth * F.cos(F.radians(slope_degrees)))


def density_for_rniirs(rating: Column) -> Column:
    """The information density that has an interpretability rating: ``collection.rniirs`` the other way."""
    turn = math.exp(1 - math.log(2) * RNIIRS_OFFSET / RNIIRS_SLOPE)
    at_turn = RNIIRS_SLOPE / math.log(2)
    return F.when(rating > at_turn, F.pow(F.lit(2.0), (rating - RNIIRS_OFFSET) / RNIIRS_SLOPE)).otherwise(rating * (turn / at_turn))


def oversampling(spacing: Column, bandwidth: Column) -> Column:
    """How many samples a resolution cell has; 1 at least."""
    return F.greatest(F.lit(1.0), 1 / F.nullif(spacing * bandwidth, F.lit(0.0)))


def bandwidth_steps(rows: Column, row_oversampling: Column, cols: Column, col_oversampling: Column) -> Column:
    """An array of (row, col): the parts of the bandwidth that are left as both apertures shrink by a sample a step, the longer one's samples setting the steps."""
    a, b = F.bround(rows / row_oversampling, 0), F.bround(cols / col_oversampling, 0)
    steps = F.greatest(a, b)
    cut = lambda size, i: F.coalesce(F.ceil((size - 1) * i / F.nullif(steps - 1, F.lit(0.0))), F.lit(0))
    left = lambda size, i: (size - cut(size, i)) / size
    return F.when(F.least(a, b) >= 1, F.transform(F.sequence(F.lit(0), (steps - 1).cast("int")), lambda i: F.struct(left(a, i).alias("row"), left(b, i).alias("col"))))


def degradation(area: Column, signal: Column, noise: Column, steps: Column, density: Column, share: Column) -> Column:
    """A struct (row, col, noise): the parts of both bandwidths to keep and the factor to the noise that lead to a wanted information density.

    share is the part of the way, in steps, that noise goes instead of
    bandwidth: 0 takes bandwidth alone, 1 noise alone.  steps are those of
    ``bandwidth_steps``.  Null if the image has less information than is
    wanted, if the last step has more, or for a share outside 0 to 1.
    """
    of = lambda s: information_density(area * s["row"] * s["col"], signal, noise)
    # Rounded, so that steps which miss by as much on either side are a tie, and the first one is taken.
    missed = F.transform(steps, lambda s, i: F.struct(F.round(F.abs(of(s) / density - 1), 9).alias("miss"), i.alias("i")))
    best = F.array_min(missed)["i"]
    chosen = F.element_at(steps, (F.least(F.greatest(F.floor(best - share * best), F.lit(0)), best) + 1).cast("int"))
    kept = area * chosen["row"] * chosen["col"]
    factor = F.greatest(F.lit(1.0), signal / noise / (F.pow(F.lit(2.0), density / kept) - 1))
    reachable = (density <= information_density(area, signal, noise)) & (density >= of(F.element_at(steps, -1))) & share.between(0, 1)
    return F.when(reachable, F.struct(chosen["row"].alias("row"), chosen["col"].alias("col"), factor.alias("noise")))


def aperture_span(size: Column, spacing: Column, bandwidth: Column, wanted: Column) -> Column:
    """A struct (first, stop): the samples of a centred spectrum that hold a wanted bandwidth; null if that is the whole band or more."""
    kept = F.bround(size / oversampling(spacing, wanted), 0)
    first = F.floor((size - kept) / 2)
    return F.when(wanted < bandwidth, F.struct(first.cast("int").alias("first"), (first + kept).cast("int").alias("stop")))


def broadening(alpha: Column, rounds: int = 50) -> Column:
    """Width at half power of the response of a raised cosine window (alpha + (1 - alpha) cos), times the bandwidth; found by halving, alpha from 0.5 to 1."""
    sinc = lambda x: F.when(x == 0, 1.0).otherwise(F.sin(math.pi * x) / (math.pi * x))
    response = lambda x: alpha * sinc(x) + (1 - alpha) / 2 * (sinc(x - 1) + sinc(x + 1))
    halve = lambda s, _: F.when(
        response((s["low"] + s["high"]) / 2) > alpha * math.sqrt(0.5), F.struct(((s["low"] + s["high"]) / 2).alias("low"), s["high"].alias("high"))
    ).otherwise(F.struct(s["low"].alias("low"), ((s["low"] + s["high"]) / 2).alias("high")))
    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    return F.when(alpha.between(0.5, 1.0), 2 * F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve)["low"])
