"""Complex samples as two Columns (re, im), and their raw encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def magnitude(re: Column, im: Column) -> Column:
    return F.sqrt(re * re + im * im)


def phase(re: Column, im: Column) -> Column:
    """Angle in (-pi, pi]."""
    return F.atan2(im, re)


def multiply_conjugate(re_a: Column, im_a: Column, re_b: Column, im_b: Column) -> tuple[Column, Column]:
    """a times the conjugate of b."""
    return re_a * re_b + im_a * im_b, im_a * re_b - re_a * im_b


def from_polar(size: Column, angle: Column) -> tuple[Column, Column]:
    return size * F.cos(angle), size * F.sin(angle)


def decode_amp_phase(amp: Column, angle: Column, bits: int = 8, table: Column | None = None) -> tuple[Column, Column]:
    """Samples stored as an unsigned magnitude, possibly through a lookup table (array), and an unsigned fraction of a turn."""
    size = F.element_at(table, amp.cast("int") + 1) if table is not None else amp.cast("double")
    return from_polar(size, angle * (2 * 3.141592653589793 / (1 << bits)))


def encode_amp_phase(re: Column, im: Column, bits: int = 8) -> tuple[Column, Column]:
    """The inverse of decode_amp_phase without a table: rounded, clipped, the angle wrapped to a turn."""
    top = (1 << bits) - 1
    turn = F.pmod(F.round(phase(re, im) / (2 * 3.141592653589793 / (1 << bits))), F.lit(float(1 << bits)))
    return F.least(F.round(magnitude(re, im)), F.lit(float(top))).cast("int"), turn.cast("int")


def clip_cast(x: Column, low: int = 0, high: int = 255) -> Column:
    """Clips, then cuts off the fraction."""
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))).cast("int")
