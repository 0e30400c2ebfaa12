"""Polynomials as arrays of ascending coefficients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def poly1d(coefficients: Column, x: Column) -> Column:
    """Horner's scheme."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda a, c: a * x + c)


def poly2d(coefficients: Column, x: Column, y: Column) -> Column:
    """Rows are powers of x, columns powers of y."""
    inner = F.transform(coefficients, lambda row: F.aggregate(F.reverse(row), F.lit(0.0), lambda a, c: a * y + c))
    return F.aggregate(F.reverse(inner), F.lit(0.0), lambda a, c: a * x + c)


def derivative(coefficients: Column) -> Column:
    """Coefficients of the first derivative; [0] for a constant."""
    out = F.transform(F.slice(coefficients, 2, F.greatest(F.size(coefficients) - 1, F.lit(0))), lambda c, i: c * (i + 1))
    return F.when(F.size(coefficients) > 1, out).otherwise(F.array(F.lit(0.0)))


def shift(coefficients: Column | Sequence[float], at: Column | float, scale: Column | float = 1.0) -> Column:
    """Coefficients q with q(x) = p(scale * x - at), by Horner's scheme over polynomials.

    Plain numbers are worked out once on the driver; Columns in each row.
    """
    if not isinstance(coefficients, Column):
        out: list[float] = []
        for c in reversed(coefficients):
            out = [(c if j == 0 else scale * out[j - 1]) - (at * out[j] if j < len(out) else 0.0) for j in range(len(out) + 1)]
        return F.array(*[F.lit(float(c)) for c in out])
    at, scale = (x if isinstance(x, Column) else F.lit(float(x)) for x in (at, scale))
    step = lambda q, c: F.zip_with(F.concat(F.array(c), F.transform(q, lambda x: x * scale)), F.concat(F.transform(q, lambda x: -at * x), F.array(F.lit(0.0))), lambda a, b: a + b)
    return F.aggregate(F.reverse(coefficients), F.array().cast("array<double>"), step)


def trim(coefficients: Column) -> Column:
    """Without the zeros at the end; at least one coefficient stays."""
    last = F.aggregate(F.transform(coefficients, lambda c, i: F.when(c != 0, i + 1).otherwise(0)), F.lit(1), lambda a, i: F.greatest(a, i))
    return F.slice(coefficients, 1, last)


def rational(numerator: Column, denominator: Column, x: Column, x_offset: float = 0.0, x_scale: float = 1.0, offset: float = 0.0, scale: float = 1.0) -> Column:
    """P/Q in the normalised variable, scaled back; null where Q vanishes."""
    u = (x - x_offset) / x_scale
    return poly1d(numerator, u) / F.nullif(poly1d(denominator, u), F.lit(0.0)) * scale + offset
