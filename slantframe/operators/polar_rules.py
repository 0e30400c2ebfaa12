"""Rules over images formed by the polar format, and over azimuth-compressed ones: one row an image, results as in operators.phase_rules.

Columns are those of operators.derivation (axes, bands, polynomials of the
polar format) and image_plane, mode, reference_index, centre_frequency,
row_deltak and col_deltak (polynomials of the band's middle over the image),
deskewed (whether the deskew was applied), deskew_phase, tstart_proc and
tend_proc, pos and vel (place and velocity at the centre of aperture), ipp (the
polynomial of the only set of pulses), kaz_poly, slant_range and dop_cone.
A rule applies where what it compares is there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slantframe.functions.geodesy import ellipsoid_normal
from slantframe.functions.polynomials import derivative, poly1d
from slantframe.functions.vectors import Vec
from slantframe.operators.derivation import _POLAR, polar_format
from slantframe.operators.phase_rules import SPEED_OF_LIGHT, Rule, evaluate

#: Times at which the polynomials of the polar format are compared with the track.
TIMES = 40


def _there(*names: str) -> Column:
    return reduce(lambda p, q: p & q, [F.col(n).isNotNull() for n in names])


def _misses(df: DataFrame) -> DataFrame:
    """df with angle_miss and scale_miss: how far the polynomials of the polar format are from the track, at most."""
    own = F.when((F.col("algorithm") == "PFA") & _there(*_POLAR, "polar_angle", "freq_scale"), F.to_json(F.struct(*_POLAR, "polar_angle", "freq_scale")))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[float | None]] = [[], []]
            for text in batch.column(len(names)).to_pylist():
                miss: tuple[float | None, float | None] = (None, None)
                if text:
                    meta = json.loads(text)
                    times = np.linspace(0, meta["duration"], max(TIMES, len(meta["polar_angle"])))
                    angle, scale = polar_format(meta, times)
                    at = np.polynomial.polynomial.polyval
                    miss = float(np.abs(at(times, meta["polar_angle"]) - angle).max()), float(np.abs(at(angle, meta["freq_scale"]) - scale).max())
                for x, m in zip(out, miss):
                    x.append(m)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array(x, pa.float64()) for x in out)], [*names, "angle_miss", "scale_miss"])

    schema = df.select("*", F.lit(0.0).cast("double").alias("angle_miss"), F.lit(0.0).cast("double").alias("scale_miss")).schema
    return df.withColumn("polar_", own).mapInArrow(run, reduce(lambda s, f: s.add(f.name, f.dataType, True), schema, type(schema)()))


def _degrees_apart(a: Vec, b: Vec) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), a.dot(b)))))


def _scalar(poly: Column) -> Column:
    return (F.size(poly) == 1) & (F.size(F.get(poly, F.lit(0))) == 1)


def _first(poly: Column) -> Column:
    return F.get(F.get(poly, F.lit(0)), F.lit(0))


def _padded(poly: Column, rows: Column, cols: Column) -> Column:
    """A table of coefficients with zeros up to a size."""
    at = lambda i, j: F.coalesce(F.get(F.get(poly, i), j), F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), rows - 1), lambda i: F.transform(F.sequence(F.lit(0), cols - 1), lambda j: at(i, j)))


def _apart(a: Column, b: Column) -> Column:
    """The largest difference of coefficients of two polynomials of any orders."""
    width = lambda p: F.coalesce(F.array_max(F.transform(p, F.size)), F.lit(1))
    rows, cols = F.greatest(F.size(a), F.size(b)), F.greatest(width(a), width(b))
    gaps = F.zip_with(F.flatten(_padded(a, rows, cols)), F.flatten(_padded(b, rows, cols)), lambda x, y: F.abs(x - y))
    return F.array_max(gaps)


def _slant(los: Vec) -> tuple[Column, Vec]:
    """(side of track, unit normal of the slant plane) at the centre of aperture."""
    look = F.signum(Vec.of("pos").cross(Vec.of("vel")).dot(los))
    return look, (los.cross(Vec.of("vel")) * -look).unit()


def polar_rules(df: DataFrame, key: str = "image") -> DataFrame:
    """(object, rule, severity, passed, detail) of PFA images."""
    c = F.col
    df = _misses(df)
    ipn, fpn, scp = Vec.of("ipn"), Vec.of("fpn"), Vec.of("scp")
    place = Vec(*(poly1d(c(f"arp_p{a}"), c("polar_ref_time")) for a in "xyz"))
    df = (scp - (place + fpn * ((scp - place).dot(ipn) / F.nullif(fpn.dot(ipn), F.lit(0.0))))).unit().attach(df, "want")
    df = ellipsoid_normal(scp).attach(df, "up")
    look, plane = _slant((scp - Vec.of("pos")).unit())
    df = plane.attach(df, "slant")
    row, up = Vec.of("want"), Vec.of("up")
    skewed = ~F.coalesce(c("deskewed"), F.lit(False))
    centre = c("centre_frequency") * F.get("freq_scale", F.lit(0)) * (2 / SPEED_OF_LIGHT)
    tolerance = F.greatest(F.lit(1e-2), 1 - F.cos(F.atan(0.5 * c("col_bw") / c("row_kctr"))))
    ends = F.array_sort(F.array(poly1d(c("polar_angle"), c("tstart_proc")), poly1d(c("polar_angle"), c("tend_proc"))))
    bounds = F.degrees(F.greatest(F.abs(ends[0] - F.atan(c("kaz1") / c("krg1"))), F.abs(ends[1] - F.atan(c("kaz2") / c("krg1")))))
    later = F.slice(F.flatten("time_coa"), 2, F.greatest(F.size(F.flatten("time_coa")) - 1, F.lit(0)))
    pfa = c("algorithm") == "PFA"
    axes = _there("ipn_x", "fpn_x", "polar_ref_time", "arp_px", "urow_x", "ucol_x")
    both = _there("ipn_x", "fpn_x", "scp_x")
    room = lambda s, k: (c(k) - c(f"{s}_kctr"), 0.5 / c(f"{s}_ss") + 1e-10, _there(k, f"{s}_kctr", f"{s}_ss"))
    edges = []
    for name, side, k, sign, more in (("kaz_high", "col", "kaz2", 1, skewed), ("kaz_low", "col", "kaz1", -1, skewed), ("krg_high", "row", "krg2", 1, F.lit(True)), ("krg_low", "row", "krg1", -1, F.lit(True))):
        off, half, there = room(side, k)
        edges.append(Rule(f"pfa_{name}", off * sign <= half, off, more & there))
    rules = [
        Rule("pfa_type", c("grid_type") == "RGAZIM", severity="warning"),
        Rule("pfa_ref_time", F.abs(c("polar_ref_time") - c("scp_time")) <= 1e-6, c("polar_ref_time") - c("scp_time"), severity="warning"),
        *edges,
        Rule("pfa_row_bandwidth", c("row_bw") <= c("krg2") - c("krg1") + 1e-10, c("row_bw"), _there("row_bw", "krg1", "krg2")),
        Rule("pfa_col_kctr", (F.abs("col_kctr") <= 1e-5) | (F.abs(c("col_kctr") - 0.5 * (c("kaz1") + c("kaz2"))) <= 1e-5), c("col_kctr"), _there("col_kctr", "kaz1", "kaz2")),
        Rule("pfa_deskew_time", ~(_scalar(c("time_coa")) | F.forall(later, lambda x: x < 1e-6)), when=~skewed & c("time_coa").isNotNull()),
        Rule("pfa_deskew_phase", _apart(c("row_deltak"), c("deskew_phase")) <= 1e-6, _apart(c("row_deltak"), c("deskew_phase")), ~skewed & _there("row_deltak", "deskew_phase"), "warning"),
        Rule("pfa_row_kctr", F.abs(c("row_kctr") / centre - 1) <= tolerance, c("row_kctr") / centre, c("reference_index").isNull() & _there("row_kctr", "col_bw", "centre_frequency", "freq_scale")),
        Rule("pfa_angle", c("angle_miss") <= 5e-3, c("angle_miss"), c("angle_miss").isNotNull()),
        Rule("pfa_scale", c("scale_miss") <= 5e-3, c("scale_miss"), c("scale_miss").isNotNull()),
        Rule("pfa_row", (row - Vec.of("urow")).norm() <= 1e-3, when=axes),
        Rule("pfa_col", (ipn.cross(row) - Vec.of("ucol")).norm() <= 1e-3, when=axes),
        Rule("pfa_slant_plane", _degrees_apart(ipn, Vec.of("slant")) <= 1, when=both & (c("image_plane") == "SLANT") & _there("pos_x", "vel_x")),
        Rule("pfa_ground_plane", _degrees_apart(ipn, up) <= 3, when=both & (c("image_plane") == "GROUND")),
        Rule("pfa_focus_outward", fpn.dot(scp) >= 0, when=both),
        Rule("pfa_focus_level", _degrees_apart(fpn, up) <= 3, when=both, severity="warning"),
        Rule("pfa_angle_bounds", bounds <= 0.1, bounds, (c("mode") == "SPOTLIGHT") & _there("kaz1", "kaz2", "krg1", "polar_angle", "tstart_proc", "tend_proc"), "warning"),
    ]
    return evaluate(df.where(pfa), key, rules)


def compression_rules(df: DataFrame, key: str = "image") -> DataFrame:
    """(object, rule, severity, passed, detail) of RGAZCOMP images: the polynomial of azimuth frequencies, and the middles of both bands."""
    c = F.col
    look, _ = _slant((Vec.of("scp") - Vec.of("pos")).unit())
    same = lambda p: F.forall(F.flatten(c(p)), lambda x: x == _first(c(p)))
    rate = poly1d(derivative(c("ipp")), c("scp_time"))
    middle = c("row_kctr") + F.coalesce(_first(c("row_deltak")), F.lit(0.0))
    step = look * middle * Vec.of("vel").norm() * F.sin(F.radians("dop_cone")) / (c("slant_range") * F.nullif(rate, F.lit(0.0)))
    gap = F.sqrt(F.aggregate(F.zip_with(F.transform("ipp", lambda x: x * step), "kaz_poly", lambda x, y: F.pow(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x))
    centre = c("centre_frequency") * (2 / SPEED_OF_LIGHT)
    off = F.abs(c("row_kctr") - (centre - F.when(_scalar(c("row_deltak")), _first(c("row_deltak"))).otherwise(0.0)))
    row, col = c("row_deltak").isNotNull(), c("col_deltak").isNotNull()
    rules = [
        Rule("rgazcomp_kaz", gap <= 1e-3, gap, _there("ipp", "kaz_poly", "row_kctr", "dop_cone", "slant_range", "scp_time", "pos_x", "vel_x") & (c("row_deltak").isNull() | _scalar(c("row_deltak")))),
        Rule("rgazcomp_row_constant", same("row_deltak"), when=row),
        Rule("rgazcomp_row_kctr", off <= 1e-6, off, row & c("reference_index").isNull() & _there("centre_frequency", "row_kctr")),
        Rule("rgazcomp_col_zero", c("col_kctr") == 0, c("col_kctr"), ~col),
        Rule("rgazcomp_col_constant", same("col_deltak"), when=col),
        Rule("rgazcomp_col_kctr", F.abs(c("col_kctr") + _first(c("col_deltak"))) <= 1e-6, c("col_kctr"), col & _scalar(c("col_deltak"))),
    ]
    return evaluate(df.where(c("algorithm") == "RGAZCOMP"), key, rules)
