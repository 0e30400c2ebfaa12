"""Values of metadata: texts to typed values, names and versions, layouts, frames and resolutions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slantframe.functions.vectors import Vec


def parse_bool(text: Column) -> Column:
    """true or 1, false or 0, whatever their case; null for anything else."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)


def parse_float(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def parse_int(text: Column) -> Column:
    """A whole number, or a number without its fraction; null for anything else."""
    return F.coalesce(F.trim(text).try_cast("bigint"), F.trim(text).try_cast("double").try_cast("bigint"))


def parse_datetime(text: Column) -> Column:
    """An ISO time without a zone; a Z behind it is passed over."""
    return F.regexp_replace(F.trim(text), "Z$", "").try_cast("timestamp_ntz")


def parameters(pairs: Column) -> Column:
    """A map of an array of structs (name, value); of names that repeat the last one counts."""
    found = F.transform(pairs, lambda p: p["name"])
    last = F.filter(pairs, lambda p, i: F.size(F.filter(F.slice(found, i + 2, F.size(found)), lambda n: n == p["name"])) == 0)
    return F.map_from_entries(last)


def polarization_version(name: Column) -> Column:
    """The least version of the metadata standard that knows a polarization's name; null for a name without two parts."""
    parts = F.split(name, ":")
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    line, turn, late = ("V", "H"), ("RHC", "LHC"), ("S", "E", "X", "Y")
    new = a.startswith("OTHER") | b.startswith("OTHER") | a.isin(*late) | b.isin(*late)
    mixed = (a.isin(*line) & b.isin(*turn)) | (b.isin(*line) & a.isin(*turn))
    return F.when(name.isNull() | name.isin("OTHER", "UNKNOWN"), "1.1.0").when(F.size(parts) != 2, F.lit(None).cast("string")).when(new, "1.3.0").when(mixed, "1.2.1").otherwise("1.1.0")


def pass_number(minutes: Column, orbits: Column) -> Column:
    """The orbit of a day in two digits, from the minutes since midnight; halves go to the even number."""
    return F.lpad(F.bround(minutes * orbits / 1440.0, 0).cast("int").cast("string"), 2, "0")


def format_layout(text: Column) -> Column:
    """An array of structs (part, kind, bytes) of a binary format such as F8 or X=F8;Y=F8;Z=F8; (a lone one has an empty part)."""
    pieces = F.filter(F.split(text, ";"), lambda p: p != "")
    kind = lambda p: F.element_at(F.split(p, "="), -1)
    part = lambda p: F.when(p.contains("="), F.element_at(F.split(p, "="), 1)).otherwise("")
    size = lambda p: F.regexp_extract(kind(p), "([0-9]+)$", 1).cast("int")
    return F.transform(pieces, lambda p: F.struct(part(p).alias("part"), kind(p).alias("kind"), size(p).alias("bytes")))


def ground_resolution(row_ss: Column, col_ss: Column, graze: Column, twist: Column) -> tuple[Column, Column]:
    """Row and column spacing on the ground, for angles in degrees."""
    g, t = F.radians(graze), F.radians(twist)
    return F.abs(row_ss / F.cos(g)), F.hypot(F.tan(g) * F.tan(t) * row_ss, col_ss / F.cos(t))


#: Turn of the earth in radians a second, without precession.
EARTH_RATE = 7.2921151467e-5


def radial_frame(place: Vec, velocity: Vec, inertial: bool = False) -> tuple[Vec, Vec, Vec]:
    """Radial, in-track and cross-track unit vectors; inertial adds the earth's turn to the velocity."""
    v = velocity + Vec(-place.y * EARTH_RATE, place.x * EARTH_RATE, F.lit(0.0)) if inertial else velocity
    radial = place.unit()
    across = radial.cross(v).unit()
    return radial, across.cross(radial), across


def corners(rows: Column, cols: Column) -> Column:
    """An array of the four corner pixels (corner, row, col), clockwise from the first."""
    last_row, last_col = rows - 1, cols - 1
    zero = F.lit(0)
    places = (("1:FRFC", zero, zero), ("2:FRLC", zero, last_col), ("3:LRLC", last_row, last_col), ("4:LRFC", last_row, zero))
    return F.array(*[F.struct(F.lit(n).alias("corner"), r.cast("int").alias("row"), c.cast("int").alias("col")) for n, r, c in places])
