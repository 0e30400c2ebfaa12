"""WGS-84 geodesy as Column expressions: degrees and metres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slantframe.functions.vectors import Vec

# Fixed values of the ellipsoid: semi-axes in metres and what follows from them.
A = 6378137.0
B = 6356752.314245179
A2, B2 = A * A, B * B
E2 = (A2 - B2) / A2
EP2 = (A2 - B2) / B2


def geodetic_to_ecf(lat: Column, lon: Column, hae: Column) -> Vec:
    """Earth-fixed place of a latitude, longitude and height above the ellipsoid."""
    p, q = F.radians(lat), F.radians(lon)
    n = F.lit(A) / F.sqrt(1 - E2 * F.sin(p) * F.sin(p))
    return Vec((n + hae) * F.cos(p) * F.cos(q), (n + hae) * F.cos(p) * F.sin(q), (n * (1 - E2) + hae) * F.sin(p))


def ecf_to_geodetic(df: DataFrame, place: str, lat: str = "lat", lon: str = "lon", hae: str = "hae", rounds: int = 3) -> DataFrame:
    """Adds latitude, longitude and height of the place (columns <place>_x, _y, _z); null near the earth's centre, where no unique answer exists.

    Bowring's rounds on the parametric latitude: each takes the tangent of the
    geodetic latitude from the centre of curvature of the last one.
    """
    names = df.columns
    p = Vec.of(place)
    c = F.col
    df = df.withColumn("axis_", F.hypot(p.x, p.y))
    tangent = F.atan2(p.z * A, c("axis_") * B)
    for _ in range(rounds):
        df = df.withColumn("beta_", tangent)
        sin, cos = F.sin("beta_"), F.cos("beta_")
        df = df.withColumn("phi_", F.atan2(p.z + EP2 * B * sin * sin * sin, c("axis_") - E2 * A * cos * cos * cos))
        tangent = F.atan2(B * F.sin("phi_"), A * F.cos("phi_"))
    # The evolute of the meridian's ellipse bounds where several normals pass.
    unique = F.pow(A * c("axis_"), F.lit(2 / 3)) + F.pow(F.abs(B * p.z), F.lit(2 / 3)) > (A2 - B2) ** (2 / 3)
    up = c("axis_") * F.cos("phi_") + p.z * F.sin("phi_") - A * F.sqrt(1 - E2 * F.sin("phi_") * F.sin("phi_"))
    found = (F.degrees("phi_"), F.degrees(F.atan2(p.y, p.x)), up)
    return df.select(*names, *(F.when(unique, x).alias(n) for n, x in zip((lat, lon, hae), found)))


def ellipsoid_normal(p: Vec) -> Vec:
    """Unit normal of the ellipsoid through an earth-fixed place."""
    return Vec(p.x / A2, p.y / A2, p.z / B2).unit()


def local_axes(lat: Column, lon: Column) -> tuple[Vec, Vec, Vec]:
    """Unit vectors (east, north, up) at a latitude and longitude."""
    p, q = F.radians(lat), F.radians(lon)
    east = Vec(-F.sin(q), F.cos(q), F.lit(0.0))
    north = Vec(-F.sin(p) * F.cos(q), -F.sin(p) * F.sin(q), F.cos(p))
    up = Vec(F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p))
    return east, north, up


def ecf_to_enu(p: Vec, origin: Vec, lat: Column, lon: Column, absolute: bool = True) -> Vec:
    """East, north, up of a place (or, not absolute, of a direction) seen from an origin at lat, lon."""
    d = p - origin if absolute else p
    return Vec(*(d.dot(axis) for axis in local_axes(lat, lon)))


def enu_to_ecf(p: Vec, origin: Vec, lat: Column, lon: Column, absolute: bool = True) -> Vec:
    east, north, up = local_axes(lat, lon)
    d = east * p.x + north * p.y + up * p.z
    return d + origin if absolute else d


def ecf_to_ned(p: Vec, origin: Vec, lat: Column, lon: Column, absolute: bool = True) -> Vec:
    e = ecf_to_enu(p, origin, lat, lon, absolute)
    return Vec(e.y, e.x, -e.z)


def ned_to_ecf(p: Vec, origin: Vec, lat: Column, lon: Column, absolute: bool = True) -> Vec:
    return enu_to_ecf(Vec(p.y, p.x, -p.z), origin, lat, lon, absolute)


def ray_on_ellipsoid(origin: Vec, direction: Vec, height: float = 0.0) -> tuple[Column, Vec]:
    """(distance, place) where a ray first meets the ellipsoid raised by height; null where it misses or looks away."""
    a, b = A + height, B + height
    o, d = Vec(origin.x / a, origin.y / a, origin.z / b), Vec(direction.x / a, direction.y / a, direction.z / b)
    half, whole = o.dot(d), F.nullif(d.dot(d), F.lit(0.0))
    under = half * half - whole * (o.dot(o) - 1.0)
    t = F.when(under >= 0, (-half - F.sqrt(F.greatest(under, F.lit(0.0)))) / whole)
    t = F.when(t > 0, t)
    return t, origin + direction * t


def dms(degrees: Column) -> tuple[Column, Column, Column]:
    """Degrees (with the sign), minutes and seconds."""
    size = F.abs(degrees)
    whole = F.floor(size)
    minutes = F.floor((size - whole) * 60)
    seconds = ((size - whole) * 60 - minutes) * 60
    return F.when(degrees < 0, -whole).otherwise(whole).cast("double"), minutes.cast("double"), seconds


def dms_text(degrees: Column, axis: str, signed: bool = False) -> Column:
    """Degrees, minutes and whole seconds, padded, with symbols and a hemisphere letter or a sign.

    Seconds that round to 60 are carried.  axis is lat or lon; a longitude
    above 180 is taken as a western one; zero counts as south or west.
    """
    value = F.when(degrees > 180, degrees - 360).otherwise(degrees) if axis == "lon" else degrees
    seconds = F.round(F.abs(value) * 3600, 0).cast("bigint")
    letters = ("N", "S") if axis == "lat" else ("E", "W")
    width = 2 if axis == "lat" else 3
    body = F.concat(
        F.lpad((F.expr("0") + F.floor(seconds / 3600)).cast("bigint").cast("string"), width, "0"),
        F.lit("°"),
        F.lpad(F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("bigint").cast("string"), 2, "0"),
        F.lit("'"),
        F.lpad(F.pmod(seconds, F.lit(60)).cast("string"), 2, "0"),
        F.lit('"'),
    )
    if signed:
        return F.concat(F.when(value > 0, "+").otherwise("-"), body)
    return F.concat(body, F.when(value > 0, letters[0]).otherwise(letters[1]))


def parse_dms(text: Column) -> Column:
    """Degrees of a text with one to three numbers; W, S or a minus sign (not both) negate; null if unreadable."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]*\.?[0-9]+)"), 1), lambda x: x.cast("double"))
    size = F.aggregate(F.reverse(numbers), F.lit(0.0), lambda a, x: a / 60.0 + x)
    negative = text.rlike("[WS]") != text.contains("-")
    value = F.when(negative, -size).otherwise(size)
    good = F.size(numbers).between(1, 3) & value.between(-180, 360) & (F.length(F.regexp_replace(text, "[^A-Za-z]", "")) <= 1)
    return F.when(good, value)
