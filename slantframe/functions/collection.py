"""Collection geometry at the centre of aperture: angles in degrees, lengths in metres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slantframe.functions.geodesy import ellipsoid_normal
from slantframe.functions.vectors import Vec


def _angle(x: Column) -> Column:
    return F.degrees(F.acos(x))


def _bearing(east: Column, north: Column) -> Column:
    """Clockwise from north, in (0, 360]."""
    a = F.degrees(F.atan2(east, north))
    return F.when(a > 0, a).otherwise(a + 360)


def scene_geometry(df: DataFrame, scp: str = "scp", arp: str = "arp", vel: str = "vel") -> DataFrame:
    """Adds the derived geometry of a scene centre, an antenna place and its velocity (columns <name>_x, _y, _z).

    side_of_track, slant_range, ground_range, rov, doppler_cone, graze,
    incidence, azimuth, twist, slope, squint, layover, layover_size, shadow
    and shadow_size.  Vectors that are needed more than once are columns of
    their own in between, so no expression is evaluated over and over.
    """
    names = df.columns
    s, a, v = Vec.of(scp), Vec.of(arp), Vec.of(vel)
    out = (s - a).attach(df, "los_")
    los = Vec.of("los_")
    out = los.unit().attach(out, "ulos_")
    out = ellipsoid_normal(s).attach(out, "etp_")
    ulos, etp = Vec.of("ulos_"), Vec.of("etp_")
    left = a.unit().cross(v.unit())
    out = out.withColumn("look_", F.when(left.dot(ulos) < 0, -1.0).otherwise(1.0))
    look = F.col("look_")
    out = (v.cross(ulos) * look).unit().attach(out, "spz_")
    out = (etp * etp.dot(ulos) - ulos).unit().attach(out, "gpx_")
    out = (Vec.literal(0, 0, 1) - etp * etp.z).unit().attach(out, "north_")
    spz, gpx, north = Vec.of("spz_"), Vec.of("gpx_"), Vec.of("north_")
    gpy, east = etp.cross(gpx), north.cross(etp)
    ground = etp - spz * etp.dot(spz)
    out = (etp - ulos * (1.0 / F.nullif(ulos.dot(etp), F.lit(0.0)))).attach(out, "sh_")
    sh = Vec.of("sh_")
    out = (sh - spz * (sh.dot(etp) / F.nullif(spz.dot(etp), F.lit(0.0)))).attach(out, "shp_")
    shp = Vec.of("shp_")
    ua, uv = a.unit(), v.unit()
    along, across = (uv - ua * uv.dot(ua)).unit(), (ulos - ua * ulos.dot(ua)).unit()
    graze = -F.degrees(F.asin(etp.dot(ulos)))
    return out.select(
        *names,
        F.when(look < 0, "R").otherwise("L").alias("side_of_track"),
        los.norm().alias("slant_range"),
        (s.norm() * F.acos(s.unit().dot(ua))).alias("ground_range"),
        (los.norm() / F.nullif(v.norm(), F.lit(0.0))).alias("rov"),
        _angle(uv.dot(ulos)).alias("doppler_cone"),
        graze.alias("graze"),
        (90 - graze).alias("incidence"),
        _bearing(gpx.dot(east), gpx.dot(north)).alias("azimuth"),
        (-F.degrees(F.asin(gpy.dot(spz)))).alias("twist"),
        _angle(etp.dot(spz)).alias("slope"),
        (look * _angle(across.dot(along))).alias("squint"),
        _bearing(ground.dot(east), ground.dot(north)).alias("layover"),
        ground.norm().alias("layover_size"),
        F.degrees(F.atan2(shp.dot(gpy), shp.dot(gpx))).alias("shadow"),
        shp.norm().alias("shadow_size"),
    )


def range_plane_points(df: DataFrame, r: str, rdot: str, side: str, arp: str, varp: str, ground: str, normal: str, out: str) -> DataFrame:
    """Adds out_x, out_y, out_z: where the contour of a range and range rate meets a plane; null where it doesn't.

    The plane holds the place ground and has a unit normal; side is 1 or -1:
    the side of the track on which the scene lies.
    """
    names = df.columns
    a, v, g, n = (Vec.of(x) for x in (arp, varp, ground, normal))
    df = df.withColumns({"height_": (a - g).dot(n), "climb_": v.dot(n)})
    df = (v - n * F.col("climb_")).attach(df, "ahead_").withColumn("flat2_", F.col(r) * F.col(r) - F.col("height_") * F.col("height_"))
    df = df.withColumns({"speed_": F.nullif(Vec.of("ahead_").norm(), F.lit(0.0)), "flat_": F.sqrt(F.greatest("flat2_", F.lit(0.0)))})
    df = (Vec.of("ahead_") * (1.0 / F.col("speed_"))).attach(df, "along_")
    df = n.cross(Vec.of("along_")).attach(df, "across_")
    df = df.withColumn("cosine_", (F.col("height_") * F.col("climb_") - F.col(r) * F.col(rdot)) / F.nullif(F.col("speed_") * F.col("flat_"), F.lit(0.0)))
    df = df.withColumn("sine_", F.col(side) * F.sqrt(F.greatest(1 - F.col("cosine_") * F.col("cosine_"), F.lit(0.0))))
    p = a - n * F.col("height_") + Vec.of("along_") * (F.col("flat_") * F.col("cosine_")) + Vec.of("across_") * (F.col("flat_") * F.col("sine_"))
    ok = (F.col("flat2_") > 0) & (F.abs("cosine_") <= 1)
    return df.select(*names, *(F.when(ok, c).alias(f"{out}_{x}") for x, c in zip("xyz", (p.x, p.y, p.z))))


# Fixed values of the interpretability fit: offset and slope over log2 of the information density.
RNIIRS_OFFSET, RNIIRS_SLOPE = 3.4761, 0.4357


def rniirs(density: Column) -> Column:
    """Interpretability from information density (bits per square metre): logarithmic, linear near zero."""
    import math

    turn = math.exp(1 - math.log(2) * RNIIRS_OFFSET / RNIIRS_SLOPE)
    return F.when(density > turn, RNIIRS_OFFSET + RNIIRS_SLOPE * F.log2(density)).otherwise(density * (RNIIRS_SLOPE / (turn * math.log(2))))


def information_density(bandwidth_area: Column, signal: Column, noise: Column) -> Column:
    return bandwidth_area * F.log2(1 + signal / noise)


# Fixed values of the radar bands: name and limits in Hz.
BANDS = (("HF", 3e6, 30e6), ("VHF", 30e6, 300e6), ("UHF", 300e6, 1e9), ("L", 1e9, 2e9), ("S", 2e9, 4e9), ("C", 4e9, 8e9), ("X", 8e9, 12e9), ("KU", 12e9, 18e9), ("K", 18e9, 27e9), ("KA", 27e9, 40e9), ("V", 40e9, 75e9), ("W", 75e9, 110e9), ("MM", 110e9, 300e9))


def band_name(centre: Column) -> Column:
    out = F.when(centre.isNull(), "UN")
    for name, low, high in BANDS:
        out = out.when((centre >= low) & (centre < high), name)
    return out.otherwise("UN")


def polarization(transmit: Column, receive: Column) -> Column:
    """Name of a channel by what it transmits and receives; an unknown part hides an other one."""
    has = lambda x: F.coalesce(transmit == x, F.lit(False)) | F.coalesce(receive == x, F.lit(False))
    missing = transmit.isNull() | receive.isNull()
    return F.when(missing | has("UNKNOWN"), "UNKNOWN").when(has("OTHER"), "OTHER").otherwise(F.concat(transmit, F.lit(":"), receive))


def physical(pixel: Column, scp_pixel: Column, first: Column, spacing: Column) -> Column:
    """Metres from the scene centre along one axis of the image."""
    return (pixel + first - scp_pixel) * spacing
