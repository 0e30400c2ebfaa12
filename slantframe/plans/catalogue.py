"""The registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantframe.functions import collection, geodesy, pixels, polynomials, remap
from slantframe.functions.vectors import Vec
from slantframe.operators import annotation, elevation, inside, planar, raster, rules, spectral
from slantframe.operators.quantiles import quantiles
from slantframe.plans import files, imaging, labelling, metadata, phase_history, signals  # noqa: F401  they register queries
from slantframe.plans import views as v
from slantframe.plans.registry import QUERIES, SQL, Query, literal, query, rounded

def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --- slices, decoding, reorientation -------------------------------------------------


@query("q_chip_window", f"with {v.PX} select image, ((r - 16) // 4)::int as r, ((c - 1) // 2)::int as c, round(re, 6) as re, round(im, 6) as im from px where r between 16 and 127 and (r - 16) % 4 = 0 and c between 1 and 5 and (c - 1) % 2 = 0")
def q_chip_window(spark, sf):
    return rounded(raster.chip(v.px(spark, sf), (16, 128, 4), (1, 6, 2), (256, 8)), 6, "re", "im")


@query("q_reorient", f"with {v.PX} select image, c as r, (255 - r)::int as c, round(re, 6) as re from px")
def q_reorient(spark, sf):
    return rounded(raster.reorient(v.px(spark, sf).drop("im"), (256, 8), reverse=(0,), transpose=True), 6, "re")


@query("q_block_mosaic", f"with {v.PX}, grid as (select image, r, c from (select distinct image from px) , (select unnest(range(0, 256))::int as r), (select unnest(range(0, 8))::int as c)) select image, r, c, round(coalesce(re, -1), 6) as re from grid left join px using (image, r, c)")
def q_block_mosaic(spark, sf):
    return rounded(raster.mosaic(v.px(spark, sf), (256, 8), ["re"], -1.0), 6, "re")


@query("q_block_mosaic_whole", f"with {v.PX}, grid as (select image, r, c from (select distinct image from px) , (select unnest(range(0, 264))::int as r), (select unnest(range(0, 10))::int as c)) select image, r, c, round(coalesce(re, -1), 6) as re from grid left join px using (image, r, c)")
def q_block_mosaic_whole(spark, sf):
    """A grid with a margin around the images, which stays filled."""
    return rounded(raster.mosaic(v.px(spark, sf), (264, 10), ["re"], -1.0), 6, "re")


@query("q_band_stack", f"with {v.PX} select r, c, round(re, 6) as re, image as band from px")
def q_band_stack(spark, sf):
    df = v.px(spark, sf)
    return rounded(raster.band_stack([df.where(f"image = {k}").select("r", "c", "re") for k in range(4)]), 6, "re")


@query("q_magnitude_phase", f"with {v.AMP} select image, r, c, round(amplitude, 6) as amplitude, round(atan2(im, re), 6) as phase from amp")
def q_magnitude_phase(spark, sf):
    return rounded(v.amplitude(spark, sf).withColumn("phase", pixels.phase(F.col("re"), F.col("im"))).drop("re", "im"), 6, "amplitude", "phase")


@query("q_amp_phase_decode", "with raw as (select l_orderkey as k, l_linenumber as n, (l_partkey % 256)::int as amp, (l_suppkey * 7 % 256)::int as angle from lineitem) select k, n, round(sqrt(amp) * cos(angle * (2 * pi() / 256)), 6) + 0 as re, round(sqrt(amp) * sin(angle * (2 * pi() / 256)), 6) + 0 as im from raw")
def q_amp_phase_decode(spark, sf):
    raw = v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 256).cast("int").alias("amp"), (F.col("l_suppkey") * 7 % 256).cast("int").alias("angle"))
    table = literal([math.sqrt(x) for x in range(256)])
    re, im = pixels.decode_amp_phase(F.col("amp"), F.col("angle"), 8, table)
    return raw.select("k", "n", (F.round(re, 6) + 0).alias("re"), (F.round(im, 6) + 0).alias("im"))


@query("q_physical_coordinates", f"with {v.PX} select image, r, c, round((r + 3 - 128) * 0.75::double, 6) as x, round((c - 4) * 0.5::double, 6) as y from px")
def q_physical_coordinates(spark, sf):
    x = collection.physical(F.col("r"), F.lit(128), F.lit(3), F.lit(0.75))
    y = collection.physical(F.col("c"), F.lit(4), F.lit(0), F.lit(0.5))
    return v.px(spark, sf).select("image", "r", "c", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


# --- statistics and remaps -----------------------------------------------------------


@query("q_image_statistics", f"with {v.AMP} select image, count(*) as n, round(avg(amplitude) filter (amplitude <> 0), 5) as mean, round(min(amplitude), 5) as low, round(max(amplitude), 5) as high, round(quantile_cont(amplitude, 0.99), 5) as quantile from amp group by image")
def q_image_statistics(spark, sf):
    return rounded(raster.statistics(v.amplitude(spark, sf)), 5, "mean", "low", "high", "quantile")


_STATS = v.AMP + ", st as (select image, avg(amplitude) filter (amplitude <> 0) as mean, min(amplitude) as low, max(amplitude) as high, quantile_cont(amplitude, 0.99) as p99 from amp group by image), a as (select * from amp join st using (image))"


def _density_sql(dmin: float, mmult: float) -> str:
    return f"((255 - {dmin}::double) / log10({mmult}::double) * log10(greatest(amplitude, 1e-5::double)) + ({dmin}::double - (255 - {dmin}::double) / log10({mmult}::double) * log10(0.8::double * mean)))"


def _histogram_sql(level: str) -> str:
    return f"with {_STATS}, l as (select image, trunc(least(greatest({level}, 0), 255))::int as level from a) select image, level, count(*) as n from l group by 1, 2"


def _remap_query(name: str, level: str) -> None:
    @query(f"q_remap_{name}", _histogram_sql(level))
    def run(spark, sf, name=name):
        return remap.get(name)(v.amplitude(spark, sf), "image").groupBy("image", "level").agg(F.count("*").alias("n"))


for _name, (_dmin, _mmult) in remap.DENSITIES.items():
    _remap_query(_name, _density_sql(_dmin, _mmult))
_remap_query("linear", "255 * least(greatest((amplitude - low) / (high - low), 0), 1)")
_remap_query("log", "case when amplitude = 0 then 0 else 255 * log2((least(greatest(amplitude, low), high) - low) / (high - low) + 1) end")
_remap_query("pedf", f"case when {_density_sql(30, 40)} > 127.5::double then 0.5::double * ({_density_sql(30, 40)} + 127.5::double) else {_density_sql(30, 40)} end")
_remap_query("nrl", "case when amplitude <= p99 then 204 * least(greatest((amplitude - low) / (p99 - low), 0), 1) else log2((least(greatest(amplitude, p99), high) - p99) / (high - p99) + 1) * 51 + 204 end")


@query("q_remap_lut", f"with {_STATS}, l as (select image, trunc(255 * least(greatest((amplitude - low) / (high - low), 0), 1))::int as level from a) select image, (level * level // 255) % 256 as colour, count(*) as n from l group by 1, 2")
def q_remap_lut(spark, sf):
    table = literal([x * x // 255 % 256 for x in range(256)])
    df = remap.get("linear")(v.amplitude(spark, sf), "image")
    return df.withColumn("colour", remap.lookup(F.col("level"), table).cast("int")).groupBy("image", "colour").agg(F.count("*").alias("n"))


@query("q_rcs_statistics", f"with {v.AMP}, p as (select image, c, amplitude * amplitude as power from amp) select image, c, count(*) as n, round(avg(power), 4) as mean, round(stddev_pop(power), 4) as std, round(min(power), 4) as low, round(max(power), 4) as high, round(10 * log10(sum(power)), 5) as total_db from p group by 1, 2")
def q_rcs_statistics(spark, sf):
    df = v.amplitude(spark, sf).withColumn("power", F.col("amplitude") * F.col("amplitude"))
    return rounded(annotation.rcs_statistics(df, ["image", "c"]), 4, "mean", "std", "low", "high").withColumn("total_db", F.round("total_db", 5))


# --- geodesy -------------------------------------------------------------------------


def _placed(spark, sf) -> DataFrame:
    return geodesy.geodetic_to_ecf(F.col("lat"), F.col("lon"), F.col("h")).attach(v.pt(spark, sf), "p")


@query("q_llh_to_ecf", f"with {v.ECF} select id, round(x, 3) + 0 as x, round(y, 3) + 0 as y, round(z, 3) + 0 as z from xyz")
def q_llh_to_ecf(spark, sf):
    return _placed(spark, sf).select("id", *((F.round(f"p_{a}", 3) + 0).alias(a) for a in "xyz"))


@query("q_ecf_to_llh", f"with {v.PT} select id, round(lat, 6) as lat, round(lon, 6) as lon, round(h, 3) as h from pt")
def q_ecf_to_llh(spark, sf):
    df = geodesy.ecf_to_geodetic(_placed(spark, sf).select("id", "p_x", "p_y", "p_z"), "p")
    return df.select("id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("hae", 3).alias("h"))


@query("q_ellipsoid_normal", f"with {v.ECF}, g as (select id, x / 6378137.0::double ** 2 as a, y / 6378137.0::double ** 2 as b, z / 6356752.314245179::double ** 2 as c from xyz) select id, round(a / sqrt(a*a + b*b + c*c), 8) + 0 as x, round(b / sqrt(a*a + b*b + c*c), 8) + 0 as y, round(c / sqrt(a*a + b*b + c*c), 8) + 0 as z from g")
def q_ellipsoid_normal(spark, sf):
    n = geodesy.ellipsoid_normal(Vec.of("p"))
    return _placed(spark, sf).select("id", *((F.round(c, 8) + 0).alias(a) for a, c in zip("xyz", (n.x, n.y, n.z))))


_ORIGIN = (12.5, 41.9, 100.0)
_LOCAL = f"""with {v.ECF}, o as (select 6378137.0::double / sqrt(1 - 0.0066943799901413165::double * sin(radians(12.5::double)) ** 2) as n),
  ox as (select (n + 100) * cos(radians(12.5::double)) * cos(radians(41.9::double)) as ox, (n + 100) * cos(radians(12.5::double)) * sin(radians(41.9::double)) as oy, (n * (1 - 0.0066943799901413165::double) + 100) * sin(radians(12.5::double)) as oz from o),
  d as (select id, x - ox as x, y - oy as y, z - oz as z, radians(12.5::double) as p, radians(41.9::double) as q from xyz, ox),
  enu as (select id, -sin(q) * x + cos(q) * y as e, -sin(p) * cos(q) * x - sin(p) * sin(q) * y + cos(p) * z as n, cos(p) * cos(q) * x + cos(p) * sin(q) * y + sin(p) * z as u from d)"""


def _origin() -> tuple[Vec, tuple]:
    lat, lon, h = (F.lit(x) for x in _ORIGIN)
    return geodesy.geodetic_to_ecf(lat, lon, h), (lat, lon)


@query("q_enu", f"{_LOCAL} select id, round(e, 3) as e, round(n, 3) as n, round(u, 3) as u from enu")
def q_enu(spark, sf):
    at, ll = _origin()
    p = geodesy.ecf_to_enu(Vec.of("p"), at, *ll)
    return _placed(spark, sf).select("id", F.round(p.x, 3).alias("e"), F.round(p.y, 3).alias("n"), F.round(p.z, 3).alias("u"))


@query("q_ned_round_trip", f"with {v.ECF} select id, round(x, 3) + 0 as x, round(y, 3) + 0 as y, round(z, 3) + 0 as z from xyz")
def q_ned_round_trip(spark, sf):
    at, ll = _origin()
    df = geodesy.ecf_to_ned(Vec.of("p"), at, *ll).attach(_placed(spark, sf), "n")
    p = geodesy.ned_to_ecf(Vec.of("n"), at, *ll)
    return df.select("id", (F.round(p.x, 3) + 0).alias("x"), (F.round(p.y, 3) + 0).alias("y"), (F.round(p.z, 3) + 0).alias("z"))


@query(
    "q_ray_ellipsoid",
    f"""with {v.ECF}, u as (select id, x * 1.5::double / 6378137.0::double as ox, y * 1.5::double / 6378137.0::double as oy, z * 1.5::double / 6356752.314245179::double as oz,
      -x / 6378137.0::double as dx, (-y + 100000) / 6378137.0::double as dy, -z / 6356752.314245179::double as dz from xyz),
      q as (select id, ox*dx + oy*dy + oz*dz as b, dx*dx + dy*dy + dz*dz as a, ox*ox + oy*oy + oz*oz - 1 as c from u),
      t as (select id, case when b*b - a*c >= 0 then (-b - sqrt(b*b - a*c)) / a end as t from q) select id, round(t, 8) as t from t""",
)
def q_ray_ellipsoid(spark, sf):
    p = Vec.of("p")
    t, _ = geodesy.ray_on_ellipsoid(p * 1.5, Vec(-p.x, -p.y + 100000, -p.z))
    return _placed(spark, sf).select("id", F.round(t, 8).alias("t"))


@query("q_dms_format", f"with {v.PT}, s as (select id, lat, round(abs(lat) * 3600)::bigint as s from pt) select id, printf('%02d', s // 3600) || '°' || printf('%02d', s % 3600 // 60) || chr(39) || printf('%02d', s % 60) || '\"' || case when lat > 0 then 'N' else 'S' end as text from s")
def q_dms_format(spark, sf):
    return v.pt(spark, sf).select("id", geodesy.dms_text(F.col("lat"), "lat").alias("text"))


@query("q_dms_parse", f"with {v.PT}, s as (select id, lat, round(abs(lat) * 3600)::bigint as s from pt) select id, round(case when lat > 0 then s / 3600.0::double else -s / 3600.0::double end, 7) as degrees from s")
def q_dms_parse(spark, sf):
    return v.pt(spark, sf).select("id", F.round(geodesy.parse_dms(geodesy.dms_text(F.col("lat"), "lat")), 7).alias("degrees"))


# --- polynomials ---------------------------------------------------------------------

_C = [1.5, -0.25, 0.125, 0.5]


def _u(spark, sf) -> DataFrame:
    return v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 97 / F.lit(16.0)).alias("u"), (F.col("o_custkey") % 31 / F.lit(8.0)).alias("w"))


_U = "u as (select o_orderkey as id, (o_orderkey % 97) / 16.0::double as u, (o_custkey % 31) / 8.0::double as w from orders)"


@query("q_poly1d", f"with {_U} select id, round(1.5 + u * (-0.25 + u * (0.125 + u * 0.5)), 6) as y from u")
def q_poly1d(spark, sf):
    return _u(spark, sf).select("id", F.round(polynomials.poly1d(literal(_C), F.col("u")), 6).alias("y"))


@query("q_poly2d", f"with {_U} select id, round((1 + 2 * w) + u * (0.5 - 0.25 * w) + u * u * (0.125 * w), 6) as y from u")
def q_poly2d(spark, sf):
    return _u(spark, sf).select("id", F.round(polynomials.poly2d(literal([[1, 2], [0.5, -0.25], [0, 0.125]]), F.col("u"), F.col("w")), 6).alias("y"))


@query("q_poly_derivative", f"with {_U} select id, round(-0.25 + u * (0.25 + u * 1.5), 6) as y from u")
def q_poly_derivative(spark, sf):
    return _u(spark, sf).select("id", F.round(polynomials.poly1d(polynomials.derivative(literal(_C)), F.col("u")), 6).alias("y"))


@query("q_poly_shift", f"with {_U}, s as (select id, 2 * u - 1.25::double as t from u) select id, round(1.5 + t * (-0.25 + t * (0.125 + t * 0.5)), 5) as y from s")
def q_poly_shift(spark, sf):
    moved = polynomials.shift(_C, 1.25, 2.0)
    return _u(spark, sf).select("id", F.round(polynomials.poly1d(moved, F.col("u")), 5).alias("y"))


@query("q_ratpoly_eval", f"with {_U}, s as (select id, (u - 3) / 2.0::double as t from u) select id, round((1.5 + t * (-0.25 + t * (0.125 + t * 0.5))) / (4 + t * t) * 10 + 7, 6) as y from s")
def q_ratpoly_eval(spark, sf):
    return _u(spark, sf).select("id", F.round(polynomials.rational(literal(_C), literal([4, 0, 1]), F.col("u"), 3.0, 2.0, 7.0, 10.0), 6).alias("y"))


# --- collection geometry -------------------------------------------------------------


def _collected(spark, sf) -> DataFrame:
    """Scene centres with an antenna 500 km above a neighbouring place, flying east with a northern part."""
    df = geodesy.geodetic_to_ecf(F.col("lat"), F.col("lon"), F.col("h")).attach(v.pt(spark, sf), "scp")
    df = geodesy.geodetic_to_ecf(F.col("lat") + 3, F.col("lon") + 2, F.lit(500000.0)).attach(df, "arp")
    east, north, _ = geodesy.local_axes(F.col("lat") + 3, F.col("lon") + 2)
    return (east * 7000.0 + north * 2500.0).attach(df, "vel")


_GEO = (
    v.PT
    + """, c as (select id, lat, lon, h from pt),
 n as (select *, 6378137.0::double / sqrt(1 - 0.0066943799901413165::double * sin(radians(lat)) ** 2) as n1, 6378137.0::double / sqrt(1 - 0.0066943799901413165::double * sin(radians(lat + 3)) ** 2) as n2, radians(lat) as p, radians(lon) as q, radians(lat + 3) as p2, radians(lon + 2) as q2 from c),
 g as (select id, (n1 + h) * cos(p) * cos(q) as sx, (n1 + h) * cos(p) * sin(q) as sy, (n1 * (1 - 0.0066943799901413165::double) + h) * sin(p) as sz,
   (n2 + 500000) * cos(p2) * cos(q2) as ax, (n2 + 500000) * cos(p2) * sin(q2) as ay, (n2 * (1 - 0.0066943799901413165::double) + 500000) * sin(p2) as az,
   -sin(q2) * 7000 - sin(p2) * cos(q2) * 2500 as vx, cos(q2) * 7000 - sin(p2) * sin(q2) * 2500 as vy, cos(p2) * 2500 as vz from n),
 e0 as (select *, sqrt((sx / 6378137.0::double ** 2) ** 2 + (sy / 6378137.0::double ** 2) ** 2 + (sz / 6356752.314245179::double ** 2) ** 2) as en from g),
 e1 as (select *, sx / 6378137.0::double ** 2 / en as ex, sy / 6378137.0::double ** 2 / en as ey, sz / 6356752.314245179::double ** 2 / en as ez from e0),
 l as (select *, sqrt((sx-ax)**2 + (sy-ay)**2 + (sz-az)**2) as rng, sqrt(vx*vx + vy*vy + vz*vz) as spd from e1),
 k as (select *, (sx-ax)/rng as lx, (sy-ay)/rng as ly, (sz-az)/rng as lz from l),
 m as (select *, case when (ay*vz - az*vy)*lx + (az*vx - ax*vz)*ly + (ax*vy - ay*vx)*lz < 0 then -1.0::double else 1.0::double end as look from k)"""
)


@query(
    "q_scpcoa",
    f"""with {_GEO}, w as (select *, look * (vy*lz - vz*ly) as wx, look * (vz*lx - vx*lz) as wy, look * (vx*ly - vy*lx) as wz from m),
    h as (select *, (ex*wx + ey*wy + ez*wz) / sqrt(wx*wx + wy*wy + wz*wz) as cs, ex*lx + ey*ly + ez*lz as el from w)
    select id, case when look < 0 then 'R' else 'L' end as side_of_track, round(rng, 2) as slant_range, round(rng / spd, 5) as rov, round(degrees(acos((vx*lx + vy*ly + vz*lz) / spd)), 5) as doppler_cone,
      round(-degrees(asin(el)), 5) as graze, round(90 + degrees(asin(el)), 5) as incidence, round(degrees(acos(cs)), 5) as slope, round(sqrt(1 - cs * cs), 6) as layover_size from h""",
)
def q_scpcoa(spark, sf):
    df = collection.scene_geometry(_collected(spark, sf))
    df = rounded(df, 5, "rov", "doppler_cone", "graze", "incidence", "slope")
    return df.select("id", "side_of_track", F.round("slant_range", 2).alias("slant_range"), "rov", "doppler_cone", "graze", "incidence", "slope", F.round("layover_size", 6).alias("layover_size"))


def _dot(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a}{x} * {b}{x}" for x in "xyz") + ")"


def _size(a: str) -> str:
    return f"sqrt({_dot(a, a)})"


def _less(name: str, a: str, b: str, share: str) -> str:
    """The vector a less a share of b, as columns."""
    return ", ".join(f"{a}{x} - {b}{x} * {share} as {name}{x}" for x in "xyz")


def _cross(name: str, a: str, b: str, scale: str = "1") -> str:
    return ", ".join(f"{scale} * ({a}{p} * {b}{q} - {a}{q} * {b}{p}) as {name}{x}" for x, p, q in ("xyz", "yzx", "zxy"))


def _unit(name: str, a: str) -> str:
    return ", ".join(f"{a}{x} / {_size(a)} as {name}{x}" for x in "xyz")


def _steps(first: str, *columns: str) -> str:
    """Common table expressions s0, s1, ... of which each adds columns to the one before."""
    return ", ".join(f"s{k} as (select *, {c} from {f's{k - 1}' if k else first})" for k, c in enumerate(columns))


_BEARINGS = _steps(
    "m",
    _cross("spq", "v", "l", "look") + ", " + ", ".join(f"e{x} * {_dot('e', 'l')} - l{x} as gq{x}" for x in "xyz") + ", -ex * ez as nqx, -ey * ez as nqy, 1 - ez * ez as nqz, " + _unit("ua", "a") + ", " + _unit("uv", "v") + ", " + _less("sh", "e", "l", f"(1 / {_dot('l', 'e')})"),
    _unit("sp", "spq") + ", " + _unit("g", "gq") + ", " + _unit("no", "nq") + ", " + _less("alq", "uv", "ua", _dot("uv", "ua")) + ", " + _less("acq", "l", "ua", _dot("l", "ua")),
    _cross("gy", "e", "g") + ", " + _cross("ea", "no", "e") + ", " + _less("la", "e", "sp", _dot("e", "sp")) + ", " + _less("sw", "sh", "sp", f"({_dot('sh', 'e')} / {_dot('sp', 'e')})") + ", " + _unit("al", "alq") + ", " + _unit("ac", "acq"),
    f"degrees(atan2({_dot('g', 'ea')}, {_dot('g', 'no')})) as bearing, degrees(atan2({_dot('la', 'ea')}, {_dot('la', 'no')})) as lean",
)


@query(
    "q_scpcoa_bearings",
    f"""with {_GEO}, {_BEARINGS} select id, round(case when bearing > 0 then bearing else bearing + 360 end, 6) as azimuth, round(-degrees(asin({_dot("gy", "sp")})), 6) as twist, round(look * degrees(acos({_dot("ac", "al")})), 6) as squint,
    round(case when lean > 0 then lean else lean + 360 end, 6) as layover, round(abs(degrees(atan2({_dot("sw", "gy")}, {_dot("sw", "g")}))), 6) as shadow, round({_size("sw")}, 6) as shadow_size, round({_size("s")} * acos({_dot("s", "ua")} / {_size("s")}), 3) as ground_range from s3""",
)
def q_scpcoa_bearings(spark, sf):
    names = ("azimuth", "twist", "squint", "layover", "shadow", "shadow_size")
    df = collection.scene_geometry(_collected(spark, sf)).withColumn("shadow", F.abs("shadow"))
    return rounded(df, 6, *names).select("id", *names, F.round("ground_range", 3).alias("ground_range"))


@query("q_image_to_ground_plane", f"with {_GEO} select id, round(sx, 1) + 0 as x, round(sy, 1) + 0 as y, round(sz, 1) + 0 as z from m")
def q_image_to_ground_plane(spark, sf):
    """The range and range rate of a scene centre meet its ground plane in the centre."""
    df = geodesy.ellipsoid_normal(Vec.of("scp")).attach(_collected(spark, sf), "n")
    scp, arp, vel, n = (Vec.of(x) for x in ("scp", "arp", "vel", "n"))
    df = (scp - arp).attach(df, "los")
    los = Vec.of("los")
    df = df.withColumns({"range": los.norm(), "rate": -vel.dot(los) / los.norm(), "side": F.when(n.cross(vel - n * vel.dot(n)).dot(los) < 0, -1.0).otherwise(1.0)})
    out = collection.range_plane_points(df, "range", "rate", "side", "arp", "vel", "scp", "n", "at")
    return out.select("id", *((F.round(f"at_{a}", 1) + 0).alias(a) for a in "xyz"))


@query("q_rniirs", f"with {_U}, d as (select id, (u + 0.01::double) * log2(1 + 1 / (0.05::double + w)) as d from u), t as (select exp(1 - ln(2) * 3.4761::double / 0.4357::double) as t) select id, round(case when d > t then 3.4761::double + 0.4357::double * log2(d) else d * 0.4357::double / (t * ln(2)) end, 6) as rniirs from d, t")
def q_rniirs(spark, sf):
    d = collection.information_density(F.col("u") + 0.01, F.lit(1.0), F.col("w") + 0.05)
    return _u(spark, sf).select("id", F.round(collection.rniirs(d), 6).alias("rniirs"))


@query("q_band_name", "with f as (select o_orderkey as id, o_totalprice * o_totalprice * (1 + o_orderkey % 40) as hz from orders), b(name, lo, hi) as (values ('HF', 3e6, 3e7), ('VHF', 3e7, 3e8), ('UHF', 3e8, 1e9), ('L', 1e9, 2e9), ('S', 2e9, 4e9), ('C', 4e9, 8e9), ('X', 8e9, 1.2e10), ('KU', 1.2e10, 1.8e10), ('K', 1.8e10, 2.7e10), ('KA', 2.7e10, 4e10), ('V', 4e10, 7.5e10), ('W', 7.5e10, 1.1e11), ('MM', 1.1e11, 3e11)) select coalesce(name, 'UN') as band, count(*) as n from f left join b on hz >= lo and hz < hi group by 1")
def q_band_name(spark, sf):
    hz = F.col("o_totalprice") * F.col("o_totalprice") * (1 + F.col("o_orderkey") % 40)
    return v.table(spark, sf, "orders").groupBy(collection.band_name(hz).alias("band")).agg(F.count("*").alias("n"))


# --- planar geometry -----------------------------------------------------------------


@query("q_ring_measures", f"with {v.RINGS}, s as (select ring, 0.5::double * sum(x0*y1 - x1*y0) as area, sum(sqrt((x1-x0)**2 + (y1-y0)**2)) as perimeter, sum((x0+x1)*(x0*y1-x1*y0)) as mx, sum((y0+y1)*(x0*y1-x1*y0)) as my, min(x0) as x_low, max(x0) as x_high, min(y0) as y_low, max(y0) as y_high from edges group by ring) select ring, round(area, 5) as area, round(perimeter, 5) as perimeter, round(mx / nullif(6 * area, 0), 4) as cx, round(my / nullif(6 * area, 0), 4) as cy, x_low, x_high, y_low, y_high from s")
def q_ring_measures(spark, sf):
    return rounded(rounded(planar.ring_measures(v.rings(spark, sf)), 5, "area", "perimeter"), 4, "cx", "cy")


@query("q_line_length", f"with {v.RINGS}, s as (select ring, lead(x) over w - x as dx, lead(y) over w - y as dy from rings window w as (partition by ring order by vtx)) select ring, round(sum(sqrt(dx*dx + dy*dy)), 5) as length from s where dx is not null group by ring")
def q_line_length(spark, sf):
    return rounded(planar.line_lengths(v.rings(spark, sf)), 5, "length")


_POINTS = "points as (select c_custkey as pt_id, (c_custkey * 13 % 400) / 4.0::double - 10 as x, (c_custkey * 7 % 104) / 4.0::double as y, c_nationkey as nation from customer)"


def _points(spark, sf) -> DataFrame:
    return v.table(spark, sf, "customer").select(F.col("c_custkey").alias("pt_id"), (F.col("c_custkey") * 13 % 400 / F.lit(4.0) - 10).alias("x"), (F.col("c_custkey") * 7 % 104 / F.lit(4.0)).alias("y"), F.col("c_nationkey").alias("nation"))


_INSIDE = "hits as (select pt_id, ring, sum(((y0 <= y) <> (y1 <= y) and case when y1 > y0 then (x1-x0)*(y-y0) - (x-x0)*(y1-y0) > 0 else (x1-x0)*(y-y0) - (x-x0)*(y1-y0) < 0 end)::int) as n, bool_or((x1-x0)*(y-y0) - (x-x0)*(y1-y0) = 0 and x between least(x0,x1) and greatest(x0,x1) and y between least(y0,y1) and greatest(y0,y1)) as edge from points, edges group by 1, 2), inside as (select pt_id, ring from hits where n % 2 = 1 or edge)"


@query("q_point_in_polygon", f"with {v.RINGS}, {_POINTS}, {_INSIDE} select * from inside")
def q_point_in_polygon(spark, sf):
    return inside.points_in_rings(_points(spark, sf), v.rings(spark, sf), 2.0)


@query("q_point_in_polygon_with_holes", f"with {v.RINGS}, {_POINTS}, {_INSIDE} select a.pt_id, 0 as ring from inside a where a.ring = (select min(ring) from rings) and not exists (select 1 from inside b where b.pt_id = a.pt_id and b.ring = (select max(ring) from rings))")
def q_point_in_polygon_with_holes(spark, sf):
    rings = v.rings(spark, sf)
    ends = rings.agg(F.min("ring").alias("low"), F.max("ring").alias("high"))
    marked = rings.crossJoin(F.broadcast(ends))
    outer = marked.where("ring = low").withColumn("ring", F.lit(0)).drop("low", "high")
    holes = marked.where("ring = high").withColumn("ring", F.lit(0)).withColumn("hole", F.lit(1)).drop("low", "high")
    return inside.points_in_polygon(_points(spark, sf), outer, holes, 2.0)


@query("q_segment_distance", f"with {v.RINGS}, {_POINTS}, d as (select pt_id, nation as ring, vtx, x, y, x0, y0, x1, y1, least(greatest(((x-x0)*(x1-x0) + (y-y0)*(y1-y0)) / ((x1-x0)**2 + (y1-y0)**2), 0), 1) as t from points left join edges on ring = nation) select pt_id, ring, round(min(sqrt((x-x0-t*(x1-x0))**2 + (y-y0-t*(y1-y0))**2)), 5) as distance from d group by pt_id, ring")
def q_segment_distance(spark, sf):
    """Every point's distance from its own nation's ring; null where the nation has none."""
    out = planar.ring_distances(_points(spark, sf).withColumnRenamed("nation", "ring"), v.rings(spark, sf))
    return out.withColumn("distance", F.round("distance", 5))


@query("q_segment_intersect", f"with {v.RINGS}, p as (select a.ring, a.x0 as ax, a.y0 as ay, a.x1 as bx, a.y1 as b_y, b.x0 as cx, b.y0 as cy, b.x1 as dx, b.y1 as dy from edges a join edges b on a.ring = b.ring and a.vtx < b.vtx), s as (select ring, sign((bx-ax)*(cy-ay)-(b_y-ay)*(cx-ax)) * sign((bx-ax)*(dy-ay)-(b_y-ay)*(dx-ax)) as u, sign((dx-cx)*(ay-cy)-(dy-cy)*(ax-cx)) * sign((dx-cx)*(b_y-cy)-(dy-cy)*(bx-cx)) as t from p) select ring, count(*) as crossings from s where u < 0 and t <= 0 or u <= 0 and t < 0 group by ring")
def q_segment_intersect(spark, sf):
    from slantframe.operators.crossings import crossings

    return crossings(planar.edges(v.rings(spark, sf))).groupBy("ring").agg(F.sum("pairs").alias("crossings"))


# --- elevation -----------------------------------------------------------------------


@query("q_dem_bilinear", f"with {v.DEM}, e as (select max(ix) as lx, max(iy) as ly from dem), p as (select c_custkey as pt_id, (c_custkey * 17 % 390) / 10.0::double as gx, (c_custkey * 29 % 490) / 10.0::double as gy from customer), b as (select p.*, least(floor(gx), lx - 1)::int as b_x, least(floor(gy), ly - 1)::int as b_y from p, e where gx between 0 and lx and gy between 0 and ly), w as (select pt_id, b_x + i as ix, b_y + j as iy, (case when i = 1 then gx - b_x else 1 - (gx - b_x) end) * (case when j = 1 then gy - b_y else 1 - (gy - b_y) end) as w from b, (values (0, 0), (0, 1), (1, 0), (1, 1)) c(i, j)) select pt_id, case when count(elev) = count(*) then round(sum(w * elev), 4) end as elev from w left join dem using (ix, iy) where w > 0 group by pt_id")
def q_dem_bilinear(spark, sf):
    p = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("pt_id"), (F.col("c_custkey") * 17 % 390 / F.lit(10.0)).alias("gx"), (F.col("c_custkey") * 29 % 490 / F.lit(10.0)).alias("gy"))
    return rounded(elevation.bilinear(p, v.dem(spark, sf)), 4, "elev")


@query("q_dem_first_tile", f"with {v.PT}, t as (select s_suppkey as tile, s_suppkey % 5 as priority, (s_suppkey * 53 % 170) - 88 as lat_low, (s_suppkey * 53 % 170) - 84 as lat_high, (s_suppkey * 97 % 340) - 175 as lon_low, (s_suppkey * 97 % 340) - 155 as lon_high from supplier) select id as pt_id, arg_min(tile, priority * 1000000 + tile) as tile from pt join t on lat between lat_low and lat_high and lon between lon_low and lon_high group by id")
def q_dem_first_tile(spark, sf):
    s = F.col("s_suppkey")
    low, left = (s * 53 % 170) - 88, (s * 97 % 340) - 175
    tiles = v.table(spark, sf, "supplier").select(s.alias("tile"), (s % 5).alias("priority"), low.alias("lat_low"), (low + 4).alias("lat_high"), left.alias("lon_low"), (left + 20).alias("lon_high"))
    return elevation.first_tile(v.pt(spark, sf).withColumnRenamed("id", "pt_id"), tiles)


@query("q_dem_extremes", f"with {v.DEM}, d as (select ix % 4 as tile, ix, iy, elev from dem) select tile, min(elev) as low, (arg_min(ix, elev * 1e9::double + ix * 1000 + iy)) as low_ix, max(elev) as high, count(*) as n from d group by tile")
def q_dem_extremes(spark, sf):
    return elevation.extremes(v.dem(spark, sf).withColumn("tile", F.col("ix") % 4), ["tile"]).select("tile", "low", "low_ix", "high", "n")


# --- neighbourhoods, registration, resampling ----------------------------------------


@query("q_coherence", f"with {v.PX}, p as (select a.image, a.r, a.c, a.re * b.re + a.im * b.im as xr, a.re * b.im - a.im * b.re as xi, a.re**2 + a.im**2 as pa, b.re**2 + b.im**2 as pb from px a join px b on a.r = b.r and a.c = b.c and b.image = a.image + 1), s as (select p.image, p.r, p.c, sum(q.xr) as xr, sum(q.xi) as xi, sum(q.pa) as pa, sum(q.pb) as pb from p join p q on q.image = p.image and q.r between p.r - 1 and p.r + 1 and q.c between p.c - 1 and p.c + 1 group by p.image, p.r, p.c) select image, r, c, round(sqrt(xr*xr + xi*xi) / sqrt(pa * pb), 5) as coherence, round(atan2(xi, xr), 5) as coherence_phase from s")
def q_coherence(spark, sf):
    """Every image against the next one."""
    df = v.px(spark, sf)
    a = df.select("image", "r", "c", F.col("re").alias("re_a"), F.col("im").alias("im_a"))
    b = df.select((F.col("image") - 1).alias("image"), "r", "c", F.col("re").alias("re_b"), F.col("im").alias("im_b"))
    pairs = a.join(b, ["image", "r", "c"])
    # A box sum in two passes needs each line's cells to be there; absent cells are zeros.
    grid = raster.mosaic(pairs, (256, 8), ["re_a", "im_a", "re_b", "im_b"], 0.0)
    out = raster.coherence(grid, 1).join(pairs.select("image", "r", "c"), ["image", "r", "c"])
    return rounded(out, 5, "coherence", "coherence_phase")


@query("q_registration_shift", f"with {v.AMP}, a as (select image, r, c, amplitude as va from amp), b as (select image - 1 as image, r, c, amplitude as vb from amp), s as (select image, dr, dc, sum(va * vb) / sqrt(sum(va*va) * sum(vb*vb)) as score, count(*) as n from a join (select image, r + dr as r, c + dc as c, dr, dc, vb from b, (select unnest(range(-2, 3)) as dr), (select unnest(range(-2, 3)) as dc)) using (image, r, c) group by 1, 2, 3) select image, dr::int as dr, dc::int as dc, round(score, 6) as score, n from s qualify row_number() over (partition by image order by round(score, 9) desc, dr, dc) = 1")
def q_registration_shift(spark, sf):
    df = v.amplitude(spark, sf)
    return rounded(raster.best_shift(df, df.withColumn("image", F.col("image") - 1), 2), 6, "score")


_TARGETS = "t as (select o_orderkey as id, (o_custkey % 4)::int as image, (o_orderkey * 11 % 2500) / 10.0::double as pr, 1 + (o_custkey * 3 % 60) / 10.0::double as pc from orders)"


def _targets(spark, sf) -> DataFrame:
    return v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 4).cast("int").alias("image"), (F.col("o_orderkey") * 11 % 2500 / F.lit(10.0)).alias("pr"), (1 + F.col("o_custkey") * 3 % 60 / F.lit(10.0)).alias("pc"))


@query("q_nearest_ortho", f"with {v.AMP}, {_TARGETS} select t.image, id, pr, pc, round(amplitude, 5) as amplitude from t left join amp on amp.image = t.image and r = floor(pr + 0.5::double)::int and c = floor(pc + 0.5::double)::int")
def q_nearest_ortho(spark, sf):
    return rounded(raster.resample(v.amplitude(spark, sf), _targets(spark, sf)), 5, "amplitude")


@query("q_bilinear_ortho", f"with {v.AMP}, {_TARGETS}, w as (select t.*, floor(pr)::int + i as r, floor(pc)::int + j as c, (case when i = 1 then pr - floor(pr) else 1 - (pr - floor(pr)) end) * (case when j = 1 then pc - floor(pc) else 1 - (pc - floor(pc)) end) as w from t, (values (0, 0), (0, 1), (1, 0), (1, 1)) k(i, j)) select id, w.image, pr, pc, case when count(amplitude) = count(*) then round(sum(w * amplitude), 5) end as amplitude from w left join amp using (image, r, c) where w > 0 group by 1, 2, 3, 4")
def q_bilinear_ortho(spark, sf):
    return rounded(raster.resample(v.amplitude(spark, sf), _targets(spark, sf), "bilinear"), 5, "amplitude")


# --- signals -------------------------------------------------------------------------


@query("q_dft_power", "with s as (select vec_id, unnest(range(0, 64)) as i, unnest(embedding)::double as x from embeddings), k as (select unnest(range(0, 64)) as k), d as (select vec_id, k, sum(x * cos(2 * pi() * i * k / 64)) as a, sum(x * sin(2 * pi() * i * k / 64)) as b from s, k group by 1, 2) select vec_id, k::int as k, round(a*a + b*b, 5) as power from d")
def q_dft_power(spark, sf):
    df = spectral.spectrum_power(v.table(spark, sf, "embeddings"), "embedding", "vec_id")
    return rounded(df.select("vec_id", F.posexplode("power").alias("k", "power")), 5, "power")


@query("q_dft_spectrum", "with s as (select vec_id, unnest(range(0, 64)) as i, unnest(embedding)::double as x from embeddings), k as (select unnest(range(0, 64)) as k), d as (select vec_id, k, sum(x * cos(2 * pi() * i * k / 64)) as a, sum(x * sin(2 * pi() * i * k / 64)) as b from s, k group by 1, 2) select vec_id, k::int as k, round(a*a + b*b, 5) as power from d")
def q_dft_spectrum(spark, sf):
    """All bins of every vector."""
    df = spectral.spectrum_power(v.table(spark, sf, "embeddings"), "embedding", "vec_id")
    return rounded(df.select("vec_id", F.posexplode("power").alias("k", "power")), 5, "power")


@query("q_window_taper", "with s as (select vec_id, unnest(range(0, 64)) as i, unnest(embedding)::double as x from embeddings) select vec_id, i::int as i, round(x * (0.54::double - 0.46::double * cos(2 * pi() * i / 63)), 7) + 0 as value from s")
def q_window_taper(spark, sf):
    """Vectors under a window."""
    df = v.table(spark, sf, "embeddings").select("vec_id", F.size("embedding").alias("n"), F.posexplode("embedding").alias("i", "x"))
    return df.select("vec_id", "i", (F.round(F.col("x").cast("double") * spectral.taper("hamming", F.col("i"), F.col("n")), 7) + 0).alias("value"))


_CUT = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(((0, 32), (16, 48), (32, 64))))


@query(
    "q_subaperture_power",
    f"""with s as (select vec_id, unnest(range(0, 64)) as i, unnest(embedding)::double as x from embeddings), k as (select unnest(range(0, 64)) as k),
    d as (select vec_id, k, sum(x * cos(2 * pi() * i * (k - 32) / 64)) as a, sum(x * sin(2 * pi() * i * (k - 32) / 64)) as b from s, k group by 1, 2),
    f(frame, first, last) as (values {_CUT}) select vec_id, frame, round(sum(a * a + b * b) / 1024, 6) as power from d join f on k >= first and k < last group by 1, 2""",
)
def q_subaperture_power(spark, sf):
    return rounded(spectral.subaperture(v.table(spark, sf, "embeddings"), "embedding", "vec_id", 3), 6, "power")


# --- rules ---------------------------------------------------------------------------


@query("q_pvp_monotonic", f"with {v.PVP}, s as (select channel, TxTime - lag(TxTime) over (partition by channel order by vector) as step from pvp) select channel as object, 'time_monotonic' as rule, 'error' as severity, min(step) > 0 as passed, min(step)::double as detail from s group by channel")
def q_pvp_monotonic(spark, sf):
    return rules.time_monotonic(v.pvp(spark, sf))


@query("q_rcv_after_tx", f"with {v.PVP} select channel as object, 'receive_after_transmit' as rule, 'error' as severity, min(RcvTime - TxTime) > 0 as passed, min(RcvTime - TxTime)::double as detail from pvp group by channel")
def q_rcv_after_tx(spark, sf):
    return rules.receive_after_transmit(v.pvp(spark, sf))


@query("q_pvp_finite", f"with {v.PVP} select channel as object, 'finite' as rule, 'error' as severity, count(*) filter (RcvTime is null or FX1 is null or isnan(FX1) or isinf(FX1) or FX2 is null or isnan(FX2) or isinf(FX2)) = 0 as passed, (count(*) filter (RcvTime is null or FX1 is null or isnan(FX1) or isinf(FX1) or FX2 is null or isnan(FX2) or isinf(FX2)))::double as detail from pvp group by channel")
def q_pvp_finite(spark, sf):
    return rules.finite(v.pvp(spark, sf), ["RcvTime", "FX1", "FX2"])


@query("q_fx_band", f"with {v.PVP}, s as (select channel, min(FX1) as lo, max(FX2) as hi from pvp group by channel) select channel as object, 'fxc' as rule, 'error' as severity, abs((lo + hi) / 2 - 50) <= 1e-6 * 50 as passed, round((lo + hi) / 2, 6) as detail from s union all select channel, 'fxbw', 'error', abs(hi - lo - 100) <= 1e-6 * 100, round(hi - lo, 6) from s")
def q_fx_band(spark, sf):
    p = v.pvp(spark, sf)
    declared = p.select("channel").distinct().withColumn("FxC", F.lit(50.0)).withColumn("FxBW", F.lit(100.0))
    return rounded(rules.band(p, declared), 6, "detail")


@query("q_fx_fixed", f"with {v.PVP} select channel as object, 'fixed_FXFixed' as rule, 'error' as severity, greatest(max(FX1) - min(FX1), max(FX2) - min(FX2), 0) = 0 as passed, round(greatest(max(FX1) - min(FX1), max(FX2) - min(FX2), 0), 6) as detail from pvp group by channel")
def q_fx_fixed(spark, sf):
    p = v.pvp(spark, sf)
    return rounded(rules.fixed(p, p.select("channel").distinct().withColumn("FXFixed", F.lit(True)), ["FX1", "FX2"], "FXFixed"), 6, "detail")


@query("q_within_limits", f"with {v.PVP}, g as (select quantile_cont(FX1, 0.1) as lo, quantile_cont(FX1, 0.9) as hi from pvp) select channel as object, 'within_FX1' as rule, 'error' as severity, count(*) filter (FX1 not between lo and hi) = 0 as passed, (count(*) filter (FX1 not between lo and hi))::double as detail from pvp, g group by channel")
def q_within_limits(spark, sf):
    p = v.pvp(spark, sf)
    limits = quantiles(p, [], "FX1", {"lo": 0.1, "hi": 0.9})
    return rules.within(p, limits, "FX1", "lo", "hi")


@query("q_normal_signal", f"with {v.PVP} select channel as object, 'normal_signal' as rule, 'error' as severity, avg(SIGNAL) >= 0.5 as passed, round(avg(SIGNAL), 9) as detail from pvp group by channel")
def q_normal_signal(spark, sf):
    return rounded(rules.normal_signal(v.pvp(spark, sf)), 9, "detail")


@query("q_unique_ids", "select n_name as path, c_mktsegment as id, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1, 2 having count(*) > 1")
def q_unique_ids(spark, sf):
    c, n = v.table(spark, sf, "customer"), v.table(spark, sf, "nation")
    nodes = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("path"), F.col("c_mktsegment").alias("id"))
    return rules.unique_ids(nodes)


@query("q_dangling_ids", "select c_custkey as id from customer where c_custkey not in (select o_custkey from orders)")
def q_dangling_ids(spark, sf):
    refs = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return rules.dangling(refs, v.table(spark, sf, "orders").select(F.col("o_custkey").alias("id")))


@query("q_unreachable_ids", f"with {v.TAX}, walk as (select 'r1' as id union select 'n3'), a as (select child as id from tax where parent = 'r1'), b as (select child as id from tax where parent in (select id from a) or parent = 'n3'), f as (select id from walk union select id from a union select id from b), n as (select parent as id from tax union select child from tax) select id from n where id not in (select id from f)")
def q_unreachable_ids(spark, sf):
    from slantframe.operators.checkpoints import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    links = v.tax(spark, sf)
    nodes = links.select(F.col("parent").alias("id")).union(links.select("child"))
    return rules.unreachable(nodes, links, spark.createDataFrame([("r1",), ("n3",)], "id string"))


@query("q_ipp_gaps", f"with {v.PVP}, s as (select channel, vector as index, TxTime as t_start, RcvTime as t_end, vector * 10 as p_start, vector * 10 + 9 + (vector % 5 = 0)::int as p_end from pvp), g as (select channel, index, t_start - lag(t_end) over w as gap_time, p_start - lag(p_end) over w - 1 as gap_pulses from s window w as (partition by channel order by index)) select * from g where gap_time <> 0 or gap_pulses <> 0")
def q_ipp_gaps(spark, sf):
    p = v.pvp(spark, sf)
    ipp = p.select("channel", F.col("vector").cast("long").alias("index"), F.col("TxTime").alias("t_start"), F.col("RcvTime").alias("t_end"), (F.col("vector") * 10).cast("long").alias("p_start"), (F.col("vector") * 10 + 9 + (F.col("vector") % 5 == 0).cast("int")).cast("long").alias("p_end"))
    return rules.gaps(ipp)


# --- labels and metadata -------------------------------------------------------------


@query("q_label_tree", f"with recursive {v.TAX}, w as (select distinct parent as id, 0 as depth, parent as path from tax where parent not in (select child from tax) union all select child, depth + 1, path || '/' || child from w join tax on parent = id) select id, depth, path from w")
def q_label_tree(spark, sf):
    return annotation.label_paths(spark, v.tax(spark, sf))


@query("q_inverted_forks", "with l as (select 's' || o_orderpriority as child, 'p' || o_orderstatus as parent from orders) select child, count(distinct parent) as parents from l group by child having count(distinct parent) > 1")
def q_inverted_forks(spark, sf):
    o = v.table(spark, sf, "orders")
    return annotation.inverted_forks(o.select(F.concat(F.lit("s"), "o_orderpriority").alias("child"), F.concat(F.lit("p"), "o_orderstatus").alias("parent")))


@query("q_label_latest", "select user_id as feature, arg_max(event_type, (epoch_us(ts), event_type)) as label, epoch_us(max(ts)) as ts from events group by user_id")
def q_label_latest(spark, sf):
    e = v.table(spark, sf, "events").select(F.col("user_id").alias("feature"), F.col("event_type").alias("label"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    return annotation.latest_label(e)


@query("q_match_partitions", "select s_suppkey as image, min(s_suppkey) over (partition by s_nationkey, s_suppkey % 3) as part from supplier")
def q_match_partitions(spark, sf):
    s = v.table(spark, sf, "supplier")
    return annotation.partitions(s.select(F.col("s_suppkey").alias("image"), "s_nationkey", (F.col("s_suppkey") % 3).alias("size")), ["s_nationkey", "size"])


# --- streams -------------------------------------------------------------------------


@query("q_pulse_windows", "select event_type as channel, time_bucket(interval 1 hour, ts) as start, count(*) as n, round(avg(value), 6) as mean, round(min(value), 6) as low, round(max(value), 6) as high from events group by 1, 2")
def q_pulse_windows(spark, sf):
    """The stream's windows over the whole table; times are without a zone, as in the table."""
    from slantframe.streaming.pulses import pulse_windows

    e = v.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("channel"), "value")
    return rounded(pulse_windows(e), 6, "mean", "low", "high").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "q_stream_frames",
    f"""with {v.PVP}, q as (select channel, vector - 1 as pulse, FX1 as re, FX2 - FX1 as im from pvp where channel is not null), f as (select channel, unnest(range(greatest((pulse - 8 + 4) // 4, 0), pulse // 4 + 1)) as frame, pulse, re, im from q),
 g as (select channel, frame, pulse - frame * 4 as k, re, im from f where pulse between frame * 4 and frame * 4 + 7), l as (select unnest(range(0, 8)) as line)
 select channel, frame, line::int as line, count(*)::int as n, count(*) = 8 as complete, round(sum(re * cos(2 * pi() * k * (line - 4) / 8) + im * sin(2 * pi() * k * (line - 4) / 8)), 5) + 0 as re, round(sum(im * cos(2 * pi() * k * (line - 4) / 8) - re * sin(2 * pi() * k * (line - 4) / 8)), 5) + 0 as im from g, l group by 1, 2, 3""",
)
def q_stream_frames(spark, sf):
    """Doppler lines of frames of eight pulses, four apart."""
    from slantframe.streaming.frames import frames

    p = v.pvp(spark, sf).select("channel", (F.col("vector").cast("long") - 1).alias("pulse"), F.array("FX1").alias("re"), F.array(F.col("FX2") - F.col("FX1")).alias("im"))
    out = frames(p, 8, 4, block=256)
    return out.select("channel", "frame", "line", "n", "complete", *((F.round(F.col(c)[0], 5) + 0).alias(c) for c in ("re", "im")))
