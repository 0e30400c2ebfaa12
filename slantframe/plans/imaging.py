"""Queries of projections, signals, fits and remaps that need metadata of an image, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantframe.functions import collection, geodesy, projection, remap
from slantframe.functions.vectors import Vec
from slantframe.operators import elevation, fits, spectral, terrain
from slantframe.operators.checkpoints import partitions, saved
from slantframe.plans import views as v
from slantframe.plans.registry import literal, query, rounded

# --- remap ---------------------------------------------------------------------------

_GDM = f"""with {v.AMP}, st as (select image, avg(amplitude) filter (amplitude <> 0) as mean, quantile_cont(amplitude, 0.5) as med from amp group by image),
 c0 as (select image, 0.77::double * med as lo, med * 10e0 ** (1.23::double + -0.0422::double * (sin(radians(35e0)) / cos(radians(40e0))) + -1.95::double * log10(med / mean)) as hi from st),
 c1 as (select *, 20 * log10(hi / lo) as span from c0), c2 as (select *, 10e0 ** ((span - least(greatest(span, 24), 40)) / 40) as beta from c1), c3 as (select image, lo * beta as lo, hi / beta as hi from c2),
 l as (select image, trunc(least(greatest(225e0 / log10(hi / lo) * (log10(greatest(amplitude, 1e-5)) - log10(lo)) + 30, 0), 255))::int as level from amp join c3 using (image)) select image, level, count(*) as n from l group by 1, 2"""


@query("q_remap_gdm", _GDM)
def q_remap_gdm(spark, sf):
    """Cut-offs from an image's mean and median, a graze of 35 and a slope of 40 degrees."""
    return remap.gdm(35.0, 40.0)(v.amplitude(spark, sf), "image").groupBy("image", "level").agg(F.count("*").alias("n"))


# --- projections ---------------------------------------------------------------------

#: Four images of one scene on the equator, one a kind.
_UX, _UY = -5e5 / math.hypot(5e5, 3e5), -3e5 / math.hypot(5e5, 3e5)
_NEAR = math.hypot(5e5, 3e5)
_KINDS = ("PFA", "RGAZCOMP", "INCA", "PLANE")


_VALUES = {
    "scp_x": 6378137.0, "scp_y": 0.0, "scp_z": 0.0, "urow_x": _UX, "urow_y": _UY, "urow_z": 0.0, "ucol_x": 0.0, "ucol_y": 0.0, "ucol_z": 1.0,
    "normal_x": 1.0, "normal_y": 0.0, "normal_z": 0.0, "scp_row": 500.0, "scp_col": 400.0, "first_row": 0.0, "first_col": 0.0, "row_ss": 0.8, "col_ss": 0.7,
    "az_sf": 1.715e-6, "r_ca": _NEAR,
}
_ARRAYS = {
    "time_coa": [[2.0, 2e-4], [1e-6, 0.0]], "arp_px": [6878137.0, 0.0, -2.0], "arp_py": [300000.0], "arp_pz": [-14000.0, 7000.0],
    "polar_angle": [0.02401, -0.012005], "freq_scale": [1.0, 0.001, -0.3], "time_ca": [2.0, 1.43e-4], "drate_sf": [[0.98, 1e-6], [1e-7, 0.0]],
}


def _images(spark) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), F.col("id").cast("int") + 1)
    return spark.range(4).select(F.col("id").cast("int").alias("image"), kind.alias("kind"), *(F.lit(x).alias(k) for k, x in _VALUES.items()), *(literal(x).alias(k) for k, x in _ARRAYS.items()))


def _pixels(spark, sf) -> DataFrame:
    o = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 4).cast("int").alias("image"), (F.col("o_orderkey") % 1000).cast("double").alias("row"), (F.col("o_custkey") * 7 % 800).cast("double").alias("col"))
    return o.join(_images(spark), "image")


_PIXELS = f"""p as (select o_orderkey as id, (o_custkey % 4)::int as image, (o_orderkey % 1000)::double as row, (o_custkey * 7 % 800)::double as col from orders),
 m as (select *, (row - 500) * 0.8::double as u, (col - 400) * 0.7::double as w from p), t as (select *, 2 + 2e-4 * w + 1e-6 * u as t from m),
 a as (select *, 6878137 - 2 * t * t as ax, 300000e0 as ay, -14000 + 7000 * t as az, -4 * t as vx, 0e0 as vy, 7000e0 as vz, 0.02401::double - 0.012005::double * t as ang, 2 + 1.43e-4 * w as ca from t),
 b as (select *, sqrt((ax - 6378137) ** 2 + ay ** 2 + az ** 2) as r0, 1 + 0.001::double * ang - 0.3::double * ang * ang as ksf, 0.001::double - 0.6::double * ang as dksf, u * cos(ang) + w * sin(ang) as ka, w * cos(ang) - u * sin(ang) as kc,
   (0.98::double + 1e-6 * w + 1e-7 * u) * (16 * ca * ca + 49e6) as drift, {_NEAR!r}::double + u as near, t - ca as late, ax - 6378137 - u * {_UX!r}::double as fx, ay - u * {_UY!r}::double as fy, az - w as fz from a),
 c as (select *, (vx * (ax - 6378137) + vy * ay + vz * az) / r0 as rate0, sqrt(near ** 2 + drift * late ** 2) as rinca, sqrt(fx ** 2 + fy ** 2 + fz ** 2) as rflat from b),
 d as (select id, image, row, col, t, case image when 0 then r0 + ksf * ka when 1 then r0 + u when 2 then rinca else rflat end as r,
   case image when 0 then rate0 + (dksf * ka + ksf * kc) * -0.012005::double when 1 then rate0 - sqrt(vx ** 2 + vz ** 2) * 1.715e-6 * w when 2 then drift * late / rinca else (vx * fx + vy * fy + vz * fz) / rflat end as rdot from c)"""


@query("q_coa_projection", f"with {_PIXELS} select id, image, round(t, 8) as t, round(r, 4) as r, round(rdot, 5) + 0 as rdot from d")
def q_coa_projection(spark, sf):
    """Range and range rate of pixels of four kinds of images."""
    out = projection.coa_projection(_pixels(spark, sf))
    return out.select("id", "image", F.round("time_coa_at", 8).alias("t"), F.round("r", 4).alias("r"), (F.round("rdot", 5) + 0).alias("rdot"))


def _residuals(df: DataFrame, place: str) -> DataFrame:
    """How far the range and range rate of a place are from those of its pixel, and on which side of the track it lies."""
    back = Vec.of("arp") - Vec.of(place)
    side = F.signum(Vec.literal(1, 0, 0).cross(Vec.of("varp")).dot(back * -1.0)).cast("int")
    return projection.coa_projection(df).select("id", (F.round(back.norm() - F.col("r"), 3) + 0).alias("range_off"), (F.round(Vec.of("varp").dot(back) / back.norm() - F.col("rdot"), 3) + 0).alias("rate_off"), side.alias("side"), *(c for c in df.columns if c == "height" or c.startswith(place)))


#: The ground plane has x of the scene centre; the track runs along z (and a little along x), so the way across is along y, away from the antenna's y.
_PLANE = f"""with {_PIXELS}, e as (select *, ax - 6378137 as h from b join d using (id, image, row, col, t)), f as (select *, sqrt(r * r - h * h) as flat from e), g as (select *, (h * vx - r * rdot) / (vz * flat) as cosine from f)
 select id, 6378137e0 as x, round(ay - flat * sqrt(1 - cosine * cosine), 3) + 0 as y, round(az + flat * cosine, 3) + 0 as z from g"""


@query("q_image_to_plane", _PLANE)
def q_image_to_plane(spark, sf):
    """Pixels of four kinds of images on the ground plane."""
    out = projection.image_to_plane(_pixels(spark, sf), "at")
    return out.select("id", F.round("at_x", 4).alias("x"), (F.round("at_y", 3) + 0).alias("y"), (F.round("at_z", 3) + 0).alias("z"))


@query("q_image_to_hae", "select o_orderkey as id, 0e0 as range_off, 0e0 as rate_off, 1 as side, (o_orderkey % 50 * 10)::double as hae from orders")
def q_image_to_hae(spark, sf):
    """Pixels on a surface of constant height have that height, their pixel's range and its rate, and lie on the scene's side of the track."""
    df = _pixels(spark, sf).withColumn("height", (F.col("id") % 50 * 10).cast("double"))
    out = geodesy.ecf_to_geodetic(_residuals(projection.image_to_hae(df, "height", "at"), "at"), "at")
    return out.select("id", "range_off", "rate_off", "side", (F.round("hae", 3) + 0).alias("hae"))


@query("q_ground_to_image", "select o_orderkey as id, (o_orderkey % 1000)::double as row, (o_custkey * 7 % 800)::double as col, 0e0 as miss from orders")
def q_ground_to_image(spark, sf):
    """Places where pixels meet the ground plane (q_image_to_plane has them in closed form) go back to their pixels."""
    df = projection.image_to_plane(_pixels(spark, sf), "at").drop("row", "col")
    out = projection.ground_to_image(df, "at")
    return rounded(out.select("id", "row", "col", "miss"), 3, "row", "col", "miss")


_POSTS = 41


def _posts(spark) -> DataFrame:
    """Uneven terrain of posts a hundredth of a degree apart around the scene."""
    ix, iy = (F.col("id") % _POSTS).cast("int"), (F.col("id") / _POSTS).cast("int")
    return spark.range(_POSTS * _POSTS).select(ix.alias("ix"), iy.alias("iy"), (100.0 + 2.0 * ix - 1.5 * iy + (ix * 7 + iy * 11) % 13 * 9.0).alias("elev"))


@query("q_image_to_dem", "select o_orderkey as id, 0e0 as range_off, 0e0 as rate_off, 1 as side, 0e0 as height_off from orders")
def q_image_to_dem(spark, sf):
    """Pixels on uneven terrain have the terrain's height, their pixel's range and its rate, and lie on the scene's side of the track."""
    df = _pixels(spark, sf)
    met = terrain.image_to_dem(df, _posts(spark), terrain.PostGrid(-0.2, -0.2, 0.01, 0.01), (0.0, 350.0, 26))
    placed = saved(geodesy.ecf_to_geodetic(_residuals(df.join(met, "id"), "at"), "at"))
    gx, gy = (F.col("lon") + 0.2) * 100, (F.col("lat") + 0.2) * 100
    ground = elevation.bilinear(placed.select(F.col("id").alias("pt_id"), gx.alias("gx"), gy.alias("gy")), _posts(spark))
    out = placed.join(ground.withColumnRenamed("pt_id", "id"), "id")
    return out.select("id", "range_off", "rate_off", "side", (F.round(F.col("hae") - F.col("elev"), 2) + 0).alias("height_off"))


# --- adjustment ----------------------------------------------------------------------

#: Along the axis away from the earth's, three tracks that see one scene from different sides.
_TRACKS = (3e5, -2e5, 6e5)


def stereo_images(spark) -> DataFrame:
    """Three images of the scene on a plane, from three tracks."""
    track = F.element_at(literal(_TRACKS), F.col("id").cast("int") + 1)
    near = F.hypot(F.lit(5e5), F.col("track"))
    own = {"urow_x": -5e5 / near, "urow_y": -F.col("track") / near, "arp_py": F.array("track")}
    values = {**_VALUES, **{k: x for k, x in _ARRAYS.items() if k in ("time_coa", "arp_px", "arp_pz")}}
    rest = [literal(x).alias(k) if isinstance(x, list) else F.lit(x).alias(k) for k, x in values.items() if k not in own]
    return spark.range(3).select(F.col("id").cast("int").alias("image"), F.lit("PLANE").alias("kind"), track.alias("track"), *rest).withColumns(own).drop("track")


@query("q_sensor_adjustment", "select (o_custkey % 4)::int as image, count(*) as n, 12.5::double * (1 + any_value(o_custkey % 4)) as along_row, -7.25::double as along_col, 0e0 as residue from orders group by 1")
def q_sensor_adjustment(spark, sf):
    """Sensors planted off their place along each image's axes, found again from places that pixels show."""
    from slantframe.operators.adjustment import adjust_sensors

    images = _images(spark)
    planted = {f"delta_arp_{a}": F.col(f"urow_{a}") * ((F.col("image") + 1) * 12.5) - F.col(f"ucol_{a}") * 7.25 for a in "xyz"}
    df = _pixels(spark, sf).withColumns({**planted, "height": (F.col("id") % 50 * 10).cast("double")})
    points = saved(projection.image_to_hae(df, "height", "place").select("image", "row", "col", "place_x", "place_y", "place_z"))
    out = adjust_sensors(points, images, unknowns=("row", "col")).join(images, "image")
    shift = Vec.of("delta_arp")
    return out.select("image", "n", (F.round(shift.dot(Vec.of("urow")), 2) + 0).alias("along_row"), (F.round(shift.dot(Vec.of("ucol")), 2) + 0).alias("along_col"), (F.round("residue", 6) + 0).alias("residue"))


@query("q_locate_features", "select c_custkey as feature, 3::bigint as n, 0e0 as off, 0e0 as residue from customer")
def q_locate_features(spark, sf):
    """Places of customers, seen in three images, found again from their pixels."""
    from slantframe.operators.adjustment import locate_features

    k = F.col("c_custkey")
    truth = v.table(spark, sf, "customer").select(k.alias("feature"), (6378137.0 + k % 5 * 30).alias("place_x"), (k % 17 * 40.0 - 300).alias("place_y"), (k % 23 * 25.0 - 250).alias("place_z"))
    truth = truth.repartition(partitions(truth), "feature")
    seen = projection.ground_to_image(truth.withColumn("image", F.explode(F.array(*map(F.lit, range(3))))).join(stereo_images(spark), "image"), "place").drop("place_x", "place_y", "place_z")
    found = locate_features(saved(seen)).join(truth.withColumnsRenamed({f"place_{a}": f"true_{a}" for a in "xyz"}), "feature")
    off = (Vec.of("place") - Vec.of("true")).norm()
    return found.select("feature", "n", (F.round(off, 1) + 0).alias("off"), (F.round("residue", 2) + 0).alias("residue"))


# --- cross sections ------------------------------------------------------------------


@query(
    "q_cross_section",
    f"""with {v.PX}, {v.RINGS}, e as (select ring, x0 * 8 as x0, y0 / 4 as y0, x1 * 8 as x1, y1 / 4 as y1 from sides), m as (select ring as feature, image, r, c, re * re + im * im as power,
  sum(case when (x0 <= r) <> (x1 <= r) and (x1 > x0) = ((x1 - x0) * (c - y0) - (r - x0) * (y1 - y0) < 0) and (x1 - x0) * (c - y0) - (r - x0) * (y1 - y0) <> 0 then 1 else 0 end) % 2 = 1
  or bool_or((x1 - x0) * (c - y0) - (r - x0) * (y1 - y0) = 0 and r between least(x0, x1) and greatest(x0, x1) and c between least(y0, y1) and greatest(y0, y1)) as inside from px join e on image = ring % 4 group by 1, 2, 3, 4, 5),
 i as (select *, 1.5::double + 0.01::double * (r - 128) * 0.5::double as rcs, 10e0 ** ((-20 + 0.1::double * (c - 4) * 2) / 10) as noise from m where inside),
 u as (select image, feature, 'PixelPower' as unit, power as value, noise, 1e0 as over from i union all select image, feature, 'RCS', power * rcs, noise * rcs, 1.875::double from i)
 select image, feature, unit, count(*) as n, round(sum(value) / any_value(over), 4) as total, round(avg(value), 4) as mean, round(stddev_pop(value), 4) as std, round(sum(noise) / any_value(over), 6) as noise_total from u group by 1, 2, 3""",
)
def q_cross_section(spark, sf):
    """Pixel power and cross section of nations' polygons, each in one of four images."""
    from slantframe.operators.cross_section import cross_sections

    areas = v.rings(spark, sf).select((F.col("ring") % 4).cast("int").alias("image"), F.col("ring").alias("feature"), F.lit(0).alias("part"), "ring", "vtx", (F.col("x") * 8).alias("x"), (F.col("y") / 4).alias("y"))
    none = F.lit(None).cast("array<array<double>>")
    values = {"scp_row": 128.0, "scp_col": 4.0, "first_row": 0.0, "first_col": 0.0, "row_ss": 0.5, "col_ss": 2.0, "row_oversample": 1.25, "col_oversample": 1.5}
    images = spark.range(4).select(F.col("id").cast("int").alias("image"), *(F.lit(x).alias(n) for n, x in values.items()), literal([[1.5], [0.01]]).alias("rcs_sf"), *(none.alias(n) for n in ("beta_sf", "sigma_sf", "gamma_sf")), literal([[-20.0, 0.1]]).alias("noise_db"))
    pixels = v.px(spark, sf).withColumns({n: F.col(n).cast("double") for n in ("re", "im")})
    out = cross_sections(pixels, areas, images).select("image", "feature", "unit", "n", "total", "mean", "std", "noise_total")
    return rounded(rounded(out, 4, "total", "mean", "std"), 6, "noise_total")


# --- signals -------------------------------------------------------------------------

_COMPLEX = "s as (select vec_id, unnest(range(0, 64)) as i, unnest(embedding)::double as x from embeddings), h as (select vec_id, i, x as re, x * ((i % 5) - 2) as im from s)"


def _vectors(spark, sf) -> DataFrame:
    e = v.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("re"))
    return e.withColumn("im", F.transform("re", lambda x, i: x * (i % 5 - 2)))


@query("q_fft_complex", f"with {_COMPLEX}, k as (select unnest(range(0, 64)) as k) select vec_id, k::int as k, round(sum(re * cos(2 * pi() * i * k / 64) + im * sin(2 * pi() * i * k / 64)), 5) + 0 as re, round(sum(im * cos(2 * pi() * i * k / 64) - re * sin(2 * pi() * i * k / 64)), 5) + 0 as im from h, k group by 1, 2")
def q_fft_complex(spark, sf):
    out = spectral.transform_complex(_vectors(spark, sf), "re", "im", "vec_id")
    out = out.select("vec_id", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z"))
    return out.select("vec_id", "k", (F.round("z.re", 5) + 0).alias("re"), (F.round("z.im", 5) + 0).alias("im"))


@query("q_ifft_round_trip", f"with {_COMPLEX} select vec_id, i::int as i, round(re, 6) + 0 as re, round(im, 6) + 0 as im from h")
def q_ifft_round_trip(spark, sf):
    """Centred spectra transformed back are the vectors."""
    there = spectral.transform_complex(_vectors(spark, sf), "re", "im", "vec_id", centred=True)
    back = spectral.transform_complex(there, "re", "im", "vec_id", inverse=True, centred=True)
    out = back.select("vec_id", F.posexplode(F.arrays_zip("re", "im")).alias("i", "z"))
    return out.select("vec_id", "i", (F.round("z.re", 6) + 0).alias("re"), (F.round("z.im", 6) + 0).alias("im"))


@query("q_subaperture_frames", "with f as (select s_suppkey as id, 60 + s_suppkey % 200 as size, 1 + s_suppkey % 7 as count, 0.1::double + 0.05::double * (s_suppkey % 11) as fraction, 1 + 0.25::double * (s_suppkey % 3) as fill from supplier), e as (select *, round_even((size - size / fill) / 2, 0)::int as edge from f), g as (select *, size - 2 * edge as filled, ceil(fraction * (size - 2 * edge))::int as width from e) select id, k::int as frame, (edge + k * if(count = 1, 0, (filled - width) // (count - 1)))::int as start, (edge + k * if(count = 1, 0, (filled - width) // (count - 1)) + width)::int as stop from g, lateral (select unnest(range(0, count)) as k)")
def q_subaperture_frames(spark, sf):
    """Frames of several lengths, counts, fractions and fills."""
    k = F.col("s_suppkey")
    one = lambda size, count, fraction, fill: spectral.frame_spans(size, count, fraction, fill)
    out = v.table(spark, sf, "supplier").select(k.alias("id"), one(60 + k % 200, 1 + k % 7, 0.1 + F.lit(0.05) * (k % 11), 1 + F.lit(0.25) * (k % 3)).alias("f"))
    return out.select("id", F.posexplode("f").alias("frame", "f")).select("id", "frame", "f.start", "f.stop")


@query("q_polynomial_fit", "select k::int as image, i::int as i, j::int as j, round([[1.5, -0.25, 0], [k + 0.125, 0.5, 0], [0, 0, -0.0625]][i + 1][j + 1]::double, 5) + 0 as coefficient from range(0, 4) a(k), range(0, 3) b(i), range(0, 3) c(j)")
def q_polynomial_fit(spark, sf):
    """Polynomials in two variables found again from their values."""
    o = v.table(spark, sf, "orders").select((F.col("o_custkey") % 4).cast("int").alias("image"), (F.col("o_orderkey") % 97 / F.lit(16.0)).alias("u"), (F.col("o_custkey") % 31 / F.lit(8.0)).alias("w"))
    u, w = F.col("u"), F.col("w")
    df = o.withColumn("z", 1.5 - 0.25 * w + (F.col("image") + 0.125) * u + 0.5 * u * w - 0.0625 * u * u * w * w)
    out = fits.fit_plane_polynomial(df, "image", "u", "w", "z", 2, 2)
    out = out.select("image", F.posexplode("coefficients").alias("i", "row")).select("image", "i", F.posexplode("row").alias("j", "coefficient"))
    return out.withColumn("coefficient", F.round("coefficient", 5) + 0)


_RATIONAL = {"numerator": {(0, 0): 1.5, (1, 0): 0.25, (0, 1): -0.5, (2, 0): 0.0, (1, 1): 0.125, (0, 2): 0.0}, "denominator": {(0, 0): 1.0, (1, 0): 0.02, (0, 1): 0.03}}


@query("q_rational_fit", " union all ".join(f"select k::int as image, '{part}' as part, {a} as i, {b} as j, {x!r}::double{' + k' if (part, a, b) == ('numerator', 0, 0) else ''} as coefficient from (select distinct o_custkey % 4 as k from orders)" for part, terms in _RATIONAL.items() for (a, b), x in terms.items()))
def q_rational_fit(spark, sf):
    """Quotients of polynomials in two variables found again from their values."""
    o = v.table(spark, sf, "orders").select((F.col("o_custkey") % 4).cast("int").alias("image"), (F.col("o_orderkey") % 97 / F.lit(16.0)).alias("u"), (F.col("o_custkey") % 31 / F.lit(8.0)).alias("w"))
    value = lambda terms: sum((F.lit(x) * F.pow("u", F.lit(float(a))) * F.pow("w", F.lit(float(b))) for (a, b), x in terms.items()), F.lit(0.0))
    df = o.withColumn("z", (value(_RATIONAL["numerator"]) + F.col("image")) / value(_RATIONAL["denominator"]))
    found = fits.fit_rational(df, "image", "u", "w", "z", 2, 1)
    parts = []
    for part in _RATIONAL:
        terms = F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j")) for a, b in fits.powers(2 if part == "numerator" else 1)])
        one = found.select("image", "scale_x", "scale_y", F.inline(F.arrays_zip(terms.alias("p"), F.col(part).alias("x"))))
        parts.append(one.select("image", F.lit(part).alias("part"), F.col("p.i").alias("i"), F.col("p.j").alias("j"), (F.round(F.col("x") / F.pow("scale_x", F.col("p.i").cast("double")) / F.pow("scale_y", F.col("p.j").cast("double")), 5) + 0).alias("coefficient")))
    return parts[0].unionAll(parts[1])


# --- geoid ---------------------------------------------------------------------------

_GEOID = "g as (select x::int as ix, y::int as iy, 30 * sin(radians(y * 10 - 90)) * cos(radians(x * 10)) + 5 as elev from range(0, 36) a(x), range(0, 19) b(y))"


@query("q_geoid_linear", f"with {v.PT}, {_GEOID}, q as (select id, (lon - 360 * floor(lon / 360)) / 10 as gx, (lat + 90) / 10 as gy from pt), b as (select *, floor(gx)::int as bx, least(floor(gy)::int, 17) as b_y from q), w as (select id, (bx + i) % 36 as ix, b_y + j as iy, (case when i = 1 then gx - bx else 1 - (gx - bx) end) * (case when j = 1 then gy - b_y else 1 - (gy - b_y) end) as w from b, (values (0, 0), (0, 1), (1, 0), (1, 1)) c(i, j)) select id, round(sum(w * elev), 6) + 0 as height from w join g using (ix, iy) group by id")
def q_geoid_linear(spark, sf):
    """Heights of the geoid between posts ten degrees apart, around the date line as well."""
    k = F.col("id")
    ix, iy = (k % 36).cast("int"), (k / 36).cast("int")
    posts = spark.range(36 * 19).select(ix.alias("ix"), iy.alias("iy"), (30 * F.sin(F.radians(iy * 10 - 90)) * F.cos(F.radians(ix * 10)) + 5).alias("elev"))
    return elevation.geoid_heights(v.pt(spark, sf), posts, 10.0).select("id", (F.round("height", 6) + 0).alias("height"))


# --- metadata ------------------------------------------------------------------------

_POL = "p as (select o_orderkey as id, ['V', 'H', 'RHC', 'LHC', 'OTHER', 'UNKNOWN', 'S', 'E'][1 + o_orderkey % 8] as tx, ['V', 'H', 'RHC', 'LHC', 'OTHER', 'UNKNOWN', 'S', 'E'][1 + o_custkey % 8] as rcv from orders)"


@query("q_polarization", f"with {_POL} select case when 'UNKNOWN' in (tx, rcv) then 'UNKNOWN' when 'OTHER' in (tx, rcv) then 'OTHER' else tx || ':' || rcv end as polarization, count(*) as n from p group by 1")
def q_polarization(spark, sf):
    names = F.array(*map(F.lit, ("V", "H", "RHC", "LHC", "OTHER", "UNKNOWN", "S", "E")))
    pick = lambda c: F.element_at(names, (F.col(c) % 8 + 1).cast("int"))
    p = collection.polarization(pick("o_orderkey"), pick("o_custkey"))
    return v.table(spark, sf, "orders").groupBy(p.alias("polarization")).agg(F.count("*").alias("n"))


# --- windows -------------------------------------------------------------------------


def _samples(spark, sf) -> DataFrame:
    """Samples of the vectors; windows are as long as a vector."""
    e = v.table(spark, sf, "embeddings").select("vec_id", F.size("embedding").alias("n"), F.posexplode("embedding").alias("i", "x"))
    return e.withColumn("x", F.col("x").cast("double"))


_SAMPLES = "s as (select vec_id, unnest(range(0, 64)) as i, unnest(embedding)::double as x from embeddings)"


@query(
    "q_window_taylor",
    f"""with a as (select acosh(10e0 ** 1.5::double) / pi() as a), h as (select a, 16 / (a * a + 12.25::double) as sp from a),
 f as (select m, (case when m % 2 = 1 then 1 else -1 end) * list_product(list_transform([1, 2, 3], lambda k: 1 - m * m / (sp * (a * a + (k - 0.5::double) ** 2)))) / (2 * list_product(list_transform(list_filter([1, 2, 3], lambda k: k <> m), lambda k: 1 - m * m / (k * k)::double))) as f from h, (values (1), (2), (3)) t(m)),
 w as (select i, (1 + 2 * sum(f * cos(2 * pi() * m * (i - 32 + 0.5::double) / 64))) / (1 + 2 * sum(f)) as w from (select unnest(range(0, 64)) as i), f group by 1), {_SAMPLES}
 select vec_id, i::int as i, round(x * w, 7) + 0 as value from s join w using (i)""",
)
def q_window_taylor(spark, sf):
    return _samples(spark, sf).select("vec_id", "i", (F.round(F.col("x") * spectral.taylor(F.col("i"), F.col("n")), 7) + 0).alias("value"))


@query("q_window_kaiser", f"with x as (select i, 49 * (1 - (2e0 * i / 63 - 1) ** 2) as q from (select unnest(range(0, 64)) as i)), w as (select i, list_sum(list_transform(range(0, 31), lambda k: q ** k / factorial(k::int)::double ** 2)) / list_sum(list_transform(range(0, 31), lambda k: 49e0 ** k / factorial(k::int)::double ** 2)) as w from x), {_SAMPLES} select vec_id, i::int as i, round(x * w, 7) + 0 as value from s join w using (i)")
def q_window_kaiser(spark, sf):
    return _samples(spark, sf).select("vec_id", "i", (F.round(F.col("x") * spectral.kaiser(F.col("i"), F.col("n"), 14.0), 7) + 0).alias("value"))


# --- labels and documents ------------------------------------------------------------


@query("q_label_cycle", f"with recursive {v.TAX}, l as (select * from tax union all select 'n' || n_nationkey, 'r' || n_regionkey from nation where n_nationkey % 5 = 0), up as (select parent as a, child as b from l union select up.a, l.child from up join l on l.parent = up.b) select a as id from up where a = b")
def q_label_cycle(spark, sf):
    """Labels that lie on a cycle, where some nations are parents of their region as well."""
    from slantframe.operators.annotation import labels_on_cycles

    n = v.table(spark, sf, "nation").where("n_nationkey % 5 = 0")
    back = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("parent"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("child"))
    return labels_on_cycles(spark, v.tax(spark, sf).unionAll(back))


@query("q_json_roundtrip", "select o_orderkey as id, o_totalprice as price, (o_orderkey % 97) / 16e0 as u, o_orderstatus as status from orders")
def q_json_roundtrip(spark, sf):
    """Metadata structs as JSON and back."""
    o = v.table(spark, sf, "orders")
    meta = F.struct(F.col("o_totalprice").alias("price"), F.struct((F.col("o_orderkey") % 97 / F.lit(16.0)).alias("u")).alias("grid"), F.col("o_orderstatus").alias("status"))
    back = F.from_json(F.to_json(meta), "struct<price:double,grid:struct<u:double>,status:string>")
    out = o.select(F.col("o_orderkey").alias("id"), back.alias("m"))
    return out.select("id", F.col("m.price").cast(o.schema["o_totalprice"].dataType).alias("price"), F.col("m.grid.u").alias("u"), F.col("m.status").alias("status"))


@query("q_xml_extract", "select o_orderkey as id, (o_orderkey % 1000)::int as scp_row, [(o_orderkey % 97)::double, 0e0, (o_custkey % 31)::double] as arp_px, 'PLANE' as kind from orders")
def q_xml_extract(spark, sf):
    """Image metadata as XML, parsed to the columns of the projections; coefficients stand in any order and zeros may be missing."""
    from slantframe.sources import sicd

    text = lambda c: F.col(c).cast("string")
    o = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 1000).cast("int").alias("row"), (F.col("o_orderkey") % 97).alias("c0"), (F.col("o_custkey") % 31).alias("c2"))
    xml = F.concat(
        F.lit("<SICD><ImageData><SCPPixel><Row>"), text("row"), F.lit("</Row><Col>1</Col></SCPPixel></ImageData><Grid><Type>XCTYAT</Type></Grid><Position><ARPPoly><X order1='2'><Coef exponent1='2'>"),
        text("c2"), F.lit("</Coef><Coef exponent1='0'>"), text("c0"), F.lit("</Coef></X></ARPPoly></Position></SICD>"),
    )
    out = sicd.projection_columns(o.select("id", sicd.parse(xml).alias("sicd")))
    return out.select("id", F.col("scp_row").cast("int").alias("scp_row"), "arp_px", "kind")


# --- rules of image metadata ---------------------------------------------------------

_ALGORITHMS = ("RGAZCOMP", "RMAT", "RMCR", "INCA")
_RULES = {
    "": (("scp_time", "error", "k % 5 <> 0", "true"), ("spotlight_scalar", "error", "false", "k % 3 = 0"), ("valid_data", "error", "k % 7 <> 0", "true"), ("polarization", "error", "k % 11 <> 0", "true"), ("projection", "warning", "true", "true")),
    "RGAZCOMP": (("plane", "error", "k % 2 = 1", "true"), ("type", "error", "true", "true"), ("azsf", "error", "k % 13 <> 0", "true"), ("row", "error", "true", "true"), ("col", "error", "k % 17 <> 0", "true"), ("col_kctr", "error", "k % 19 <> 0", "true")),
    "RMAT": (("type", "error", "true", "true"), ("row", "error", "true", "true"), ("col", "error", "k % 17 <> 0", "true"), ("cone", "error", "k % 23 <> 0", "true"), ("row_kctr", "warning", "true", "k % 2 = 0")),
    "RMCR": (("type", "error", "true", "true"), ("row", "error", "true", "true"), ("col", "error", "k % 17 <> 0", "true"), ("cone", "error", "k % 23 <> 0", "true"), ("col_kctr", "error", "k % 19 <> 0", "true"), ("row_kctr", "warning", "true", "k % 2 = 0")),
    "INCA": (("type", "warning", "true", "true"), ("row", "error", "true", "true"), ("col", "error", "k % 17 <> 0", "true"), ("range", "error", "k % 29 <> 0", "true"), ("drate", "error", "true", "true"), ("col_kctr", "error", "k % 19 <> 0", "true")),
}
_RULES_SQL = "with s as (select s_suppkey as image, s_suppkey // 4 as k, ['RGAZCOMP', 'RMAT', 'RMCR', 'INCA'][1 + s_suppkey % 4] as algorithm from supplier) " + " union all ".join(
    f"select image::varchar as object, '{(a.lower() + '_') * bool(a)}{n}' as rule, '{severity}' as severity, {passed} as passed, null::double as detail from s where {when}" + f" and algorithm = '{a}'" * bool(a)
    for a, rules in _RULES.items()
    for n, severity, passed, when in rules
)


@query("q_rules_images", _RULES_SQL)
def q_rules_images(spark, sf):
    """Image metadata that agree with their geometry, but for one field in every so many images."""
    from slantframe.operators.metadata_rules import image_rules

    k = F.floor(F.col("image") / 4)
    frequency = 1e10
    wave = 2 * frequency / 299792458.0
    algorithm = F.element_at(F.array(*map(F.lit, _ALGORITHMS)), (F.col("image") % 4 + 1).cast("int"))
    base = v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("image"))
    df = base.withColumns({"algorithm": algorithm, **{n: F.lit(x) for n, x in _VALUES.items()}, **{n: literal(x) for n, x in _ARRAYS.items()}})
    every = lambda n: k % n == 0
    own = {"RGAZCOMP": "RGAZIM", "RMAT": "XCTYAT", "RMCR": "XRGYCR", "INCA": "RGZERO"}
    types = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])
    places = {f"{p}_{a}": F.lit(x) for p in ("pos", "ref_pos") for a, x in zip("xyz", (6878137.0, 300000.0, 0.0))}
    places |= {f"{p}_{a}": F.lit(x) for p in ("vel", "ref_vel") for a, x in zip("xyz", (0.0, 0.0, 7000.0))}
    df = df.withColumns({
        **places, "kind": F.lit("PLANE"), "grid_type": types[F.col("algorithm")], "image_plane": F.when(every(2), "GROUND").otherwise("SLANT"),
        "mode": F.when(every(3), "SPOTLIGHT").otherwise("STRIPMAP"), "scp_time": F.when(every(5), 2.1).otherwise(2.0), "time_coa": literal([[2.0, 2e-4], [1e-6, 0.0]]),
        "image_vertices": F.lit(4), "geo_vertices": F.when(every(7), F.lit(None).cast("int")).otherwise(F.lit(4)), "polarization": F.when(every(11), "H:V").otherwise("V:V"), "received": F.array(F.lit("V:V"), F.lit("V:H")),
        "dop_cone": F.lit(90.0), "ref_dop_cone": F.when(every(23), 91.0).otherwise(90.0), "centre_frequency": F.lit(frequency), "reference_index": F.when(k % 2 == 1, 1),
        "row_kctr": F.lit(wave), "col_kctr": F.when(every(19), 0.5).otherwise(0.0), "arp_px": literal([6878137.0]), "time_ca": literal([2.0, 1 / 7000.0]), "drate_sf": literal([[1.0]]),
        "r_ca": F.when(every(29), _NEAR + 1).otherwise(_NEAR),
    })
    pos, vel = Vec.of("pos"), Vec.of("vel")
    df = df.withColumn("look_", F.signum(pos.unit().cross(vel.unit()).dot((Vec.of("scp") - pos).unit())))
    return image_rules(df.withColumns({"az_sf": F.when(every(13), 0.5).otherwise(-F.col("look_") / _NEAR), "ucol_z": F.when(every(17), F.lit(0.9)).otherwise(F.lit(1.0)) * -F.col("look_")}))
