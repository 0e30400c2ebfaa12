"""What image metadata imply: columns that are null are filled from the others, one row an image.

Besides the columns of functions.projection a row has (all of them may be
missing, or null):

algorithm       PFA, RGAZCOMP, RMAT, RMCR or INCA;  mode, image_plane, grid_type
scp_time, pos, vel, acc     centre of aperture; geometry as in functions.collection
tx_min, tx_max, centre_frequency     Hz
num_rows, num_cols, vertices (an array of row and col: the valid area)
row_, col_      window, window_parameter, weights, bw, wid, ss, kctr, dk_poly, dk1, dk2
ipn, fpn, polar_ref_time, duration, krg1, krg2, kaz1, kaz2       PFA
ref_pos, ref_vel, ref_dop_cone (RMAT, RMCR); freq_zero (INCA)
rcs_sf, beta_sf, sigma_sf, gamma_sf      radiometric polynomials
"""

from __future__ import annotations

import json
import math
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slantframe.functions.collection import scene_geometry
from slantframe.functions.polynomials import derivative, poly1d, poly2d
from slantframe.functions.vectors import Vec
from slantframe.operators.phase_rules import SPEED_OF_LIGHT

SIDES = ("row", "col")
VECTORS = ("scp", "urow", "ucol", "pos", "vel", "acc", "ipn", "fpn", "ref_pos", "ref_vel")
GEOMETRY = ("side_of_track", "slant_range", "ground_range", "rov", "doppler_cone", "graze", "incidence", "azimuth", "twist", "slope", "squint", "layover", "layover_size", "shadow", "shadow_size")
FACTORS = ("rcs_sf", "beta_sf", "sigma_sf", "gamma_sf")
#: Columns by type.
TYPES = {
    "string": ("algorithm", "mode", "image_plane", "grid_type", "row_window", "col_window", "side_of_track"),
    "double": (
        *(f"{v}_{a}" for v in VECTORS for a in "xyz"), *GEOMETRY[1:], "scp_time", "tx_min", "tx_max", "centre_frequency", "num_rows", "num_cols", "scp_row", "scp_col", "first_row", "first_col",
        *(f"{s}_{n}" for s in SIDES for n in ("window_parameter", "bw", "wid", "ss", "kctr", "dk1", "dk2")), "polar_ref_time", "duration", "krg1", "krg2", "kaz1", "kaz2", "ref_dop_cone", "r_ca", "freq_zero", "az_sf",
    ),
    "array<double>": ("arp_px", "arp_py", "arp_pz", "row_weights", "col_weights", "polar_angle", "freq_scale", "time_ca"),
    "array<array<double>>": ("time_coa", "row_dk_poly", "col_dk_poly", *FACTORS),
    "array<struct<row:double,col:double>>": ("vertices",),
}
#: Samples of a window that only a name describes.
SAMPLES = 512


def _fill(df: DataFrame, **values: Column) -> DataFrame:
    return df.withColumns({n: F.coalesce(F.col(n), x) for n, x in values.items()})


def _fill_vector(df: DataFrame, name: str, x: Vec, when: Column) -> DataFrame:
    """A vector that lacks a component, whole, where a condition holds."""
    lacks = reduce(lambda p, q: p | q, [F.col(f"{name}_{a}").isNull() for a in "xyz"]) & F.coalesce(when, F.lit(False))
    return df.withColumns({f"{name}_{a}": F.when(lacks, v).otherwise(F.col(f"{name}_{a}")) for a, v in zip("xyz", (x.x, x.y, x.z))})


def _at(df: DataFrame, t: Column) -> tuple[Vec, Vec, Vec]:
    """Place, velocity and acceleration of the antenna."""
    p = [F.col(f"arp_p{a}") for a in "xyz"]
    return Vec(*(poly1d(c, t) for c in p)), Vec(*(poly1d(derivative(c), t) for c in p)), Vec(*(poly1d(derivative(derivative(c)), t) for c in p))


# --- windows -------------------------------------------------------------------------


def window(name: str, parameter: float | None, n: int = SAMPLES) -> np.ndarray | None:
    """Weights of a named window, symmetric; None for a name that isn't known.  Taylor's parameter is the level of its side lobes."""
    edge = 2 * np.arange(n) / (n - 1) - 1
    if name == "UNIFORM":
        return np.ones(32)
    if name in ("HAMMING", "HANNING"):
        a = 0.5 if name == "HANNING" else 0.54 if parameter is None else parameter
        return a + (1 - a) * np.cos(np.pi * edge)
    if name == "KAISER":
        return np.kaiser(n, 14.0 if parameter is None else parameter)
    if name == "TAYLOR":
        a, m = math.acosh(10 ** (abs(-30.0 if parameter is None else parameter) / 20)) / math.pi, np.arange(1, 4)
        wide = 16 / (a * a + 3.5**2)
        f = np.array([-((-1) ** k) * np.prod(1 - k * k / (wide * (a * a + (m - 0.5) ** 2))) / np.prod(1 - k * k / m[m != k] ** 2) for k in m])
        shape = lambda x: 1 + f @ np.cos(np.outer(m, x))
        return shape(2 * np.pi * (np.arange(n) - n / 2 + 0.5) / n) / shape(np.zeros(1))
    return None


def broadening(weights: np.ndarray) -> float:
    """Width, in samples of a spectrum without a window, of the response of weights where it has fallen to 1 / sqrt 2."""
    n = len(weights)
    at = (np.arange(n) - (n - 1) / 2) / n
    fallen = lambda x: abs((weights * np.exp(2j * np.pi * at * x)).sum()) < abs(weights.sum()) / math.sqrt(2)
    high = 0.25
    while not fallen(high):
        if high > n / 2:
            return float("nan")
        high += 0.25
    low = high - 0.25
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (low, middle) if fallen(middle) else (middle, high)
    return low + high


def spread(weights: np.ndarray) -> float:
    """Mean square over squared mean; not a number where the mean is nought."""
    mean = weights.mean()
    return float((weights * weights).mean() / mean**2) if mean else float("nan")


@lru_cache(maxsize=1024)
def _named(name: str, parameter: float | None) -> tuple[np.ndarray, float, float] | None:
    w = window(name, parameter)
    return None if w is None else (w, broadening(w), spread(w))


def _shape(given: pa.Array, names: pa.Array, parameters: pa.Array) -> pa.Array:
    """How much each row's window broadens a response and how uneven it is; named windows are worked out once."""
    wide, flat = [], []
    for i, (name, parameter) in enumerate(zip(names.to_pylist(), parameters.to_pylist())):
        known = _named(name.upper(), parameter) if name else None
        own = given[i].values if given[i].is_valid else None
        usable = own is not None and len(own) > 0 and own.null_count == 0 and own.to_numpy().sum() != 0
        wide.append(known[1] if known is not None else broadening(own.to_numpy()) if usable else None)
        flat.append(1.0 if own is None and known is None else known[2] if own is None else spread(own.to_numpy()) if usable else None)
    return pa.StructArray.from_arrays([pa.array(x, pa.float64(), from_pandas=True) for x in (wide, flat)], ["wide", "flat"])


def _samples(names: pa.Array, parameters: pa.Array) -> pa.Array:
    """Weights of named windows, null for others; each window is made once and no weights become Python numbers."""
    order, made, at = {}, [], []
    for key in zip(names.to_pylist(), parameters.to_pylist()):
        known = _named(key[0].upper(), key[1]) if key[0] else None
        if known is not None and key not in order:
            order[key] = len(made)
            made.append(known[0])
        at.append(order.get(key))
    return pa.array(made, pa.list_(pa.float64())).take(pa.array(at, pa.int64()))


def _windows(df: DataFrame) -> DataFrame:
    """df with weights of both sides, where a name gives them, and wide_row_ and flat_row_.., how much each window broadens a response and how uneven it is.

    Both are functions of three columns, so rows pass the workers without the
    other columns, and weights (long) aren't made where nobody selects them.
    """
    c, shape, samples = F.col, F.arrow_udf(_shape, "struct<wide:double,flat:double>"), F.arrow_udf(_samples, "array<double>")
    for s in SIDES:
        name, parameter = c(f"{s}_window"), c(f"{s}_window_parameter")
        df = df.withColumn("shape_", shape(f"{s}_weights", name, parameter))
        df = df.withColumns({f"wide_{s}_": c("shape_.wide"), f"flat_{s}_": c("shape_.flat"), f"{s}_weights": F.coalesce(f"{s}_weights", samples(name, parameter))}).drop("shape_")
    return df


def _directions(df: DataFrame) -> DataFrame:
    """Weights, widths of responses and bands of spatial frequencies of both sides."""
    df = _windows(df)
    corner = lambda r, c: F.struct(r.cast("double").alias("row"), c.cast("double").alias("col"))
    zero, bottom, right = F.lit(0.0), F.col("num_rows") - 1, F.col("num_cols") - 1
    whole = F.when(bottom.isNotNull() & right.isNotNull(), F.array(corner(zero, zero), corner(zero, right), corner(bottom, right), corner(bottom, zero)))
    df = df.withColumn("area_", F.coalesce("vertices", whole))
    x = lambda p: (p["row"] - F.col("scp_row") + F.coalesce(F.col("first_row"), zero)) * F.col("row_ss")
    y = lambda p: (p["col"] - F.col("scp_col") + F.coalesce(F.col("first_col"), zero)) * F.col("col_ss")
    for s in SIDES:
        wide = F.col(f"wide_{s}_")
        df = _fill(df, **{f"{s}_wid": F.try_divide(wide, F.col(f"{s}_bw"))})
        df = _fill(df, **{f"{s}_bw": F.try_divide(wide, F.col(f"{s}_wid"))})
        own = F.col(f"{s}_dk_poly")
        df = df.withColumn("off_", F.transform("area_", lambda p: poly2d(own, x(p), y(p))))  # noqa: B023
        half, most = F.col(f"{s}_bw") / 2, F.try_divide(F.lit(0.5), F.abs(F.col(f"{s}_ss")))
        low, high = F.coalesce(F.array_min("off_"), zero) - half, F.coalesce(F.array_max("off_"), zero) + half
        beyond = (low < -most) | (high > most)
        lacks = F.col(f"{s}_dk1").isNull() | F.col(f"{s}_dk2").isNull()
        df = df.withColumns({"low_": F.when(beyond, -most).when(half.isNotNull() & most.isNotNull(), low), "high_": F.when(beyond, most).when(half.isNotNull() & most.isNotNull(), high)})
        df = df.withColumns({f"{s}_dk1": F.when(lacks, F.coalesce("low_", f"{s}_dk1")).otherwise(F.col(f"{s}_dk1")), f"{s}_dk2": F.when(lacks, F.coalesce("high_", f"{s}_dk2")).otherwise(F.col(f"{s}_dk2"))})
    return df.drop("area_", "off_", "low_", "high_", *(f"wide_{s}_" for s in SIDES))


# --- polar format --------------------------------------------------------------------

_POLAR = ("arp_px", "arp_py", "arp_pz", *(f"{v}_{a}" for v in ("scp", "ipn", "fpn") for a in "xyz"), "polar_ref_time", "duration")


def polar_format(meta: dict, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(polar angles, scales of spatial frequency) of the antenna in the image plane at times."""
    place = lambda t: np.stack([np.polynomial.polynomial.polyval(t, meta[f"arp_p{a}"]) for a in "xyz"], axis=-1)
    scp, ipn, fpn = (np.array([meta[f"{v}_{a}"] for a in "xyz"]) for v in ("scp", "ipn", "fpn"))
    norm = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    flat = lambda p: p + ((scp - p) @ ipn / (fpn @ ipn))[..., None] * fpn
    right = norm(flat(place(np.array(meta["polar_ref_time"]))) - scp)
    away, in_plane = norm(place(times) - scp), norm(flat(place(times)) - scp)
    return np.arctan2(in_plane @ np.cross(ipn, right), in_plane @ right), np.sqrt((1 - (away @ fpn) ** 2) / (1 - (in_plane @ fpn) ** 2))


def _polar_polynomials(df: DataFrame, degree: int = 5, count: int = 15) -> DataFrame:
    """df with polar_angle and freq_scale fitted at times spread over the collection, where a PFA image lacks one of them."""
    need = (F.col("algorithm") == "PFA") & (F.col("polar_angle").isNull() | F.col("freq_scale").isNull())
    have = reduce(lambda p, q: p & q, [F.col(c).isNotNull() for c in _POLAR])

    @F.arrow_udf("struct<angle:array<double>,scale:array<double>>")
    def fitted(texts: pa.Array) -> pa.Array:
        angle, scale = [], []
        for text in texts.to_pylist():
            if not text:
                angle.append(None)
                scale.append(None)
                continue
            meta = json.loads(text)
            times = np.linspace(0, meta["duration"], count)
            a, k = polar_format(meta, times)
            angle.append(np.polynomial.polynomial.polyfit(times, a, degree).tolist())
            scale.append(np.polynomial.polynomial.polyfit(a, k, degree).tolist())
        return pa.StructArray.from_arrays([pa.array(x, pa.list_(pa.float64())) for x in (angle, scale)], ["angle", "scale"])

    out = df.withColumn("polar_", fitted(F.when(need & have, F.to_json(F.struct(*_POLAR)))))
    new = {n: F.coalesce(F.col(f"polar_.{f}"), F.col(n)) for n, f in (("polar_angle", "angle"), ("freq_scale", "scale"))}
    return out.withColumns(new).drop("polar_")


# --- all -----------------------------------------------------------------------------


def derive(df: DataFrame) -> DataFrame:
    """df with every column named above: nulls are filled where the other columns determine them, nothing else changes.

    Only RGAZCOMP images have their plane and grid type reset, since there is
    just one of each.  row_oversample, col_oversample and resolution (four
    digits of centimetres) are added.  Where a track is made of place,
    velocity and acceleration, it is the one through that place; ref_dop_cone
    and r_ca are those of the scene's centre.
    """
    c, own = F.col, lambda *names: F.coalesce(F.col("algorithm").isin(*names), F.lit(False))
    known = set(df.columns)
    rest = [n for n in df.columns if n not in {x for names in TYPES.values() for x in names}]
    out = df.select(*rest, *((c(n) if n in known else F.lit(None)).cast(kind).alias(n) for kind, names in TYPES.items() for n in names))
    out = _fill(out, scp_time=F.get(F.get("time_coa", F.lit(0)), F.lit(0)))
    out = _fill(out, time_coa=F.when((c("mode") == "SPOTLIGHT") & c("scp_time").isNotNull(), F.array(F.array("scp_time"))))
    # The centre of aperture and the track, one from the other.
    place, speed, push = _at(out, c("scp_time"))
    lacks = c("pos_x").isNull() | c("pos_y").isNull() | c("pos_z").isNull()
    out = out.withColumn("lacks_", lacks)
    for name, x in (("pos", place), ("vel", speed), ("acc", push)):
        out = out.withColumns({f"{name}_{a}": F.when(c("lacks_"), F.coalesce(v, c(f"{name}_{a}"))).otherwise(c(f"{name}_{a}")) for a, v in zip("xyz", (x.x, x.y, x.z))})
    t, tracks = c("scp_time"), {}
    for a in "xyz":
        p, s, q = c(f"pos_{a}"), c(f"vel_{a}"), F.coalesce(c(f"acc_{a}"), F.lit(0.0))
        tracks[f"arp_p{a}"] = F.when((p + s + t).isNotNull(), F.array(p - s * t + q * t * t / 2, s - q * t, q / 2))
    out = _fill(out, **tracks)
    # Frequencies, then geometry.
    out = _fill(out, centre_frequency=(c("tx_min") + c("tx_max")) / 2)
    out = scene_geometry(out.withColumnsRenamed({n: f"given_{n}" for n in GEOMETRY}), "scp", "pos", "vel")
    usable = (c("pos_x") + c("vel_x") + c("scp_x")).isNotNull()
    out = out.withColumns({n: F.coalesce(c(f"given_{n}"), F.when(usable, c(n))) for n in GEOMETRY}).drop(*(f"given_{n}" for n in GEOMETRY))
    # References of the algorithms.
    for name, x in (("ref_pos", Vec.of("pos")), ("ref_vel", Vec.of("vel"))):
        out = _fill_vector(out, name, x, own("RMAT", "RMCR"))
    out = _fill(out, polar_ref_time=F.when(own("PFA"), c("scp_time")), freq_zero=F.when(own("INCA"), c("centre_frequency")))
    closest, fast, _ = _at(out, F.get("time_ca", F.lit(0)))
    pick = lambda a, b, d: F.when(own("INCA"), a).when(own("RMAT", "RMCR"), b).when(own("RGAZCOMP"), d)
    for name, triple in (("rp_", (closest, Vec.of("ref_pos"), Vec.of("pos"))), ("rv_", (fast, Vec.of("ref_vel"), Vec.of("vel")))):
        out = Vec(*(pick(*(getattr(x, a) for x in triple)) for a in "xyz")).attach(out, name)
    scp, rp, rv = Vec.of("scp"), Vec.of("rp_"), Vec.of("rv_")
    out = (scp - rp).attach(out, "los_")
    out = _fill(out, r_ca=F.when(own("INCA"), Vec.of("los_").norm()), ref_dop_cone=F.when(own("RMAT", "RMCR"), F.degrees(F.acos(Vec.of("los_").unit().dot(rv.unit())))))
    out = out.withColumn("turn_", F.signum(rp.unit().cross(rv.unit()).dot(Vec.of("los_").unit())))
    # Axes: range first and azimuth in the slant plane, or (RMAT) the track first.
    los, track = Vec.of("los_").unit(), rv.unit() * (-c("turn_"))
    out = los.attach(out, "r1_")
    out = ((rv.cross(Vec.of("r1_")) * c("turn_")).unit().cross(Vec.of("r1_"))).attach(out, "c1_")
    out = track.attach(out, "c2_")
    out = Vec.of("c2_").cross(Vec.of("r1_").cross(Vec.of("c2_")).unit()).attach(out, "r2_")
    # A polar format's planes and axes.
    look = F.when(c("side_of_track") == "R", -1.0).otherwise(1.0)
    sight = (scp - Vec.of("pos")).unit()
    out = (Vec.of("vel").cross(sight) * look).unit().attach(out, "slant_")
    lat = Vec(c("scp_x") / 6378137.0**2, c("scp_y") / 6378137.0**2, c("scp_z") / 6356752.314245179**2)
    out = lat.unit().attach(out, "up_")
    ground = c("image_plane") == "GROUND"
    flat = Vec(*(F.when(ground, c(f"up__{a}")).when(c("image_plane").isNull() | (c("image_plane") == "SLANT"), c(f"slant__{a}")) for a in "xyz"))
    out = _fill_vector(_fill_vector(out, "ipn", flat, own("PFA")), "fpn", Vec.of("up_"), own("PFA"))
    out = _directions(_polar_polynomials(out))
    seen, _, _ = _at(out, c("polar_ref_time"))
    out = seen.attach(out, "seen_")
    ipn, fpn = Vec.of("ipn"), Vec.of("fpn")
    drop = F.try_divide((scp - Vec.of("seen_")).dot(ipn), fpn.dot(ipn))
    out = (scp - Vec.of("seen_") - fpn * drop).unit().attach(out, "r3_")
    out = ipn.cross(Vec.of("r3_")).attach(out, "c3_")
    both = c("urow_x").isNull() & c("ucol_x").isNull()
    out = out.withColumn("lacks_", F.when(own("RGAZCOMP"), F.lit(True)).otherwise(both))
    for name, kind in (("urow", "r"), ("ucol", "c")):
        x = Vec(*(F.when(own("PFA"), c(f"{kind}3__{a}")).when(own("RMAT"), c(f"{kind}2__{a}")).otherwise(c(f"{kind}1__{a}")) for a in "xyz"))
        out = _fill_vector(out, name, x, c("lacks_"))
    # Centres of spatial frequency.
    k, first = c("centre_frequency") * (2 / SPEED_OF_LIGHT), lambda s: F.coalesce(F.get(F.get(c(s), F.lit(0)), F.lit(0)), F.lit(0.0))
    for s in ("krg", "kaz"):
        side = "row" if s == "krg" else "col"
        out = _fill(out, **{f"{s}{i}": F.when(own("PFA"), c(f"{side}_kctr") + sign * 0.5 * c(f"{side}_bw")) for i, sign in ((1, -1), (2, 1))})
    rga = own("RGAZCOMP")
    fixed = out.withColumns({
        "row_dk_poly": F.coalesce("row_dk_poly", F.when(rga & c("row_kctr").isNotNull() & k.isNotNull(), F.array(F.array(k - c("row_kctr"))))),
        "col_dk_poly": F.coalesce("col_dk_poly", F.when(rga & c("col_kctr").isNotNull() & k.isNotNull(), F.array(F.array(-c("col_kctr"))))),
    })
    cone = F.radians("ref_dop_cone")
    out = _fill(
        fixed,
        row_kctr=F.when(rga, k - first("row_dk_poly")).when(own("RMAT"), k * F.sin(cone)).when(own("RMCR"), k).when(own("INCA"), c("freq_zero") * (2 / SPEED_OF_LIGHT)).when(own("PFA"), F.coalesce((c("krg1") + c("krg2")) / 2, k + F.get("freq_scale", F.lit(0)))),
        col_kctr=F.when(rga & k.isNotNull(), -first("col_dk_poly")).when(own("RMAT"), k * F.cos(cone)).when(own("RMCR"), k).when(own("INCA", "PFA"), F.lit(0.0)),
        az_sf=F.when(rga, F.try_divide(-look * F.sin(F.radians("doppler_cone")), c("slant_range"))),
    )
    kinds = {"PFA": "RGAZIM", "RMAT": "XCTYAT", "RMCR": "XRGYCR", "INCA": "RGZERO"}
    natural = reduce(lambda w, n: w.when(own(n), kinds[n]), kinds, F.when(F.lit(False), F.lit(None).cast("string")))
    out = out.withColumns({"grid_type": F.when(rga, "RGAZIM").otherwise(F.coalesce("grid_type", natural)), "image_plane": F.when(rga, "SLANT").otherwise(F.coalesce("image_plane", F.when(own("RMAT", "RMCR"), "SLANT")))})
    return _named_columns(_radiometry(out), rest)


def _radiometry(df: DataFrame) -> DataFrame:
    """Any one of the radiometric polynomials gives the others."""
    c = F.col
    df = df.withColumn("spot_", F.try_divide(c("flat_row_") * c("flat_col_"), c("row_bw") * c("col_bw")))
    slope, graze = F.cos(F.radians("slope")), F.sin(F.radians("graze"))
    scaled = lambda p, k: F.when(k.isNotNull(), F.transform(p, lambda row: F.transform(row, lambda x: x * k)))
    #: How much larger each is than the one for the slant plane's brightness.
    sizes = {"rcs_sf": c("spot_"), "sigma_sf": slope, "gamma_sf": F.try_divide(slope, graze)}
    df = _fill(df, beta_sf=F.coalesce(*(scaled(c(n), F.try_divide(F.lit(1.0), k)) for n, k in sizes.items())))
    return _fill(df, **{n: scaled(c("beta_sf"), k) for n, k in sizes.items()}).drop("spot_", "flat_row_", "flat_col_")


def _named_columns(df: DataFrame, rest: list[str]) -> DataFrame:
    over = {f"{s}_oversample": F.when((F.col(f"{s}_ss") * F.col(f"{s}_bw")).isNotNull(), F.greatest(F.lit(1.0), F.try_divide(F.lit(1.0), F.col(f"{s}_ss") * F.col(f"{s}_bw")))) for s in SIDES}
    size = F.floor(100 * F.sqrt(F.abs("row_wid") * F.abs("col_wid")))
    name = F.when(size.isNotNull(), F.lpad(F.least(size, F.lit(9999)).cast("string"), 4, "0")).otherwise("0000")
    return df.select(*rest, *(n for names in TYPES.values() for n in names), *(x.alias(n) for n, x in over.items()), name.alias("resolution"))
