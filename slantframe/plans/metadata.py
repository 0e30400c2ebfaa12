"""Queries of metadata values, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from slantframe.functions import values
from slantframe.functions.vectors import Vec
from slantframe.plans import views as v
from slantframe.plans.registry import literal, query, rounded

_TEXTS = "['true', '0', ' False', '1', 'yes', '12', '-7.9', '1e3', 'x', '']"


@query(
    "q_parse_values",
    f"""with t as (select o_orderkey as id, {_TEXTS}[1 + o_orderkey % 10] as t from orders)
 select id, case when lower(trim(t)) in ('true', '1') then true when lower(trim(t)) in ('false', '0') then false end as flag, try_cast(trim(t) as double) as number,
 trunc(try_cast(trim(t) as double))::bigint as whole from t""",
)
def q_parse_values(spark, sf):
    """Texts as booleans, numbers and whole numbers; null where they are none."""
    texts = F.array(*map(F.lit, ("true", "0", " False", "1", "yes", "12", "-7.9", "1e3", "x", "")))
    t = F.element_at(texts, (F.col("o_orderkey") % 10 + 1).cast("int"))
    return v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), values.parse_bool(t).alias("flag"), values.parse_float(t).alias("number"), values.parse_int(t).alias("whole"))


@query("q_parse_times", "select event_id as id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as text, date_trunc('second', ts) as time from events")
def q_parse_times(spark, sf):
    """Times as ISO texts and back."""
    e = v.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("text"))
    return e.withColumn("time", values.parse_datetime(F.concat("text", F.lit("Z"))))


@query("q_parameters", "select o_orderkey as id, (o_orderkey % 3)::varchar as a, (o_custkey % 5)::varchar as b, 2 as n from orders")
def q_parameters(spark, sf):
    """Name and value pairs as maps, one name given twice."""
    text = lambda c: c.cast("string")
    pair = lambda n, x: F.struct(F.lit(n).alias("name"), x.alias("value"))
    m = values.parameters(F.array(pair("a", F.lit("first")), pair("b", text(F.col("o_custkey") % 5)), pair("a", text(F.col("o_orderkey") % 3))))
    out = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), m.alias("m"))
    return out.select("id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), F.size("m").alias("n"))


_NAMES = "['V', 'H', 'RHC', 'LHC', 'OTHER', 'OTHER1', 'S', 'E']"


@query(
    "q_polarization_version",
    f"with p as (select o_orderkey as id, {_NAMES}[1 + o_orderkey % 8] as a, {_NAMES}[1 + o_custkey % 8] as b, o_orderkey % 50 as k from orders) select id, case when k = 0 or k = 1 then '1.1.0' when k = 2 then null when starts_with(a, 'OTHER') or starts_with(b, 'OTHER') or a in ('S', 'E') or b in ('S', 'E') then '1.3.0' when (a in ('V', 'H')) <> (b in ('V', 'H')) then '1.2.1' else '1.1.0' end as version from p",
)
def q_polarization_version(spark, sf):
    names = F.array(*map(F.lit, ("V", "H", "RHC", "LHC", "OTHER", "OTHER1", "S", "E")))
    pick = lambda c: F.element_at(names, (F.col(c) % 8 + 1).cast("int"))
    k = F.col("o_orderkey") % 50
    name = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "UNKNOWN").when(k == 2, "V").otherwise(F.concat(pick("o_orderkey"), F.lit(":"), pick("o_custkey")))
    return v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), values.polarization_version(name).alias("version"))


@query("q_pass_number", "select o_orderkey as id, printf('%02d', round_even((o_orderkey % 1440) * 15.2::double / 1440, 0)::int) as number from orders")
def q_pass_number(spark, sf):
    return v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), values.pass_number(F.col("o_orderkey") % 1440, F.lit(15.2)).alias("number"))


@query("q_format_layout", "with f(id, k, part, kind, bytes) as (values (0, 0, '', 'F8', 8), (1, 0, 'X', 'F8', 8), (1, 1, 'Y', 'F8', 8), (1, 2, 'Z', 'F8', 8), (2, 0, 'DCX', 'F4', 4), (2, 1, 'DCY', 'F4', 4), (3, 0, '', 'CI4', 4)) select n_nationkey as nation, k, part, kind, bytes from nation join f on n_nationkey % 4 = id")
def q_format_layout(spark, sf):
    texts = F.array(*map(F.lit, ("F8", "X=F8;Y=F8;Z=F8;", "DCX=F4;DCY=F4;", "CI4")))
    layout = values.format_layout(F.element_at(texts, (F.col("n_nationkey") % 4 + 1).cast("int")))
    out = v.table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.posexplode(layout).alias("k", "x"))
    return out.select("nation", "k", "x.part", "x.kind", "x.bytes")


@query("q_ground_resolution", "with g as (select o_orderkey as id, 0.5::double + (o_orderkey % 7) * 0.1::double as r, 0.4::double + (o_custkey % 5) * 0.1::double as c, radians(20e0 + o_orderkey % 50) as g, radians((o_custkey % 40 - 20)::double) as t from orders) select id, round(abs(r / cos(g)), 6) as row_ground, round(sqrt((tan(g) * tan(t) * r) ** 2 + (c / cos(t)) ** 2), 6) as col_ground from g")
def q_ground_resolution(spark, sf):
    k, m = F.col("o_orderkey"), F.col("o_custkey")
    row, col = values.ground_resolution(0.5 + (k % 7) * F.lit(0.1), 0.4 + (m % 5) * F.lit(0.1), F.lit(20.0) + k % 50, (m % 40 - 20).cast("double"))
    return rounded(v.table(spark, sf, "orders").select(k.alias("id"), row.alias("row_ground"), col.alias("col_ground")), 6, "row_ground", "col_ground")


@query(
    "q_radial_frame",
    """with p as (select c_custkey as id, 7e6 + c_custkey % 100 as x, (c_custkey % 1000) * 1e3 as y, (c_custkey % 77) * 1e4 as z, 100e0 as vx, (c_custkey % 13) * 100e0 as vy, 7000e0 as vz from customer),
 q as (select *, vx - 7.2921151467e-5 * y as ux, vy + 7.2921151467e-5 * x as uy, sqrt(x*x + y*y + z*z) as r from p), s as (select *, (y*vz - z*uy) as cx, (z*ux - x*vz) as cy, (x*uy - y*ux) as cz from q)
 select id, round(x / r, 9) as rx, round(cx / sqrt(cx*cx + cy*cy + cz*cz), 9) + 0 as ax, round((cy*z - cz*y) / (r * sqrt(cx*cx + cy*cy + cz*cz)), 9) + 0 as ix, round((cz*x - cx*z) / (r * sqrt(cx*cx + cy*cy + cz*cz)), 9) + 0 as iy, round((cx*y - cy*x) / (r * sqrt(cx*cx + cy*cy + cz*cz)), 9) + 0 as iz from s""",
)
def q_radial_frame(spark, sf):
    """Radial, in-track and cross-track axes in a frame that doesn't turn with the earth."""
    k = F.col("c_custkey")
    place = Vec(7e6 + k % 100, (k % 1000) * 1e3, (k % 77) * 1e4)
    radial, along, across = values.radial_frame(place, Vec(F.lit(100.0), (k % 13) * 100.0, F.lit(7000.0)), inertial=True)
    out = v.table(spark, sf, "customer").select(k.alias("id"), radial.x.alias("rx"), across.x.alias("ax"), along.x.alias("ix"), along.y.alias("iy"), along.z.alias("iz"))
    return out.select("id", *((F.round(c, 9) + 0).alias(c) for c in ("rx", "ax", "ix", "iy", "iz")))


@query("q_image_corners", "select s_suppkey as image, c.corner, (case when c.lr then 99 + s_suppkey else 0 end)::int as row, (case when c.lc then 49 + s_suppkey else 0 end)::int as col from supplier, (values ('1:FRFC', false, false), ('2:FRLC', false, true), ('3:LRLC', true, true), ('4:LRFC', true, false)) c(corner, lr, lc)")
def q_image_corners(spark, sf):
    s = F.col("s_suppkey")
    return v.table(spark, sf, "supplier").select(s.alias("image"), F.inline(values.corners(100 + s, 50 + s)))


_DERIVED = """with o as (select o_orderkey as id, o_orderkey as k, o_custkey % 4 as a, (o_orderkey % 5)::double as t, (o_custkey % 3)::double as ca, 1 + (o_orderkey % 3) * 0.25::double as bw, 2 * (9.6e9 + (o_orderkey % 10) * 1e7) / 299792458 as k0 from orders),
 s as (select *, case when a = 3 then ca else t end as u, 6378137 - (6878137 - 2 * t * t) as lx, -300000e0 as ly, 14000 - 7000 * t as lz, -4 * t as vx, 7000e0 as vz from o),
 r as (select *, sqrt(lx * lx + ly * ly + lz * lz) as n, sqrt(vx * vx + vz * vz) as v, 6378137 - (6878137 - 2 * u * u) as sx, 14000 - 7000 * u as sz from s),
 d as (select *, (lx * vx + lz * vz) / (n * v) as cone, sqrt(sx * sx + ly * ly + sz * sz) as far, sqrt((vz * ly) ** 2 + (vz * lx - vx * lz) ** 2 + (vx * ly) ** 2) as cr from r),
 e as (select *, case when a = 1 then lx / n - cone * vx / v else sx / far end as ex, case when a = 1 then ly / n else ly / far end as ey, case when a = 1 then lz / n - cone * vz / v else sz / far end as ez from d),
 h as (select 0.54::double - 0.46::double * cos(2 * pi() * i / 511) as w from range(0, 512) x(i)), f as (select avg(w * w) / avg(w) ** 2 as f from h)
 select id, t as scp_time, round(ex / sqrt(ex * ex + ey * ey + ez * ez), 8) as ux, round(ey / sqrt(ex * ex + ey * ey + ez * ez), 8) as uy, round(ez / sqrt(ex * ex + ey * ey + ez * ez), 8) + 0 as uz,
  round(case when a = 1 then k0 * sqrt(1 - cone * cone) else k0 end, 6) as row_kctr, round(case a when 1 then k0 * cone when 2 then k0 else 0 end, 6) + 0 as col_kctr, case when a = 3 then round(far, 4) end as r_ca,
  -least(bw / 2, 0.625::double) as dk1, least(bw / 2, 0.625::double) as dk2, round((1.5::double + k % 7) * f / (bw * 2), 6) as rcs, round((1.5::double + k % 7) * abs(vz * ly) / cr, 6) as sigma,
  ['RGAZIM', 'XCTYAT', 'XRGYCR', 'RGZERO'][1 + a] as grid_type from e, f"""


@query("q_derive_metadata", _DERIVED)
def q_derive_metadata(spark, sf):
    """What image metadata of four algorithms imply: centre of aperture, axes, bands, radiometric factors."""
    from slantframe.operators.derivation import derive

    k, m = F.col("o_orderkey"), F.col("o_custkey")
    middle = 9.6e9 + (k % 10) * 1e7
    meta = {
        "algorithm": F.element_at(F.array(*map(F.lit, ("RGAZCOMP", "RMAT", "RMCR", "INCA"))), (m % 4 + 1).cast("int")), "time_coa": F.array(F.array((k % 5).cast("double"))), "time_ca": F.array((m % 3).cast("double")),
        "scp_x": F.lit(6378137.0), "scp_y": F.lit(0.0), "scp_z": F.lit(0.0), "arp_px": literal([6878137, 0, -2]), "arp_py": literal([300000]), "arp_pz": literal([-14000, 7000]), "tx_min": middle - 1e8, "tx_max": middle + 1e8,
        "row_bw": 1 + (k % 3) * F.lit(0.25), "col_bw": F.lit(2.0), "row_ss": F.lit(0.8), "col_ss": F.lit(0.4), "row_window": F.lit("HAMMING"), "col_window": F.lit("UNIFORM"), "beta_sf": F.array(F.array(F.lit(1.5) + k % 7)),
    }
    out = derive(v.table(spark, sf, "orders").select(k.alias("id"), *(x.alias(n) for n, x in meta.items())))
    out = out.select("id", "scp_time", *(F.col(f"urow_{a}").alias(f"u{a}") for a in "xyz"), "row_kctr", "col_kctr", "r_ca", F.col("row_dk1").alias("dk1"), F.col("row_dk2").alias("dk2"), F.col("rcs_sf")[0][0].alias("rcs"), F.col("sigma_sf")[0][0].alias("sigma"), "grid_type")
    out = rounded(rounded(rounded(out, 8, "ux", "uy", "uz"), 6, "row_kctr", "col_kctr", "rcs", "sigma"), 4, "r_ca")
    return out.withColumns({c: F.col(c) + 0 for c in ("uz", "col_kctr")})


_PFA_AXES = """m as (select s_suppkey as k, 6878137e0 as px, 300000e0 as py, (s_suppkey % 3) * 1000e0 - 1000 as pz, case when s_suppkey % 2 = 0 and s_suppkey % 16 <> 0 or s_suppkey % 6 = 5 then 1e0 else 3 / sqrt(34e0) end as ix, case when s_suppkey % 2 = 0 and s_suppkey % 16 <> 0 or s_suppkey % 6 = 5 then 0e0 else -5 / sqrt(34e0) end as iy,
   case when s_suppkey % 7 = 0 then -1e0 when s_suppkey % 5 = 0 then cos(0.1e0) else 1e0 end as fx, case when s_suppkey % 7 <> 0 and s_suppkey % 5 = 0 then sin(0.1e0) else 0e0 end as fy from supplier),
 n as (select *, ((6378137 - px) * ix - py * iy) / (fx * ix + fy * iy) as o from m), q as (select *, 6378137 - px - o * fx as qx, -py - o * fy as qy, -pz as qz from n),
 w as (select *, qx / sqrt(qx * qx + qy * qy + qz * qz) as wx, qy / sqrt(qx * qx + qy * qy + qz * qz) as wy, qz / sqrt(qx * qx + qy * qy + qz * qz) as wz, sqrt((px - 6378137) ** 2 + py * py + pz * pz) as far from q),
 p as (select *, abs(0.5145e0 - sqrt((1 - (((px - 6378137) * fx + py * fy) / far) ** 2) / (1 - (wx * fx + wy * fy) ** 2))) as scale_miss, 60 + (k % 4) * 0.5e0 as row_kctr, (k % 5) * 0.01e0 as col_kctr, 0.004e0 * (k % 3) as angle, 2 * (1.75e10 + (k % 4) * 1e7) / 299792458 * 0.5145e0 as centre,
   50 + (k % 3) * 10e0 as krg1, case when k % 13 = 0 then 72e0 else 70e0 end as krg2, k % 9 = 0 as deskewed from w),
 r as (select *, case when k % 8 = 1 then krg1 * tan(angle) else -0.5e0 - (k % 4) * 0.1e0 end as kaz1, case when k % 8 = 1 then krg1 * tan(angle) else 0.5e0 + (k % 4) * 0.1e0 end as kaz2 from p)"""
_PFA_RULES = [
    ("pfa_type", "k % 10 <> 0", "null", "true", "warning"),
    ("pfa_ref_time", "abs((k % 8 = 0)::int * 0.5e0) <= 1e-6", "(k % 8 = 0)::int * 0.5e0", "true", "warning"),
    ("pfa_kaz_high", "kaz2 - col_kctr <= 0.5e0 / 0.75e0 + 1e-10", "round(kaz2 - col_kctr, 6)", "not deskewed"),
    ("pfa_kaz_low", "-(kaz1 - col_kctr) <= 0.5e0 / 0.75e0 + 1e-10", "round(kaz1 - col_kctr, 6)", "not deskewed"),
    ("pfa_krg_high", "krg2 - row_kctr <= 10 + 1e-10", "round(krg2 - row_kctr, 6)"),
    ("pfa_krg_low", "-(krg1 - row_kctr) <= 10 + 1e-10", "round(krg1 - row_kctr, 6)"),
    ("pfa_row_bandwidth", "12 <= krg2 - krg1 + 1e-10", "12"),
    ("pfa_col_kctr", "abs(col_kctr) <= 1e-5 or abs(col_kctr - 0.5e0 * (kaz1 + kaz2)) <= 1e-5", "round(col_kctr, 6)"),
    ("pfa_deskew_time", "k % 2 <> 0", "null", "deskewed"),
    ("pfa_deskew_phase", "k % 2 <> 0", "round(case when k % 2 = 0 then 0.25e0 else 0 end, 6)", "deskewed", "warning"),
    ("pfa_row_kctr", "abs(row_kctr / centre - 1) <= greatest(1e-2, 1 - cos(atan(0.5e0 * 0.8e0 / row_kctr)))", "round(row_kctr / centre, 6)", "k % 3 <> 0"),
    ("pfa_angle", "angle <= 5e-3", "round(angle, 6)"),
    ("pfa_scale", "scale_miss <= 5e-3", "round(scale_miss, 6)"),
    ("pfa_row", "sqrt(wx ** 2 + (wy + 1) ** 2 + wz ** 2) <= 1e-3", "null"),
    ("pfa_col", "sqrt((iy * wz) ** 2 + (ix * wz) ** 2 + (ix * wy - iy * wx + 1) ** 2) <= 1e-3", "null"),
    ("pfa_slant_plane", "degrees(acos(least(1e0, (3 * ix - 5 * iy) / sqrt(34e0)))) <= 1", "null", "k % 2 = 1"),
    ("pfa_ground_plane", "degrees(acos(ix)) <= 3", "null", "k % 2 = 0"),
    ("pfa_focus_outward", "fx >= 0", "null"),
    ("pfa_focus_level", "degrees(acos(fx)) <= 3", "null", "true", "warning"),
    ("pfa_angle_bounds", "degrees(greatest(abs(angle - atan(kaz1 / krg1)), abs(angle - atan(kaz2 / krg1)))) <= 0.1", "round(degrees(greatest(abs(angle - atan(kaz1 / krg1)), abs(angle - atan(kaz2 / krg1)))), 6)", "k % 4 = 1", "warning"),
]


def _rule_rows(source: str, rules: list[tuple]) -> str:
    out = []
    for name, passed, detail, *more in rules:
        when, severity = (*more, *("true", "error")[len(more) :])
        out.append(f"select k::varchar as object, '{name}' as rule, '{severity}' as severity, ({passed}) as passed, ({detail})::double as detail from {source} where {when}")
    return " union all ".join(out)


@query("q_rules_polar", f"with {_PFA_AXES} " + _rule_rows("r", _PFA_RULES))
def q_rules_polar(spark, sf):
    """Rules of polar-format images: bounds of frequencies, polynomials, planes and axes, with failures of each."""
    from slantframe.operators.polar_rules import polar_rules

    k = F.col("s_suppkey")
    flat = ((k % 2 == 0) & (k % 16 != 0)) | (k % 6 == 5)
    root, one = 34.0**0.5, lambda x: F.lit(float(x))
    place = {"x": one(6878137), "y": one(300000), "z": (k % 3) * 1000.0 - 1000}
    table = lambda x: F.array(F.array(one(0.5), x))
    krg1 = 50 + (k % 3) * one(10)
    even = krg1 * F.tan(0.004 * (k % 3))
    meta = {
        "image": k, "algorithm": F.lit("PFA"), "grid_type": F.when(k % 10 == 0, "PLANE").otherwise("RGAZIM"), "image_plane": F.when(k % 2 == 0, "GROUND").otherwise("SLANT"), "mode": F.when(k % 4 == 1, "SPOTLIGHT").otherwise("DYNAMIC STRIPMAP"),
        "polar_ref_time": F.when(k % 8 == 0, 1.0).otherwise(0.5), "scp_time": one(0.5), "duration": one(4), "tstart_proc": one(0), "tend_proc": one(4), **{f"arp_p{a}": F.array(x) for a, x in place.items()}, **{f"pos_{a}": x for a, x in place.items()},
        "vel_x": one(0), "vel_y": one(0), "vel_z": one(7000), "scp_x": one(6378137), "scp_y": one(0), "scp_z": one(0), "urow_x": one(0), "urow_y": one(-1), "urow_z": one(0), "ucol_x": one(0), "ucol_y": one(0), "ucol_z": one(-1),
        "ipn_x": F.when(flat, 1.0).otherwise(3 / root), "ipn_y": F.when(flat, 0.0).otherwise(-5 / root), "ipn_z": one(0), "fpn_x": F.when(k % 7 == 0, -1.0).when(k % 5 == 0, F.cos(one(0.1))).otherwise(1.0), "fpn_y": F.when((k % 7 != 0) & (k % 5 == 0), F.sin(one(0.1))).otherwise(0.0), "fpn_z": one(0),
        "row_kctr": 60 + (k % 4) * one(0.5), "col_kctr": (k % 5) * one(0.01), "row_ss": one(0.05), "col_ss": one(0.75), "row_bw": one(12), "col_bw": one(0.8), "krg1": krg1, "krg2": F.when(k % 13 == 0, 72.0).otherwise(70.0), "kaz1": F.when(k % 8 == 1, even).otherwise(-0.5 - (k % 4) * one(0.1)), "kaz2": F.when(k % 8 == 1, even).otherwise(0.5 + (k % 4) * one(0.1)),
        "polar_angle": F.array(0.004 * (k % 3)), "freq_scale": F.array(one(0.5145)), "centre_frequency": 1.75e10 + (k % 4) * one(1e7), "reference_index": F.when(k % 3 == 0, 1), "deskewed": k % 9 == 0,
        "time_coa": table(F.when(k % 2 == 0, 0.0).otherwise(0.5)), "row_deltak": table(one(0.25)), "deskew_phase": table(F.when(k % 2 == 0, 0.5).otherwise(0.25)),
    }
    found = polar_rules(v.table(spark, sf, "supplier").select(*(x.alias(n) for n, x in meta.items())))
    return found.withColumn("detail", F.round("detail", 6) + 0)


_COMPRESSION = """a as (select s_suppkey as k, case when s_suppkey % 3 = 0 then null when s_suppkey % 3 = 1 then 0.25e0 else -0.5e0 end as dk, 2 * 9e9 / 299792458 as centre, 500 + (s_suppkey % 7) * 0.1e0 as rate, radians(85e0 + s_suppkey % 10) as cone from supplier),
 b as (select *, centre - coalesce(dk, 0) + (case when k % 11 = 0 then 0.125e0 else 0 end) as kctr, case when k % 12 = 0 then 0.25e0 else (k % 2) * 0.5e0 end as ckctr, k % 15 = 1 as uneven from a), c as (select *, (kctr + coalesce(dk, 0)) * 7000 * sin(cone) / (583095.1894845301e0 * rate) as step, (centre) * 7000 / (583095.1894845301e0 * rate) as given from b)"""
_COMPRESSION_RULES = [
    ("rgazcomp_kaz", "sqrt((10 * (step - given)) ** 2 + (rate * (step - given)) ** 2) <= 1e-3", "round(sqrt((10 * (step - given)) ** 2 + (rate * (step - given)) ** 2), 6)", "not uneven"),
    ("rgazcomp_row_constant", "not uneven", "null", "dk is not null"),
    ("rgazcomp_row_kctr", "abs(kctr - (centre - case when uneven then 0 else dk end)) <= 1e-6", "round(abs(kctr - (centre - case when uneven then 0 else dk end)), 6)", "dk is not null"),
    ("rgazcomp_col_zero", "ckctr = 0", "round(ckctr, 6)", "k % 4 = 0"),
    ("rgazcomp_col_constant", "k % 4 <> 3", "null", "k % 4 <> 0"),
    ("rgazcomp_col_kctr", "abs(ckctr - 0.5e0) <= 1e-6", "round(ckctr, 6)", "k % 4 in (1, 2)"),
]


@query("q_rules_compression", f"with {_COMPRESSION} " + _rule_rows("c", _COMPRESSION_RULES))
def q_rules_compression(spark, sf):
    """Rules of azimuth-compressed images: the polynomial of azimuth frequencies and the middles of both bands."""
    from slantframe.operators.polar_rules import compression_rules

    k, one = F.col("s_suppkey"), lambda x: F.lit(float(x))
    dk = F.when(k % 3 == 0, None).when(k % 3 == 1, 0.25).otherwise(-0.5)
    centre, rate = 2 * 9e9 / 299792458, 500 + (k % 7) * one(0.1)
    far = 583095.1894845301
    given = centre * 7000 / (far * rate)
    meta = {
        "image": k, "algorithm": F.lit("RGAZCOMP"), "scp_x": one(6378137), "scp_y": one(0), "scp_z": one(0), "pos_x": one(6878137), "pos_y": one(300000), "pos_z": one(0), "vel_x": one(0), "vel_y": one(0), "vel_z": one(7000),
        "ipp": F.array(one(10), rate), "kaz_poly": F.array(10 * given, rate * given), "scp_time": one(1), "slant_range": one(far), "dop_cone": one(85) + k % 10, "row_kctr": centre - F.coalesce(dk, one(0)) + F.when(k % 11 == 0, 0.125).otherwise(0.0), "col_kctr": F.when(k % 12 == 0, 0.25).otherwise((k % 2) * one(0.5)),
        "row_deltak": F.when(k % 15 == 1, F.array(F.array(dk, one(0.1)))).when(dk.isNotNull(), F.array(F.array(dk))), "col_deltak": F.when(k % 4 == 3, F.array(F.array(one(-0.5), one(0.1)))).when(k % 4 != 0, F.array(F.array(one(-0.5)))), "centre_frequency": one(9e9), "reference_index": F.lit(None).cast("int"),
    }
    found = compression_rules(v.table(spark, sf, "supplier").select(*(x.alias(n) for n, x in meta.items())))
    return found.withColumn("detail", F.round("detail", 6) + 0)
