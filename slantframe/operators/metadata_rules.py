"""Rules over the metadata of complex images: one row an image, results as in operators.phase_rules.

A row has the columns of functions.projection and, beside them, grid_type,
image_plane, mode, algorithm, scp_time, row_kctr, col_kctr, centre_frequency,
reference_index, polarization, received (an array) and the numbers of vertices
of its valid areas (image_vertices, geo_vertices); pos and vel are the place
and the velocity at the centre of aperture, ref_pos and ref_vel those of the
algorithm, dop_cone and ref_dop_cone their angles from the velocity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slantframe.functions.polynomials import derivative, poly1d
from slantframe.functions.vectors import Vec
from slantframe.operators.phase_rules import SPEED_OF_LIGHT, Rule, evaluate


def _axes(df: DataFrame, pos: str, vel: str, prefix: str, range_first: bool = True) -> DataFrame:
    """Adds <prefix>row, <prefix>col (unit vectors), <prefix>look, <prefix>cone (degrees) and <prefix>range of a slant plane.

    The first axis is the line of sight and the second lies in the plane at
    right angles to it, or, the other way round, the second is the track.
    """
    p, v, scp = Vec.of(pos), Vec.of(vel), Vec.of("scp")
    df = (scp - p).attach(df, f"{prefix}los").withColumn(f"{prefix}range", Vec.of(f"{prefix}los").norm())
    los = Vec.of(f"{prefix}los").unit()
    look = F.signum(p.unit().cross(v.unit()).dot(los))
    df = df.withColumns({f"{prefix}look": look, f"{prefix}cone": F.degrees(F.acos(los.dot(v.unit())))})
    if range_first:
        row = los
        col = (v.cross(los) * F.col(f"{prefix}look")).unit().cross(los)
    else:
        col = v.unit() * (-F.col(f"{prefix}look"))
        row = col.cross(los.cross(col).unit())
    return col.attach(row.attach(df, f"{prefix}row"), f"{prefix}col")


def _near(a: str, b: str, limit: float = 1e-3) -> Column:
    return (Vec.of(a) - Vec.of(b)).norm() <= limit


def _close(x: Column, y: Column, limit: float) -> Column:
    return F.abs(x - y) <= limit


def image_rules(df: DataFrame, key: str = "image") -> DataFrame:
    """(object, rule, severity, passed, detail) of every image; rules of an algorithm apply to its own images."""
    c = F.col
    df = _axes(_axes(_axes(df, "pos", "vel", "a_"), "ref_pos", "ref_vel", "t_", False), "ref_pos", "ref_vel", "c_")
    t0 = F.get(c("time_ca"), F.lit(0))
    place, speed = (Vec(*(poly1d(f(c(f"arp_p{a}")), t0) for a in "xyz")) for f in (lambda p: p, derivative))
    df = _axes(speed.attach(place.attach(df, "ca"), "cv"), "ca", "cv", "i_")
    k = c("centre_frequency") * (2 / SPEED_OF_LIGHT)
    own = {name: c("algorithm") == name for name in ("RGAZCOMP", "RMAT", "RMCR", "INCA")}
    free = c("reference_index").isNull()
    scalar = (F.size("time_coa") == 1) & (F.size(F.get("time_coa", F.lit(0))) == 1)
    cone = F.radians("ref_dop_cone")
    drate = 1 / F.abs(F.get("time_ca", F.lit(1)) * Vec.of("cv").norm())
    rules = [
        Rule("scp_time", _close(c("scp_time"), F.get(F.get("time_coa", F.lit(0)), F.lit(0)), 1e-6), when=c("scp_time").isNotNull() & c("time_coa").isNotNull()),
        Rule("spotlight_scalar", scalar, when=(c("mode") == "SPOTLIGHT") & c("time_coa").isNotNull()),
        Rule("scalar_spotlight", F.lit(False), when=(c("mode") != "SPOTLIGHT") & scalar, severity="warning"),
        Rule("valid_data", c("image_vertices").eqNullSafe(c("geo_vertices"))),
        Rule("polarization", F.array_contains("received", c("polarization")), when=c("polarization").isNotNull() & c("received").isNotNull()),
        Rule("projection", c("kind").isNotNull() & c("arp_px").isNotNull() & c("scp_x").isNotNull(), severity="warning"),
        Rule("rgazcomp_plane", c("image_plane") == "SLANT", when=own["RGAZCOMP"]),
        Rule("rgazcomp_type", c("grid_type") == "RGAZIM", when=own["RGAZCOMP"]),
        Rule("rgazcomp_azsf", _close(c("az_sf"), -c("a_look") * F.sin(F.radians("dop_cone")) / c("a_range"), 1e-6), when=own["RGAZCOMP"]),
        Rule("rgazcomp_row", _near("urow", "a_row"), when=own["RGAZCOMP"]),
        Rule("rgazcomp_col", _near("ucol", "a_col"), when=own["RGAZCOMP"]),
        Rule("rgazcomp_col_kctr", c("col_kctr") == 0, when=own["RGAZCOMP"]),
        Rule("rmat_type", c("grid_type") == "XCTYAT", when=own["RMAT"]),
        Rule("rmat_row", _near("urow", "t_row"), when=own["RMAT"]),
        Rule("rmat_col", _near("ucol", "t_col"), when=own["RMAT"]),
        Rule("rmat_cone", _close(c("ref_dop_cone"), c("t_cone"), 1e-6), when=own["RMAT"]),
        Rule("rmat_row_kctr", F.abs(k * F.sin(cone) / c("row_kctr") - 1) <= 1e-3, when=own["RMAT"] & free, severity="warning"),
        Rule("rmcr_type", c("grid_type") == "XRGYCR", when=own["RMCR"]),
        Rule("rmcr_row", _near("urow", "c_row"), when=own["RMCR"]),
        Rule("rmcr_col", _near("ucol", "c_col"), when=own["RMCR"]),
        Rule("rmcr_cone", _close(c("ref_dop_cone"), c("c_cone"), 1e-6), when=own["RMCR"]),
        Rule("rmcr_col_kctr", F.abs("col_kctr") <= 1e-6, when=own["RMCR"]),
        Rule("rmcr_row_kctr", F.abs(k / c("row_kctr") - 1) <= 1e-3, when=own["RMCR"] & free, severity="warning"),
        Rule("inca_type", c("grid_type") == "RGZERO", when=own["INCA"], severity="warning"),
        Rule("inca_row", _near("urow", "i_row"), when=own["INCA"]),
        Rule("inca_col", _near("ucol", "i_col"), when=own["INCA"]),
        Rule("inca_range", _close(c("r_ca"), c("i_range"), 1e-2), when=own["INCA"]),
        Rule("inca_drate", _close(F.get(F.get("drate_sf", F.lit(0)), F.lit(0)), drate, 1e-3), when=own["INCA"]),
        Rule("inca_col_kctr", F.abs("col_kctr") <= 1e-8, when=own["INCA"]),
    ]
    return evaluate(df, key, rules)
