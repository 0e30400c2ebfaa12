import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slantframe.operators.derivation import FACTORS, TYPES, broadening, derive, polar_format, window

BASE = {"mode": "SPOTLIGHT", "scp_x": 6378137.0, "scp_y": 0.0, "scp_z": 0.0, "scp_row": 50.0, "scp_col": 40.0, "num_rows": 101.0, "num_cols": 81.0, "row_ss": 0.5, "col_ss": 0.4, "row_bw": 1.5, "col_bw": 2.0, "tx_min": 9.4e9, "tx_max": 9.8e9, "duration": 4.0}
TRACK = {"arp_px": [6878137.0, 10.0, -2.0], "arp_py": [300000.0, -30.0], "arp_pz": [-14000.0, 7000.0]}
C = 299792458.0


POS = {"pos_x": 6878149.0, "pos_y": 299940.0, "pos_z": 0.0, "vel_x": 2.0, "vel_y": -30.0, "vel_z": 7000.0, "acc_x": -4.0, "acc_y": 0.0, "acc_z": 0.0}
COA = {"time_coa": [[2.0]]}
CASES = {
    "compressed": {**COA, "algorithm": "RGAZCOMP", "image_plane": "GROUND"},
    "track": {**dict.fromkeys(TRACK), **POS, "scp_time": 2.0},
    **{a: {**COA, "algorithm": a, "time_ca": [1.5]} for a in ("RMAT", "RMCR", "INCA")},
    **{f"polar {p}": {**COA, "algorithm": "PFA", "image_plane": p, "row_kctr": 60.0} for p in ("GROUND", "SLANT", None)},
    "windows": {"row_window": "Hamming", "col_window": "TAYLOR", "row_dk_poly": [[0.1, 0.0], [0.01, 0.0]], "col_bw": 4.0},
    "inside": {"row_dk_poly": [[0.1, 0.0], [0.001, 0.0]], "col_wid": 0.7, "col_window": "UNIFORM", "col_bw": None},
    "odd": {"row_window": "MINE", "col_weights": [0.0, 0.0]},
    **{f"radio {n}": {**COA, n: [[2.0, 1.0]], "row_window": "HANNING"} for n in FACTORS},
    "noughts": {**dict.fromkeys([*BASE, *TRACK]), **{n: 0.0 for n in (*POS, "scp_x", "scp_y", "scp_z", "row_bw", "row_ss", "row_wid", "scp_time")}, "row_weights": [], "algorithm": "RMCR", "beta_sf": [[1.0]]},
    "nothing": dict.fromkeys([*BASE, *TRACK]),
}


@pytest.fixture(scope="module")
def made(spark):
    """All cases, derived at once."""
    kinds = {n: kind for kind, names in TYPES.items() for n in names}
    used = sorted({n for extra in CASES.values() for n in (*BASE, *TRACK, *extra)})
    rows = [(name, *({**BASE, **TRACK, **extra}.get(n) for n in used)) for name, extra in CASES.items()]
    df = derive(spark.createDataFrame(rows, ", ".join(["name string", *(f"{n} {kinds[n]}" for n in used)])))
    assert derive(spark.range(0).withColumn("name", F.lit("x"))).columns == df.columns[:0] + ["id", *df.columns]
    return {r["name"]: r for r in df.collect()}


def vec(row, name):
    return np.array([row[f"{name}_{a}"] for a in "xyz"])


def unit(x):
    return x / np.linalg.norm(x)


def test_place_and_track(made):
    r = made["compressed"]
    assert r.scp_time == 2 and np.allclose(vec(r, "pos"), [6878137 + 20 - 8, 299940, 0]) and np.allclose(vec(r, "vel"), [2, -30, 7000]) and np.allclose(vec(r, "acc"), [-4, 0, 0])
    los = unit(vec(r, "scp") - vec(r, "pos"))
    assert np.allclose(vec(r, "urow"), los) and abs(vec(r, "ucol") @ los) < 1e-12 and r.image_plane == "SLANT" and r.grid_type == "RGAZIM"
    assert abs(r.row_kctr - 2 * 9.6e9 / C) < 1e-9 and r.col_kctr == 0
    assert abs(abs(r.az_sf) - math.sin(math.radians(r.doppler_cone)) / r.slant_range) < 1e-15
    back = made["track"]
    assert back.time_coa == [[2.0]] and all(np.allclose(np.polynomial.polynomial.polyval([0.0, 1.0, 2.0], back[n]), np.polynomial.polynomial.polyval([0.0, 1.0, 2.0], x)) for n, x in TRACK.items())


def test_range_migration(made):
    for algorithm, kind in (("RMAT", "XCTYAT"), ("RMCR", "XRGYCR"), ("INCA", "RGZERO")):
        r = made[algorithm]
        row, col = vec(r, "urow"), vec(r, "ucol")
        assert abs(row @ col) < 1e-12 and abs(np.linalg.norm(row) - 1) < 1e-12 and r.grid_type == kind
        if algorithm == "INCA":
            closest = np.array([np.polynomial.polynomial.polyval(1.5, x) for x in TRACK.values()])
            assert abs(r.r_ca - np.linalg.norm(vec(r, "scp") - closest)) < 1e-6 and r.freq_zero == 9.6e9 and r.col_kctr == 0
        else:
            cone = math.acos(unit(vec(r, "scp") - vec(r, "pos")) @ unit(vec(r, "vel")))
            assert np.allclose(vec(r, "ref_pos"), vec(r, "pos")) and abs(r.ref_dop_cone - math.degrees(cone)) < 1e-9
            k = 2 * 9.6e9 / C
            assert np.allclose([r.row_kctr, r.col_kctr], [k * math.sin(cone), k * math.cos(cone)] if algorithm == "RMAT" else [k, k])
        if algorithm == "RMAT":
            assert np.allclose(abs(col @ unit(vec(r, "vel"))), 1)


def test_polar_format(made):
    """Angles are nought at the reference time; fitted polynomials give angles and scales; axes lie in the plane."""
    for plane in ("GROUND", "SLANT", None):
        r = made[f"polar {plane}"]
        times = np.linspace(0, 4, 33)
        angle, scale = polar_format({**r.asDict()}, times)
        poly = np.polynomial.polynomial.polyval
        assert abs(poly(2.0, r.polar_angle)) < 1e-9 and np.allclose(poly(times, r.polar_angle), angle, atol=1e-9) and np.allclose(poly(angle, r.freq_scale), scale, atol=1e-9)
        assert np.allclose(vec(r, "ipn") @ vec(r, "urow"), 0, atol=1e-9) and np.allclose(vec(r, "ucol"), np.cross(vec(r, "ipn"), vec(r, "urow")))
        assert (r.krg1, r.krg2, r.col_kctr) == (59.25, 60.75, 0.0)
        assert np.allclose(vec(r, "fpn"), [1, 0, 0])


def test_windows_and_bands(made):
    assert abs(broadening(window("UNIFORM", None)) - 0.8859) < 1e-3 and abs(broadening(window("HANNING", None)) - 1.4382) < 6e-3
    r = made["windows"]
    assert len(r.row_weights) == 512 and abs(r.row_wid - broadening(window("HAMMING", None)) / 1.5) < 1e-12
    x = np.array([-50 * 0.5, 50 * 0.5])
    assert np.allclose([r.row_dk1, r.row_dk2], [-1.0, 1.0]) and (0.1 + 0.01 * x.max()) + 0.75 > 1
    assert np.allclose([r.col_dk1, r.col_dk2], [-1.25, 1.25])
    inside = made["inside"]
    assert np.allclose([inside.row_dk1, inside.row_dk2], [0.1 - 0.025 - 0.75, 0.1 + 0.025 + 0.75])
    assert abs(inside.col_bw - broadening(np.ones(32)) / 0.7) < 1e-12 and inside.row_oversample == 1 / 0.75
    odd = made["odd"]
    assert odd.row_weights is None and odd.row_wid is None and odd.col_wid is None and odd.resolution == "0000"


def test_radiometry(made):
    """Whichever polynomial is given, the others follow from it."""
    for name in FACTORS:
        r = made[f"radio {name}"]
        w = np.array(r.row_weights)
        slope, graze = math.cos(math.radians(r.slope)), math.sin(math.radians(r.graze))
        sizes = {"beta_sf": 1.0, "rcs_sf": (1 + w.var() / w.mean() ** 2) / 3, "sigma_sf": slope, "gamma_sf": slope / graze}
        for other in FACTORS:
            assert np.allclose(r[other], np.array([[2.0, 1.0]]) * sizes[other] / sizes[name])


def test_nothing_known(made):
    r = made["nothing"]
    assert r.resolution == "0000" and all(x is None for n, x in r.asDict().items() if n not in ("name", "resolution"))


def test_noughts(made):
    """An antenna at the scene's centre that doesn't move, empty weights, bands of nothing: no axes, no factors, no error."""
    r = made["noughts"]
    assert r.urow_x is None and r.row_kctr is None and r.rcs_sf is None and r.row_oversample == 1


def test_only_selected_columns_are_made(spark):
    """Weights aren't made for those who don't select them, and no worker gets whole rows."""
    kinds = {n: kind for kind, names in TYPES.items() for n in names}
    used = sorted({*BASE, "row_window"})
    df = derive(spark.createDataFrame([tuple({**BASE, "row_window": "HAMMING"}.get(n) for n in used)], ", ".join(f"{n} {kinds[n]}" for n in used)))
    plan = lambda out: out._jdf.queryExecution().optimizedPlan().toString()
    few = df.select("row_wid", "sigma_sf")
    assert "_shape(" in plan(few) and "_samples(" not in plan(few) and "MapInArrow" not in plan(few)
    assert "_samples(" in plan(df.select("row_weights")) and len(df.select("row_weights").first()[0]) == 512
