"""Every rule of polar-format and azimuth-compressed images passes and fails somewhere; nulls only keep rules away."""

import pytest
from pyspark.sql import functions as F

from slantframe.operators import polar_rules
from slantframe.plans import metadata


@pytest.mark.parametrize("query, rules", [("polar", metadata._PFA_RULES), ("compression", metadata._COMPRESSION_RULES)])
def test_both_outcomes(spark, query, rules):
    got = getattr(metadata, f"q_rules_{query}")(spark, "/root/testdata/sf0.01")
    seen = {r.rule: set(r.outcomes) for r in got.groupBy("rule").agg(F.collect_set("passed").alias("outcomes")).collect()}
    assert set(seen) == {r[0] for r in rules}
    assert all(v == {True, False} for v in seen.values()), seen


def _of(spark, run, known):
    """Rules of one image with all columns null but the known ones."""
    names = {"image": "int", "algorithm": "string", "grid_type": "string", "image_plane": "string", "mode": "string", "reference_index": "int", "deskewed": "boolean"}
    tables = {"time_coa", "row_deltak", "col_deltak", "deskew_phase"}
    lists = {"arp_px", "arp_py", "arp_pz", "polar_angle", "freq_scale", "ipp", "kaz_poly"}
    numbers = {f"{v}_{a}" for v in ("pos", "vel", "scp", "urow", "ucol", "ipn", "fpn") for a in "xyz"} | set("polar_ref_time scp_time duration tstart_proc tend_proc row_kctr col_kctr row_ss col_ss row_bw col_bw krg1 krg2 kaz1 kaz2 centre_frequency slant_range dop_cone".split())
    types = names | dict.fromkeys(tables, "array<array<double>>") | dict.fromkeys(lists, "array<double>") | dict.fromkeys(numbers, "double")
    df = spark.createDataFrame([tuple(known.get(n) for n in types)], ", ".join(f"{n} {t}" for n, t in types.items()))
    return {r.rule: r.passed for r in run(df).collect()}


def test_nulls(spark):
    assert _of(spark, polar_rules.polar_rules, {"algorithm": "PFA"}) == {"pfa_type": False, "pfa_ref_time": False}
    assert _of(spark, polar_rules.polar_rules, {"algorithm": "INCA"}) == {}
    assert _of(spark, polar_rules.polar_rules, {}) == {}
    assert _of(spark, polar_rules.compression_rules, {"algorithm": "RGAZCOMP"}) == {"rgazcomp_col_zero": False}


def test_polynomials_of_unlike_orders(spark):
    deskew = {"algorithm": "PFA", "deskewed": True, "time_coa": [[1.0]], "row_deltak": [[1.0]]}
    assert _of(spark, polar_rules.polar_rules, deskew | {"deskew_phase": [[1.0, 0.0], [0.0]]})["pfa_deskew_phase"]
    assert not _of(spark, polar_rules.polar_rules, deskew | {"deskew_phase": [[1.0], [0.0, 0.5]]})["pfa_deskew_phase"]
    uneven = _of(spark, polar_rules.compression_rules, {"algorithm": "RGAZCOMP", "row_deltak": [[1.0, 2.0]], "col_deltak": [[0.5]], "col_kctr": -0.5})
    assert uneven == {"rgazcomp_row_constant": False, "rgazcomp_col_constant": True, "rgazcomp_col_kctr": True}
