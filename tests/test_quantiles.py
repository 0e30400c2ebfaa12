import numpy as np
import pytest

from slantframe.operators import rules
from slantframe.operators.quantiles import quantiles

SHARES = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.99, "e": 1.0}


def test_equal_to_sorting(spark):
    rng = np.random.default_rng(9)
    groups = {"x": rng.standard_normal(501), "y": rng.integers(0, 4, 1000).astype(float), None: np.array([3.0]), "z": np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("x", None), ("x", float("nan")), ("y", float("inf")), ("none", None), ("none", float("-inf"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: [r[n] for n in SHARES] for r in quantiles(df, ["k"], "v", SHARES).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        assert np.allclose(got[k], np.quantile(x, list(SHARES.values())))
    (whole,) = quantiles(df, [], "v", SHARES).collect()
    assert np.allclose(list(whole), np.quantile(np.concatenate(list(groups.values())), list(SHARES.values())))
    assert quantiles(df.limit(0), ["k"], "v", SHARES).count() == 0


def test_limits_are_one_row(spark):
    pvp = spark.createDataFrame([("c", 1.0), ("c", 9.0)], "channel string, x double")
    limits = spark.createDataFrame([(0.0, 5.0)], "lo double, hi double")
    (r,) = rules.within(pvp, limits, "x", "lo", "hi").collect()
    assert (r.passed, r.detail) == (False, 1.0)
    for bad in (limits.unionAll(limits), limits.limit(0)):
        with pytest.raises(ValueError, match="rows of limits"):
            rules.within(pvp, bad, "x", "lo", "hi")
