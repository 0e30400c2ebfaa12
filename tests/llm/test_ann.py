import numpy as np
from pyspark.sql import functions as F

from slantframe.llm.ann import nearest_neighbours


def brute(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0):
            good[i] = np.array(v, dtype=np.float32).astype(float)
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids])
    out = {}
    for i in ids[ids % 5 == 0]:
        s = np.array([np.dot(good[i], y) for y in x])
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_recall_scores_and_ties(spark):
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((1500, 16)) * rng.uniform(0.5, 2, (1500, 1))).astype(np.float32)
    x[700:1000] = x[700]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000, None), (5005, [0.0] * 16), (5010, [float("nan")] * 16), (5015, [1.0] * 15 + [None]), (5020, [1.0] * 3), (None, [1.0] * 16), (5025, [float("inf")] * 16), rows[3]]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, rank int").repartition(5)
    got = {}
    for r in nearest_neighbours(df, F.col("vec_id") % 5 == 0, 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(rows, 10)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        for _, i, s in found:
            assert abs(s - np.dot(x[q].astype(float), x[i].astype(float))) < 1e-9
        hits += len({f[1] for f in found} & {w[0] for w in want[q]})
    assert hits / (10 * len(want)) >= 0.9
    assert [f[1] for f in got[750]][:3] == [w[0] for w in want[750]][:3]


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (5, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, nearest_neighbours(df, F.col("vec_id") % 5 == 0, 20).collect()))
    assert got == [(0, 1, 5, 1.0), (0, 2, 1, 0.5), (5, 1, 0, 1.0), (5, 2, 1, 0.5)]
    assert nearest_neighbours(df.limit(0), F.lit(True)).count() == 0
