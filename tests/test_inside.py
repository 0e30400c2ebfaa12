"""Points in rings against brute force, with points on sides, vertices and borders of cells."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from slantframe.operators.inside import _blocks, points_in_polygon, points_in_rings
from slantframe.operators.planar import ring_distances


def brute(p, ring):
    x, y = p
    odd = False
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        cross = (x1 - x0) * (y - y0) - (x - x0) * (y1 - y0)
        if cross == 0 and min(x0, x1) <= x <= max(x0, x1) and min(y0, y1) <= y <= max(y0, y1):
            return True
        if (y0 <= y) != (y1 <= y) and (cross > 0) == (y1 > y0):
            odd = not odd
    return odd


def frames(spark, points, rings):
    p = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)], "pt_id long, x double, y double")
    r = spark.createDataFrame([(k, i, float(x), float(y)) for k, ring in enumerate(rings) for i, (x, y) in enumerate(ring)], "ring int, vtx int, x double, y double")
    return p, r


def check(spark, points, rings, cell):
    got = {(r.pt_id, r.ring) for r in points_in_rings(*frames(spark, points, rings), cell).collect()}
    assert got == {(i, k) for i, p in enumerate(points) for k, ring in enumerate(rings) if brute(p, ring)}


@pytest.mark.parametrize("cell", [0.3, 1.0, 8.0, 1000.0])
def test_grids_and_random_rings(spark, cell):
    rng = np.random.default_rng(int(cell * 10))
    rings = [[tuple(v) for v in rng.integers(-12, 13, (n, 2)).tolist()] for n in (3, 4, 7, 30)]
    rings += [[(-8, -8), (8, -8), (8, 8), (-8, 8)], [(0, 0), (5, 0), (5, 0), (5, 5), (2.5, 1), (0, 5)]]
    points = [(x / 2, y / 2) for x in range(-26, 27) for y in range(-26, 27)] + [tuple(v) for v in rng.uniform(-13, 13, (300, 2)).tolist()]
    check(spark, points, rings, cell)


def test_wide_ring_in_small_cells(spark):
    ring = [(-50_000.0, -1.0), (70_000.0, -1.2), (70_000.0, 1.3), (-50_000.0, 1.1)]
    points = [(x * 997.3, y) for x in range(-60, 80) for y in (-1.5, 0.0, 0.25, 1.2)]
    check(spark, points, [ring], 0.5)


def test_blocks_cover_once(spark):
    df = spark.createDataFrame([(0, 0), (-37, 5000), (16, 31), (15, 16), (-256, 255), (7, 40_000_000)], "a long, b long").select("a", "b", _blocks(F.col("a"), F.col("b")).alias("s"))
    for row in df.collect():
        spans = sorted((s.block * 16**s.level, (s.block + 1) * 16**s.level - 1) for s in row.s)
        assert spans[0][0] == row.a and spans[-1][1] == row.b and all(p[1] + 1 == q[0] for p, q in zip(spans, spans[1:]))


def test_holes_nulls_and_nothing(spark):
    p, r = frames(spark, [(1, 1), (5, 5), (9.5, 0.5)], [[(0, 0), (10, 0), (10, 10), (0, 10)]])
    _, h = frames(spark, [(0, 0)], [[(4, 4), (6, 4), (6, 6), (4, 6)]])
    assert {x.pt_id for x in points_in_polygon(p, r, h.withColumn("hole", F.lit(1)), 2.0).collect()} == {0, 2}
    odd = p.unionAll(spark.createDataFrame([(7, None, 1.0), (8, float("nan"), 1.0), (9, float("inf"), 1.0)], p.schema))
    assert {x.pt_id for x in points_in_rings(odd, r, 2.0).collect()} == {0, 1, 2}
    assert points_in_rings(p.limit(0), r, 2.0).collect() == [] and points_in_rings(p, r.limit(0), 2.0).collect() == []


def test_equal_points_and_sides_are_one_class(spark):
    """Rings drawn twice and three times, points that repeat; only different points meet sides."""
    ring = [(0, 0), (6, 0), (6, 5), (2, 3), (0, 5)]
    points = [(x / 2, y / 2) for x in range(-2, 15) for y in range(-2, 13)] * 2
    check(spark, points, [ring, ring * 2, ring * 3, [(0, 0), (6, 5), (0, 0), (6, 5)]], 2.0)
    plan = points_in_rings(*frames(spark, points, [ring]), 2.0)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[x#\d+, y#\d+\]", plan)


def test_distances_from_rings(spark):
    """Points that repeat, sides that repeat, a ring without sides and nulls against all pairs; only different points meet sides."""
    rng = np.random.default_rng(3)
    rings = [[tuple(v) for v in rng.integers(0, 9, (n, 2)).tolist()] for n in (5, 12)] + [[(0, 0), (4, 0)] * 3, [(1, 1)]]
    points = [tuple(v) for v in (rng.integers(-8, 30, (60, 2)) / 2).tolist()] * 2
    p, r = frames(spark, points, rings)
    p = p.select((F.col("pt_id") % 5).cast("int").alias("ring"), "pt_id", "x", "y").unionAll(spark.createDataFrame([(0, 900, None, 1.0), (None, 901, 1.0, 1.0)], "ring int, pt_id long, x double, y double"))

    def nearest(k, x, y):
        d = [np.inf]
        for (ax, ay), (bx, by) in zip(rings[k], rings[k][1:] + rings[k][:1]):
            if (ax, ay) != (bx, by):
                t = min(max(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2), 0), 1)
                d.append(np.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
        return min(d)

    out = ring_distances(p, r, shares=3)
    got = {row.pt_id: row for row in out.collect()}
    assert len(got) == len(points) + 2 and got[900].distance is None and got[901].distance is None and got[901].ring is None
    for i, (x, y) in enumerate(points):
        want = nearest(i % 5, x, y) if i % 5 < 3 else None
        assert got[i].ring == i % 5 and (got[i].distance is None if want is None else abs(got[i].distance - want) < 1e-12)
    assert re.search(r"Aggregate \[ring#\d+, x#\d+, y#\d+\]", out._jdf.queryExecution().optimizedPlan().toString())
