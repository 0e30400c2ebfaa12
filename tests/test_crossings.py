import random
from itertools import combinations

from slantframe.operators.crossings import crossings

SCHEMA = "ring int, vtx int, x0 double, y0 double, x1 double, y1 double"


def sign(x):
    return (x > 0) - (x < 0)


def cross(a, b):
    side = lambda p, q, r: sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    p, q, r, s = a[:2], a[2:], b[:2], b[2:]
    u, t = side(p, q, r) * side(p, q, s), side(r, s, p) * side(r, s, q)
    return (u < 0 and t <= 0) or (u <= 0 and t < 0)


def brute(rows):
    return sum(cross(a[2:], b[2:]) for a, b in combinations(rows, 2) if a[0] == b[0])


def grid(rng, n, rings, span, reach):
    """Sides with ends on a coarse grid, so that they touch, overlap and repeat."""
    out = []
    while len(out) < n:
        x, y = rng.randrange(span), rng.randrange(span)
        u, w = x + rng.randint(-reach, reach), y + rng.randint(-reach, reach)
        if (x, y) != (u, w):
            out.append((rng.randrange(rings), len(out), x / 4, y / 4, u / 4, w / 4))
    return out


def test_against_all_pairs(spark):
    rng = random.Random(11)
    rows = grid(rng, 260, 3, 60, 20) + [(0, 1000 + k, -30.0, 3.0 + k / 8, 50.0, 9.0) for k in range(3)]
    rows += [(1, 2000 + k, 1.0, 1.0, 5.0, 7.0) for k in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    for cell, crowd, levels in ((None, 256, 12), (3.0, 4, 3)):
        found = crossings(df, cell=cell, crowd=crowd, levels=levels).collect()
        assert len({(r.ring, r.a, r.b) for r in found}) == len(found)
        assert sum(r.pairs for r in found) == brute(rows)


def test_odd_sides(spark):
    """Nulls and infinite ends don't count; an empty table has no crossings."""
    rows = [(0, 0, 0.0, 0.0, 2.0, 2.0), (0, 1, 0.0, 2.0, 2.0, 0.0), (0, 2, None, 0.0, 1.0, 1.0), (0, 3, float("inf"), 0.0, 1.0, 1.0), (0, 4, float("nan"), 0.0, 1.0, 1.0)]
    found = crossings(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.a, r.b, r.pairs) for r in found] == [(0, 1, 1)]
    assert crossings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pairs_are_spread_over_tasks(spark):
    """Cells are dealt by number, so that Spark doesn't gather few sides with many pairs in one task."""
    plan = crossings(spark.createDataFrame(grid(random.Random(5), 40, 2, 20, 5), SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [ring#" in plan
