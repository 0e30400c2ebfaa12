"""Sensor adjustment from tie points, and places of features that several images show.

Both are rounds of least squares in which a round's work is one pass over the
points: rows of the linearised problem become triangles in the tasks (fits), or
sums, and what comes back is a row an image or a feature.  Rounds are cut by
tables in the shared folder; a round ends the loop when nothing moves more than
the tolerance, or after the last one allowed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantframe.functions.projection import ADJUSTMENTS, METADATA, _axes, _mapped, packed
from slantframe.functions.scenes import Scene, dot
from slantframe.operators.checkpoints import partitions, saved
from slantframe.operators.fits import _solved, _triangles

#: Unknowns of an image: metres along its row and column axes or along the earth's axes, metres a second, metres.
UNKNOWNS = ("row", "col", "arp_x", "arp_y", "arp_z", "varp_x", "varp_y", "varp_z", "bias")
#: What counts as one step of an unknown.
STEPS = {name: 0.01 if name.startswith("varp") else 1.0 for name in UNKNOWNS}


def _direction(image: Scene, name: str) -> np.ndarray:
    """(7, 1): an unknown as a change of place, velocity and range."""
    out = np.zeros((7, 1))
    if name in ("row", "col"):
        out[:3] = image.urow if name == "row" else image.ucol
    else:
        out[{"arp": 0, "varp": 3}[name[:-2]] + "xyz".index(name[-1]) if name != "bias" else 6] = 1.0
    return out


def _off(r, rdot, arp, varp, place, change: np.ndarray) -> np.ndarray:
    """(2, n): range and range rate that places miss, in metres, with a change of the sensor (7, 1)."""
    back = arp + change[:3] - place
    length = np.sqrt(dot(back, back))
    return np.stack([length - r - change[6], (dot(varp + change[3:6], back) / length - rdot) * length / np.sqrt(dot(varp, varp))])


def _linear(image: Scene, row: np.ndarray, col: np.ndarray, place: np.ndarray, unknowns: Sequence[str]) -> list[np.ndarray]:
    """Pixels that places miss their observations by, and how they change with a step of each unknown: rows first, then columns."""
    x, y, _ = image.to_pixel(place)
    _, r, rdot, arp, varp = image.coa(x, y)
    fx = image.missing(x + 0.5, y, place) - image.missing(x - 0.5, y, place)
    fy = image.missing(x, y + 0.5, place) - image.missing(x, y - 0.5, place)
    det = fx[0] * fy[1] - fx[1] * fy[0]
    out = [[x - row], [y - col]]
    for name in unknowns:
        change = _direction(image, name) * STEPS[name]
        f = (_off(r, rdot, arp, varp, place, change) - _off(r, rdot, arp, varp, place, -change)) / 2
        out[0].append((f[1] * fy[0] - f[0] * fy[1]) / det)
        out[1].append((f[0] * fx[1] - f[1] * fx[0]) / det)
    return [*out[0], *out[1]]


def adjust_sensors(points: DataFrame, images: DataFrame, key: str = "image", unknowns: Sequence[str] = ("row", "col", "varp_x", "varp_y", "varp_z", "bias"), rounds: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """(key, delta_arp_x.., delta_varp_x.., range_bias, n, residue, condition) of every image: the adjustment with which tie points project best onto their pixels.

    points (key, place_x, place_y, place_z, row, col) are known places and
    where they were seen; images have the metadata of functions.projection,
    one row each, and their own adjustments are left out.  residue is the mean
    of the squared pixels that points still miss, n how many points took part:
    those with a null, or that can't be projected, don't.  Unknowns that the
    points don't tell apart share the shortest solution (condition is then
    infinite or large); an image without points stays as it is.  The loop ends
    when no step is longer than the tolerance (metres, or hundredths of a
    metre a second).
    """
    if not unknowns or set(unknowns) - set(UNKNOWNS):
        raise ValueError(f"unknowns must be some of {UNKNOWNS}")
    m, kind = len(unknowns), images.schema[key].dataType.simpleString()
    meta = images.select(key, *(c for c in METADATA if c in images.columns and c not in (*ADJUSTMENTS, "delta_frame")))
    tied = points.select(F.col(key).alias("tie_"), *(F.col(c).cast("double").alias(c + "_") for c in ("row", "col", "place_x", "place_y", "place_z")))
    names = [f"{a}{i}_" for a in "rc" for i in range(m + 1)]

    def missed(params: DataFrame) -> DataFrame:
        met = tied.join(meta.join(params, key), F.col("tie_") == F.col(key)).drop("tie_")
        return _mapped(met, [f"{c}_" for c in ("row", "col", "place_x", "place_y", "place_z")], names, lambda image, row, col, x, y, z: _linear(image, row, col, np.stack([x, y, z]), unknowns)).select(key, *names).dropna(subset=names)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_solved(x, m + 1) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tolist() for s, _ in found], pa.list_(pa.float64())), pa.array([c for _, c in found], pa.float64())], [key, "step", "condition"])

    def along(part: str, axis: str | None = None) -> object:
        """A step's share of an adjustment."""
        out = F.lit(0.0)
        for i, name in enumerate(unknowns):
            share = F.col("step")[i] * STEPS[name]
            if name in ("row", "col") and part == "arp":
                out = out + share * F.col(f"u{name}_{axis}")
            elif name == (part if axis is None else f"{part}_{axis}"):
                out = out + share
        return out

    params = meta.select(key, *(F.lit(0.0).alias(c) for c in ADJUSTMENTS))
    for _ in range(rounds):
        both = missed(params).select(key, F.inline(F.array(*[F.struct(*[F.col(f"{a}{i}_").alias(f"x{i}") for i in [*range(1, m + 1), 0]]) for a in "rc"])))
        both = both.withColumn("x0", -F.col("x0"))
        solved = _triangles(both, key, [f"x{i}" for i in [*range(1, m + 1), 0]], lambda v: v, m + 1).mapInArrow(solve, f"`{key}` {kind}, step array<double>, condition double")
        met = meta.select(key, *_axes("urow", "ucol")).join(params.drop("condition", "moved"), key).join(solved, key, "left")
        shares = {**{f"delta_arp_{a}": along("arp", a) for a in "xyz"}, **{f"delta_varp_{a}": along("varp", a) for a in "xyz"}, "range_bias": along("bias")}
        moved = F.coalesce(F.array_max(F.transform("step", lambda x: F.abs(x))), F.lit(0.0))
        params = saved(met.select(key, *((F.col(c) + F.coalesce(x, F.lit(0.0))).alias(c) for c, x in shares.items()), "condition", moved.alias("moved")))
        if not (params.agg(F.max("moved")).first()[0] or 0.0) > tolerance:
            break
    left = missed(params.drop("condition", "moved")).groupBy(key).agg(F.count("*").alias("n"), F.avg(F.col("r0_") ** 2 + F.col("c0_") ** 2).alias("residue"))
    out = params.join(left, key, "left")
    return out.select(key, *ADJUSTMENTS, F.coalesce("n", F.lit(0)).alias("n"), "residue", "condition")


def locate_features(seen: DataFrame, feature: str = "feature", row: str = "row", col: str = "col", height: float = 0.0, rounds: int = 12, tolerance: float = 1e-4) -> DataFrame:
    """(feature, place_x, place_y, place_z, height, n, residue): where the images that show a feature agree best.

    seen has a row for each image that shows a feature: its pixel there and
    the image's metadata (with adjustments, if it has some).  Pixels meet the
    surface of a height above the ellipsoid; the height is the one at which
    their places are nearest to each other, the place their mean, residue the
    mean squared distance from it.  A feature is a few sums a round, so one
    that is seen very often is no harder.  Features seen less than twice, and
    pixels that don't meet the surface, are left out; where all images look
    alike the height stays as it was.
    """
    kind = seen.schema[feature].dataType.simpleString()
    base = seen.select(F.col(feature).alias("feature_"), F.col(row).cast("double").alias("row_"), F.col(col).cast("double").alias("col_"), packed(seen).alias("scene_")).where(F.col("feature_").isNotNull())
    # Metadata become text once, not once a round; rounds are much work for few bytes, so the rows are spread over tasks.
    base = saved(base.repartition(partitions(seen), "feature_"))
    outputs = [*(f"p{a}_" for a in "xyz"), *(f"d{a}_" for a in "xyz")]

    def work(image: Scene, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
        low, high = image.to_height(x, y, h - 0.5, 1e-7), image.to_height(x, y, h + 0.5, 1e-7)
        return [*((low + high) / 2), *(high - low)]

    state = base.groupBy("feature_").agg(F.lit(float(height)).alias("h_"), *(F.lit(0.0).alias(f"o{a}_") for a in "xyz"))
    p, d = ([F.col(f"p{a}_") - F.col(f"o{a}_") for a in "xyz"], [F.col(f"d{a}_") for a in "xyz"])
    product = lambda u, w: u[0] * w[0] + u[1] * w[1] + u[2] * w[2]
    for _ in range(rounds):
        met = base.join(state.select("feature_", "h_", *(f"o{a}_" for a in "xyz")), "feature_")
        put = _mapped(met, ["row_", "col_", "h_"], outputs, work, F.col("scene_")).where("px_ is not null")
        sums = put.groupBy("feature_").agg(
            F.count("*").alias("n_"), F.max("h_").alias("h_"), *(F.max(f"o{a}_").alias(f"o{a}_") for a in "xyz"), *(F.avg(x).alias(f"m{a}_") for a, x in zip("xyz", p)), *(F.avg(x).alias(f"e{a}_") for a, x in zip("xyz", d)),
            F.avg(product(p, p)).alias("pp_"), F.avg(product(p, d)).alias("pd_"), F.avg(product(d, d)).alias("dd_"),
        )
        m, e = [F.col(f"m{a}_") for a in "xyz"], [F.col(f"e{a}_") for a in "xyz"]
        spread = F.col("dd_") - product(e, e)
        step = F.when(spread > 1e-10, -(F.col("pd_") - product(m, e)) / spread).otherwise(0.0)
        residue = F.greatest(F.col("pp_") - product(m, m), F.lit(0.0))
        state = saved(sums.where("n_ >= 2").select("feature_", (F.col("h_") + step).alias("h_"), *((F.col(f"o{a}_") + F.col(f"m{a}_") + step * F.col(f"e{a}_")).alias(f"o{a}_") for a in "xyz"), F.col("n_").alias("n"), residue.alias("residue"), F.abs(step).alias("moved")))
        if not (state.agg(F.max("moved")).first()[0] or 0.0) > tolerance:
            break
    return state.select(F.col("feature_").cast(kind).alias(feature), *(F.col(f"o{a}_").alias(f"place_{a}") for a in "xyz"), F.col("h_").alias("height"), "n", "residue")
