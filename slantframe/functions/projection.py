"""Image grids and the ground: pixels to range and range rate at the centre of aperture, and places to pixels.

An image's metadata are columns of its row (one row an image, joined to the
pixels or places), so that images of different kinds lie in one table:

kind            PFA, RGAZCOMP, INCA or PLANE
scp, urow, ucol, normal   places and unit vectors: <name>_x, <name>_y, <name>_z
scp_row, scp_col, first_row, first_col, row_ss, col_ss   pixel of the scene centre, chip's origin, spacings
time_coa        rows of coefficients over row and column metres
arp_px, arp_py, arp_pz    antenna place as polynomials of time
polar_angle, freq_scale   PFA;  az_sf: RGAZCOMP;  r_ca, time_ca, drate_sf: INCA
delta_arp, delta_varp, range_bias   adjustments, which may be missing, in the axes
                that delta_frame names (ECF, RIC_ECF or RIC_ECI)

Iterations end when what is missing is below a tolerance, which rows reach at
different times, so they run over Arrow batches, an image's rows of a batch at
once; nothing is shuffled.  A row that doesn't settle, or lacks a value, gives
nulls.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slantframe.functions.scenes import Scene

#: Columns of the metadata that the functions read.
VECTORS = ("scp", "urow", "ucol", "normal")
ADJUSTMENTS = (*(f"{v}_{a}" for v in ("delta_arp", "delta_varp") for a in "xyz"), "range_bias")
METADATA = ("kind", *ADJUSTMENTS, "delta_frame", *(f"{v}_{a}" for v in VECTORS for a in "xyz"), "scp_row", "scp_col", "first_row", "first_col", "row_ss", "col_ss", "time_coa", "arp_px", "arp_py", "arp_pz", "polar_angle", "freq_scale", "az_sf", "r_ca", "time_ca", "drate_sf")


def packed(df: DataFrame) -> Column:
    """The metadata of a row as text, equal for the rows of an image."""
    return F.to_json(F.struct(*[F.col(c) for c in METADATA if c in df.columns]))


@lru_cache(maxsize=256)
def scene(text: str) -> Scene:
    return Scene(json.loads(text))


def by_scene(texts: pa.Array, inputs: list[np.ndarray], outputs: int, work: Callable) -> list[np.ndarray]:
    """work(scene, *inputs) of the rows of each image, put back into the order of rows."""
    coded = texts.dictionary_encode()
    numbers = coded.indices.to_numpy()
    out = [np.full(len(numbers), np.nan) for _ in range(outputs)]
    for k, text in enumerate(coded.dictionary.to_pylist()):
        at = np.flatnonzero(numbers == k)
        for whole, part in zip(out, work(scene(text), *(x[at] for x in inputs))):
            whole[at] = part
    return out


def numbers(column: pa.Array) -> np.ndarray:
    return np.array(column.cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=float)


def _mapped(df: DataFrame, inputs: list[str], outputs: list[str], work: Callable, scene: Column | None = None) -> DataFrame:
    """df with outputs: work(scene, *inputs) gives them, a batch's rows of an image at once.

    Workers get the inputs and the metadata as text (scene, if a column has it
    already) and no other column of df.
    """

    def run(texts: pa.Array, *given: pa.Array) -> pa.Array:
        with np.errstate(all="ignore"):
            found = by_scene(texts, [numbers(x) for x in given], len(outputs), work)
        return pa.StructArray.from_arrays([pa.array(x, mask=~np.isfinite(x)) for x in found], outputs)

    # Spark would run a deterministic function twice, for a filter on its outputs and for the outputs.
    made = F.arrow_udf(run, f"struct<{','.join(f'`{o}`:double' for o in outputs)}>").asNondeterministic()
    out = df.withColumn("mapped_", made(packed(df) if scene is None else scene, *(F.col(c).cast("double") for c in inputs)))
    return out.select(*df.columns, *(F.col("mapped_")[o].alias(o) for o in outputs))


def _axes(*names: str) -> list[str]:
    return [f"{n}_{a}" for n in names for a in "xyz"]


def coa_projection(df: DataFrame, row: str = "row", col: str = "col", range_bias: float = 0.0) -> DataFrame:
    """Adds time_coa_at, r, rdot, arp_x.. and varp_x.. of each pixel; df has the image's metadata.

    A kind that isn't known gives null range and rate.
    """

    def work(image: Scene, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        t, r, rdot, arp, varp = image.coa(x, y)
        return [t, r + range_bias, rdot, *arp, *varp]

    return _mapped(df, [row, col], ["time_coa_at", "r", "rdot", *_axes("arp", "varp")], work)


def image_to_plane(df: DataFrame, out: str = "at", row: str = "row", col: str = "col") -> DataFrame:
    """Adds out_x..: where each pixel's range and range rate meet the plane through the scene centre with the image's normal."""
    return _mapped(df, [row, col], _axes(out), lambda image, x, y: image.to_plane(x, y))


def image_to_hae(df: DataFrame, height: str, out: str = "at", row: str = "row", col: str = "col", tolerance: float = 1e-4) -> DataFrame:
    """Adds out_x..: where each pixel's range and range rate meet the surface of a height (metres, a column) above the ellipsoid.

    Rounds end when a place moves by less than the tolerance (metres).
    """
    return _mapped(df, [row, col, height], _axes(out), lambda image, x, y, h: image.to_height(x, y, h, tolerance))


def ground_to_image(df: DataFrame, place: str = "place", tolerance: float = 1e-6) -> DataFrame:
    """Adds row, col and miss (metres): the pixel that has the range and range rate of a place.

    Rounds end when a pixel moves by less than the tolerance (pixels).
    """
    return _mapped(df, _axes(place), ["row", "col", "miss"], lambda image, x, y, z: image.to_pixel(np.stack([x, y, z]), tolerance))
