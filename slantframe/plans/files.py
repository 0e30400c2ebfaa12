"""Queries of whole images: files that Spark writes from the tables and reads again, grids and spectra; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slantframe.operators.checkpoints import ensure_checkpoint_dir
from slantframe.plans import views as v
from slantframe.plans.registry import query


def _shared(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}-{name}"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Whole lines (image, r, bands) of four images of 256 x 8 pixels; pixels that aren't there are 0."""
    p = v.px(spark, sf).groupBy("image", "r").agg(F.map_from_entries(F.collect_list(F.struct(F.col("c").cast("int"), F.struct(F.col("re").cast("float").alias("re"), F.col("im").cast("float").alias("im"))))).alias("m"))
    grid = spark.range(4 * 256).select((F.col("id") % 4).cast("int").alias("image"), (F.col("id") / 4).cast("int").alias("r"))
    band = lambda n: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.coalesce(F.try_element_at("m", c)[n], F.lit(0.0).cast("float")))
    return grid.join(p, ["image", "r"], "left").select("image", "r", F.array(band("re"), band("im")).alias("bands"))


@query(
    "q_nitf_chip",
    f"""with {v.PX}, g as (select a::int as image, b::int as r, c::int as c from range(0, 4) x(a), range(0, 256) y(b), range(0, 8) z(c))
 select image, r, c, round(coalesce(re::float::double, 0), 4) as re, round(coalesce(im::float::double, 0), 4) as im from g left join px using (image, r, c) where image <> 2 and r between 32 and 199 and c between 2 and 6""",
)
def q_nitf_chip(spark, sf):
    """A file of four images, written by many tasks; of three of them the blocks of a window are read again."""
    from slantframe.sources.nitf_image import read_image
    from slantframe.sources.nitf_write import write_image

    path = _shared(spark, "images.nitf")
    write_image(_lines(spark, sf), path, 4, 256, 8)
    chip = read_image(spark, path, cols=(2, 7)).where(F.col("image").isin(0, 1, 3) & (F.col("r") >= 32) & (F.col("r") < 200))
    out = chip.select("image", "r", "c0", F.posexplode(F.arrays_zip(F.col("bands")[0].alias("re"), F.col("bands")[1].alias("im"))).alias("k", "z"))
    return out.select("image", "r", (F.col("c0") + F.col("k")).alias("c"), F.round(F.col("z.re").cast("double"), 4).alias("re"), F.round(F.col("z.im").cast("double"), 4).alias("im"))


#: A page's records: a corner table, as many grids as its id says, and one of an unknown kind that holds its url.
_AREAS = """
with p as (select page_id as id, (page_id % 4)::int as n, coalesce(url, '') as url, lpad((page_id % 100000)::varchar, 5, '0') as five from pages),
f as (select id, 0 as number, 'BLOCKA' as tag, unnest([{'name': 'BLOCK_INSTANCE', 'value': '01'}, {'name': 'N_GRAY', 'value': five}, {'name': 'L_LINES', 'value': five}, {'name': 'LAYOVER_ANGLE', 'value': left(five, 3)}, {'name': 'SHADOW_ANGLE', 'value': ''}, {'name': 'RESERVED_001', 'value': ''},
   {'name': 'FRLC_LOC', 'value': five}, {'name': 'LRLC_LOC', 'value': ''}, {'name': 'LRFC_LOC', 'value': ''}, {'name': 'FRFC_LOC', 'value': ''}, {'name': 'RESERVED_002', 'value': '010.0'}]) as x, '' as place from p),
g as (select id, 1 as number, 'GRDPSB' as tag, i, five from p, lateral (select unnest(range(0, n)) as i))
select id, number, tag, x.name as name, place, x.value as value from f
union all select id, 1, 'GRDPSB', 'NUM_GRDS', '', n::varchar from p
union all select id, number, tag, unnest(['ZVL', 'BAD', 'LOD', 'LAD', 'LSO', 'PSO']), i::varchar, unnest([i::varchar, five, '', '', '', '1.5']) from g
union all select id, 2, 'MYURL', null, null, url from p
"""


@query("q_tagged_records", _AREAS)
def q_tagged_records(spark, sf):
    """Records of three kinds, one of them unknown, taken apart from each page's bytes."""
    from slantframe.sources.records import read_records

    five, n, url = F.lpad((F.col("page_id") % 100000).cast("string"), 5, "0"), F.col("page_id") % 4, F.coalesce("url", F.lit(""))
    pad = lambda x, size: F.rpad(x, size, " ")
    corners = F.concat(F.lit("01"), five, five, F.left(five, F.lit(3)), F.lit(" " * 19), pad(five, 21), F.lit(" " * 63), F.lit("010.0"))
    grid = lambda i: F.concat(pad(i.cast("string"), 10), pad(five, 10), F.lit(" " * 35), pad(F.lit("1.5"), 11))
    some = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    grids = F.concat(F.lpad(n.cast("string"), 2, "0"), F.array_join(F.transform(some, grid), ""))
    record = lambda tag, data: F.concat(F.lit(tag.ljust(6)), F.lpad(F.octet_length(data).cast("string"), 5, "0"), data)
    area = F.concat(record("BLOCKA", corners), record("GRDPSB", grids), record("MYURL", url)).cast("binary")
    found = read_records(v.table(spark, sf, "pages").select(F.col("page_id").alias("id"), area.alias("content")), ["id"])
    known = found.where("fields is not null").select("id", "number", "tag", F.inline("fields"))
    known = known.select("id", "number", "tag", "name", F.array_join(F.col("at").cast("array<string>"), ".").alias("place"), "value")
    text = F.lit(None).cast("string")
    return known.unionAll(found.where("fields is null and reason is null").select("id", "number", "tag", text, text, F.col("data").cast("string")))


@query(
    "q_ortho_tiles",
    f"""with {v.AMP}, g as (select a::int as image, b::int as r, c::int as c, 0.75::double * b + 1.5::double * c + 3.3::double as pr, 1.0007::double + 0.7::double * c + 0.013::double * b as pc from range(0, 4) x(a), range(0, 256) y(b), range(0, 8) z(c)),
 w as (select g.image, g.r, g.c, floor(pr)::int + i as sr, floor(pc)::int + j as sc, (case when i = 1 then pr - floor(pr) else 1 - (pr - floor(pr)) end) * (case when j = 1 then pc - floor(pc) else 1 - (pc - floor(pc)) end) as w from g, (values (0, 0), (0, 1), (1, 0), (1, 1)) k(i, j))
 select w.image, w.r, w.c, case when count(amplitude) = count(*) then round(sum(w * amplitude), 5) end as amplitude from w left join amp on amp.image = w.image and amp.r = sr and amp.c = sc group by 1, 2, 3""",
)
def q_ortho_tiles(spark, sf):
    """Four images on a sheared grid, in output tiles that fetch the source tiles they need."""
    from slantframe.operators.ortho import resample

    out = resample(v.amplitude(spark, sf), spark.range(4).select(F.col("id").cast("int").alias("image")), (256, 8), lambda _, r, c: (0.75 * r + 1.5 * c + 3.3, 1.0007 + 0.7 * c + 0.013 * r), tile=32)
    return out.withColumn("amplitude", F.round("amplitude", 5))


@query(
    "q_fft2",
    f"""with {v.PX}, g as (select a::int as image, b::int as r, c::int as c from range(0, 4) x(a), range(0, 256) y(b), range(0, 8) z(c)),
 z as (select image, r, c, coalesce(re::float::double, 0) as re, coalesce(im::float::double, 0) as im from g left join px using (image, r, c)),
 a as (select image, r, k, sum(re * cos(2 * pi() * c * k / 8) + im * sin(2 * pi() * c * k / 8)) as re, sum(im * cos(2 * pi() * c * k / 8) - re * sin(2 * pi() * c * k / 8)) as im from z, range(0, 8) q(k) group by 1, 2, 3),
 b as (select image, n, k, sum(re * cos(2 * pi() * r * n / 256) + im * sin(2 * pi() * r * n / 256)) as re, sum(im * cos(2 * pi() * r * n / 256) - re * sin(2 * pi() * r * n / 256)) as im from a, range(0, 256) q(n) group by 1, 2, 3)
 select image, ((n + 128) % 256)::int as r, ((k + 4) % 8)::int as c, round(re, 4) + 0 as re, round(im, 4) + 0 as im from b""",
)
def q_fft2(spark, sf):
    """Centred spectra of four images in two dimensions."""
    from slantframe.operators.spectra import fft2

    lines = _lines(spark, sf).select("image", "r", F.col("bands")[0].alias("re"), F.col("bands")[1].alias("im"))
    out = fft2(lines, block=3).select("image", "r", F.posexplode(F.arrays_zip("re", "im")).alias("c", "z"))
    return out.select("image", "r", "c", (F.round("z.re", 4) + 0).alias("re"), (F.round("z.im", 4) + 0).alias("im"))


@query("q_register_grid", "select a * 5 + b as point, (a * 16 + 12)::double as r, (b * 16 + 12)::double as c, 5e0 as dr, 2e0 as dc, 1e0 as peak from range(0, 5) x(a), range(0, 5) y(b), (select count(*) from lineitem) n")
def q_register_grid(spark, sf):
    """Shifts of a grid of points between prices laid out as an image and the same image moved by 5 rows and 2 columns."""
    from slantframe.operators.registration import register

    side = 96
    cell = v.table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % side).cast("int").alias("r"), (F.col("l_partkey") % side).cast("int").alias("c")).agg(F.sum("l_extendedprice").cast("double").alias("v"))
    grid = spark.range(side * side).select((F.col("id") / side).cast("int").alias("r"), (F.col("id") % side).cast("int").alias("c"))
    fixed = grid.join(cell, ["r", "c"], "left").select("r", "c", F.coalesce("v", F.lit(0.0)).alias("value"))
    moving = fixed.select(F.pmod(F.col("r") + 5, F.lit(side)).alias("r"), F.pmod(F.col("c") + 2, F.lit(side)).alias("c"), (F.col("value") * 2 + 1).alias("value"))
    out = register(fixed, moving, (side, side), spacing=16, half=8, reach=8)
    return out.select("point", "r", "c", (F.round("dr", 2) + 0).alias("dr"), (F.round("dc", 2) + 0).alias("dc"), F.round("peak", 3).alias("peak"))


@query(
    "q_pyramid",
    f"with {v.AMP}, k as (select unnest(range(0, 6))::int as level) select image, level, (r::bigint >> level) // 8 as tile_r, (c::bigint >> level) // 8 as tile_c, r::bigint >> level as r, c::bigint >> level as c, round(avg(amplitude), 6) as amplitude from amp, k group by 1, 2, 3, 4, 5, 6",
)
def q_pyramid(spark, sf):
    """Six levels of four images of 256 rows, in tiles of eight."""
    from slantframe.operators.pyramid import pyramid

    return pyramid(v.amplitude(spark, sf), 8).withColumn("amplitude", F.round("amplitude", 6))


_TILE = f"""with {v.DEM}, t as (select a::int as tile_lat, b::int as tile_lon from range(-1, 1) x(a), range(10, 13) y(b) where a + b <> 10),
 posts as (select tile_lat, tile_lon, iy as r, ix as c, (elev + tile_lon * 10 + tile_lat)::float::double as elev from dem, t)"""


def _tiles(spark, sf) -> str:
    """A folder of five tiles of 50 x 40 posts that Spark writes from elevation posts."""
    from slantframe.operators.dem_tiles import write_tiles

    folder = _shared(spark, "tiles")
    t = spark.range(-1, 1).select(F.col("id").cast("int").alias("tile_lat")).join(spark.range(10, 13).select(F.col("id").cast("int").alias("tile_lon"))).where("tile_lat + tile_lon <> 10")
    posts = v.dem(spark, sf).join(t).select("tile_lat", "tile_lon", F.col("iy").alias("r"), F.col("ix").alias("c"), (F.col("elev") + F.col("tile_lon") * 10 + F.col("tile_lat")).cast("float").alias("elev"))
    write_tiles(posts, folder, "{ns}{lat:02d}_{ew}{lon:03d}.tif", 50, 40).write.format("noop").mode("overwrite").save()
    return folder


@query(
    "q_tiff_window",
    _TILE + ", g as (select tile_lat, tile_lon, b::int as r, c::int as c from t, range(10, 20) y(b), range(5, 25) z(c)) select (case when tile_lat < 0 then 's' else 'n' end) || lpad(abs(tile_lat)::varchar, 2, '0') || '_e' || lpad(tile_lon::varchar, 3, '0') || '.tif' as file, r, c, round(elev, 3) as elev from g left join posts using (tile_lat, tile_lon, r, c)",
)
def q_tiff_window(spark, sf):
    """A window of each of five images: only the strips that it touches are read."""
    from slantframe.sources.tiff import read_tiff

    lines = read_tiff(spark, _tiles(spark, sf), cols=(5, 25)).where("r >= 10 and r < 20")
    out = lines.select(F.element_at(F.split("path", "/"), -1).alias("file"), "r", "c0", F.posexplode(F.col("bands")[0]).alias("k", "elev"))
    return out.select("file", "r", (F.col("c0") + F.col("k")).alias("c"), F.round(F.nanvl("elev", F.lit(None).cast("double")), 3).alias("elev"))


@query(
    "q_tile_elevations",
    _TILE
    + """, p as (select c_custkey as id, (c_custkey * 17 % 400) / 100e0 - 2 as lat, (c_custkey * 29 % 500) / 100e0 + 9 as lon from customer),
 a as (select *, floor(lat)::int as tile_lat, floor(lon)::int as tile_lon from p), g as (select *, (tile_lat + 1 - lat) * 49 as gr, (lon - tile_lon) * 39 as gc from a),
 b as (select *, least(floor(gr), 48)::int as r0, least(floor(gc), 38)::int as c0 from g),
 w as (select id, tile_lat, tile_lon, r0 + i as r, c0 + j as c, (case when i = 1 then gr - r0 else 1 - (gr - r0) end) * (case when j = 1 then gc - c0 else 1 - (gc - c0) end) as w from b, (values (0, 0), (0, 1), (1, 0), (1, 1)) k(i, j))
 select id, case when count(elev) = 4 then round(sum(w * elev), 4) else 0 end as elev from w left join posts using (tile_lat, tile_lon, r, c) group by id""",
)
def q_tile_elevations(spark, sf):
    """Elevations of points from tiles of one degree; 0 where there is no tile."""
    from slantframe.operators.dem_tiles import tile_elevations

    k = F.col("c_custkey")
    points = v.table(spark, sf, "customer").select(k.alias("id"), (k * 17 % 400 / F.lit(100.0) - 2).alias("lat"), (k * 29 % 500 / F.lit(100.0) + 9).alias("lon"))
    return tile_elevations(points, _tiles(spark, sf), "{ns}{lat:02d}_{ew}{lon:03d}.tif").select("id", F.round("elev", 4).alias("elev"))


@query(
    "q_received_signal",
    f"with {v.PVP}, s as (select channel, vector - 1 as vector, TxTime, FX1, k, ((TxTime // 1000000 + k * 7) % 100 - 50) * 0.5e0 as re, ((TxTime // 1000000 * 3 + k) % 100 - 50) * 0.5e0 as im from pvp, range(0, 4) q(k)) select channel, vector, TxTime, FX1, (k - 1)::int as k, round(re, 1) as re, round(im, 1) as im from s where k between 1 and 2 and vector between 5 and 3000 and channel <> 'view'",
)
def q_received_signal(spark, sf):
    """Vectors of all channels written into one file of received signals by many tasks; of some the parameters and two samples are read again."""
    from slantframe.sources.cphd_ranged import read_pvp, read_signal
    from slantframe.sources.phase_write import write_phase

    path = _shared(spark, "signals.crsd")
    second = F.floor(F.col("TxTime") / 1000000)
    part = lambda by, step: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: ((second * by + k * step) % 100 - 50) * F.lit(0.5))
    vectors = v.pvp(spark, sf).select("channel", (F.col("vector") - 1).alias("vector"), "TxTime", "FX1", F.lit(0.5).alias("AmpSF"), part(1, 7).alias("re"), part(3, 1).alias("im"))
    write_phase(vectors, path, {"TxTime": "I8", "FX1": "F8", "AmpSF": "F8"}, kind="CRSD")
    some = "vector between 5 and 3000 and channel in ('click', 'purchase', 'error', 'signup')"
    parameters, samples = read_pvp(spark, path, "TxTime", "FX1").where(some).drop("path"), read_signal(spark, path, (1, 3), scaled=True).where(some)
    own = samples.select("channel", "vector", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z"))
    return parameters.join(own, ["channel", "vector"]).select("channel", "vector", "TxTime", "FX1", "k", F.round(F.col("z.re").cast("double"), 1).alias("re"), F.round(F.col("z.im").cast("double"), 1).alias("im"))
