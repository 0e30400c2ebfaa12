import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slantframe.sources import nitf_image, records, sicd_image
from slantframe.sources.nitf_write import file_head, write_image
from slantframe.sources.records import LAYOUTS, Field, Loop, RecordError, When, joined, read_record, write_record
from tests.nitf_files import image, nitf_file


def made_up(items, rng, scopes):
    """Values of a layout, counts and conditions included."""
    own = scopes[-1]
    for x in items:
        if isinstance(x, Field):
            if x.name == "EXISTENCE_MASK":
                own[x.name] = rng.randbytes(4)
            elif x.kind == "d":
                own[x.name] = rng.randrange(0, 4)
            else:
                own[x.name] = rng.randbytes(x.size) if x.kind == "b" else rng.randrange(-9, 9) / 8 if x.kind == "f" else rng.choice("01IRA") + "".join(rng.choices("ab 9.", k=x.size - 1)).rstrip()
        elif isinstance(x, When):
            if x.holds(records._find(scopes, x.field)):
                made_up(x.items, rng, scopes)
        else:
            n = x.count if isinstance(x.count, int) else records._find(scopes, x.count)
            own[x.name] = []
            for _ in range(n):
                own[x.name].append({})
                made_up(x.items, rng, [*scopes, own[x.name][-1]])


@pytest.mark.parametrize("tag", sorted(LAYOUTS))
def test_round_trip(tag):
    rng, seen = random.Random(tag), set()
    for _ in range(25):
        values = {}
        made_up(LAYOUTS[tag], rng, [values])
        data = write_record(LAYOUTS[tag], values)
        seen.add(len(data))
        assert read_record(LAYOUTS[tag], data) == values and write_record(LAYOUTS[tag], read_record(LAYOUTS[tag], data)) == data
        for broken in (data[:-1], data + b" "):
            with pytest.raises(RecordError):
                read_record(LAYOUTS[tag], broken)
    assert len(seen) > 1 or not any(isinstance(x, (Loop, When)) and not (isinstance(x, Loop) and isinstance(x.count, int)) for x in LAYOUTS[tag])


def test_published_sizes():
    sizes = {"AIMIDB": 89, "BLOCKA": 123, "ICHIPB": 224, "PIAIMC": 362, "RPC00B": 1041, "RSMIDA": 1628, "STDIDC": 89, "USE00A": 107}
    for tag, size in sizes.items():
        assert sum(x.size if isinstance(x, Field) else x.count * sum(y.size for y in x.items) for x in LAYOUTS[tag]) == size, tag


def test_records_of_files(spark, tmp_path):
    grids = {"NUM_GRDS": 2, "GRDS": [{"ZVL": str(i), "BAD": "b", "LOD": "", "LAD": "", "LSO": "", "PSO": ""} for i in range(2)]}
    area = joined([("GRDPSB", write_record(LAYOUTS["GRDPSB"], grids)), ("NOSUCH", b"\x00\xff"), ("BLOCKA", b"short")])
    head, body = image(np.ones((2, 2, 1), np.float32))
    assert head.endswith(b"0000000000")
    head = head[:-10] + f"{len(area) + 3:05d}000".encode() + area + b"00000"
    (tmp_path / "x.nitf").write_bytes(nitf_file([(head, body), image(np.ones((2, 2, 1), np.float32), level=2)]))
    areas = nitf_image.read_areas(spark, str(tmp_path))
    got = {r.tag: r for r in records.read_records(areas, ["path", "header", "index"]).collect()}
    assert {k: r.reason for k, r in got.items()} == {"GRDPSB": None, "NOSUCH": None, "BLOCKA": "N_GRAY is cut off"}
    assert got["NOSUCH"].data == b"\x00\xff" and got["NOSUCH"].fields is None and got["BLOCKA"].data == b"short" and got["GRDPSB"].header == "image"
    assert [(f.name, f["at"], f.value) for f in got["GRDPSB"].fields][:3] == [("NUM_GRDS", [], "2"), ("ZVL", [0], "0"), ("BAD", [0], "b")]
    assert nitf_image.read_image(spark, str(tmp_path)).where("r is not null").count() == 4
    odd = spark.createDataFrame([(1, b"GRDPSB00099x"), (2, None), (3, b""), (4, b"AB")], "id int, content binary")
    assert {(r.id, r.tag, r.reason) for r in records.read_records(odd, ["id"]).collect()} == {(1, "GRDPSB", "the record is cut off"), (4, "AB", "the record is cut off")}
    assert records.read_records(odd.limit(0), ["id"]).count() == 0


def _lines(spark, a, parts=7):
    rows = [(k, r, [a[k, r, :, b].tolist() for b in range(a.shape[3])]) for k in range(a.shape[0]) for r in range(a.shape[1])]
    return spark.createDataFrame(rows, "image int, r int, bands array<array<float>>").repartition(parts)


def test_many_tasks_write_one_file(spark, tmp_path):
    a = np.random.default_rng(1).standard_normal((3, 40, 9, 2)).astype(np.float32)
    path = f"{tmp_path}/out.nitf"
    write_image(_lines(spark, a), path, 3, 40, 9)
    got = np.zeros_like(a)
    for r in nitf_image.read_image(spark, path).collect():
        got[r.image, r.r] = np.array(r.bands).T
    assert np.array_equal(got, a) and os.listdir(tmp_path) == ["out.nitf"]
    with pytest.raises(Exception, match="there already"):
        write_image(_lines(spark, a), path, 3, 40, 9)
    write_image(_lines(spark, a[:1]), path, 1, 40, 9, overwrite=True)
    assert nitf_image.read_image(spark, path).count() == 40


def test_nothing_is_left_of_a_failed_write(spark, tmp_path):
    a = np.ones((1, 10, 4, 2), np.float32)
    lines = _lines(spark, a)
    for bad in (lines.where("r <> 5"), lines.unionAll(lines.where("r = 5")), lines.withColumn("r", F.col("r") + 1), lines.withColumn("bands", F.slice("bands", 1, 1)), lines.withColumn("r", F.when(F.col("r") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("r")))):
        with pytest.raises(Exception):
            write_image(bad, f"file://{tmp_path}/x.nitf", 1, 10, 4)
        assert os.listdir(tmp_path) == []


def test_complex_images_in_one_call(spark, tmp_path):
    amp, phase = np.random.default_rng(2).integers(0, 256, (2, 6, 5))
    xml = "<SICD xmlns='urn:SICD:1.3.0'><ImageData><PixelType>{}</PixelType>{}</ImageData></SICD>"
    table = "<AmpTable size='256'>" + "".join(f"<Amplitude index='{i}'>{i * i / 7}</Amplitude>" for i in reversed(range(256))) + "</AmpTable>"
    both = np.stack([amp, phase], axis=2)
    signed = both.astype(np.int16) - 100
    byte, short = ("INT", 8, ">u1"), ("SI", 16, ">i2")
    files = {"a": (image(both, "B", (4, 4), pixel=byte), xml.format("AMP8I_PHS8I", table)), "b": (image(both, "P", pixel=byte), xml.format("AMP8I_PHS8I", "")), "c": (image(signed, "S", pixel=short), xml.format("RE16I_IM16I", "")), "d": (image(both, "P", pixel=byte), "<other/>")}
    for name, (part, text) in files.items():
        (tmp_path / f"{name}.nitf").write_bytes(nitf_file([part], [text.encode()]))
    polar = lambda size: size * np.exp(2j * np.pi * phase / 256)
    want = {"a": polar(amp * amp / 7), "b": polar(amp), "c": signed[:, :, 0] + 1j * signed[:, :, 1]}
    got = sicd_image.read_sicd(spark, str(tmp_path), cols=(1, 4), rows=(2, 6)).collect()
    assert len(got) == 3 * 4 and {r.c0 for r in got} == {1}
    for r in got:
        assert np.allclose(np.array(r.re) + 1j * np.array(r.im), want[r.path.rsplit("/", 1)[1][0]][r.r, 1:4], rtol=1e-5, atol=1e-2)
    (tmp_path / "e.nitf").write_bytes(nitf_file([image(both, pixel=byte, compression="C3")], [xml.format("AMP8I_PHS8I", "").encode()]))
    with pytest.raises(Exception, match="compression C3"):
        sicd_image.read_sicd(spark, str(tmp_path)).collect()


def test_heads_are_where_they_say():
    heads, places, size = file_head(2, 10, 5, 2, b"<x/>")
    assert places[0] == len(heads[0][1]) + len(heads[1][1]) and places[1] == places[0] + 400 + len(heads[2][1]) and size == places[1] + 400 + len(heads[3][1])


def test_a_batch_is_taken_apart_in_parts():
    """What a worker holds as Python objects doesn't grow with the batch; all records come, in order."""
    import pyarrow as pa

    area = records.joined([("MYURL", b"abc"), ("OTHER", b"")])
    batch = pa.RecordBatch.from_arrays([pa.array(range(1300), pa.int64()), pa.array([area if i % 7 else None for i in range(1300)])], ["id", "content"])
    parts = list(records._taken_apart(batch, ["id"], {}))
    assert len(parts) == 3 and max(p.num_rows for p in parts) <= 2 * records.AREAS
    got = [(r["id"], r["number"], r["tag"]) for p in parts for r in p.to_pylist()]
    assert got == [(i, k, t) for i in range(1300) if i % 7 for k, t in enumerate(("MYURL", "OTHER"))]
