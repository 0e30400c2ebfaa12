"""Readers against files of our own making."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slantframe.functions import projection
from slantframe.operators import phase_rules
from slantframe.sources import cphd, nitf, sicd


def _poly(values, two=False):
    if two:
        coefs = "".join(f'<Coef exponent1="{i}" exponent2="{j}">{x}</Coef>' for i, row in enumerate(values) for j, x in enumerate(row))
        return f"order1=\"{len(values) - 1}\" order2=\"{len(values[0]) - 1}\">{coefs}"
    return f'order1="{len(values) - 1}">' + "".join(f'<Coef exponent1="{i}">{x}</Coef>' for i, x in reversed(list(enumerate(values))))


XML = f"""<SICD xmlns="urn:SICD:1.3.0"><CollectionInfo><CollectorName>test</CollectorName></CollectionInfo>
<ImageData><NumRows>13</NumRows><NumCols>17</NumCols><FirstRow>0</FirstRow><FirstCol>0</FirstCol><SCPPixel><Row>6</Row><Col>8</Col></SCPPixel></ImageData>
<GeoData><SCP><ECF><X>6378137</X><Y>0</Y><Z>0</Z></ECF></SCP></GeoData>
<Grid><Type>PLANE</Type><TimeCOAPoly {_poly([[1.0, 1e-4], [0.0, 0.0]], True)}</TimeCOAPoly>
<Row><UVectECF><X>-0.8574929257</X><Y>-0.5144957554</Y><Z>0</Z></UVectECF><SS>0.5</SS></Row><Col><UVectECF><X>0</X><Y>0</Y><Z>1</Z></UVectECF><SS>0.4</SS></Col></Grid>
<Timeline><CollectDuration>2</CollectDuration></Timeline>
<Position><ARPPoly><X {_poly([6878137.0])}</X><Y {_poly([300000.0])}</Y><Z {_poly([-7000.0, 7000.0])}</Z></ARPPoly></Position></SICD>"""


def test_complex_image_file(spark, tmp_path):
    a = np.arange(13 * 17 * 2, dtype=np.float32).view(np.complex64).reshape(13, 17)
    b = (a[:4, :5] * 1j).astype(np.complex64)
    (tmp_path / "a.nitf").write_bytes(nitf.encode([a, b], [XML], "two images"))
    files = nitf.read_files(spark, f"file://{tmp_path}/a.nitf")
    assert files.first().file.FTITLE == "two images"
    got = {(r.kind, r["index"]): r.size for r in nitf.segments(files).collect()}
    assert got == {("image", 0): 13 * 17 * 8, ("image", 1): 4 * 5 * 8, ("extension", 0): len(XML)}
    heads = {r["index"]: r for r in nitf.image_headers(files).collect()}
    assert (heads[1].image.NROWS, heads[1].bands, heads[0].compression) == ("00000004", ["I", "Q"], "NC")
    lines = {(r["index"], r.r): r.bands for r in nitf.read_lines(spark, f"file://{tmp_path}/a.nitf").collect()}
    assert len(lines) == 17
    for (i, r), (re, im) in lines.items():
        own = (a, b)[i][r]
        assert np.array_equal(re, own.real) and np.array_equal(im, own.imag)
    meta = nitf.xml_segments(files).select(sicd.parse(F.col("xml")).alias("sicd"))
    first = sicd.projection_columns(meta).withColumns({"row": F.lit(6.0), "col": F.lit(8.0)})
    assert first.first().arp_pz == [-7000.0, 7000.0] and first.first().kind == "PLANE"
    # The scene centre's pixel projects to the centre and back.
    at = projection.image_to_plane(first, "at").first()
    assert (at.at_x, at.at_y, at.at_z) == pytest.approx((6378137, 0, 0), abs=1e-2)


@pytest.mark.parametrize("mode", "PBRS")
def test_sample_orders(mode):
    whole = np.arange(6 * 10 * 3, dtype=">i2").reshape(6, 10, 3)
    blocks = whole.reshape(2, 3, 2, 5, 3)
    axes = {"P": (0, 2, 1, 3, 4), "B": (0, 2, 4, 1, 3), "R": (0, 2, 1, 4, 3), "S": (4, 0, 2, 1, 3)}[mode]
    data = memoryview(b"xx" + blocks.transpose(axes).tobytes())
    assert np.array_equal(nitf.samples(data, 2, 6, 10, 3, "SI", 16, mode, (3, 5)), whole)
    with pytest.raises(nitf.NitfError):
        nitf.samples(data[:-1], 2, 6, 10, 3, "SI", 16, mode, (3, 5))


def test_phase_history_file(spark, tmp_path):
    rng = np.random.default_rng(3)
    names = ["TxTime", "RcvTime", "FX1", "FX2", "AmpSF"]
    channels = {c: (rng.standard_normal((n, 5)), (rng.standard_normal((n, 8)) + 1j * rng.standard_normal((n, 8))).astype(np.complex64)) for c, n in (("a", 6), ("b", 3))}
    (tmp_path / "x.cphd").write_bytes(cphd.encode(channels, names))
    heads = cphd.read_headers(spark, f"file://{tmp_path}/x.cphd")
    results = phase_rules.evaluate(cphd.layout(heads), "file", phase_rules.layout_rules()).collect()
    assert results and all(r.passed for r in results)
    pvp, signal = cphd.read_pvp(heads), cphd.read_signal(heads)
    for r in cphd.vectors(pvp, *names).collect():
        assert [r[n] for n in names] == channels[r.channel][0][r.vector].tolist()
    rows = cphd.scaled_signal(signal, pvp).collect()
    assert len(rows) == 9
    for r in rows:
        values, samples = channels[r.channel]
        assert np.allclose(np.array(r.re) + 1j * np.array(r.im), samples[r.vector] * np.float32(values[r.vector, 4]), atol=1e-5)
