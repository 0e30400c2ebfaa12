import numpy as np
import pytest
from pyspark.sql import functions as F

from slantframe.sources import cphd_ranged
from slantframe.sources.cphd import CphdError
from slantframe.sources.ranged import Ranges

RNG = np.random.default_rng(6)
PVP = np.dtype([("time", ">f8"), ("x", ">f8"), ("y", ">f8"), ("z", ">f8"), ("signal", ">i8"), ("big", ">u8"), ("gain", ">f4"), ("pad", ">u4")])
FIELDS = "<TxTime><Offset>0</Offset><Size>1</Size><Format>F8</Format></TxTime><TxPos><Offset>1</Offset><Size>3</Size><Format>X=F8;Y=F8;Z=F8;</Format></TxPos><SIGNAL><Offset>4</Offset><Size>1</Size><Format>I8</Format></SIGNAL><AddedPVP><Name>Big</Name><Offset>5</Offset><Size>1</Size><Format>U8</Format></AddedPVP><AddedPVP><Name>Gain</Name><Offset>6</Offset><Size>1</Size><Format>F4</Format></AddedPVP>"


def build(channels, samples=10, form="CI4", more=""):
    """(bytes of a file, {channel: (parameters, complex samples)}, support array)."""
    base = {"CI2": ">i1", "CI4": ">i2", "CF8": ">f4"}[form]
    pvp, signal, body, made = b"", b"", "", {}
    for name, n in channels.items():
        own = np.zeros(n, PVP)
        for f in PVP.names:
            own[f] = RNG.integers(0, 100, n) if f != "big" else np.uint64(2**63 + 5) + np.arange(n, dtype=np.uint64)
        own["signal"] = 2**53 + 1 + np.arange(n)
        data = RNG.integers(-99, 99, (n, samples, 2)).astype(base)
        body += f"<Channel><Identifier>{name}</Identifier><NumVectors>{n}</NumVectors><NumSamples>{samples}</NumSamples><SignalArrayByteOffset>{len(signal)}</SignalArrayByteOffset><PVPArrayByteOffset>{len(pvp)}</PVPArrayByteOffset></Channel>"
        pvp, signal = pvp + own.tobytes(), signal + data.tobytes()
        made[name] = own, data[:, :, 0].astype(float) + 1j * data[:, :, 1]
    gains = RNG.standard_normal((4, 3, 2)).astype(">f4")
    support = gains.tobytes()
    xml = f'<CPHD xmlns="urn:cphd"><Data><SignalArrayFormat>{form}</SignalArrayFormat><NumBytesPVP>{PVP.itemsize}</NumBytesPVP>{more}{body}<SupportArray><Identifier>pattern</Identifier><NumRows>4</NumRows><NumCols>3</NumCols><BytesPerElement>8</BytesPerElement><ArrayByteOffset>0</ArrayByteOffset></SupportArray></Data><SupportArray><AntGainPhase><Identifier>pattern</Identifier><ElementFormat>Gain=F4;Phase=F4;</ElementFormat></AntGainPhase></SupportArray><PVP>{FIELDS}</PVP></CPHD>'.encode()
    blocks, at, lines = {"XML": xml, "SUPPORT": support, "PVP": pvp, "SIGNAL": signal}, 2048, ["CPHD/1.1.0"]
    for k, data in blocks.items():
        lines += [f"{k}_BLOCK_SIZE := {len(data)}", f"{k}_BLOCK_BYTE_OFFSET := {at}"]
        at += len(data) + 2 * (k == "XML")
    return ("\n".join(lines) + "\n\f\n").encode().ljust(2048, b"\0") + xml + b"\f\n" + support + pvp + signal, made, gains


def test_parameters_keep_their_types(spark, tmp_path):
    data, made, _ = build({"a": 30, "b": 7})
    (tmp_path / "x.cphd").write_bytes(data)
    df = cphd_ranged.read_pvp(spark, f"file://{tmp_path}")
    assert dict(df.dtypes) == {"path": "string", "channel": "string", "vector": "int", "TxTime": "double", "TxPos_x": "double", "TxPos_y": "double", "TxPos_z": "double", "SIGNAL": "bigint", "Big": "decimal(20,0)", "Gain": "float"}
    rows = {(r.channel, r.vector): r for r in df.collect()}
    assert len(rows) == 37
    for (c, k), r in rows.items():
        own = made[c][0][k]
        assert (r.TxTime, r.TxPos_z, r.SIGNAL, int(r.Big), r.Gain) == (own["time"], own["z"], own["signal"], own["big"], own["gain"])
    some = cphd_ranged.read_pvp(spark, str(tmp_path), "signal", "Big").where("channel = 'a' and vector between 5 and 8 and SIGNAL > 0")
    assert some.columns == ["path", "channel", "vector", "SIGNAL", "Big"] and sorted(r.vector for r in some.collect()) == [5, 6, 7, 8]
    with pytest.raises(Exception, match="no parameter Nope"):
        cphd_ranged.read_pvp(spark, str(tmp_path), "Nope").collect()


@pytest.mark.parametrize("form", ["CI2", "CI4", "CF8"])
def test_windows_of_the_signal(spark, tmp_path, form):
    data, made, gains = build({"a": 12, "b": 5}, 40, form)
    (tmp_path / "x.cphd").write_bytes(data)
    for samples in (None, (3, 30), (11, 14), (38, 99), (50, 60)):
        low, high = samples or (0, 40)
        got = {(r.channel, r.vector): np.array(r.re) + 1j * np.array(r.im) for r in cphd_ranged.read_signal(spark, str(tmp_path), samples).where("vector >= 2").collect()}
        assert len(got) == 13
        assert all(np.array_equal(x, made[c][1][k][low:high]) for (c, k), x in got.items())
    lines = {(r.r, r.part): r["values"] for r in cphd_ranged.read_support(spark, str(tmp_path)).where((F.col("identifier") == "pattern") & (F.col("r") > 1)).collect()}
    assert set(lines) == {(r, p) for r in (2, 3) for p in ("Gain", "Phase")} and np.allclose(lines[3, "Phase"], gains[3, :, 1])


def test_only_what_is_asked_for_is_read(tmp_path):
    data, _, _ = build({"a": 200, "b": 5}, 5000, "CF8")
    path = tmp_path / "x.cphd"
    path.write_bytes(data)
    reader = cphd_ranged._SignalReader({"path": str(path), "samples": "100:110"})
    reader.bounds.among, reader.bounds.low, reader.bounds.high = {"channel": {"a"}}, {"vector": 50}, {"vector": 59}
    (piece,) = reader.pieces()
    assert (piece.channel, piece.first, piece.last) == ("a", 50, 60)
    taken, made = [], Ranges.read
    Ranges.read = lambda self, at, size: taken.append(size) or made(self, at, size)
    try:
        assert sum(b.num_rows for b in reader.read(piece)) == 10
    finally:
        Ranges.read = made
    assert sum(taken) == 10 * 10 * 8


def test_broken_files(spark, tmp_path):
    data, _, _ = build({"a": 3})
    (tmp_path / "cut.cphd").write_bytes(data[:-1])
    with pytest.raises(Exception, match="cut off"):
        cphd_ranged.read_signal(spark, str(tmp_path)).collect()
    (tmp_path / "cut.cphd").write_bytes(build({"a": 3}, more="<SignalCompressionID>zip</SignalCompressionID>")[0])
    with pytest.raises(Exception, match="compressed"):
        cphd_ranged.read_signal(spark, str(tmp_path)).collect()
    (tmp_path / "cut.cphd").write_bytes(b"hello")
    with Ranges(str(tmp_path / "cut.cphd")) as file, pytest.raises(CphdError):
        cphd_ranged.head(file)
