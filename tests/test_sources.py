import numpy as np
import pytest
from pyspark.sql import functions as F

from slantframe.sources import dted, sio, sniff
from slantframe.streaming.pulses import first_pulses, pulse_windows


def test_sio_round_trip(spark, tmp_path):
    data = np.arange(13 * 17 * 2, dtype=np.float32).reshape(13, 17, 2)
    (tmp_path / "a.sio").write_bytes(sio.encode(data[:, :, 0], data[:, :, 1], {"note": b"x"}))
    lines = sio.read_sio(spark, f"file://{tmp_path}/a.sio")
    got = {r.r: (r.re, r.im) for r in lines.collect()}
    assert len(got) == 13 and all(np.array_equal(got[i][k], data[i, :, k]) for i in range(13) for k in (0, 1))
    assert sio.pixels(lines).count() == 13 * 17
    again = bytes(sio.image_files(lines).first().content)
    assert np.array_equal(sio.decode(again)[0], data[:, :, 0])
    assert sio.read_sio(spark, f"file://{tmp_path}/a.sio", rows=(2, 5)).count() == 3
    big = b"\xff\x01\x7f\xfe" + np.array([1, 2, 12, 4], ">u4").tobytes() + np.array([1, -2, 3, 4], ">i2").tobytes()
    assert sio.decode(big)[1].tolist() == [[-2, 4]]
    for broken in (b"", b"JUNK" * 9, big[:-1]):
        with pytest.raises(sio.SioError):
            sio.decode(broken)


def test_dted_round_trip(spark, tmp_path):
    posts = np.arange(5 * 7, dtype=float).reshape(5, 7) - 10
    posts[2, 3] = np.nan
    (tmp_path / "t.dt0").write_bytes(dted.encode(-3, 41, posts))
    rows = dted.read_dted(spark, f"file://{tmp_path}/t.dt0").collect()
    assert len(rows) == 35 and all(r.elev == posts[r.ix, r.iy] or (r.elev is None and (r.ix, r.iy) == (2, 3)) for r in rows)
    assert {(r.tile_lat, r.tile_lon) for r in rows} == {(41, -3)} and max(r.lat for r in rows) == pytest.approx(42, abs=1e-3)
    with pytest.raises(dted.DtedError):
        dted.decode(b"nothing")
    assert {r.format for r in sniff.list_formats(spark, f"file://{tmp_path}").collect()} == {"dted"}


def test_windows_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    rows = [(f"c{i % 3}", i, float(i), 3600 * (1000 + i // 7)) for i in range(60)]
    events = spark.createDataFrame(rows, "channel string, pulse int, value double, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = pulse_windows(stream, late="10 minutes").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, pulse_windows(events).collect()))
    q = first_pulses(stream.unionAll(stream), "10 hours").writeStream.format("memory").queryName("firsts").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("firsts").count() == 60
