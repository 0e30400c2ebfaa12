import random
from datetime import datetime, timedelta

import numpy as np

from slantframe.streaming.frames import frames, frames_of_stream

SCHEMA = "channel string, pulse long, ts timestamp, re array<double>, im array<double>"


def pulses(n=61, missing=(17, 40)):
    rng = np.random.default_rng(5)
    out = []
    for channel, count in (("a", n), ("b", 9)):
        for p in range(count):
            if channel == "b" or p not in missing:
                out.append((channel, p, datetime(2024, 1, 1) + timedelta(seconds=p), rng.normal(size=3).tolist(), rng.normal(size=3).tolist()))
    return out


def rows_of(df):
    return {(r.channel, r.frame, r.line): (r.n, r.complete, np.round(r.re, 9).tolist(), np.round(r.im, 9).tolist()) for r in df.collect()}


def test_frames_are_transforms(spark):
    """Every frame against the transform of its pulses, whatever the size of blocks; gaps between frames hold no pulses."""
    given = pulses()
    df = spark.createDataFrame(given, SCHEMA)
    for width, step in ((8, 3), (5, 5), (4, 7), (1, 1)):
        want = {}
        for channel in "ab":
            own = {p: np.array(re) + 1j * np.array(im) for c, p, _, re, im in given if c == channel}
            for f in range(max(own) // step + 1):
                held = [p for p in range(f * step, f * step + width) if p in own]
                if held:
                    lines = np.fft.fftshift(np.fft.fft([own.get(p, np.zeros(3)) for p in range(f * step, f * step + width)], axis=0), axes=0)
                    want |= {(channel, f, i): (len(held), len(held) == width, np.round(x.real, 9).tolist(), np.round(x.imag, 9).tolist()) for i, x in enumerate(lines)}
        for block in (1, 4):
            got = rows_of(frames(df, width, step, block))
            assert got.keys() == want.keys()
            for k, (n, complete, re, im) in want.items():
                assert got[k][:2] == (n, complete) and np.allclose(got[k][2], re) and np.allclose(got[k][3], im)


def test_odd_rows(spark):
    """Copies, nulls and negative pulses don't count; an empty table has no frames."""
    given = pulses()
    odd = [given[0], (None, 1, None, [1.0] * 3, [1.0] * 3), ("a", None, None, [1.0] * 3, [1.0] * 3), ("a", -4, None, [1.0] * 3, [1.0] * 3), ("a", 17, None, None, [1.0] * 3)]
    assert rows_of(frames(spark.createDataFrame(given + odd, SCHEMA), 8, 3)) == rows_of(frames(spark.createDataFrame(given, SCHEMA), 8, 3))
    assert frames(spark.createDataFrame([], SCHEMA), 8, 3).count() == 0


def test_stream_of_shuffled_pulses(spark, tmp_path):
    """Pulses in any order within the lateness, some twice, in eight files: the table's frames, each once."""
    given = pulses()
    late = random.Random(3)
    order = sorted(given + given[::7], key=lambda r: (r[2] + timedelta(seconds=late.uniform(0, 12)), r[0]))
    end = ("end", 0, datetime(2024, 1, 2), [0.0] * 3, [0.0] * 3)
    pieces = [order[k::1][:20] for k in range(0, len(order), 20)] + [[end]]
    for k, piece in enumerate(pieces):
        spark.createDataFrame(piece, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"k={k:03}"))
    stream = spark.readStream.schema(SCHEMA + ", k int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = frames_of_stream(stream, 8, 3, late="40 seconds", hold=60, block=4)
    run = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    assert run.awaitTermination(240)
    got = spark.read.parquet(str(tmp_path / "out")).where("channel <> 'end'")
    want = rows_of(frames(spark.createDataFrame(given, SCHEMA), 8, 3))
    assert got.count() == len(want)
    assert rows_of(got) == want
