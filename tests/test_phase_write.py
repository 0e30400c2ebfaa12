"""Files of vectors written by many tasks and read again."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from slantframe.sources import cphd_ranged
from slantframe.sources.cphd import CphdError
from slantframe.sources.phase_write import parameter_layout, write_phase

PARAMETERS = {"TxTime": "F8", "TxPos": "X=F8;Y=F8;Z=F8;", "SIGNAL": "I8", "AmpSF": "F8", "Gain": "F4", "Big": "U8"}


def vectors(spark, tasks=7):
    rng = np.random.default_rng(8)
    rows = []
    for channel, n, samples in (("b", 40, 5), ("a & <c>", 23, 8)):
        for k in range(n):
            z = rng.integers(-900, 900, (2, samples)) * 0.5
            rows.append((channel, k, z[0].tolist(), z[1].tolist(), k * 0.25, 1.0, 2.0 + k, -3.0, 2**53 + 1 + k, 0.5, k / 4, 5 + k))
    return spark.createDataFrame(rows, "channel string, vector int, re array<double>, im array<double>, TxTime double, TxPos_x double, TxPos_y double, TxPos_z double, SIGNAL long, AmpSF double, Gain float, Big long").repartition(tasks)


@pytest.mark.parametrize("kind", ["CPHD", "CRSD"])
@pytest.mark.parametrize("form", ["CI4", "CF8"])
def test_written_and_read(spark, tmp_path, kind, form):
    df = vectors(spark)
    path = str(tmp_path / "x.phase")
    write_phase(df, path, PARAMETERS, form, kind, added=("Gain", "Big"), more="<Note>n</Note>", lines={"RELEASE_INFO": "ALL"})
    assert os.listdir(tmp_path) == ["x.phase"]
    own = {(r.channel, r.vector): r for r in df.collect()}
    back = {(r.channel, r.vector): r for r in cphd_ranged.read_pvp(spark, path).collect()}
    assert back.keys() == own.keys()
    for k, r in own.items():
        b = back[k]
        assert (b.TxTime, b.TxPos_x, b.TxPos_y, b.TxPos_z, b.SIGNAL, b.AmpSF, b.Gain, int(b.Big)) == (r.TxTime, r.TxPos_x, r.TxPos_y, r.TxPos_z, r.SIGNAL, r.AmpSF, r.Gain, r.Big)
    for r in cphd_ranged.read_signal(spark, path, (1, 4), scaled=True).collect():
        assert r.re == own[r.channel, r.vector].re[1:4] and r.im == own[r.channel, r.vector].im[1:4]
    stored = cphd_ranged.read_signal(spark, path).where("channel = 'b' and vector = 3").first()
    assert stored.re == [2 * x for x in own["b", 3].re]
    with pytest.raises(Exception, match="there already"):
        write_phase(df, path, PARAMETERS, form, kind)


def test_what_is_wrong_leaves_nothing(spark, tmp_path):
    df, path = vectors(spark), str(tmp_path / "x.phase")
    cases = {
        "missing or come twice": df.withColumn("vector", F.when(F.col("vector") == 7, 8).otherwise(F.col("vector"))),
        "doesn't fit": df.where("vector <> 7"),
        "several lengths": df.withColumn("re", F.when(F.col("vector") == 2, F.slice("re", 1, 2)).otherwise(F.col("re"))),
        "don't fit CI4": df.withColumn("re", F.transform("re", lambda x: x * 1e6)),
        "is null": df.withColumn("Gain", F.when(F.col("vector") != 2, F.col("Gain"))),
    }
    for text, broken in cases.items():
        with pytest.raises(Exception, match=text):
            write_phase(broken, path, PARAMETERS)
        assert os.listdir(tmp_path) == [], text
    with pytest.raises(CphdError):
        write_phase(df, path, {"TxTime": "F9"})


def test_parameters_begin_at_words():
    parts, words, width = parameter_layout({"Gain": "F4", "Pos": "X=F8;Y=F8;", "Flag": "I1"})
    assert parts == [("Gain", 0, ">f4"), ("Pos_x", 8, ">f8"), ("Pos_y", 16, ">f8"), ("Flag", 24, ">i1")] and words == {"Gain": (0, 1), "Pos": (1, 2), "Flag": (3, 1)} and width == 32


def test_no_vectors(spark, tmp_path):
    path = str(tmp_path / "x.phase")
    write_phase(vectors(spark).limit(0), path, PARAMETERS)
    assert cphd_ranged.read_pvp(spark, path).count() == 0
