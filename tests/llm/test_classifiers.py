import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from slantframe.llm import kernels, quality, toxicity
from slantframe.llm.labelled import remainder


def _corpus(spark):
    rnd = random.Random(3)
    names = ["word%d" % i for i in range(60)]
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = [rnd.choice(names) for _ in range(rnd.randrange(5, 60))]
        if i % 3 == 0:
            text.insert(0, "women" if bad or i % 2 else "men")
        if bad:
            text.insert(rnd.randrange(len(text)), rnd.choice(["Nasty", "vile"]))
        docs.append((i, " ".join(text), i))
        labels.append((i, int(not bad), int(bad)))
    docs += [(900, None, 0), (901, "", 0), (None, "vile word1", 0), (902, "word1 " * 5000, 0), (0, docs[0][1], 5)]
    return spark.createDataFrame(docs, "doc_id long, text string, score int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_marks_and_not_group_mentions(spark):
    docs, labels = _corpus(spark)
    learn, held = toxicity.held_out(3, 1)
    model = toxicity.fit_toxicity(docs, labels, learn)
    at = {int(h): w for h, w in zip(model.hashes, model.weights)}
    mention = abs(at[toxicity.word_hash("women")] - at[toxicity.word_hash("men")])
    free = toxicity.fit_toxicity(docs, labels, learn, pairing=0.0)
    at = {int(h): w for h, w in zip(free.hashes, free.weights)}
    assert mention < abs(at[toxicity.word_hash("women")] - at[toxicity.word_hash("men")])
    out = toxicity.score_toxicity(docs, model).withColumn("held_out", held).collect()
    assert len(out) == docs.count()
    for r in out:
        bad = r.doc_id is None or (r.doc_id < 900 and r.doc_id % 4 == 0)
        assert r.predicted == int(bad), r
        assert 0 <= r.score <= 1


def test_without_labels_or_rows(spark):
    docs, labels = _corpus(spark)
    none = labels.where("false")
    assert {r.predicted for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, none)).collect()} == {0}
    assert {r.score for r in quality.score_quality(docs, quality.fit_quality(docs, none)).collect()} == {0.5}
    model = toxicity.fit_toxicity(docs, labels.withColumn("toxic", F.lit(None).cast("int")))
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_remainder_is_crc32_of_the_text(spark):
    got = spark.range(50).select("id", remainder(F.col("id"), 3).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 3 for r in got)


def test_quality_votes_equal_brute_force(spark):
    rnd = random.Random(9)
    docs = [(i, (" ".join("WORD%d!!" % rnd.randrange(9) for _ in range(30)) if i % 5 == 0 else " ".join("some%s." % "x" * rnd.randrange(4) for _ in range(30)))) for i in range(200)] + [(300, None), (301, "")]
    labels = [(i, int(i % 5 != 0), 0) for i in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = quality.fit_quality(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rank=8, neighbours=7)
    got = {r.doc_id: r for r in quality.score_quality(df, model).collect()}
    import pyarrow as pa

    for i, text in docs:
        counts = next(quality.term_counts(pa.array([text or ""])))[1]
        v = model.embed(counts)[0]
        cos = model.vectors @ v
        near = np.argsort(-cos, kind="stable")[:7]
        w = np.maximum(cos[near], 0).astype(float)
        want = (w * model.labels[near]).sum() / w.sum() if w.sum() else model.prior
        assert abs(got[i].score - want) < 0.02
    assert sum(got[i].predicted == int(i % 5 != 0) for i in range(100, 200)) >= 97


def test_shingle_sets_equal_brute_force():
    import pyarrow as pa

    texts = ["a b c d e a b c d", "", None, "A\tb", "x y z w", "  é b\nc d  ", "one"]
    sep = kernels.white_space()
    sets = list(kernels.shingle_sets(pa.array(texts), 4, sep))
    words = [(t or "").lower().split() for t in texts]
    brute = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set()) for w in words]
    assert [len(s) for s in sets] == [len(b) for b in brute]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(np.intersect1d(sets[i], sets[j])) == len(brute[i] & brute[j])


def test_pairs_exist_without_mentions_and_flatten_later_ones(spark):
    docs = spark.createDataFrame([(i, "plain words here " + ("vile" if i % 2 else "fine")) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert model.pairs > 0
    mentions = spark.createDataFrame([(i, f"plain words here fine {w}") for i, w in enumerate(("", "women", "musulmans", "männer", "judíos"))], "doc_id long, text string")
    scores = [r.score for r in toxicity.score_toxicity(mentions, model).orderBy("doc_id").collect()]
    assert max(abs(s - scores[0]) for s in scores) < 1e-6


def test_the_fit_never_holds_the_whole_sample_as_a_dense_matrix(spark):
    import tracemalloc

    n = 12_000
    bad = F.col("id") % 4 == 0
    word = lambda k: F.concat(F.lit(f"w{k}x"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(40)))
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.when(bad, "vile").otherwise("fine"), *map(word, range(6))).alias("text"), bad.cast("int").alias("toxic"))
    tracemalloc.start()
    try:
        model = toxicity.fit_toxicity(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.pairs >= n
    assert peak < n * len(model.hashes) * 8
    assert {(r.doc_id % 4 == 0, r.predicted) for r in toxicity.score_toxicity(rows.select("doc_id", "text"), model).collect()} == {(True, 1), (False, 0)}


def test_alike_rows_count_as_often_as_they_occur():
    rnd = np.random.default_rng(4)
    d, n = 7, toxicity.DENSE + 90
    x = rnd.random((n, d)) < 0.3
    y = rnd.random(n) < np.where(x[:, 0], 0.8, 0.3)
    counts = rnd.integers(1, 4, n)
    of = lambda x, y, counts: toxicity.WordRows(y.astype(int), counts, np.nonzero(x)[1], np.r_[0, np.cumsum(x.sum(axis=1))])
    many, bias = toxicity.fit_logits(of(x, y, counts), np.eye(d) / 9, 1.0, 1e-6)
    each, same = toxicity.fit_logits(of(np.repeat(x, counts, axis=0), np.repeat(y, counts), np.ones(counts.sum(), dtype=int)), np.eye(d) / 9, 1.0, 1e-6)
    np.testing.assert_allclose(np.r_[many, bias], np.r_[each, same], atol=1e-9)
    # The gradient of the loss is zero there.
    p = 1 / (1 + np.exp(-(x @ many + bias)))
    slope = (counts * (p - y)) @ x / counts.sum() + 2 * many / 9 + 2e-6 * many
    assert np.abs(slope).max() < 1e-9


def test_equal_cosines_go_to_the_least_id():
    vectors = np.array([[1, 0], [0, 1], [1, 0], [1, 0]], np.float32)
    counts = np.zeros((1, quality.TERMS))
    axes = np.zeros((quality.TERMS, 2), np.float32)
    axes[0, 0] = 1
    model = quality.QualityModel(np.ones(quality.TERMS), axes, vectors, np.array([1.0, 1.0, 0.0, 0.0]), 2, 0.5)
    counts[0, 0] = 3
    original = quality.term_counts
    quality.term_counts = lambda column: iter([(0, counts)])
    try:
        assert model.scores([None]).tolist() == [0.5]
    finally:
        quality.term_counts = original


def test_repeated_ids_give_one_text(spark):
    from slantframe.llm.labelled import labelled_sample

    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    got = sorted(map(tuple, labelled_sample(docs, labels, "toxic", F.lit(True), 10).collect()))
    assert got == [(1, 1, "a"), (2, 0, None)]
