from collections import Counter

import numpy as np
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from slantframe.llm.suffix_dedup import LENGTH, strip_repeats
from tests.llm.test_jaccard import brute as brute_components

SF = "/root/testdata/sf0.001"


def brute_cut(texts):
    raw = [t.encode() for t in texts]
    seen = Counter(r[i : i + LENGTH] for r in raw for i in range(len(r) - LENGTH + 1))
    for t, r in zip(texts, raw):
        gone = np.zeros(len(r), dtype=bool)
        for i in range(len(r) - LENGTH + 1):
            if seen[r[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = True
        at, out = 0, []
        for c in t:
            n = len(c.encode())
            if not gone[at : at + n].all():
                out.append(c)
            at += n
        yield "".join(out)


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(pipeline.STAGES)
    more = "/root/testdata/sf0.01"
    clean = stages["toxicity"](spark, spark.read.parquet(f"{more}/documents.parquet"), more)
    labels = spark.read.parquet(f"{more}/labels.parquet").collect()
    kept = {r.doc_id for r in clean.select("doc_id").collect()}
    assert clean.columns == docs.columns
    assert all(r.doc_id in kept for r in labels if r.toxic == 0)
    assert sum(r.doc_id not in kept for r in labels if r.toxic == 1) >= 0.7 * sum(r.toxic for r in labels)

    some = docs.where("doc_id < 150")
    rows = sorted((r.doc_id, r.text) for r in some.collect())
    one = stages["ngram_jaccard_join"](spark, some, SF)
    want = {x[0] for x in brute_components([t for _, t in rows], [i for i, _ in rows], pipeline.Similarity(5, 80, 100)) if x[0] == x[2]}
    assert {str(r.doc_id) for r in one.collect()} == want and one.columns == docs.columns

    cut = stages["suffix_array_dedup"](spark, some, SF)
    assert {r.doc_id: r.text for r in cut.collect()} == dict(zip([i for i, _ in rows], brute_cut([t for _, t in rows])))
    assert cut.where(F.length("text") != F.col("n_chars")).count() == 0 and cut.columns == docs.columns

    bench = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r.doc_id for r in stages["benchmark_decontamination"](spark, docs, SF).collect()}
    for r in docs.collect():
        if any(b in " ".join(r.text.lower().split()) for b in bench):
            assert r.doc_id not in left
    assert len(left) > docs.count() * 0.8


def test_run_and_repeated_ids(spark):
    out = pipeline.run(spark, SF).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=pipeline.MODEL)
    assert 0 < len(out) < 200 and all(r.n_tokens == len(r.ids) for r in out)
    assert all(sp.encode(sp.decode(list(r.ids)), add_bos=True, add_eos=True) == list(r.ids) for r in out[:20])
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, "x y"), (3, None)], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in pipeline.keep_one_each(docs).collect()) == ["1", "3", "3", "None"]
    # A row stays though its namesake goes, and names of columns don't matter.
    other = " ".join(f"v{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, 0, 0), (5, text, 1, 1), (5, other, 2, 2), (6, other + " x", 3, 3), (7, "", 4, 4), (7, "", 5, 5)], "doc_id long, text string, gone int, cls int").withColumns({"__gone": F.lit(1), "maybe": F.lit(2), "ent": F.lit(3), "__kept": F.lit(4)})
    left = pipeline.keep_one_each(docs)
    assert sorted(r.gone for r in left.collect()) == [0, 2, 4, 5] and left.columns == docs.columns
    assert strip_repeats(docs).count() == 6
