import random

from slantframe.llm import quality


def test_words_tell_texts_of_one_layout_apart(spark):
    """Every text has 30 lower-case words of five letters and a full stop, none repeated; only the words differ."""
    rnd = random.Random(4)
    good, poor = (["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(200)] for _ in range(2))
    docs = [(i, " ".join(rnd.sample(good if i % 2 else poor, 30)) + ".") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    out = quality.score_quality(df, quality.fit_quality(df, labels), threshold=0.5).where("doc_id >= 150").collect()
    assert sum(r.predicted == r.doc_id % 2 for r in out) >= 145
