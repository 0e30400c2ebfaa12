import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

P = pytest.importorskip("public_tokenizers")
MODEL = P.path("piece_bpe_32k.model")

from slantframe.llm.piece_codec import PieceCodec, PieceTables, encode_documents  # noqa: E402


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    with open(MODEL, "rb") as f:
        return PieceCodec(PieceTables(f.read()))


def _texts():
    rnd = random.Random(5)
    alphabet = "aaabcdeeeiot  \n\tésßü漢\U0001f600.,!<>[]0123▁THEhe\x00'\"_"
    yield from ["", " ", "a", "▁x", "a\n\nb", "\x00a", "<s>", "<0x0A>", "a" * 5000, " " * 3000 + "x"]
    yield from (" " * k + x for k in range(40) for x in ("", "a", "漢", ",", "ab"))
    yield from ("".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(3000))


def test_equals_the_library(codec, library):
    for text in _texts():
        ids = library.encode(text, add_bos=True, add_eos=True)
        coded = codec.encode(text)
        assert np.frombuffer(coded, "<u4").tolist() == ids, text[:80]
        assert codec.decode(coded) == library.decode(ids), text[:80]


def test_random_ids_decode_as_the_library_does(codec, library):
    rnd = random.Random(7)
    for _ in range(1000):
        ids = [rnd.randrange(259, 32000) for _ in range(rnd.randrange(12))]
        assert codec.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_query_on_nulls_repeats_and_clashing_columns(spark, library):
    rows = [(1, "a b", 1), (1, "a b", 2), (None, None, 3), (2, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = sorted(map(tuple, encode_documents(docs, MODEL).collect()), key=str)
    empty = hashlib.sha256(np.array([1, 2], "<u4").tobytes()).hexdigest()
    ids = library.encode("a b", add_bos=True, add_eos=True)
    full = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert out == sorted([(1, len(ids), full, sha("a b"))] * 2 + [(None, 2, empty, sha("")), (2, 2, empty, sha(""))], key=str)
    assert encode_documents(docs.limit(0), MODEL).count() == 0


def test_workers_forget_spans_after_a_task(spark):
    docs = spark.range(64, numPartitions=8).selectExpr("id as doc_id", "concat('word', id, ' other', id * 7) as text")
    assert encode_documents(docs, MODEL).agg({"n_tokens": "sum"}).first()[0] > 0

    def remembered(batches):
        from slantframe.llm import piece_codec

        for _ in batches:
            n = [len(x) for c in piece_codec._CODECS.values() for x in (c.spans, c.pairs, c.run_ids)]
            yield pa.RecordBatch.from_pydict({"codecs": [len(n) // 3], "n": [sum(n)]})

    left = spark.range(64, numPartitions=8).mapInArrow(remembered, "codecs long, n long").collect()
    assert any(r.codecs for r in left) and not any(r.n for r in left)
