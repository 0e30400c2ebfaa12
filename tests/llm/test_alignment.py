import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from slantframe.llm import alignment

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(A_FILE)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_FILE)


def spans(pieces):
    at, out = 0, []
    for p in pieces:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(texts):
    letters = alignment.byte_letters()
    docs, held = [], Counter()
    for text in texts:
        text = text or ""
        raw = (" " + text).encode()
        ids_a, ids_b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
        bytes_a = [bytes(letters[c] for c in A.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            docs.append(([], [], [], ""))
            continue
        span_a, span_b = spans(bytes_a), spans(bytes_b)
        links = [(a, b) for a, (s, e) in zip(ids_a, span_a) for b, (u, v) in zip(ids_b, span_b) if s < v and u < e]
        cuts = sorted({e for _, e in span_a} & {e for _, e in span_b})
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for i, (_, e) in zip(ids_a, span_a) if low < e <= c) + "|" + ",".join(str(i) for i, (_, e) in zip(ids_b, span_b) if low < e <= c))
            low = c
        held.update(set(links))
        docs.append((ids_a, ids_b, links, ";".join(groups)))
    most = {}
    for (a, _), n in held.items():
        most[a] = max(most.get(a, 0), n)
    return [(len(a), len(b), g.count(";") + bool(g), len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "", g) for a, b, links, g in docs]


TEXTS = [
    "Hello world, the quick brown fox.", "Hello world, the quick brown fox.", None, "", " ", "  two  spaces\n\n\tand tabs ", "é ß 漢字 \U0001f600\U0001f468‍\U0001f469 ́", "<|endoftext|> <s> </s> <unk> <0x41> [INST]",
    "a▁b", "\x00\x01 nul", "x" * 700, "1234567890 3.14 don't we'll I'M", "￾﻿�", "tab\tend ", "Ciónraó dollque iera — “quoted”", "naïve café " * 40,
]


def test_equals_brute_force(spark):
    rows = [(i % 14, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(None, "the quick world", "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs string, n_a long")
    want = sorted(((r[0], *w) for r, w in zip(rows, brute([r[1] for r in rows]))), key=str)
    assert want[0][7] is not None and any(w[1] > w[3] for w in want)
    for hot in (0, 16, alignment.HOT):
        got = alignment.align_documents(docs.repartition(3), A_FILE, B_FILE, hot=hot, keep_groups=True).collect()
        assert sorted((tuple(r) for r in got), key=str) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_documents(docs, A_FILE, B_FILE).count() == 0
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {tuple(r) for r in alignment.align_documents(docs, A_FILE, B_FILE).collect()} == {(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")}


def test_very_long_text_and_odd_characters():
    with open(A_FILE, "rb") as a, open(B_FILE, "rb") as b:
        aligner = alignment.Aligner(a.read(), b.read())
    text = " ".join(TEXTS[i % len(TEXTS)] or "" for i in range(30_000) if i % len(TEXTS) != 8)
    (a,), (b,) = aligner.a.encode([text]), aligner.b.encode([text])
    assert a.tolist() == A.encode(" " + text, add_special_tokens=False).ids
    n_a, n_b, groups, links, _, pairs, times, written = alignment._aligned(aligner, text, a, b, True)
    assert links == n_a + n_b - groups and groups == written.count(";") + 1
    for at in range(0, 0x3000, 64):
        odd = [f" a{chr(c)}b {chr(c)}{chr(c)}1 .{chr(c)}!" for c in range(at, at + 64)]
        assert [x.tolist() for x in aligner.a.encode(odd)] == [e.ids for e in A.encode_batch([" " + t for t in odd], add_special_tokens=False)]
