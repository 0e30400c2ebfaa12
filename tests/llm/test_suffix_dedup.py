import hashlib
import random
from collections import Counter

from slantframe.llm.suffix_dedup import LENGTH, remove_repeats


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + LENGTH] for r in raw for i in range(len(r) - LENGTH + 1))
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - LENGTH + 1):
            if seen[r[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = [True] * LENGTH
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        yield len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(rnd.randrange(30, 120)) for _ in range(8)]
    texts = [None, "", "x" * 150, "y" * 700, "ab" * 300, prose(900)]
    for _ in range(60):
        parts = [prose(rnd.randrange(0, 60)) for _ in range(3)]
        for _ in range(rnd.randrange(3)):
            s = rnd.choice(shared)
            a = rnd.randrange(len(s) // 2)
            parts.insert(rnd.randrange(4), s[a : a + rnd.randrange(150, 500)])
        texts.append("".join(parts))
    for t in texts[6:16]:
        words = t.split(" ")
        words[rnd.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [texts[8], texts[8], texts[9], texts[3]]
    texts += [shared[0][:230] + prose(20) for _ in range(6)] + [t[: LENGTH + k] for k, t in enumerate(texts[40:46])]
    return texts


def test_equals_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        rows = [(i if i != 11 else None, t, i) for i, t in enumerate(texts)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int").repartition(5)
        got = {r.doc_id: tuple(r)[1:] for r in remove_repeats(docs).collect()}
        want = {r[0]: w for r, w in zip(rows, brute(texts))}
        assert sum(w[1] > 0 for w in want.values()) > 20
        assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_equal_ids_and_no_rows(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(400))
    docs = spark.createDataFrame([(1, text), (1, text), (1, "other" + text[:250])], "doc_id long, text string")
    assert sorted(r.n_removed for r in remove_repeats(docs).collect()) == [250, 400, 400]
    assert remove_repeats(docs.limit(0)).count() == 0
