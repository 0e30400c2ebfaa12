import random

import numpy as np

from slantframe.llm.decontaminate import LEAST, covered, find_contamination


def brute(item, text, least):
    """Greedy string tiling by its definition: longest matches first, none overlapping."""
    own, other = [True] * len(item), [True] * len(text)
    while True:
        best = 0
        found = []
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and own[i + k] and other[j + k] and item[i + k] == text[j + k]:
                    k += 1
                if k > best:
                    best, found = k, []
                if k == best and k:
                    found.append((i, j))
        if best < least:
            return own.count(False)
        for i, j in found:
            if all(own[i : i + best]) and all(other[j : j + best]):
                own[i : i + best] = [False] * best
                other[j : j + best] = [False] * best


def test_tiling_equals_its_definition():
    rng = np.random.default_rng(1)
    for _ in range(60):
        names = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
        item, text = names[rng.integers(0, 6, rng.integers(1, 30))], names[rng.integers(0, 6, rng.integers(1, 40))]
        assert covered(item, text, least=3) == brute(item.tolist(), text.tolist(), 3)


def test_leaks_in_any_order_and_clean_documents(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(4))
    items = [[word() for _ in range(40)] for _ in range(20)]
    bench = [(i, " ".join(x), 0) for i, x in enumerate(items)] + [(None, "a b c d e f", 0), (77, None, 0), (78, "too short", 0), (79, " ".join(items[3]), 0)]
    docs, want = [(None, None, 1), (900, "", 2), (901, "too short", 3), (902, word() + " x" * 20000, 4)], {900: 0, 901: 0, 902: 0, None: 0}
    for d in range(60):
        body = [word() for _ in range(rnd.randrange(80))]
        if d % 3 == 0:
            x = items[d % 20]
            body[10:10] = x[25:] + ["gap"] + x[12:25] + ["Gap,"] + x[:12]
        elif d % 3 == 1:
            body[5:5] = items[d % 20][:10]
        docs.append((d, " ".join(body).upper() if d % 2 else ", ".join(body), d))
        want[d] = int(d % 3 == 0)
    docs.append(docs[4])
    df, bf = spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(bench, "item_id long, text string, doc_id int")
    for most in (10_000, 0):
        got = find_contamination(df, bf, broadcast_seeds=most).collect()
        assert len(got) == len(docs)
        assert {r.doc_id: r.contaminated for r in got} == want
        assert all(r.item_id == r.doc_id % 20 and r.coverage == 1 for r in got if r.contaminated)
    assert find_contamination(df.limit(0), bf).count() == 0
    assert {r.contaminated for r in find_contamination(df, bf.limit(0)).collect()} == {0}
    assert LEAST == 5


def test_repeated_and_textual_item_ids_on_both_paths(spark):
    rnd = random.Random(8)
    passage = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(20)) for _ in range(4)]
    bench = [("b", passage[0]), ("b", passage[1]), ("c", passage[2]), ("a", passage[2])]
    docs = [(i, f"before {p} after", "own") for i, p in enumerate(passage)]
    df, bf = spark.createDataFrame(docs, "doc_id int, text string, leak string"), spark.createDataFrame(bench, "item_id string, text string")
    for most in (10_000, 0):
        got = find_contamination(df, bf, broadcast_seeds=most, keep=True)
        assert got.columns == ["doc_id", "text", "leak", "leak_item", "leak_coverage", "leak_"]
        assert sorted((r.doc_id, r.leak_item, r.leak_, r.leak) for r in got.collect()) == [(0, "b", 1, "own"), (1, "b", 1, "own"), (2, "a", 1, "own"), (3, None, 0, "own")]
