import numpy as np
import pytest

from slantframe.llm import kernels
from slantframe.llm.decontaminate import find_contamination
from slantframe.llm.jaccard import Similarity, jaccard_components
from slantframe.llm.suffix_dedup import remove_repeats


def thue_morse(n, pair="ab"):
    return "".join(pair[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096, 65536])
def test_strings_alike_modulo_powers_of_two(n):
    for pair in ("ab", "xq", "\x00\xff"):
        a, b = (thue_morse(n, p).encode("latin-1") for p in (pair, pair[::-1]))
        sums = kernels.prefix_sums(np.frombuffer(a + b, dtype=np.uint8), kernels.EXACT)
        x, y = kernels.span_hashes(sums, np.array([0, n]), np.array([n, 2 * n]))
        assert x != y and kernels.window_hashes(sums, n)[0] == kernels.window_hashes(sums, n)[0]
        windows = kernels.window_hashes(sums, 200)
        strings = {(a + b)[i : i + 200] for i in range(2 * n - 199)}
        assert len(np.unique(windows)) == len(strings)
        assert len(np.unique(windows & np.uint64((1 << 40) - 1))) >= len(strings) - 1


def test_where_a_string_lies_does_not_matter():
    rng = np.random.default_rng(0)
    word = rng.integers(0, 256, 999, dtype=np.uint8)
    data = np.concatenate([rng.integers(0, 256, 700_000, dtype=np.uint8), word, word])
    sums = kernels.prefix_sums(data, kernels.EXACT)
    n = len(data)
    x, y = kernels.span_hashes(sums, np.array([n - 1998, n - 999]), np.array([n - 999, n]))
    z = kernels.span_hashes(kernels.prefix_sums(word, kernels.EXACT), np.array([0]), np.array([999]))[0]
    assert x == y == z


def test_words_without_a_common_byte_string(spark):
    rows = [(i + 1, thue_morse(n, p)) for i, (n, p) in enumerate((n, p) for n in (1024, 2048, 4096) for p in ("ab", "ba"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_components(docs, Similarity(4, 85, 100)).collect()}
    assert got == {i: i for i, _ in rows}
    item = spark.createDataFrame([(1, " ".join(thue_morse(1024) + str(i) for i in range(20)))], "item_id long, text string")
    text = spark.createDataFrame([(1, " ".join(thue_morse(1024, "ba") + str(i) for i in range(20)))], "doc_id long, text string")
    assert find_contamination(text, item).first().coverage == 0.0
    assert find_contamination(text, item, broadcast_seeds=0).first().coverage == 0.0
    left = {r.doc_id: r.n_removed for r in remove_repeats(docs).collect()}
    raw = [t.encode() for _, t in rows]
    for (i, _), r in zip(rows, raw):
        gone = np.zeros(len(r), dtype=bool)
        for k in range(len(r) - 199):
            w = r[k : k + 200]
            if sum(x.count(w) for x in raw) > 1 or r.find(w, k + 1) >= 0 or r.find(w) < k:
                gone[k : k + 200] = True
        assert left[i] == gone.sum()
