import random

import numpy as np
from pyspark.sql import functions as F

from slantframe.llm.components import connected_components, merged_components
from slantframe.llm.jaccard import Similarity, jaccard_components, keep_one_each, part_keys
from slantframe.llm.scratch import Scratch


def brute(texts, ids, sim):
    sets = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")).split()
        n = sim.words
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and sim.den * len(sets[i] & sets[j]) >= sim.num * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((str(d), len(s), str(least.get(root(i)))) for i, (d, s) in enumerate(zip(ids, sets)))


def corpus(seed, edits):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 6)))
    texts = [None, "", "  \n", "one", "One", "a b c", "a b C", "x " * 400, "word"]
    for _ in range(12):
        base = [word() for _ in range(rnd.choice([5, 9, 30, 80, 300]))]
        for _ in range(12):
            own = list(base)
            for _ in range(rnd.randrange(edits)):
                own[rnd.randrange(len(own))] = word()
            texts.append(" ".join(own))
    return texts


def test_equals_brute_force(spark):
    for seed, edits, sim in ((1, 4, Similarity()), (2, 14, Similarity(words=5, num=80))):
        texts = corpus(seed, edits)
        ids = [None if i == 3 else (i * 37) % 1000 for i in range(len(texts))]
        docs = spark.createDataFrame(list(zip(ids, texts, range(len(texts)))), "doc_id long, text string, cls int").repartition(4)
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_components(docs, sim).collect())
        want = brute(texts, ids, sim)
        assert len({w[2] for w in want}) < len(texts) - 20
        assert got == want
    assert jaccard_components(docs.limit(0)).count() == 0


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(4)
    sim = Similarity()
    for _ in range(400):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = int(rng.integers(0, max(1, n // 10) + 1))
        b = np.unique(np.r_[a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 12) + 1)), dtype=np.uint64)])
        if len(b) and sim.linked(a, b) and not np.array_equal(a, b):
            keys, owner = part_keys([a, b], sim)
            assert len(np.intersect1d(keys[owner == 0], keys[owner == 1]))


def test_components_of_paths_and_stars(spark):
    rnd = random.Random(1)
    order = list(range(200))
    rnd.shuffle(order)
    pairs = list(zip(order, order[1:])) + [(1000, 1000 + i) for i in range(1, 300)] + [(2000, 2001), (2001, 2000), (5, 5)]
    links = spark.createDataFrame(pairs, "a long, b long")
    roots = {r.node: r.root for r in connected_components(links, Scratch(spark, "t")).collect()}
    assert all(roots[i] == 0 for i in range(1, 200))
    assert all(roots[1000 + i] == 1000 for i in range(1, 300)) and roots[2001] == 2000
    assert connected_components(links.where(F.lit(False)), Scratch(spark, "t")).count() == 0


def test_crowded_parts_over_several_blocks(spark):
    """More sets than a block holds share parts: some link, most are near misses; and one text is longer than a chunk."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(40)]
    texts = []
    for i in range(4500):
        words = list(base)
        for at in rng.choice(40, int(rng.integers(3, 9)), replace=False):
            words[at] = f"x{rng.integers(0, 60)}"
        texts.append(" ".join(words))
    long = " ".join(f"long{i}" for i in range(90_000))
    texts += [long, long + " more", " ".join(f"other{i}" for i in range(90_000))]
    names = {w: k for k, w in enumerate(sorted({w for t in texts[:4500] for w in t.split()}))}
    sets = np.zeros((4500, len(names)), np.float32)
    for i, t in enumerate(texts[:4500]):
        sets[i, [names[w] for w in set(t.split())]] = 1
    size = sets.sum(axis=1)
    both = sets @ sets.T
    link = 100 * both >= 80 * (size[:, None] + size[None, :] - both)
    root = np.arange(4500)
    while True:
        least = np.where(link, root[None, :], 4500).min(axis=1)
        least = np.minimum(least, least[least])
        if (least == root).all():
            break
        root = least
    assert 20 < len(set(root)) and (np.bincount(root) > 100).any()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard_components(df, Similarity(words=1, num=80)).collect()}
    assert {i: c for i, c in got.items() if i < 4500} == dict(enumerate(root.tolist()))
    assert (got[4500], got[4501], got[4502]) == (4500, 4500, 4502)


def test_components_merged_by_further_links(spark):
    rnd = random.Random(6)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(160)]
    scratch = Scratch(spark, "test")
    frame = lambda x: spark.createDataFrame(x, "a long, b long")
    whole = {r.node: r.root for r in connected_components(frame(links), scratch).collect()}
    first = connected_components(frame(links[:100]), scratch)
    for more in (links[100:], links[100:] + links[:5]):
        assert {r.node: r.root for r in merged_components(first, frame(more), scratch).collect()} == whole
    none = {r.node: r.root for r in merged_components(first, frame(links[:1]), scratch).collect()}
    assert none == {r.node: r.root for r in first.collect()}


def test_a_task_has_one_python_worker(spark):
    docs = spark.createDataFrame([(i, f"a b c d e f g {i // 2}") for i in range(40)] + [(None, "x y"), (50, None)], "doc_id long, text string")
    out = keep_one_each(docs)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect()) == [-1, *range(0, 40, 2), 50]
    runs = []
    for line in out._jdf.queryExecution().sparkPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        runs = [x for x in runs if x < depth]
        if "Join" in line or "Aggregate" in line or "Union" in line:
            runs = []
        if "ArrowEvalPython" in line or "MapInArrow" in line:
            assert not runs, line
            runs.append(depth)
