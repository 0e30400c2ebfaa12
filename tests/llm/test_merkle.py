import hashlib
import zlib

from slantframe.llm.merkle import manifest
from slantframe.llm.queries import tampered


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r):
    return H(*["-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in ("doc_id", "source", "lang", "n_chars", "text")])


def climb(nodes):
    """(root, siblings of each node: [(left, right), ...])."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for p, i in zip(paths, at):
            run, j = runs[i // 3], i % 3
            p.append((run[:j], run[j + 1 :]))
        at = [i // 3 for i in at]
        nodes = [H(*r) for r in runs]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs, out = [], []
    for k in keys:
        groups[k].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        subs.append(climb([leaf_of(r) for r in groups[k]]))
    root, over = climb([s for s, _ in subs])
    for k, (sub, paths), up in zip(keys, subs, over):
        for r, path in zip(groups[k], paths):
            steps = path + up
            now = dict(r)
            if r["text"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                now["text"] = r["text"].replace("\n", "")
            folded = leaf_of(now)
            for left, right in steps:
                folded = H(*left, folded, *right)
            proof = H(*[x for left, right in steps for x in left + right])
            out.append((r["doc_id"], leaf_of(r), sub, root, proof, folded, folded == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx int, `range` string"


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    want = brute([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows])
    assert sorted((tuple(r) for r in tampered(docs).select(*COLUMNS).collect()), key=str) == want
    return want


def test_equals_brute_force(spark):
    rows = [(i, f"line {i}\nmore é" * (i % 5), "en", f"s{i % 4 if i % 3 else 9}", i) for i in range(240)]
    rows += [(500, None, None, None, None), (None, "a\nb", "de", None, 3), (None, None, None, None, None), (501, "", "", "", 0), (-7, "\n\n", "fr", "é", -2), (502, "x" * 200_000 + "\n", "en", "\U00010000", 5), (503, "b", "en", "￿", 5)]
    rows += [(600, "same\n", "en", "ties", 1)] * 7 + [(600, "other", "en", "ties", 1)] * 3
    want = check(spark, rows)
    assert {x[-1] for x in want} == {True, False}


def test_one_row_one_source_and_sizes(spark):
    check(spark, [(8, "a\nb", "en", "s", 1)])
    for n in (3, 4, 10):
        check(spark, [(i, f"t\n{i}", "en", "s" if n < 10 else f"s{i}", 1) for i in range(n)])


def test_empty_table_and_nothing_changed(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert manifest(docs).count() == 0
    docs = spark.createDataFrame([(i, f"t\n{i}", "en", None, 1, 1, "") for i in range(11)], SCHEMA)
    got = manifest(docs, fanout=2).collect()
    assert all(r.verified for r in got) and len({r.root for r in got}) == 1 and [len(r.steps) for r in got] == [4] * 11
    assert sorted(r.idx for r in got) == list(range(11))
