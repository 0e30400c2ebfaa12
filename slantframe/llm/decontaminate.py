"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a seed (a run of LEAST words) are
tiled: the longest common run of words that no tile covers yet is found by
Karp-Rabin hashes of running length, marked in both, and so on down to LEAST
words.  A document whose tiles cover enough of an item is contaminated, in
whatever order the passages stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantframe.llm import kernels
from slantframe.llm.scratch import bit_filter, free_names

#: Words of a seed, and the shortest tile.
LEAST = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.5
#: Benchmarks of at most so many seeds are broadcast; larger ones are joined.
BROADCAST_SEEDS = 1_000_000
FILTER_BITS = 1 << 24
SEPARATORS = kernels.not_alphanumeric()


def _runs(tokens: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the runs of size words that are all free."""
    if len(tokens) < size:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    taken = np.r_[0, np.cumsum(~free)]
    starts = np.flatnonzero(taken[size:] == taken[:-size])
    sums = kernels.value_sums(tokens)
    return starts, kernels.span_hashes(sums, starts, starts + size)


def covered(item: np.ndarray, text: np.ndarray, free: np.ndarray | None = None, least: int = LEAST) -> int:
    """How many words of item the tiles of item and text cover; free: words of text that tiles may use."""
    own, other = np.ones(len(item), dtype=bool), np.ones(len(text), dtype=bool) if free is None else free.copy()
    most = min(len(item), len(text))
    while most >= least:
        low, high = least - 1, most
        while low < high:
            size = (low + high + 1) // 2
            if len(np.intersect1d(_runs(item, own, size)[1], _runs(text, other, size)[1])):
                low = size
            else:
                high = size - 1
        if low < least:
            break
        most = low
        at, keys = _runs(text, other, most)
        order = np.argsort(keys, kind="stable")
        at, keys = at[order], keys[order]
        for i, key in zip(*(x.tolist() for x in _runs(item, own, most))):
            if own[i : i + most].all():
                place = int(np.searchsorted(keys, np.uint64(key)))
                while place < len(keys) and int(keys[place]) == key:
                    j = int(at[place])
                    if other[j : j + most].all():
                        own[i : i + most] = False
                        other[j : j + most] = False
                        break
                    place += 1
    return int((~own).sum())


def words_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text."""
    data, offsets = kernels.utf8(column)
    for a, b in kernels.chunks(offsets):
        hashes, bounds, _, _ = kernels.words(data[offsets[a] : offsets[b]], offsets[a : b + 1], SEPARATORS)
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield hashes[x:y]


def share(item: np.ndarray, text: np.ndarray) -> float:
    """Share of item that tiles cover; text is cut down to where it shares seeds with item first."""
    if len(item) < LEAST or len(text) < LEAST:
        return 0.0
    hit = np.isin(kernels.shingles(text, LEAST), kernels.shingles(item, LEAST))
    near = np.zeros(len(text) + 1, dtype=np.int64)
    at = np.flatnonzero(hit)
    near[at] += 1
    np.add.at(near, at + LEAST, -1)
    free = np.cumsum(near)[:-1] > 0
    keep = free | np.r_[False, free[:-1]]
    return covered(item, text[keep], free[keep]) / len(item)


def find_contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, broadcast_seeds: int = BROADCAST_SEEDS, keep: bool = False) -> DataFrame:
    """doc_id, item_id, coverage and contaminated of every row of docs.

    item_id is the item (the least one, if several) of which the text covers
    the largest share, null where no seed is shared; contaminated is 1 if the
    share is at least coverage.  Words are runs of letters, digits and
    non-ASCII characters, A-Z lower-cased.  Null texts are empty; items of
    fewer than LEAST words or with a null id take no part; each text of a
    repeated item_id counts; repeated rows give a row each.  With keep, all
    columns of docs are returned and, behind them, leak_item, leak_coverage
    and leak, with underscores behind a name that docs has.
    """
    docs = docs if keep else docs.select("doc_id", "text")
    items = benchmark.where("item_id is not null").select("item_id", "text")
    out = _broadcast(docs, items, coverage, broadcast_seeds) or _joined(docs, items, coverage)
    return out if keep else out.toDF("doc_id", "text", "item_id", "coverage", "contaminated").drop("text")


def _names(docs: DataFrame) -> list[str]:
    return free_names(docs.columns, "leak_item", "leak_coverage", "leak")


def _schema(docs: DataFrame, kind: str) -> str:
    item, part, leak = _names(docs)
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{item}` {kind}, `{part}` double, `{leak}` int"])


def _broadcast(docs: DataFrame, items: DataFrame, coverage: float, most: int) -> DataFrame | None:
    """One pass over docs with the items broadcast; None if they have more than most seeds."""
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > 2 * most:  # a word has two characters with what follows it, at least
        return None
    got = sorted((r[0], r[1]) for r in items.select("item_id", F.coalesce("text", F.lit(""))).collect())
    tokens = list(words_of(pa.array([t for _, t in got], pa.string()))) if got else []
    found = [(k, s) for k, t in enumerate(tokens) if len(t) >= LEAST for s in (kernels.shingles(t, LEAST),)]
    seeds = np.concatenate([s for _, s in found]) if found else np.zeros(0, dtype=np.uint64)
    owner = np.concatenate([np.full(len(s), k) for k, s in found]) if found else np.zeros(0, dtype=np.int64)
    order = np.argsort(seeds, kind="stable")
    quick = np.zeros(1 << 20, dtype=bool)
    quick[(seeds & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    kind = items.schema["item_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(([i for i, _ in got], tokens, seeds[order], owner[order], quick))
    text, names = docs.columns.index("text"), [*docs.columns, *_names(docs)]

    @kernels.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tokens, seeds, owner, quick = shared.value
        low = np.uint64(len(quick) - 1)
        for batch in batches:
            best, shares = [], []
            for words in words_of(batch.column(text)):
                item, most = None, 0.0
                runs = kernels.shingles(words, LEAST)
                runs = np.unique(runs[quick[(runs & low).astype(np.int64)]])
                if len(runs):
                    a, b = np.searchsorted(seeds, runs), np.searchsorted(seeds, runs, side="right")
                    for k in np.unique(np.concatenate([owner[x:y] for x, y in zip(a, b)])):
                        part = share(tokens[k], words)
                        if part > most:
                            item, most = ids[k], part
                best.append(item)
                shares.append(most)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, _arrow(kind)), pa.array(shares), pa.array([int(x >= coverage) for x in shares], pa.int32())], names)

    return docs.mapInArrow(run, _schema(docs, kind))


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())


def _seeds(rows: DataFrame, id_name: str, kind: str, flags=None) -> DataFrame:
    """(id, seed) of the distinct seeds of each text (columns id, text)."""

    @kernels.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for i, words in enumerate(words_of(batch.column(1))):
                runs = np.unique(kernels.shingles(words, LEAST))
                if flags is not None and len(runs):
                    at = (runs % np.uint64(len(flags.value) * 8)).astype(np.int64)
                    runs = runs[(flags.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
                ids.append(np.full(len(runs), i))
                found.append(runs)
            if found and sum(map(len, found)):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(ids))), pa.array(np.concatenate(found).view(np.int64))], [id_name, "seed"])

    return rows.mapInArrow(run, f"{id_name} {kind}, seed long")


def _joined(docs: DataFrame, items: DataFrame, coverage: float) -> DataFrame:
    """Seeds, texts and items joined by shuffles; a filter of bounded size drops most seeds first."""
    kind = items.schema["item_id"].dataType.simpleString()
    theirs = _seeds(items, "item_id", kind)
    flags = docs.sparkSession.sparkContext.broadcast(bit_filter(theirs.select(F.col("seed").alias("key")), FILTER_BITS))
    (own,) = free_names(docs.columns, "key")
    keyed = docs.withColumn(own, F.sha2(F.coalesce("text", F.lit("")), 256))
    texts = keyed.select(F.col(own).alias("key"), F.col("text").alias("doc_text")).dropDuplicates(["key"])
    pairs = _seeds(texts, "key", "string", flags).join(theirs, "seed").select("key", "item_id").distinct()

    @kernels.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = [share(item, text) for text, item in zip(words_of(batch.column(2)), words_of(batch.column(3)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(shares, pa.float64())], ["key", "item_id", "share"])

    both = pairs.join(items.distinct(), "item_id").join(texts, "key").select("key", "item_id", "doc_text", "text")
    scored = both.mapInArrow(run, f"key string, item_id {kind}, share double").where("share > 0")
    # The largest share comes first, among equal ones the least item.
    best = scored.groupBy("key").agg(F.min(F.struct((-F.col("share")).alias("less"), "item_id")).alias("b"))
    item, part, leak = _names(docs)
    found = best.select(F.col("key").alias(own), F.col("b.item_id").alias(item), (-F.col("b.less")).alias(part))
    out = keyed.join(found, own, "left").fillna(0.0, [part]).withColumn(leak, (F.col(part) >= coverage).cast("int"))
    return out.select(*docs.columns, item, part, leak)
