"""Set-similarity join of word n-grams by parity sketches.

A document's set of shingle hashes is folded into a bit sketch in which every
shingle flips one bit, so the Hamming distance of two sketches is at most the
size of the sets' symmetric difference.  Sets are dealt into bands by size.
In a band, two linked sets differ in at most d shingles; a sketch is cut into
more than d parts, so the sketches of two linked sets agree in a part.  The
sets that agree in a part are compared, first with the least of them; those
that are still in different components are compared with each other.  Sizes
and whole sketches rule most pairs out; the sets of the others are intersected.

Documents with equal sets are one class, and only classes are compared, so
copies cost nothing.  What agrees within a task is tied to one representative
there, and of a part that very many sets share a task sends on three; the others'
rows stay where they are until it is known which ones are still apart.  Those
meet twice: first only with the members that are close to the most others, of
which each member sees one, then with all that are still in another component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantframe.llm import kernels
from slantframe.llm.components import connected_components, merged_components
from slantframe.llm.scratch import Scratch, TEXTS, bit_filter, free_names, partitions, small_batches

#: Bits of a sketch's part.
PART_BITS = 1024
#: For so many shingles in which linked sets may differ there is one part more than they need.
SPARE = 5
#: Keys that a task gathers before it hands them on, and shingles whose parts it forms at a time.
HELD = 1_000_000
FORMED = 100_000
#: Shingles of all sets for each shard of the keys, which one task holds at a time.
SHARD = 6_000_000
#: Classes of one key that a task sends on as they are; of more it sends three.
LOCAL = 64
#: Bits a shingle of the sketches that tell near misses from links; larger sets have sketches of one bit a shingle at first.
FINE = 4
SMALL = 1024
#: Least keys of a class by which a pair that meets in several parts is told to leave but one of them.
LEAST_KEYS = 8
#: Members of a crowded part that meet in one place.
BLOCK = 4096
#: A part's key has 48 bits; two parts with one key by chance are one comparison more.
KEY = np.dtype([("key", "<u8"), ("cls", "<u8")])
PACKED = np.dtype([("low", "<u4"), ("high", "<u2"), ("cls", "<u8")])
PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])


@dataclass(frozen=True)
class Similarity:
    """Shingles of words words; sets link when their overlap is at least num / den of their union."""

    words: int = 4
    num: int = 85
    den: int = 100

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if self.num * max(len(a), len(b)) > self.den * min(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * both >= self.num * (len(a) + len(b) - both)

    def bands(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(least size of each band, most shingles in which linked sets differ).

        Linked sets lie in one band or in neighbouring ones; the second array
        bounds the difference of two sets of which the smaller lies in the band.
        """
        low = [1, 2]
        while low[-1] <= most:
            low.append(max(low[-1] + 1, (low[-1] - 1) * self.den // self.num + 1))
        largest = np.array(low[1:]) - 1
        total = largest + largest * self.den // self.num
        return np.array(low[:-1]), (self.den - self.num) * total // (self.den + self.num)


def class_of(shingles: np.ndarray) -> int:
    """A 64-bit id of a set: equal sets have equal ids."""
    total = np.array([np.add.reduce(shingles), np.bitwise_xor.reduce(shingles), len(shingles)], dtype=np.uint64)
    return int(np.bitwise_xor.reduce(kernels.mix(total * np.array([3, 5, 7], dtype=np.uint64) + np.arange(3, dtype=np.uint64))))


def part_keys(sets: list[np.ndarray], similarity: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """(keys, index of the set) of the parts of the sketches of some sets.

    A key stands for a band, a part of its sketches, that part's bits and its
    number of shingles.  Sets that differ in at most d shingles agree in t of
    d + t parts, so they agree in one of the d + 1 parts that come first in any
    order that depends on keys alone: each set sends those with the most
    shingles, since a part of few is shared by sets that have little in common.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if not len(sizes) or not sizes.max():
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    low, most = similarity.bands(int(sizes.max()))
    band = np.searchsorted(low, sizes, side="right") - 1
    flat = np.concatenate(sets)
    keys, owners = [], []
    for down in (0, 1):
        group = band - down
        use = np.flatnonzero((sizes > 0) & (group >= 0))
        use = use[most[group[use]] > 0]
        if not len(use):
            continue
        differ = most[group[use]]
        parts = differ + 1 + differ // SPARE
        take = np.isin(np.arange(len(sizes)), use)
        h = flat[np.repeat(take, sizes)]
        owner = np.repeat(np.arange(len(use)), sizes[use])
        part = ((h >> np.uint64(32)) * parts[owner].astype(np.uint64)) >> np.uint64(32)
        # Every part has a cell, those without shingles too.
        begin = np.cumsum(parts) - parts
        cell = begin[owner] + part.astype(np.int64)
        of = np.repeat(np.arange(len(use)), parts)
        salt = group[use][of].astype(np.uint64) << np.uint64(44) | (np.arange(len(of)) - begin[of]).astype(np.uint64) << np.uint64(12)
        count = np.bincount(cell, minlength=len(of))
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        bits = np.zeros(len(of), dtype=np.uint64)
        bits[cell[first]] = np.bitwise_xor.reduceat(kernels.mix(salt[cell] | (h & np.uint64(PART_BITS - 1))), first)
        key = kernels.mix(bits ^ kernels.mix(~(salt | np.minimum(count, PART_BITS - 1).astype(np.uint64))))
        order = np.lexsort((key, -count, of))
        sent = order[np.arange(len(of)) - begin[of] <= differ[of]]
        keys.append(key[sent])
        owners.append(use[of[sent]])
    if not keys:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def _sorted_unique(rows: np.ndarray) -> np.ndarray:
    names = rows.dtype.names
    rows = rows[np.lexsort((rows[names[1]], rows[names[0]]))]
    return rows[np.r_[True, rows[1:] != rows[:-1]]] if len(rows) else rows


def _stars(rows: np.ndarray, least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows to send on, pairs of each class with its key's least one, rows of crowded keys).

    Of keys with more than least classes three rows are sent on, and their
    pairs are formed; a key is crowded with three classes or more.
    """
    rows = _sorted_unique(rows)
    first = np.r_[True, rows["key"][1:] != rows["key"][:-1]] if len(rows) else np.zeros(0, dtype=bool)
    number = np.cumsum(first) - 1
    size = np.bincount(number, minlength=1)[number] if len(rows) else np.zeros(0, dtype=int)
    rank = np.arange(len(rows)) - np.flatnonzero(first)[number] if len(rows) else size
    tie = (size > least) & ~first
    pairs = np.empty(int(tie.sum()), dtype=PAIR)
    pairs["a"], pairs["b"] = rows["cls"][first][number[tie]], rows["cls"][tie]
    return rows[(size <= least) | (rank < 3)], _sorted_unique(pairs), rows[(size > least) & (size > 2)]


def _pack(rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), dtype=PACKED)
    out["low"], out["high"], out["cls"] = rows["key"] & np.uint64(0xFFFFFFFF), rows["key"] >> np.uint64(32), rows["cls"]
    return out


def _unpack(data: bytes) -> np.ndarray:
    rows = np.frombuffer(data, dtype=PACKED)
    out = np.empty(len(rows), dtype=KEY)
    out["key"], out["cls"] = rows["high"].astype(np.uint64) << np.uint64(32) | rows["low"], rows["cls"]
    return out


def _split(rows: np.ndarray, shard: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(shard, kind="stable")
    rows, shard = rows[order], shard[order]
    cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, dtype=np.int64)
    for a, b in zip(cuts, [*cuts[1:], len(shard)]):
        yield int(shard[a]), rows[a:b].tobytes()


BLOB = "kind string, shard int, data binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.binary()))], ["kind", "shard", "data"])


def _keys(docs: DataFrame, similarity: Similarity, shards: int) -> DataFrame:
    """Rows of keys (PACKED, to be joined), pairs (PAIR, found within a task) and crowds (PACKED, of crowded parts)."""
    sep = kernels.white_space()

    @kernels.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        n = 0
        for batch in batches:
            block: list[np.ndarray] = []
            ids: list[int] = []
            formed = 0
            for s in kernels.shingle_sets(batch.column(0), similarity.words, sep):
                if len(s) and (c := class_of(s)) not in seen:
                    seen.add(c)
                    block.append(s)
                    ids.append(c)
                    formed += len(s)
                if formed >= FORMED:
                    held.append(_block(block, ids))
                    n += len(held[-1])
                    block, ids, formed = [], [], 0
                if n >= HELD:
                    yield flush(held)
                    held, n = [], 0
            if block:
                held.append(_block(block, ids))
                n += len(held[-1])
        if n:
            yield flush(held)

    def _block(sets: list[np.ndarray], ids: list[int]) -> np.ndarray:
        keys, owner = part_keys(sets, similarity)
        out = np.empty(len(keys), dtype=KEY)
        out["key"], out["cls"] = keys >> np.uint64(16), np.array(ids, dtype=np.uint64)[owner]
        return out

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        sent, pairs, crowd = _stars(np.concatenate(held), LOCAL)
        out = [("key", s, d) for s, d in _split(_pack(sent), sent["key"] % np.uint64(shards))]
        out += [("pair", s, d) for s, d in _split(pairs, pairs["b"] % np.uint64(shards))]
        out += [("crowd", s, d) for s, d in _split(_pack(crowd), crowd["cls"] % np.uint64(shards))]
        return _rows(out)

    return docs.select("text").mapInArrow(run, BLOB)


def _candidates(keys: DataFrame, shards: int) -> DataFrame:
    """Joins the keys of all tasks: pairs with the least class of a part, and the rows of crowded parts."""

    @kernels.tidied
    def step(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_pylist(), table.column("data").to_pylist()
        _, pairs, crowd = _stars(_unpack(b"".join(d for k, d in zip(kinds, blobs) if k == "key")))
        out = [(k, table.column("shard")[0].as_py(), d) for k, d in zip(kinds, blobs) if k != "key"]
        out += [("pair", s, d) for s, d in _split(pairs, pairs["a"] % np.uint64(shards))]
        out += [("crowd", s, d) for s, d in _split(_pack(crowd), crowd["key"] % np.uint64(shards))]
        return pa.Table.from_batches([_rows(out)])

    return keys.groupBy("shard").applyInArrow(step, BLOB)


def _pairs(blobs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of PAIR blobs."""

    @kernels.tidied
    def step(table: pa.Table) -> pa.Table:
        pairs = _sorted_unique(np.frombuffer(b"".join(table.column("data").to_pylist()), dtype=PAIR))
        return pa.table({"a": pairs["a"].copy().view(np.int64), "b": pairs["b"].copy().view(np.int64)})

    return blobs.select("shard", "data").groupBy("shard").applyInArrow(step, "a long, b long").distinct()


def verify(pairs: DataFrame, texts: DataFrame, similarity: Similarity) -> DataFrame:
    """The pairs (a, b) of classes whose sets link; texts has a text for each class in question."""
    sep = kernels.white_space()

    @kernels.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            keep = []
            a = batch.column(0).to_pylist()
            right = kernels.shingle_sets(batch.column(3), similarity.words, sep)
            for i, other in enumerate(right):
                if left is None or a[i] != last:
                    last, left = a[i], next(kernels.shingle_sets(batch.column(2).slice(i, 1), similarity.words, sep))
                if similarity.linked(left, other):
                    keep.append(i)
            if keep:
                yield pa.RecordBatch.from_arrays([c.take(pa.array(keep)) for c in batch.columns[:2]], ["a", "b"])

    right = pairs.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _close_in_group(root: np.ndarray, n: np.ndarray, bits: list[bytes], similarity: Similarity, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the members of different components whose sketches don't rule a link out; one of them is own."""
    num, den = similarity.num, similarity.den
    lengths = np.array([len(x) for x in bits])
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for small in np.unique(lengths):
        # Those of this length meet each other and, folded to it, the longer ones.
        us, them = np.flatnonzero(lengths == small), np.flatnonzero(lengths >= small)
        rows = np.stack([np.bitwise_xor.reduce(np.frombuffer(bits[k], dtype=np.uint64).reshape(-1, small // 8), axis=0) for k in them])
        mine = rows[np.searchsorted(them, us)]
        step = max(1, (1 << 19) // rows.size)
        for x in range(0, len(us), step):
            a, at = us[x : x + step, None], them[None, :]
            ok = (num * np.maximum(n[a], n[at]) <= den * np.minimum(n[a], n[at])) & (root[a] != root[at]) & (own[a] | own[at])
            ok &= (a < at) | (lengths[at] > small)
            i, j = np.nonzero(ok)
            for y in range(0, len(i), 1 << 14):
                p, q = i[y : y + (1 << 14)], j[y : y + (1 << 14)]
                apart = np.bitwise_count(mine[x + p] ^ rows[q]).sum(axis=1, dtype=np.int64)
                keep = apart * (den + num) <= (den - num) * (n[us[x + p]] + n[them[q]])
                left.append(us[x + p[keep]])
                right.append(them[q[keep]])
    left, right = np.concatenate(left), np.concatenate(right)
    return np.minimum(left, right), np.maximum(left, right)


def _hub_pairs(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Indices of fewer pairs than there are members: those of the member with the most pairs, and so on among the members that are in none yet."""
    taken, left = [np.zeros(0, dtype=np.int64)], np.arange(len(p))
    while len(left):
        a, b = p[left], q[left]
        hub = np.bincount(np.r_[a, b]).argmax()
        own = (a == hub) | (b == hub)
        taken.append(left[own])
        seen = np.r_[a[own], b[own]]
        left = left[~(np.isin(a, seen) | np.isin(b, seen))]
    return np.concatenate(taken)


def _met_before(least: np.ndarray, p: np.ndarray, q: np.ndarray, key: int) -> np.ndarray:
    """Which pairs have a key smaller than key in common, as far as their least keys tell (-1: none)."""
    out = np.zeros(len(p), dtype=bool)
    for x in range(0, len(p), 1 << 16):
        a, b = least[p[x : x + (1 << 16)]], least[q[x : x + (1 << 16)]]
        for i in range(LEAST_KEYS):
            own = a[:, i : i + 1]
            out[x : x + (1 << 16)] |= ((own == b) & (own >= 0) & (own < key)).any(axis=1)
    return out


def _members(crowds: DataFrame) -> DataFrame:
    """(key, cls) of the members of crowded parts."""

    @kernels.tidied
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = _unpack(data)
                yield pa.RecordBatch.from_arrays([pa.array(rows["key"].view(np.int64)), pa.array(rows["cls"].view(np.int64))], ["key", "cls"])

    return crowds.select("data").mapInArrow(explode, "key long, cls long").distinct()


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, cls, root, g) of the members of crowded parts that join different components; g: how many the part has."""
    rooted = members.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("g")).where("low < high")
    return rooted.join(mixed.select("key", "g"), "key")


def _cross_pairs(apart: DataFrame, classes: DataFrame, similarity: Similarity, shards: int, hubs: bool) -> DataFrame:
    """Pairs (a, b) that share a crowded part, lie in different components, and whose sketches are close.

    They meet in blocks of BLOCK, and only close pairs leave a block, unless
    they are known to meet in a part of a smaller key as well.  With
    hubs, blocks don't meet each other, fewer pairs than members leave, and
    rows with a key instead of a pair name the parts that have more of them.
    """

    @kernels.tidied
    def compare(table: pa.Table) -> pa.Table:
        key, i, j = (table.column(c).to_numpy() for c in ("key", "i", "j"))
        cls, root, n, block = (table.column(c).to_numpy() for c in ("cls", "root", "n", "block"))
        bits, keys = table.column("sketch").to_pylist(), table.column("keys").to_pylist()
        least = np.full((len(keys), LEAST_KEYS), -1, dtype=np.int64)
        for row, own in zip(least, keys):
            row[: len(own)] = own
        order = np.lexsort((cls, j, i, key))
        place = np.stack([key, i, j])[:, order]
        cuts = np.flatnonzero(np.r_[True, (place[:, 1:] != place[:, :-1]).any(axis=0)]) if len(order) else np.zeros(0, dtype=np.int64)
        a, b, more = [], [], []
        for x, y in zip(cuts, [*cuts[1:], len(order)]):
            at = order[x:y]
            if len(at) > 1 and (root[at] != root[at[0]]).any():
                # Of two blocks, a pair of one block is left to that block's own meeting.
                own = block[at] == i[at[0]]
                p, q = _close_in_group(root[at], n[at], [bits[k] for k in at], similarity, own)
                if i[at[0]] != j[at[0]]:
                    p, q = p[own[p] != own[q]], q[own[p] != own[q]]
                keep = np.flatnonzero(~_met_before(least[at], p, q, key[at[0]]))
                p, q = p[keep], q[keep]
                if hubs:
                    some = _hub_pairs(p, q)
                    if len(some) < len(p):
                        more.append(key[at[0]])
                    p, q = p[some], q[some]
                a.append(cls[at][p])
                b.append(cls[at][q])
        pairs = np.stack([np.concatenate(a), np.concatenate(b)]) if a else np.zeros((2, 0), dtype=np.int64)
        pairs = np.unique(pairs, axis=1)
        out = pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64()), "key": pa.nulls(pairs.shape[1], pa.int64())})
        return pa.concat_tables([out, pa.table({"a": pa.nulls(len(more), pa.int64()), "b": pa.nulls(len(more), pa.int64()), "key": pa.array(more, pa.int64())})])

    met = apart.withColumn("blocks", F.ceil(F.col("g") / BLOCK).cast("int"))
    least = met.groupBy("cls").agg(F.slice(F.sort_array(F.collect_set("key")), 1, LEAST_KEYS).alias("keys"))
    met = met.join(classes.join(least, "cls"), "cls")
    met = met.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = met.withColumn("other", F.col("block") if hubs else F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "cls", "root", "n", "sketch", "keys", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("key", "i", "j"), F.lit(4 * shards)).cast("int"))
    found = dealt.groupBy("shard").applyInArrow(compare, "a long, b long, key long")
    if not hubs:
        return found.distinct()
    wide = apart.where(F.col("g") > BLOCK).select(F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), "key")
    return found.unionAll(wide).distinct()


def sketch(shingles: np.ndarray, fine: int | None = None) -> bytes:
    """A bit sketch of a power of two of bits, about fine bits a shingle: each shingle flips one bit."""
    if fine is None:
        fine = FINE if len(shingles) <= SMALL else 1
    bits = max(256, 1 << max(0, fine * len(shingles) - 1).bit_length())
    at = (shingles >> np.uint64(7)) % np.uint64(bits)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits) & 1 == 1).tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Differing bits of two sketches, the larger one folded to the size of the other."""
    x, y = (np.frombuffer(s, dtype=np.uint8) for s in (a, b))
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(s.reshape(-1, n), axis=0) for s in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def near(pairs: DataFrame, classes: DataFrame, similarity: Similarity) -> DataFrame:
    """The pairs whose sizes and sketches don't rule a link out."""
    num, den = similarity.num, similarity.den

    @kernels.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (na, sa, nb, sb) in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:]))):
                if num * max(na, nb) <= den * min(na, nb) and hamming(sa, sb) * (den + num) <= (den - num) * (na + nb):
                    keep.append(i)
            if keep:
                yield pa.RecordBatch.from_arrays([c.take(pa.array(keep)) for c in batch.columns[:2]], ["a", "b"])

    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(run, "a long, b long")


def _class_filter(classes: DataFrame) -> np.ndarray:
    """A bit for each class (cls); at most 2**27 bits reach the driver."""
    classes = classes.select(F.col("cls").alias("key")).distinct()
    bits = 1 << max(12, min(27, (16 * max(1, classes.count())).bit_length()))
    return bit_filter(classes, bits)


def _texts(docs: DataFrame, flags: np.ndarray, similarity: Similarity) -> DataFrame:
    """(cls, text): a text of each class that the filter lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(flags)
    sep, bits = kernels.white_space(), len(flags) * 8

    @kernels.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keep, ids = [], []
            for i, s in enumerate(kernels.shingle_sets(batch.column(0), similarity.words, sep)):
                if len(s) and (c := class_of(s)) not in seen:
                    at = c % bits
                    if shared.value[at >> 3] >> (at & 7) & 1:
                        seen.add(c)
                        keep.append(i)
                        ids.append(c)
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, dtype=np.uint64).view(np.int64)), batch.column(0).take(pa.array(keep))], ["cls", "text"])

    found = docs.select("text").mapInArrow(run, "cls long, text string")
    return found.dropDuplicates(["cls"])


def _fine_sketches(texts: DataFrame, similarity: Similarity) -> DataFrame:
    """(cls, n, sketch): sketches of FINE bits a shingle, which tell near misses from links."""
    sep = kernels.white_space()

    @kernels.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(s), sketch(s, FINE)) for s in kernels.shingle_sets(batch.column(1), similarity.words, sep)]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.binary())))], ["cls", "n", "sketch"])

    return texts.select("cls", "text").mapInArrow(run, "cls long, n long, sketch binary")


def _meta(docs: DataFrame, similarity: Similarity) -> DataFrame:
    sep = kernels.white_space()
    kind = docs.schema["doc_id"].dataType.simpleString()

    @kernels.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, sketches = [], [], []
            for s in kernels.shingle_sets(batch.column(1), similarity.words, sep):
                sizes.append(len(s))
                sketches.append(sketch(s) if len(s) else None)
                ids.append(np.uint64(class_of(s)).astype(np.int64).item() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(sketches, pa.binary())], ["doc_id", "n_shingles", "cls", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, cls long, sketch binary")


def jaccard_components(docs: DataFrame, similarity: Similarity = Similarity(), keep_class: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs; with keep_class also cls, a number of its set (null: none).

    Words are runs of bytes other than white space, A-Z lower-cased.  A text
    of fewer words than a shingle has its whole sequence as one; a null text
    or one without words has none and links with nothing.  component_id is
    the least doc_id reachable by links, the row's own included.  Rows count
    by themselves; a null doc_id is in a component but never names it unless
    all ids are null; other columns are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    with small_batches(spark, TEXTS):
        meta = scratch.save(_meta(docs, similarity))
    shards = max(partitions(spark), (meta.agg(F.sum("n_shingles")).first()[0] or 0) // SHARD)
    sketches = scratch.save(meta.where("cls is not null").select("cls", F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["cls"]))
    with small_batches(spark, TEXTS):
        found = scratch.save(_candidates(_keys(docs, similarity, shards), shards))
    pairs = scratch.save(_pairs(found.where("kind = 'pair'")))

    def texts_of(classes: DataFrame) -> DataFrame:
        with small_batches(spark, TEXTS):
            return scratch.save(_texts(docs, _class_filter(classes), similarity))

    def checked(close: DataFrame, texts: DataFrame) -> DataFrame:
        with small_batches(spark):
            out = scratch.save(verify(close, texts, similarity))
        scratch.drop(close, texts)
        return out

    def ends(close: DataFrame) -> DataFrame:
        return close.select(F.explode(F.array("a", "b")).alias("cls"))

    close = scratch.save(near(pairs, sketches, similarity))
    links = checked(close, texts_of(ends(close)))
    roots = connected_components(links, scratch)
    members = scratch.save(_members(found.where("kind = 'crowd'")))
    scratch.drop(found, pairs)
    met = scratch.save(_cross_pairs(_apart(members, roots), sketches, similarity, shards, hubs=True))
    close = met.where("key is null").select("a", "b")
    texts = texts_of(ends(close))
    fine = scratch.save(_fine_sketches(texts, similarity))
    more = checked(scratch.save(near(close, fine, similarity)), texts)
    first, roots = roots, merged_components(roots, more, scratch)
    scratch.drop(first, more, links, sketches, fine)
    rest = scratch.save(_apart(members.join(met.where("key is not null").select("key").distinct(), "key", "left_semi"), roots))
    texts = texts_of(rest)
    fine = scratch.save(_fine_sketches(texts, similarity))
    close = scratch.save(_cross_pairs(rest, fine, similarity, shards, hubs=False).select("a", "b"))
    scratch.drop(members, met, rest, fine)
    more = checked(close, texts)
    first, roots = roots, merged_components(roots, more, scratch)
    scratch.drop(first, more)
    classes = meta.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    rooted = classes.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.save(rooted.join(names, "root").select("cls", "component_id"))
    scratch.drop(roots)
    return meta.join(named, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *["cls"] * keep_class)


def _classed(docs: DataFrame, similarity: Similarity, name: str, maybe: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of docs that maybe lets through by the hashes in the last column, with the number of each text's set in its place.

    Rows are chosen here, not by a function before this one: a task with two Python functions has two workers.
    """
    sep, text, words, names = kernels.white_space(), docs.columns.index("text"), similarity.words, [*docs.columns[:-1], name]

    @kernels.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(maybe(batch.columns[-1].to_numpy())))
            if not batch.num_rows:
                continue
            ids = [np.uint64(class_of(s)).astype(np.int64).item() if len(s) else None for s in kernels.shingle_sets(batch.column(text), words, sep)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.int64())], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return docs.mapInArrow(run, f"{kinds}, `{name}` long")


def keep_one_each(docs: DataFrame, similarity: Similarity = Similarity(words=5, num=80)) -> DataFrame:
    """One row of each component, those with a null id, and those without words.

    A component keeps a row with the id that names it, one if there are
    several; rows are told apart by their id and their text's set, so a row
    stays though its namesake goes.  Only rows that may go are shuffled: a
    filter of bounded size over the ids that go tells which.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "distinct")
    found = scratch.save(jaccard_components(docs, similarity, keep_class=True).where("cls is not null and doc_id is not null"))
    gone, again, cls, group, maybe_ = free_names(docs.columns, "gone", "again", "cls", "group", "maybe")
    rows = found.groupBy(F.col("doc_id").alias(gone), F.col("cls").alias(cls), F.col("component_id").alias(group)).agg(F.count("*").alias("n"))
    least = F.col(gone) == F.col(group)
    several = rows.where(least).groupBy(gone, group).agg(F.sum("n").alias("n")).where("n > 1").select(gone, group)
    goes = rows.where(~least).select(gone, cls, group, F.lit(False).alias(again))
    marked = scratch.save(goes.unionAll(rows.where(least).join(several, [gone, group]).select(gone, cls, group, F.lit(True))))
    bits = 1 << max(12, min(27, (16 * max(1, marked.count())).bit_length()))
    shared = spark.sparkContext.broadcast(bit_filter(marked.select(F.xxhash64(gone).alias("key")), bits))

    def marks(hashes: np.ndarray) -> np.ndarray:
        at = (hashes.view(np.uint64) % np.uint64(bits)).astype(np.int64)
        return ((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)

    @F.pandas_udf("boolean")
    def maybe(hashes: pd.Series) -> pd.Series:
        return pd.Series(marks(hashes.to_numpy()))

    hashed = F.xxhash64("doc_id")
    (own,) = free_names([*docs.columns, cls], "own")
    some = _classed(docs.withColumn(maybe_, hashed), similarity, own, marks)
    met = some.join(marked, (F.col("doc_id") == F.col(gone)) & (F.col(own) == F.col(cls)), "left")
    sure = met.where(F.col(gone).isNull()).select(*docs.columns)
    one = met.where(F.col(again)).dropDuplicates([gone, group]).select(*docs.columns)
    return docs.where(~maybe(hashed)).unionAll(sure).unionAll(one)
