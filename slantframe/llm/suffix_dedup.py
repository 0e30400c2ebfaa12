"""Removal of long repeated byte strings by a logarithmic family of suffix arrays.

Which suffixes are indexed is decided by content: of every string of LENGTH
bytes, the suffix at its least hashed gram of GRAM bytes.  Both places of a
repeated string therefore index the same suffix.  An entry orders its suffix
by the fingerprint of its first GRAM bytes (equal heads are neighbours, and
shards by fingerprint are even), and a sorted run of entries is a sparse
suffix array.

A batch of texts becomes such a run, is merge-scanned against the arrays of
all levels for heads that occur again, and arrays of equal level are merged
as in a binary counter, so that a text is rewritten a logarithmic number of
times.  Arrays keep one entry a head; every entry that meets an equal one is
reported as a hit.

Hits are then made exact.  A hit whose whole surroundings (all strings of
LENGTH bytes that hold the head) occur again needs no more work.  For the
others, the single strings that index the head are compared by their hashes.  Equality is that of 64-bit hashes throughout.

Equal texts are one entity; a text that occurs twice is removed as a whole.
Everything that meets in one task is a shard of fixed share, and what is alike
within a task is sent on once, so that a passage that a third of all texts
hold is no larger than a rare one.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantframe.llm import kernels
from slantframe.llm.scratch import Scratch, TEXTS, bit_filter, free_names, partitions, small_batches

LENGTH, GRAM = 200, 100
WINDOWS = LENGTH - GRAM + 1
BATCHES = 4
#: Entries that a task gathers before it hands them on.
HELD = 600_000

ENTRY = np.dtype([("fp", "<u8"), ("ent", "<u8"), ("pos", "<i8")])
HIT = np.dtype([("ent", "<u8"), ("pos", "<i8")])
CONTEXT = np.dtype([("key", "<u8"), ("fp", "<u8"), ("at", "<i4")])
HEAD = np.dtype([("fp", "<u8"), ("at", "<i4")])
WINDOW = np.dtype([("key", "<u8"), ("at", "<i4")])
#: Bytes of all texts for each shard, which one task holds at a time, and shards at most (a table's buckets).
SHARD_BYTES, MOST_SHARDS = 24 << 20, 100_000
#: Bits of the broadcast filter of texts with hits, at most.
FILTER_BITS = 1 << 27


def heads(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, places, fingerprints): each LENGTH-byte string of a chunk's texts and its indexed suffix.

    The suffix is the leftmost one with the least hash, so it depends on the
    string alone.
    """
    local = offsets - offsets[0]
    sizes = np.maximum(0, np.diff(local) - LENGTH + 1)
    total = int(sizes.sum())
    if not total:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64)
    hashes = kernels.window_hashes(kernels.prefix_sums(data, kernels.EXACT), GRAM)
    bits = np.uint64(max(20, int(len(hashes)).bit_length()))
    place = np.uint64((1 << int(bits)) - 1)
    least = kernels.sliding_min((hashes & ~place) | np.arange(len(hashes), dtype=np.uint64), WINDOWS)
    starts = np.repeat(local[:-1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
    at = (least[starts] & place).astype(np.int64)
    return starts, at, hashes[at]


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, fingerprints) of the indexed suffixes of the texts of a chunk, in order."""
    _, at, fps = heads(data, offsets)
    new = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, dtype=bool)
    return at[new], fps[new]


def entity(text: memoryview | bytes) -> tuple[int, str]:
    """(64-bit id, full digest) of a text."""
    digest = hashlib.sha256(text)
    return int.from_bytes(digest.digest()[:8], "little"), digest.hexdigest()


def _split(rows: np.ndarray, shard: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The rows of each shard as bytes."""
    order = np.argsort(shard, kind="stable")
    rows, shard = rows[order], shard[order]
    cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, dtype=np.int64)
    for a, b in zip(cuts, [*cuts[1:], len(shard)]):
        yield int(shard[a]), rows[a:b].tobytes()


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of group, size of own group) for each of sorted keys."""
    first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, dtype=bool)
    number = np.cumsum(first) - 1
    return first, np.bincount(number, minlength=1)[number] if len(keys) else np.zeros(0, dtype=np.int64)


def _joined(blobs: list, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=kind)


def _hits_of(rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), dtype=HIT)
    out["ent"], out["pos"] = rows["ent"], rows["pos"]
    return out


def _new_run(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted run with one entry a head, hits among the rows)."""
    rows = rows[np.lexsort((rows["pos"], rows["ent"], rows["fp"]))]
    if len(rows):
        rows = rows[np.r_[True, rows[1:] != rows[:-1]]]
    first, size = _groups(rows["fp"])
    return rows[first], _hits_of(rows[size > 1])


def _table(columns: list, names: list[str], types: list[pa.DataType]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


_BLOB = ([("kind", pa.string()), ("shard", pa.int32()), ("data", pa.binary())], "kind string, shard int, data binary")
_PIECE = ([("shard", pa.int32()), ("home", pa.int32()), ("data", pa.binary())], "shard int, home int, data binary")


def _rows(rows: list[tuple], layout) -> pa.Table:
    fields = layout[0]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return _table(columns, [n for n, _ in fields], [t for _, t in fields])


class SuffixIndexFamily:
    """Levels of sparse suffix arrays in the shared folder; add takes batches of entries."""

    def __init__(self, scratch: Scratch, shards: int) -> None:
        self.scratch, self.shards = scratch, shards
        self.levels: dict[int, DataFrame] = {}

    def add(self, entries: DataFrame) -> DataFrame:
        """Takes a batch (shard, data: ENTRY rows); returns the hits it made (shard, data: HIT rows).

        shard of a hit is that of its text.
        """
        shards, level = self.shards, 0
        while level in self.levels:
            level += 1
        merged = [self.levels.pop(k) for k in range(level)]
        rows = entries.select(F.lit("new").alias("kind"), "shard", "data")
        for name, frames in (("merge", merged), ("scan", list(self.levels.values()))):
            for frame in frames:
                rows = rows.unionAll(frame.where("kind = 'level'").select(F.lit(name), "shard", "data"))

        @kernels.tidied
        def step(table: pa.Table) -> pa.Table:
            blobs: dict[str, list] = {"new": [], "merge": [], "scan": []}
            for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist()):
                blobs[kind].append(data)
            new, hits = _new_run(_joined(blobs["new"], ENTRY))
            found = [hits]
            parts = [new]
            for kind in ("merge", "scan"):
                for data in blobs[kind]:
                    old = np.frombuffer(data, dtype=ENTRY)
                    at = np.minimum(np.searchsorted(old["fp"], new["fp"]), len(old) - 1)
                    same = old["fp"][at] == new["fp"]
                    found += [_hits_of(new[same]), _hits_of(old[at[same]])]
                    if kind == "merge":
                        parts.append(old)
            array = np.concatenate(parts)
            array = array[np.argsort(array["fp"], kind="stable")]
            array = array[_groups(array["fp"])[0]] if len(array) else array
            out = [("level", table.column("shard")[0].as_py(), array.tobytes())] if len(array) else []
            hit = np.unique(np.concatenate(found))
            out += [("hit", s, data) for s, data in _split(hit, hit["ent"] % np.uint64(shards))]
            return _rows(out, _BLOB)

        path = self.scratch.path()
        rows.groupBy("shard").applyInArrow(step, _BLOB[1]).write.partitionBy("kind").parquet(path)
        for old in merged:
            self.drop(old)
        done = self.scratch.spark.read.schema("shard int, data binary, kind string").parquet(path)
        done._scratch_path = path
        self.levels[level] = done
        return done.where("kind = 'hit'").select("shard", "data")

    def drop(self, level: DataFrame) -> None:
        """Deletes a level's arrays; the hits that came with them stay."""
        self.scratch.drop_path(f"{level._scratch_path}/kind=level")


def _scan(docs: DataFrame, shards: int, batches: int) -> DataFrame:
    """Rows of three kinds: meta (a document), entry (a batch's ENTRY rows of a shard) and hit (HIT rows)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["kind", "doc_id", "ent", "n_bytes", "sha", "batch", "shard", "data"]

    @kernels.tidied
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        ids = None
        for batch in rows:
            ids = batch.column(0).type
            data, offsets = kernels.utf8(batch.column(1))
            ents = np.zeros(batch.num_rows, dtype=np.uint64)
            shas = []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                ents[i], sha = entity(data[a:b])
                shas.append(sha)
            for a, b in kernels.chunks(offsets):
                at, fps = anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1])
                if len(at):
                    text = np.searchsorted(offsets[a : b + 1] - offsets[a], at, side="right") - 1
                    out = np.empty(len(at), dtype=ENTRY)
                    out["fp"], out["ent"], out["pos"] = fps, ents[a + text], at - (offsets[a + text] - offsets[a])
                    held.append(out)
                    n += len(out)
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(["meta"] * m), batch.column(0), pa.array(ents.view(np.int64)), pa.array(np.diff(offsets)), pa.array(shas), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
            if n >= HELD:
                yield from flush(held, ids)
                held, n = [], 0
        if n:
            yield from flush(held, ids)

    def flush(held: list[np.ndarray], ids: pa.DataType) -> Iterator[pa.RecordBatch]:
        run, hits = _new_run(np.concatenate(held))
        out = []
        number = (run["ent"] >> np.uint64(32)) % np.uint64(batches)
        for k in range(batches):
            own = run[number == k]
            out += [("entry", k, s, d) for s, d in _split(own, own["fp"] % np.uint64(shards))]
        out += [("hit", None, s, d) for s, d in _split(hits, hits["ent"] % np.uint64(shards))]
        m = len(out)
        kinds, number, shard, blobs = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.nulls(m, ids), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), pa.array(number, pa.int32()), pa.array(shard, pa.int32()), pa.array(blobs, pa.binary())], names)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"kind string, doc_id {kind}, ent long, n_bytes long, sha string, batch int, shard int, data binary")


def _hit_filter(hits: DataFrame, bits: int) -> np.ndarray:
    """A bit for each text with hits; at most FILTER_BITS bits reach the driver."""
    block = 1 << 15

    def marks(table: pa.Table) -> pa.Table:
        ents = np.unique(_joined(table.column("data").to_pylist(), HIT)["ent"])
        own = np.unique((ents % np.uint64(bits)).astype(np.int64))
        out = []
        for b in np.unique(own // block):
            flags = np.zeros(block, dtype=bool)
            flags[own[own // block == b] - b * block] = True
            out.append(("bits", int(b), np.packbits(flags, bitorder="little").tobytes()))
        return _rows(out, _BLOB)

    def either(table: pa.Table) -> pa.Table:
        flags = np.bitwise_or.reduce([np.frombuffer(x, dtype=np.uint8) for x in table.column("data").to_pylist()])
        return _rows([("bits", table.column("shard")[0].as_py(), flags.tobytes())], _BLOB)

    out = np.zeros(-(-bits // block) * block // 8, dtype=np.uint8)
    for r in hits.groupBy("shard").applyInArrow(marks, _BLOB[1]).groupBy("shard").applyInArrow(either, _BLOB[1]).collect():
        out[r["shard"] * (block // 8) : (r["shard"] + 1) * (block // 8)] = np.frombuffer(r["data"], dtype=np.uint8)
    return out


def _texts(docs: DataFrame, flags: np.ndarray, bits: int, shards: int) -> DataFrame:
    """(shard, ent, text) of the texts that the filter lets through, once a task."""
    shared = docs.sparkSession.sparkContext.broadcast(flags)

    @kernels.tidied
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in rows:
            out = []
            for text in batch.column(0):
                raw = memoryview(text.as_buffer()) if text.is_valid else b""
                if len(raw) < LENGTH:
                    continue
                ent, _ = entity(raw)
                at = ent % bits
                if shared.value[at >> 3] >> (at & 7) & 1 and ent not in seen:
                    seen.add(ent)
                    out.append((ent % shards, np.uint64(ent).astype(np.int64), bytes(raw)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary()))], ["shard", "ent", "text"])

    return docs.select(F.col("text").cast("binary")).mapInArrow(run, "shard int, ent long, text binary")


def _with_hits(texts: pa.Table, hits: pa.Table) -> pa.Table:
    """(shard, ent, text, hits) of the texts of a shard that have hits."""
    own = np.unique(_joined(hits.column("data").to_pylist(), HIT))
    out, seen = [], set()
    ents = texts.column("ent").to_numpy().view(np.uint64)
    lo, hi = np.searchsorted(own["ent"], ents), np.searchsorted(own["ent"], ents, side="right")
    for i in np.flatnonzero(hi > lo):
        if ents[i] not in seen:
            seen.add(ents[i])
            out.append((texts.column("shard")[0].as_py(), int(ents[i].astype(np.int64)), texts.column("text")[int(i)].as_py(), own["pos"][lo[i] : hi[i]].tobytes()))
    return _table(list(zip(*out)) if out else [[]] * 4, ["shard", "ent", "text", "hits"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()])


class _Shard:
    """The texts of a shard that have hits, one after the other, in the order of their entities."""

    def __init__(self, table: pa.Table) -> None:
        order = np.argsort(table.column("ent").to_numpy(), kind="stable")
        self.ents = table.column("ent").to_numpy()[order]
        column = table.column("text").combine_chunks().take(pa.array(order))
        self.data, self.offsets = kernels.utf8(column)
        places = table.column("hits").to_pylist()
        places = [np.frombuffer(places[i], dtype=np.int64) for i in order]
        self.text = np.repeat(np.arange(len(order)), [len(p) for p in places])
        pos = np.concatenate(places) if places else np.zeros(0, dtype=np.int64)
        self.at = self.offsets[self.text] + pos
        self.lo = np.maximum(self.offsets[self.text], self.at - (LENGTH - GRAM))
        self.hi = np.minimum(self.offsets[self.text + 1], self.at + LENGTH)

    def chunks(self) -> Iterator[tuple[int, int, int, int]]:
        """(first text, text after the last, first hit, hit after the last) of each chunk."""
        for a, b in kernels.chunks(self.offsets):
            yield a, b, *np.searchsorted(self.text, [a, b])

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """(key of the surroundings, fingerprint of the head) of each hit."""
        keys, fps = np.zeros(len(self.at), dtype=np.uint64), np.zeros(len(self.at), dtype=np.uint64)
        for a, b, x, y in self.chunks():
            base = self.offsets[a]
            sums = kernels.prefix_sums(self.data[base : self.offsets[b]], kernels.EXACT)
            keys[x:y] = kernels.span_hashes(sums, self.lo[x:y] - base, self.hi[x:y] - base)
            fps[x:y] = kernels.span_hashes(sums, self.at[x:y] - base, self.at[x:y] - base + GRAM)
        return keys, fps

    def _cover(self, lo: np.ndarray, hi: np.ndarray, base: int, n: int) -> np.ndarray:
        """Which of n places from base on lie in one of the ranges lo to hi."""
        steps = np.bincount(lo - base, minlength=n + 1)[: n + 1] - np.bincount(hi - base, minlength=n + 1)[: n + 1]
        return np.cumsum(steps)[:-1] > 0

    def open(self, settled: np.ndarray, told: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(starts, keys) of the strings to compare, by chunk.

        These are the strings whose head is a hit that isn't settled, or one
        that is told to stand for others.
        """
        for a, b, x, y in self.chunks():
            base, n = self.offsets[a], int(self.offsets[b] - self.offsets[a])
            data = self.data[base : base + n]
            starts, at, _ = heads(data, self.offsets[a : b + 1])
            wanted = np.zeros(n, dtype=bool)
            wanted[self.at[x:y][~settled[x:y] | told[x:y]] - base] = True
            starts = starts[wanted[at]]
            sums = kernels.prefix_sums(data, kernels.EXACT)
            yield starts + base, kernels.span_hashes(sums, starts, starts + LENGTH)


def _whole_characters(data: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """flags without the bytes of characters that they cover in part."""
    lead = (data & 0xC0) != 0x80
    lead[0] = True
    starts = np.flatnonzero(lead)
    return np.repeat(np.logical_and.reduceat(flags, starts), np.diff(np.r_[starts, len(data)]))


def _flags(n: int, blobs: list) -> np.ndarray:
    out = np.zeros(n, dtype=bool)
    out[np.frombuffer(b"".join(blobs), dtype="<i4")] = True
    return out


def _first_and_many(keys: np.ndarray, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of one of each key, which keys have two places or more)."""
    order = np.lexsort((places, keys)) if places is not None else np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    first, size = _groups(sorted_keys)
    if places is not None:
        new = np.r_[True, (sorted_keys[1:] != sorted_keys[:-1]) | (places[order][1:] != places[order][:-1])] if len(keys) else first
        number = np.cumsum(first) - 1
        size = np.bincount(number, weights=new, minlength=1)[number].astype(int) if len(keys) else size
    many = np.zeros(len(keys), dtype=bool)
    many[order] = size > 1
    return order[first], many


def _blob(at: np.ndarray) -> bytes:
    return at.astype("<i4").tobytes()


def repeated_spans(docs: DataFrame, batches: int = BATCHES, keep_text: bool = False) -> tuple[DataFrame, DataFrame, Scratch]:
    """(meta, spans, scratch): the documents and, for each entity with removed bytes, its spans.

    meta: doc_id, ent, n_bytes, sha, copies.  spans: ent, starts and ends of
    the maximal removed runs, n_removed, n_spans, kept_sha256 and, with
    keep_text, kept: the text without the characters that lie in a run whole.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    shards = max(partitions(spark), min(MOST_SHARDS, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))
    with small_batches(spark, TEXTS):
        raw = scratch.save(_scan(docs, shards, batches))
    meta = raw.where("kind = 'meta'").select("doc_id", "ent", "n_bytes", "sha")
    family = SuffixIndexFamily(scratch, shards)
    hits = raw.where("kind = 'hit'").select("shard", "data")
    for k in range(batches):
        hits = hits.unionAll(family.add(raw.where(f"kind = 'entry' and batch = {k}").select("shard", "data")))
    n = meta.count()
    bits = 1 << max(12, min(FILTER_BITS.bit_length() - 1, (8 * n).bit_length()))
    texts = _texts(docs, _hit_filter(hits, bits), bits, shards)
    together = texts.groupBy("shard").cogroup(hits.groupBy("shard")).applyInArrow(_with_hits, "shard int, ent long, text binary, hits binary")
    name = f"suffix_{uuid.uuid4().hex}"
    try:
        with small_batches(spark, TEXTS):
            together.write.option("compression", "zstd").bucketBy(shards, "shard").saveAsTable(name)
        for level in family.levels.values():
            family.drop(level)
        own = spark.table(name)

        @kernels.tidied
        def surroundings(table: pa.Table) -> pa.Table:
            home, part = table.column("shard")[0].as_py(), _Shard(table)
            keys, fps = part.contexts()
            one, many = _first_and_many(keys, part.lo)
            out = [(-1, home, _blob(np.flatnonzero(many)))]
            sent = np.empty(len(one), dtype=CONTEXT)
            sent["key"], sent["fp"], sent["at"] = keys[one], fps[one], one
            # A key that repeats here is known to: its sign is in the place's sign bit.
            sent["at"] = np.where(many[one], -1 - one, one)
            out += [(s, home, d) for s, d in _split(sent, sent["key"] % np.uint64(shards))]
            return _rows(out, _PIECE)

        @kernels.tidied
        def settle(table: pa.Table) -> pa.Table:
            """Tells the homes which hits repeat as a whole; sends heads on to be matched."""
            homes, blobs = table.column("home").to_pylist(), table.column("data").to_pylist()
            rows = _joined(blobs, CONTEXT)
            home = np.repeat(homes, [len(b) // CONTEXT.itemsize for b in blobs])
            one, many = _first_and_many(rows["key"])
            known = rows["at"] < 0
            at = np.where(known, -1 - rows["at"], rows["at"])
            out = [("settled", h, d) for h, d in _split(at[many & ~known].astype("<i4"), home[many & ~known])]
            lone = np.unique(rows["fp"][~many & ~known])
            out += [(f"lone:{s}", -1, d) for s, d in _split(lone, lone % np.uint64(shards))]
            stands = np.zeros(len(rows), dtype=bool)
            stands[one] = True
            stands &= many | known
            for h in np.unique(home[stands]):
                mine = stands & (home == h)
                heads = np.empty(int(mine.sum()), dtype=HEAD)
                heads["fp"], heads["at"] = rows["fp"][mine], at[mine]
                out += [(f"heads:{s}", int(h), d) for s, d in _split(heads, heads["fp"] % np.uint64(shards))]
            return _rows(out, _BLOB)

        @kernels.tidied
        def tell(table: pa.Table) -> pa.Table:
            """Tells hits that stand for equal ones to compare their strings if their head has a lone hit."""
            lone, out = [], []
            for h, data in zip(table.column("home").to_pylist(), table.column("data").to_pylist()):
                if h < 0:
                    lone.append(data)
            lone = np.unique(_joined(lone, np.dtype("<u8")))
            for h, data in zip(table.column("home").to_pylist(), table.column("data").to_pylist()):
                if h >= 0:
                    heads = np.frombuffer(data, dtype=HEAD)
                    out.append(("told", h, heads["at"][np.isin(heads["fp"], lone)].astype("<i4").tobytes()))
            return _rows(out, _BLOB)

        pieces = scratch.save(own.groupBy("shard").applyInArrow(surroundings, _PIECE[1]))
        local = pieces.where("shard < 0").select(F.lit("settled").alias("kind"), F.col("home").alias("shard"), "data")
        sent = scratch.save(pieces.where("shard >= 0").groupBy("shard").applyInArrow(settle, _BLOB[1]))
        scratch_told = (
            sent.where("kind != 'settled'")
            .select(F.element_at(F.split("kind", ":"), 2).cast("int").alias("shard"), F.col("shard").alias("home"), "data")
            .groupBy("shard")
            .applyInArrow(tell, _BLOB[1])
        )
        answers = answers_table = scratch.save(local.unionAll(sent.where("kind = 'settled'")).unionAll(scratch_told))
        scratch.drop(pieces, sent)

        def said(part: _Shard, table: pa.Table) -> tuple[np.ndarray, np.ndarray, list]:
            by: dict[str, list] = {"settled": [], "told": [], "again": []}
            for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist()):
                by[kind].append(data)
            return _flags(len(part.at), by["settled"]), _flags(len(part.at), by["told"]), by["again"]

        @kernels.tidied
        def strings(table: pa.Table, told: pa.Table) -> pa.Table:
            if not table.num_rows:
                return _rows([], _PIECE)
            home, part = table.column("shard")[0].as_py(), _Shard(table)
            keys = np.concatenate([k for _, k in part.open(*said(part, told)[:2])] or [np.zeros(0, dtype=np.uint64)])
            one, many = _first_and_many(keys)
            out = [(-1, home, _blob(np.flatnonzero(many)))]
            rows = np.empty(len(one), dtype=WINDOW)
            rows["key"], rows["at"] = keys[one], np.where(many[one], -1 - one, one)
            out += [(s, home, d) for s, d in _split(rows, rows["key"] % np.uint64(shards))]
            return _rows(out, _PIECE)

        @kernels.tidied
        def again(table: pa.Table) -> pa.Table:
            homes, blobs = table.column("home").to_pylist(), table.column("data").to_pylist()
            rows = _joined(blobs, WINDOW)
            home = np.repeat(homes, [len(b) // WINDOW.itemsize for b in blobs])
            _, many = _first_and_many(rows["key"])
            many &= rows["at"] >= 0
            return _rows([("again", h, d) for h, d in _split(rows["at"][many].astype("<i4"), home[many])], _BLOB)

        pieces = scratch.save(own.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(strings, _PIECE[1]))
        local = pieces.where("shard < 0").select(F.lit("again").alias("kind"), F.col("home").alias("shard"), "data")
        repeats = pieces.where("shard >= 0").groupBy("shard").applyInArrow(again, _BLOB[1])
        answers = answers.unionAll(local).unionAll(repeats)
        kept_type = [("kept", pa.binary())] if keep_text else []

        @kernels.tidied
        def remove(table: pa.Table, told: pa.Table) -> pa.Table:
            fields = [("ent", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *kept_type]
            out: list[tuple] = []
            if table.num_rows:
                part = _Shard(table)
                settled, stand, blobs = said(part, told)
                found = [s for s, _ in part.open(settled, stand)]
                starts = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
                starts = starts[_flags(len(starts), blobs)]
                for a, b, x, y in part.chunks():
                    base, n = part.offsets[a], int(part.offsets[b] - part.offsets[a])
                    own = np.flatnonzero(settled[x:y]) + x
                    s = starts[(starts >= base) & (starts < base + n)]
                    cover = part._cover(np.r_[part.lo[own], s], np.r_[part.hi[own], s + LENGTH], base, n)
                    for i in range(a, b):
                        p, q = part.offsets[i] - base, part.offsets[i + 1] - base
                        flags = cover[p:q]
                        if flags.any():
                            edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
                            own_bytes = part.data[base + p : base + q]
                            kept = own_bytes[~flags].tobytes()
                            whole = own_bytes[~_whole_characters(own_bytes, flags)].tobytes() if keep_text else b""
                            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                            out.append((int(part.ents[i]), begin, end, int(flags.sum()), len(begin), hashlib.sha256(kept).hexdigest(), *([whole] if keep_text else [])))
            return _table(list(zip(*out)) if out else [[] for _ in fields], [f for f, _ in fields], [t for _, t in fields])

        schema = "ent long, starts array<long>, ends array<long>, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
        spans = scratch.save(own.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(remove, schema))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    scratch.drop(pieces, answers_table)
    copies = meta.groupBy("ent").agg(F.count("*").alias("copies")).where("copies > 1")
    return meta.join(copies, "ent", "left").fillna(1, ["copies"]), spans, scratch


def remove_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs.

    Texts are UTF-8 bytes (null: empty).  Removed is every byte covered by a
    LENGTH-byte string that also starts elsewhere, in the same document or
    another; matches end at the end of a document.  Rows count by themselves,
    also those with equal or null ids; other columns are not looked at.
    """
    meta, spans, _ = repeated_spans(docs, batches)
    found = meta.join(spans.select("ent", "n_removed", "n_spans", "kept_sha256"), "ent", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    return found.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def strip_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """docs with every repeated LENGTH-byte string cut out of text, by whole characters.

    All rows and columns stay; a text of which nothing is left is empty, a
    null text stays null.  Only texts that may have changed are shuffled: a
    filter of bounded size tells which.
    """
    meta, spans, scratch = repeated_spans(docs, batches, keep_text=True)
    copied = meta.where((F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)).select("ent").distinct()
    ent, kept, maybe = free_names(docs.columns, "ent", "kept", "maybe")
    changed = spans.join(copied, "ent", "left_anti").select("ent", "kept").unionAll(copied.select("ent", F.lit(b"").alias("kept")))
    changed = scratch.save(changed.toDF(ent, kept))
    bits = 1 << max(12, min(27, (16 * max(1, changed.count())).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(changed.select(F.col(ent).alias("key")), bits))
    text, names = docs.columns.index("text"), [*docs.columns, ent, maybe]

    @kernels.tidied
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ents = np.array([entity(x.as_buffer() if x.is_valid else b"")[0] for x in batch.column(text)], dtype=np.uint64)
            at = (ents % np.uint64(bits)).astype(np.int64)
            hit = shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ents.view(np.int64)), pa.array(hit.astype(bool))], names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{ent}` long, `{maybe}` boolean"])
    tagged = docs.mapInArrow(run, schema)
    cut = tagged.where(F.col(maybe)).join(changed, ent, "left")
    text_now = F.coalesce(F.col(kept).cast("string"), F.col("text")).alias("text")
    cut = cut.select(*(text_now if c == "text" else F.col(c) for c in docs.columns))
    return tagged.where(~F.col(maybe)).select(*docs.columns).unionAll(cut)
