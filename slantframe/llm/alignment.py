"""Alignment of two tokenizers over the same bytes.

Both tokenizers cut the bytes of space + text.  A string with a label a byte
says which tokens end there (none, A's, B's, both); a regular expression scans
it for spans up to each byte where both end, and the labels of a span count the
tokens of a group.  Every byte that has a label ends one stretch that one token
of A and one of B share, so links are read off the same string.

Texts are encoded once, in place; what is kept of a document are its distinct
linked id pairs and how often each occurs.  How many documents hold a pair is
counted in the tasks first and then by a shuffle of pairs.  The pairs that most
documents hold, at most ``HOT`` of them, are broadcast; rarer ones meet their
counts in a join, where none of them is frequent.

Nulls and empty texts have no tokens, and neither has a text that a tokenizer
does not give back byte by byte.  Repeated rows and null ids give a row each;
columns other than the two named are not looked at.  An empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantframe.llm import kernels
from slantframe.llm.scratch import Scratch

#: Most pairs that are broadcast: 17 bytes each.
HOT = 1 << 20
#: Distinct pairs that a task counts before it sends them on.
FLUSH = 1 << 22
#: Rows of texts in memory at once.
ROWS = 128
#: Spans and token codes that a worker remembers or joins at once.
MEMORY = 1 << 20

#: Fixed value: how the byte-level vocabulary's tokenizer cuts a text into words.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE_SPACE = "▁"

NONE, A_END, B_END, BOTH = range(4)
GROUP = re.compile(rb"[^\x03]*\x03", re.DOTALL).findall


def byte_letters() -> dict[str, int]:
    """The bytes that the letters of a byte-level vocabulary stand for: printable ones themselves, the others in order from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class ByteTokens:
    """Encoder A: a byte-level BPE vocabulary file of the tokenizers library, special tokens left out."""

    def __init__(self, data: bytes) -> None:
        model = json.loads(data)
        letters = byte_letters()
        special = {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        order = [model["model"]["vocab"]["".join(m)] for m in merges]
        if order != sorted(order):
            raise ValueError("merges aren't in the order of their ids")
        import tiktoken

        self.coder = tiktoken.Encoding("byte-level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.coder.encode_to_numpy(" " + t).astype(np.int64) for t in texts]


class PieceTokens:
    """Encoder B: a model file of the sentencepiece library, which sets a space before the text itself."""

    def __init__(self, data: bytes) -> None:
        import sentencepiece

        self.coder = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bytes = [self._raw(i) for i in range(self.coder.get_piece_size())]

    def _raw(self, i: int) -> bytes:
        piece = self.coder.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.coder.is_byte(i) else piece.replace(PIECE_SPACE, " ").encode()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, dtype=np.int64) for ids in self.coder.encode(texts, num_threads=1)]


class _Counts(dict):
    """A's and B's tokens in a span of labels, as one number."""

    def __missing__(self, span: bytes) -> int:
        out = ((span.count(b"\x01") + 1) << 32) | (span.count(b"\x02") + 1)
        if len(span) < 64:
            if len(self) >= MEMORY:
                self.clear()
            self[span] = out
        return out


class Aligner:
    """Groups and links of one text at a time."""

    def __init__(self, a_file: bytes, b_file: bytes) -> None:
        self.a, self.b = ByteTokens(a_file), PieceTokens(b_file)
        self.a_sizes = np.array([len(x) for x in self.a.bytes])
        self.b_sizes = np.array([len(x) for x in self.b.bytes])
        self.counts = _Counts()
        #: A token's text in a group, with what follows it: another token, the other side, the next group.
        self.marks = [f"{i}{end}" for n, last in ((len(self.a_sizes), "|"), (len(self.b_sizes), ";")) for i in range(n) for end in (",", last)]

    def groups(self, a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(labels, A's tokens a group, B's tokens a group)."""
        labels = np.zeros(size, dtype=np.uint8)
        labels[np.cumsum(self.a_sizes[a]) - 1] = A_END
        labels[np.cumsum(self.b_sizes[b]) - 1] += np.uint8(B_END)
        counts = np.array(list(map(self.counts.__getitem__, GROUP(labels.tobytes()))), dtype=np.int64)
        return labels, counts >> 32, counts & 0xFFFFFFFF

    def written(self, a: np.ndarray, b: np.ndarray, per_a: np.ndarray, per_b: np.ndarray) -> Iterator[str]:
        """The groups as text, in pieces: a1,a2|b1;a3|b2,b3;"""
        ends_a, ends_b = np.cumsum(per_a), np.cumsum(per_b)
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        codes[np.arange(len(a)) + np.repeat(ends_b - per_b, per_a)] = 2 * a
        codes[np.arange(len(b)) + np.repeat(ends_a, per_b)] = 2 * (b + len(self.a_sizes))
        ends = ends_a + ends_b
        codes[ends - 1] += 1
        codes[ends - per_b - 1] += 1
        for at in range(0, len(codes), MEMORY):
            yield "".join(map(self.marks.__getitem__, codes[at : at + MEMORY].tolist()))

    def links(self, a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """A key (A id x size of B + B id) for each pair of overlapping tokens, in order."""
        found = labels[labels > 0]
        ends_a, ends_b = (found & A_END) > 0, (found & B_END) > 0
        return a[np.cumsum(ends_a) - ends_a] * len(self.b_sizes) + b[np.cumsum(ends_b) - ends_b]


_ALIGNERS: dict[int, Aligner] = {}


def _aligner(key: int, files) -> Aligner:
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(*files.value)
    return _ALIGNERS[key]


def _deltas(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, a plane of bytes each, so that the file's compression finds the high ones alike."""
    steps = np.diff(keys, prepend=0).astype("<i8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def _keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel())


def align_texts(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text", keep_groups: bool = False) -> DataFrame:
    """id_column, n_a, n_b, n_groups, n_links, groups_sha256 and what the counts need: row, pairs, times.

    With keep_groups also groups: the text a1,a2|b1;a3|b2,b3 itself.  The two
    files, of fixed size, are read on the driver and broadcast.
    """
    with open(a_path, "rb") as a_file, open(b_path, "rb") as b_file:
        files = docs.sparkSession.sparkContext.broadcast((a_file.read(), b_file.read()))
    key = files.id if hasattr(files, "id") else id(files)

    @kernels.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(key, files)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [x or "" for x in part.column(2).to_pylist()]
                out = [_aligned(aligner, t, a, b, keep_groups) for t, a, b in zip(texts, aligner.a.encode(texts), aligner.b.encode(texts))]
                columns = list(zip(*out))
                arrays = [part.column(0), part.column(1), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, k) for c, k in zip(columns[4:], (pa.string(), pa.binary(), pa.binary(), pa.string()))]]
                yield pa.RecordBatch.from_arrays(arrays, names)

    names = [id_column, "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", *["groups"] * keep_groups]
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary" + ", groups string" * keep_groups
    return docs.select(F.col(id_column), F.monotonically_increasing_id(), F.col(text_column)).mapInArrow(run, schema)


def _aligned(aligner: Aligner, text: str, a: np.ndarray, b: np.ndarray, keep_groups: bool) -> tuple:
    raw = (" " + text).encode()
    none = (0, 0, 0, 0, "", b"", b"", *[""] * keep_groups)
    if not text or b"".join(map(aligner.a.bytes.__getitem__, a.tolist())) != raw or b"".join(map(aligner.b.bytes.__getitem__, b.tolist())) != raw:
        return none
    labels, per_a, per_b = aligner.groups(a, b, len(raw))
    links = aligner.links(a, b, labels)
    pairs, times = np.unique(links, return_counts=True)
    digest, kept, last = hashlib.sha256(), [], ""
    for piece in aligner.written(a, b, per_a, per_b):
        digest.update(last.encode())
        kept += [last] * keep_groups
        last = piece
    digest.update(last[:-1].encode())
    return (len(a), len(b), len(per_a), len(links), digest.hexdigest(), _deltas(pairs), times.astype("<u4").tobytes(), *["".join([*kept, last[:-1]])] * keep_groups)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, docs): how many rows hold each linked pair."""

    @kernels.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        waiting, n = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, sizes = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *waiting]), return_counts=True)
            every, at = np.unique(np.concatenate([held, keys]), return_inverse=True)
            return every, np.bincount(at, np.concatenate([counts, sizes]), len(every)).astype(np.int64)

        for batch in batches:
            for x in batch.column(0).to_pylist():
                if x:
                    waiting.append(_keys(x))
                    n += len(waiting[-1])
                if n >= FLUSH:
                    held, counts = merged()
                    waiting, n = [], 0
                    if len(held) >= FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], ["pair", "docs"])
                        held, counts = held[:0], counts[:0]
        held, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], ["pair", "docs"])

    return aligned.select("pairs").mapInArrow(run, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))


def _threshold(counts: DataFrame, most: int) -> int:
    """The least power of two that at most ``most`` pairs reach in documents."""
    sizes = {int(r["size"]): r["n"] for r in counts.groupBy(F.floor(F.log2("docs")).alias("size")).agg(F.count("*").alias("n")).collect()}
    held, size = 0, 63
    while size > 0 and held + sizes.get(size - 1, 0) <= most:
        size -= 1
        held += sizes.get(size, 0)
    return 1 << size


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text", hot: int = HOT, keep_groups: bool = False) -> DataFrame:
    """Token groups of every text under both tokenizers and how its links stand in the whole table.

    Returns id_column, n_a, n_b, n_groups, n_links, n_best (links whose pair
    is held by most documents among those of its A id), count_sum (documents
    that hold the pair, over all links) and groups_sha256; with keep_groups
    also the groups.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    aligned = scratch.save(align_texts(docs, a_path, b_path, id_column, text_column, keep_groups))
    counts = scratch.save(pair_counts(aligned))
    with open(b_path, "rb") as f:
        b_size = len(PieceTokens(f.read()).bytes)
    of_a = F.floor(F.col("pair") / b_size)
    best = counts.groupBy(of_a.alias("a")).agg(F.max("docs").alias("most"))  # a row a token of A at most
    ranked = scratch.save(counts.withColumn("a", of_a).join(F.broadcast(best), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")))
    bound = _threshold(ranked, hot)
    top = ranked.where(F.col("docs") >= bound).toArrow().sort_by("pair")
    shared = docs.sparkSession.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("pair", "docs", "best")))

    @kernels.tidied
    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, held, first = shared.value
        for batch in batches:
            bests, sums = [], []
            for x, t in zip(batch.column("pairs"), batch.column("times")):
                at, there, times = _found(pairs, x, t)
                bests.append(int(times[there][first[at[there]]].sum()))
                sums.append(int((times[there] * held[at[there]]).sum()))
            kept = [batch.column(c) for c in own]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bests, pa.int64()), pa.array(sums, pa.int64())], [*own, "n_best", "count_sum"])

    @kernels.tidied
    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = shared.value[0]
        for batch in batches:
            for r, x, t in zip(batch.column("row").to_pylist(), batch.column("pairs"), batch.column("times")):
                _, there, times = _found(pairs, x, t)
                if not there.all():
                    keys = _keys(x.as_py())[~there]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), r)), pa.array(keys), pa.array(times[~there])], ["row", "pair", "times"])

    own = [c for c in aligned.columns if c not in ("pairs", "times")]
    kinds = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in own)
    out = aligned.mapInArrow(known, f"{kinds}, n_best long, count_sum long")
    if bound > 1:  # else every pair is among the broadcast ones
        met = aligned.select("row", "pairs", "times").mapInArrow(rare, "row long, pair long, times long").join(ranked.where(F.col("docs") < bound), "pair")
        more = met.groupBy("row").agg(F.sum(F.col("times") * F.col("docs")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
        out = out.join(more, "row", "left").withColumns({"count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0))})
    return out.select(id_column, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * keep_groups)


def _found(pairs: np.ndarray, keys: pa.BinaryScalar, times: pa.BinaryScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of a row's keys among the sorted pairs, whether they are there, how often each occurs)."""
    own = _keys(keys.as_py())
    at = np.searchsorted(pairs, own)
    there = np.zeros(len(own), dtype=bool)
    inside = at < len(pairs)
    there[inside] = pairs[at[inside]] == own[inside]
    return at, there, np.frombuffer(times.as_py(), dtype="<u4").astype(np.int64)
