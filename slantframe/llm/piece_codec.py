"""SentencePiece BPE encoding and decoding by a table over prefixes.

The BPE encoding of a text is the only token sequence in which every two
neighbours are compatible, so each prefix of a text has one possible last
token.  An Aho-Corasick automaton reports the tokens that end at each place,
longest first; the one that is compatible with the last token of what stands
before it is stored, and the ids are read off the table backwards.  The work
is linear in the text whatever its length.

Two facts of the model, both checked when it is loaded, let the table work on
short spans: no piece joins two spans of ``SPANS`` and no piece joins a run
of spaces to other characters (but for one space at the front).  Runs of
spaces are merged by hand since all their pieces have one and the same score.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from slantframe.llm import kernels
from pyspark.sql import functions as F

SPACE = "▁"
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Spans that are encoded by themselves: Latin letters, or anything else, with the spaces before them.
SPANS = re.compile(f"{SPACE}*[{_LATIN}]+|{SPACE}*[^{_LATIN}{SPACE}]+|{SPACE}+")
#: Spans and token pairs that a worker remembers during a task; beyond it starts anew.
MEMORY = 1 << 18
NEVER = 1 << 60


def _replace_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("replace-each-byte", _replace_byte)


class PieceTables:
    """What encoding and decoding need of a model; small and picklable."""

    def __init__(self, model: bytes) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = [0] * 256
        self.out = [b""] * n
        self.ids: dict[str, int] = {}
        order = []
        for i, name in enumerate(names):
            if sp.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                self.out[i] = bytes([int(name[3:5], 16)])
            elif sp.is_unknown(i):
                self.out[i] = " ⁇ ".encode()
            elif not sp.is_control(i) and not sp.is_unused(i):
                self.ids[name] = i
                self.out[i] = name.replace(SPACE, " ").encode()
                if len(name) > 1:
                    order.append((-sp.get_score(i), i))
        runs = {name for name in self.ids if name.strip(SPACE) == "" and len(name) > 1}
        for name in self.ids:
            if SPANS.findall(name) != [name] or (name not in runs and SPACE in name[1:]):
                raise ValueError(f"piece {name!r} joins spans that are encoded apart")
        self.run_lengths = {len(name) for name in runs}
        order = [(s, i) for s, i in sorted(order) if names[i] not in runs]
        if len({s for s, _ in order}) != len(order):
            raise ValueError("two pieces have the same score")
        self.names = names
        self.rank = {names[i]: r for r, (_, i) in enumerate(order)}
        self.ranks = [-1] * n
        for r, (_, i) in enumerate(order):
            self.ranks[i] = r
        self.parts: dict[int, tuple[int, int]] = {}
        self.reachable = [i for name, i in self.ids.items() if name not in runs and self._build(name, i)]

    def _build(self, name: str, i: int) -> bool:
        """Whether merging the characters of a piece gives the piece; keeps its last merge."""
        if len(name) == 1:
            return True
        symbols = list(name)
        after = list(range(1, len(symbols))) + [-1]
        before = list(range(-1, len(symbols) - 1))
        queue = [(self.rank[a + b], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in self.rank]
        heapq.heapify(queue)
        last = None
        while queue:
            r, k = heapq.heappop(queue)
            nxt = after[k] if symbols[k] else -1
            if nxt < 0 or self.rank.get(symbols[k] + symbols[nxt]) != r:
                continue
            last = (symbols[k], symbols[nxt])
            symbols[k] += symbols[nxt]
            symbols[nxt] = ""
            after[k] = after[nxt]
            if after[k] >= 0:
                before[after[k]] = k
                if (r := self.rank.get(symbols[k] + symbols[after[k]])) is not None:
                    heapq.heappush(queue, (r, k))
            if before[k] >= 0 and (r := self.rank.get(symbols[before[k]] + symbols[k])) is not None:
                heapq.heappush(queue, (r, before[k]))
        if symbols[0] != name:
            return False
        if last[0] not in self.ids or last[1] not in self.ids:
            return False
        self.parts[i] = (self.ids[last[0]], self.ids[last[1]])
        return True


class PieceCodec:
    """encode and decode for one worker; remembers spans and token pairs until it is told to forget them."""

    def __init__(self, tables: PieceTables) -> None:
        self.t = tables
        self.sizes = [len(name) for name in tables.names]
        self.automaton = ahocorasick.Automaton()
        for i in tables.reachable:
            self.automaton.add_word(tables.names[i], i)
        self.automaton.make_automaton()
        self.pairs = _Pairs(self)
        self.spans = _Spans(self)
        self.run_ids: dict[int, list[int]] = {}

    def forget(self) -> None:
        """Drops what is remembered: a worker lives on after its task, beside those of other tasks."""
        for memory in (self.pairs, self.spans, self.run_ids):
            memory.clear()

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging would leave tokens a and b side by side.

        Undoes the merges next to the border, latest first, and looks at each
        step for a merge across the border that would have come earlier.
        """
        t, limit = self.t, NEVER
        while True:
            if t.rank.get(t.names[a] + t.names[b], NEVER) < limit:
                return False
            ra, rb = t.ranks[a], t.ranks[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, t.parts[a][1]
            else:
                limit, b = rb + 1, t.parts[b][0]

    def table(self, span: str) -> list[int]:
        """Ids of a span with at most one space, at its front; unknown characters as bytes."""
        n, sizes, pairs = len(span), self.sizes, self.pairs
        last = [-1] * (n + 1)
        for end, token in self.automaton.iter(span):
            end += 1
            if last[end] < 0:
                start = end - sizes[token]
                if start == 0 or (before := last[start]) < 0 or pairs[before << 20 | token]:
                    last[end] = token
        out: list[int] = []
        at = n
        while at:
            if last[at] < 0:
                out.extend(self.t.byte_ids[x] for x in reversed(span[at - 1].encode("utf-8", "replace")))
                at -= 1
            else:
                out.append(last[at])
                at -= self.sizes[last[at]]
        return out[::-1]

    def run(self, n: int) -> list[int]:
        """Ids of n spaces: always the leftmost possible merge."""
        if n not in self.run_ids:
            stack: list[int] = []
            rest = n
            while rest:
                # What stands left of the next space can't merge any more; the space grows as far as it can.
                stack.append(1)
                rest -= 1
                while rest and stack[-1] + 1 in self.t.run_lengths:
                    stack[-1] += 1
                    rest -= 1
                    while len(stack) > 1 and stack[-2] + stack[-1] in self.t.run_lengths:
                        stack[-2:] = [stack[-2] + stack[-1]]
            if len(self.run_ids) > MEMORY // 100:
                self.run_ids.clear()
            self.run_ids[n] = [self.t.ids[SPACE * k] for k in stack]
        return self.run_ids[n]

    def encode_span(self, span: str) -> list[int]:
        rest = span.lstrip(SPACE)
        n = len(span) - len(rest)
        if not rest:
            return self.run(n)
        if n < 2:
            return self.table(span)
        ids = self.table(SPACE + rest)
        if ids[0] == self.t.ids[SPACE]:
            return self.run(n) + ids[1:]
        return self.run(n - 1) + ids

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids with begin and end."""
        body = b"".join(map(self.spans.__getitem__, SPANS.findall(SPACE + text.replace(" ", SPACE)))) if text else b""
        return self.t.bos.to_bytes(4, "little") + body + self.t.eos.to_bytes(4, "little")

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids: pieces joined, bytes put together, the first space dropped."""
        raw = b"".join(map(self.t.out.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return raw[raw[:1] == b" " :].decode("utf-8", "replace-each-byte")


class _Pairs(dict):
    """Whether two tokens are compatible, for the pairs met so far."""

    def __init__(self, codec: PieceCodec) -> None:
        super().__init__()
        self.codec = codec

    def __missing__(self, key: int) -> bool:
        if len(self) >= MEMORY:
            self.clear()
        out = self[key] = self.codec.compatible(key >> 20, key & 0xFFFFF)
        return out


class _Spans(dict):
    """Ids of the spans met so far, as bytes."""

    def __init__(self, codec: PieceCodec) -> None:
        super().__init__()
        self.codec = codec

    def __missing__(self, span: str) -> bytes:
        out = np.array(self.codec.encode_span(span), dtype="<u4").tobytes()
        if len(span) < 64:
            if len(self) >= MEMORY:
                self.clear()
            self[span] = out
        return out


_CODECS: dict[int, PieceCodec] = {}


def _codec(key: int, broadcast) -> PieceCodec:
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = PieceCodec(broadcast.value)
    return _CODECS[key]


def encode_documents(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """Tokens of every whole text and the text that decoding them gives.

    Returns id_column, n_tokens (begin and end included), ids_sha256 (of the
    ids as little-endian 32-bit integers), decoded_sha256 and, on request,
    ids (array) and decoded (string).  A null text is an empty one; repeated
    rows and null ids give a row each; other columns are not looked at.  The
    model (a file of fixed size, half a megabyte here) is read on the driver
    and broadcast; texts never leave their partition.
    """
    with open(model_path, "rb") as f:
        tables = PieceTables(f.read())
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    key = shared.id if hasattr(shared, "id") else id(shared)
    extra = ", ids array<int>" * keep_ids + ", decoded string" * keep_text

    @kernels.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shared)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    coded = [codec.encode(x or "") for x in part.column(1).to_pylist()]
                    texts = [codec.decode(x) for x in coded]
                    columns = [
                        part.column(0),
                        pa.array([len(x) // 4 for x in coded], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in coded]),
                        pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in texts]),
                    ]
                    if keep_ids:
                        columns.append(pa.array([np.frombuffer(x, dtype="<i4") for x in coded], pa.list_(pa.int32())))
                    if keep_text:
                        columns.append(pa.array(texts))
                    yield pa.RecordBatch.from_arrays(columns, names)
        finally:
            codec.forget()

    names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids, *["decoded"] * keep_text]
    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
