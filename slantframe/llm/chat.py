"""Chat formatting with typed content parts.

A visitor walks the content parts of a turn and writes them as one string:
text with the template's control strings escaped, and for each image, audio
clip or document a placeholder, recording the attachment's reference, its
place and the tokens that it expands to.  A reader takes the output apart
again.  Turns are formatted where they lie; a conversation is their blocks
in order, so a conversation of any length is read as a stream.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of the template; none of them may stand in a text unescaped.
OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
HEAD, REST = "<s>", "[/ROLE]"
CONTROLS = (HEAD, END, OPEN, CLOSE, "[ROLE]", REST, "<<SYS>>", "<</SYS>>", "<|image|>", "<|audio|>", "<|document|>")
ESCAPE = "\\"
_CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ")(.)", re.DOTALL)
_ESCAPED = re.compile(r"\\(\\?)")
_BLOCK = re.compile(re.escape(HEAD) + re.escape("[ROLE]") + "(?P<role>.*?)" + re.escape(REST) + "(?P<text>.*?)" + re.escape(END), re.DOTALL)
#: Roles whose text is learned.
LEARNED = ("assistant",)


def escape(text: str) -> str:
    """Doubles escape characters and breaks control strings after their first character."""
    return _CONTROL.sub(r"\1\\", text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass(frozen=True)
class Attachment:
    """What a placeholder stands for."""

    kind: str
    reference: str
    offset: int
    tokens: int


@dataclass
class Flattener:
    """Visits typed parts in order; parts are mappings with a type and that type's fields.

    text: text.  image: ref, width, height (one token a patch of side patch).
    audio: ref, seconds (rate tokens a second).  document: ref, pages
    (page_tokens tokens a page).  A null field counts as empty or 0; an
    unknown type is a ValueError.  Texts that follow one another are escaped
    as one, so no control string arises where they meet.
    """

    patch: int = 28
    rate: float = 12.5
    page_tokens: int = 512
    pieces: list[str] = field(default_factory=list)
    attachments: list[Attachment] = field(default_factory=list)
    size: int = 0
    pending: list[str] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        visitor = getattr(self, f"visit_{part.get('type')}", None)
        if visitor is None:
            raise ValueError(f"a content part of type {part.get('type')!r}")
        visitor(part)

    def visit_text(self, part: dict) -> None:
        self.pending.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        side = lambda x: math.ceil((part.get(x) or 0) / self.patch)
        self._attach("image", part, side("width") * side("height"))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0) * self.rate))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 0) * self.page_tokens)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self._settle()
        self.attachments.append(Attachment(kind, part.get("ref") or "", self.size, tokens))
        self._write(f"<|{kind}|>")

    def _settle(self) -> None:
        """Writes the texts since the last placeholder."""
        if self.pending:
            self._write(escape("".join(self.pending)))
            self.pending.clear()

    def _write(self, piece: str) -> None:
        self.pieces.append(piece)
        self.size += len(piece)

    @property
    def text(self) -> str:
        self._settle()
        return "".join(self.pieces)


@dataclass(frozen=True)
class Block:
    """A formatted turn; loss_start and loss_end bound the learned characters (equal: none)."""

    text: str
    loss_start: int
    loss_end: int
    attachments: tuple[Attachment, ...]


def format_turn(role: str | None, parts: Sequence[dict], learned: Sequence[str] = LEARNED) -> Block:
    """One turn as a block of the template; attachments' offsets are places in the block."""
    flat = Flattener()
    for part in parts:
        flat.visit(part)
    head = f"{HEAD}[ROLE]{escape(role or '')}{REST}"
    body = flat.text
    start = len(head)
    end = start + len(body) if role in learned else start
    moved = tuple(Attachment(a.kind, a.reference, a.offset + start, a.tokens) for a in flat.attachments)
    return Block(head + body + END, start, end, moved)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each block of an output, unescaped; placeholders stay as they are (read_parts tells them from quoted ones)."""
    for m in _blocks(formatted):
        yield unescape(m["role"]), unescape(m["text"])


def _blocks(formatted: str) -> Iterator[re.Match]:
    at = 0
    for m in _BLOCK.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no block at {at}")
        at = m.end()
        yield m
    if at != len(formatted):
        raise ValueError(f"no block at {at}")


_PLACEHOLDER = re.compile(r"<\|(image|audio|document)\|>")


def read_parts(formatted: str) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """(role, parts) of each block of an output: ("text", text) and (kind, "") for a placeholder.

    A placeholder that a text quotes is escaped, so it is read as text.
    Empty texts between placeholders are left out.
    """
    for m in _blocks(formatted):
        parts, at = [], 0
        for p in _PLACEHOLDER.finditer(m["text"]):
            parts += [("text", unescape(m["text"][at : p.start()])), (p[1], "")]
            at = p.end()
        parts.append(("text", unescape(m["text"][at:])))
        yield unescape(m["role"]), [p for p in parts if p != ("text", "")]


BLOCKS = "formatted string, loss_start int, loss_end int, attachments array<struct<kind:string,reference:string,offset:int,tokens:int>>"


def format_conversations(turns: DataFrame, parts_column: str | None = None) -> DataFrame:
    """conv_id, turn and the formatted block of every row of turns.

    The content is the column text, or parts_column: an array of structs with
    type, text, ref, width, height, seconds and pages.  Null text is empty, a
    null role is an empty one; other columns are not looked at.
    """
    content = F.col("text" if parts_column is None else parts_column)
    kinds = [turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, bodies = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            blocks = [format_turn(r, [{"type": "text", "text": b}] if parts_column is None else b or []) for r, b in zip(roles, bodies)]
            files = [[vars(a) for a in b.attachments] for b in blocks]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([b.text for b in blocks], pa.string()), pa.array([b.loss_start for b in blocks], pa.int32()), pa.array([b.loss_end for b in blocks], pa.int32()), pa.array(files, _FILES)],
                ["conv_id", "turn", "formatted", "loss_start", "loss_end", "attachments"],
            )

    rows = turns.select("conv_id", "turn", "role", content.alias("content"))
    return rows.mapInArrow(run, f"conv_id {kinds[0]}, turn {kinds[1]}, {BLOCKS}")


_FILES = pa.list_(pa.struct([("kind", pa.string()), ("reference", pa.string()), ("offset", pa.int32()), ("tokens", pa.int32())]))


def digest_conversations(blocks: DataFrame) -> DataFrame:
    """What the formatted blocks say when they are read back, by conversation.

    Rows are sorted by conversation and turn (ties: by the block) and read as
    a stream with running digests, so no conversation is held in memory.
    Conversations with a null id are one conversation.
    """
    kind = blocks.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, state = None, None
        ids = None
        for batch in batches:
            done = []
            ids = batch.column(0).type
            for conv, formatted, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != open_id:
                    if state is not None:
                        done.append((open_id, state))
                    open_id, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                learned = unescape(formatted[a:b])
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(formatted)
            if done:
                yield _digests(done, ids)
        if state is not None:
            yield _digests([(open_id, state)], ids)

    def _digests(done: list, ids: pa.DataType) -> pa.RecordBatch:
        columns = [[c for c, _ in done], *([s[k] if k in (0, 2, 4) else s[k].hexdigest() for _, s in done] for k in range(5))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [ids, *types])], names)

    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    rows = blocks.select("conv_id", "turn", "formatted", "loss_start", "loss_end")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").drop("turn")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
