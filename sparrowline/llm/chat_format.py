r"""Chat formatting by columnar byte assembly, with a loss mask, and reading back.

Turns are marked by role: `[INST] text [/INST]` (user), `<s> text </s>` (assistant),
`<<SYS>> text <</SYS>>` (system), `[ROLE] name`, a line feed and `text [/ROLE]` (any other).
Inside texts and names a backslash becomes `\b`, `<` becomes `\l` and `[` becomes `\s` (in names
also a line feed `\n`), so no text can hold a mark and every text is read back exactly.

A batch is put together at once: lengths of all segments, their cumulative offsets, and for each
byte of text the place it goes to; headers, escaped texts and trailers are scattered into one
preallocated buffer, of which the Arrow column of formatted parts is made without a copy. Places are
worked out slice by slice, so a long text takes a few times its own size and no more.

Rows are dealt by ranges of (conversation, turn), so a conversation of any size is formatted by
as many tasks as it needs and comes out as several parts, in order of `part`. The loss mask
covers the assistant's texts, without marks.

Defined cases: turns are ordered by turn, role, text, nulls first; a null text or role is empty;
a null conv_id is a conversation of its own; repeated rows are turns of their own; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowline.llm.common import pick

MARKS = {"user": (b"[INST] ", b" [/INST]"), "assistant": (b"<s> ", b" </s>"), "system": (b"<<SYS>> ", b" <</SYS>>")}
OTHER = (b"[ROLE] ", b"\n", b" [/ROLE]")
ESCAPE = ord("\\")
CODES = {b"\\": b"b", b"<": b"l", b"[": b"s"}
PLAIN = {b"\\" + code: char for char, code in CODES.items()} | {b"\\n": b"\n"}
#: Bytes of text that are put together at a time.
PORTION = 4 << 20
#: Bytes whose places are worked out at a time, also inside one long text.
SLICE = 1 << 20

CODE = np.zeros(256, dtype=np.uint8)
for _char, _code in CODES.items():
    CODE[_char[0]] = _code[0]

TURN = re.compile(
    rb"\[INST\] (?P<user>[^\[<]*) \[/INST\]|<s> (?P<assistant>[^\[<]*) </s>|<<SYS>> (?P<system>[^\[<]*) <</SYS>>"
    rb"|\[ROLE\] (?P<name>[^\[<\n]*)\n(?P<other>[^\[<]*) \[/ROLE\]"
)
ESCAPED = re.compile(rb"\\.")


def escaped(text: bytes) -> bytes:
    return re.sub(rb"[\\<\[]", lambda m: b"\\" + CODES[m[0]], text)


def unescaped(text: bytes) -> bytes:
    return ESCAPED.sub(lambda m: PLAIN[m[0]], text) if b"\\" in text else text


def _marks(role: str) -> tuple[bytes, bytes]:
    if role in MARKS:
        return MARKS[role]
    return OTHER[0] + escaped(role.encode()).replace(b"\n", b"\\n") + OTHER[1], OTHER[2]


def _slices(data: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of each slice of the bytes: where it is, which bytes are escaped, and how many are before each of its bytes and its end."""
    carried = 0
    for lo in range(0, len(data), SLICE):
        special = CODE[data[lo : lo + SLICE]] > 0
        before = carried + np.concatenate([[0], np.cumsum(special)])
        carried = int(before[-1])
        yield lo, lo + len(special), special, before


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted turns end to end: bytes, the offset of each turn and of the end, and where
    each turn's text starts and stops."""
    texts = pc.fill_null(texts, b"").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]

    coded = pc.fill_null(roles, "").dictionary_encode()
    kind = coded.indices.to_numpy(zero_copy_only=False)
    marks = [_marks(r) for r in coded.dictionary.to_pylist()]
    header = np.array([len(h) for h, _ in marks], dtype=np.int64)[kind]
    trailer = np.array([len(t) for _, t in marks], dtype=np.int64)[kind]

    escapes = np.zeros(len(offsets), dtype=np.int64)  # before each text
    for lo, hi, _, before in _slices(data):
        at = slice(*np.searchsorted(offsets, [lo, hi]))
        escapes[at] = before[offsets[at] - lo]
        escapes[at.stop :] = before[-1]
    inside = np.diff(offsets) + np.diff(escapes)  # bytes of each escaped text
    ends = np.cumsum(header + inside + trailer)
    starts = np.concatenate([[0], ends])

    out = np.empty(int(starts[-1]), dtype=np.uint8)
    shift = starts[:-1] + header - offsets[:-1] - escapes[:-1]
    for lo, hi, special, before in _slices(data):
        first, last = np.searchsorted(offsets, lo, side="right") - 1, np.searchsorted(offsets, hi)
        bytes_of = np.diff(np.clip(offsets[first : last + 1], lo, hi))
        place = np.arange(lo, hi) + before[:-1] + np.repeat(shift[first:last], bytes_of)
        out[place] = np.where(special, ESCAPE, data[lo:hi])
        out[place[special] + 1] = CODE[data[lo:hi][special]]
    for k, (h, t) in enumerate(marks):
        rows = np.flatnonzero(kind == k)
        out[starts[rows][:, None] + np.arange(len(h))] = np.frombuffer(h, dtype=np.uint8)
        out[(ends[rows] - len(t))[:, None] + np.arange(len(t))] = np.frombuffer(t, dtype=np.uint8)
    return out, starts, starts[:-1] + header, ends - trailer


PARTS = "conv_id long, part long, formatted string, loss array<struct<start:long,stop:long>>"
SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])


def _format_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() << 40
    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False))
        cuts = [0, *(np.searchsorted(sizes, np.arange(PORTION, int(sizes[-1]) + 1, PORTION)) + 1)] if b.num_rows else [0]
        cuts = np.unique([*cuts, b.num_rows])
        for lo, hi in zip(cuts, cuts[1:]):
            rows = b.slice(lo, hi - lo)
            out, starts, text_start, text_stop = assemble(rows.column(1), rows.column(2))
            conv = rows.column(0)
            same = pc.equal(conv[1:], conv[:-1]) if len(conv) > 1 else pa.array([], pa.bool_())
            both_null = pc.and_(pc.is_null(conv[1:]), pc.is_null(conv[:-1]))
            new = ~(pc.fill_null(same, False).to_numpy(zero_copy_only=False) | both_null.to_numpy(zero_copy_only=False))
            first = np.flatnonzero(np.r_[True, new])  # first turn of each part
            bounds = starts[np.r_[first, len(conv)]]
            formatted = pa.Array.from_buffers(
                pa.large_string(), len(first), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)]
            )
            trained = np.flatnonzero(pc.fill_null(pc.equal(rows.column(1), "assistant"), False).to_numpy(zero_copy_only=False))
            of_part = np.searchsorted(first, trained, side="right") - 1
            spans = pa.StructArray.from_arrays(
                [pa.array(text_start[trained] - bounds[of_part]), pa.array(text_stop[trained] - bounds[of_part])],
                fields=list(SPAN),
            )
            counts = np.bincount(of_part, minlength=len(first))
            loss = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), spans)
            number = pa.array(part + np.arange(len(first)))
            part += len(first)
            yield pa.RecordBatch.from_arrays(
                [conv.take(pa.array(first)), number, formatted.cast(pa.string()), loss],
                names=["conv_id", "part", "formatted", "loss"],
            )


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, part, formatted, loss (byte spans of `formatted`) of conversations(conv_id, turn, role, text)."""
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role")]
    ranges = rows.repartitionByRange(*order, F.asc_nulls_first(F.substring("text", 1, 64)))
    ordered = ranges.sortWithinPartitions(*order, F.asc_nulls_first("text"))
    turns = ordered.select(F.col("conv_id").cast("long"), "role", F.col("text").cast("binary").alias("text"))
    return turns.mapInArrow(_format_batches, PARTS)


def turns_of(formatted: bytes) -> Iterator[tuple[bytes, bytes, int, int]]:
    """Role, text, and the text's place in a formatted part."""
    at = 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn starts at byte {at}")
        at = m.end()
        group = m.lastgroup
        role = unescaped(m["name"]) if group == "other" else group.encode()
        yield role, unescaped(m[group]), m.start(group), m.end(group)


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


class _Digest:
    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss: list[dict]) -> None:
        data = formatted.encode()
        self.chars += len(formatted)
        for role, text, _, _ in turns_of(data):
            self.turns += 1
            self.all.update(role + b"\n" + text + b"\n")
        for span in loss:
            text = unescaped(data[span["start"] : span["stop"]])
            self.loss_chars += len(text.decode())
            self.loss.update(text)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts arrive in order; a conversation is hashed as it passes, whatever its size."""
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

    now, done = None, []
    for b in batches:
        for conv_id, formatted, loss in zip(b.column(0).to_pylist(), b.column(2), b.column(3)):
            if now is None or now.conv_id != conv_id:
                done += [now.row()] if now else []
                now = _Digest(conv_id)
            now.add(formatted.as_py(), loss.as_py())
        if done:
            yield rows(done)
            done = []
    if now:
        yield rows([now.row()])


def digests(parts: DataFrame) -> DataFrame:
    """What is read back from formatted parts, by conversation: turns, loss mask, and their hashes."""
    ordered = parts.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "part")
    return ordered.mapInArrow(_digest_batches, DIGESTS)
