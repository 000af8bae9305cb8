"""Chat formatting by columnar byte assembly.

A turn becomes `<|im_start|>`role`\\n`text`<|im_end|>\\n`.  Inside roles and texts every control
string gets a backslash after its first character, and a backslash is doubled, so no control
string is left in them and dropping the backslashes restores them; in a role a newline is escaped too.

A batch is assembled at once: numpy finds the places that need a backslash in the batch's bytes,
computes the lengths and cumulative offsets of headers, contents and footers and the scatter index
of each byte, and copies all of them into one preallocated Arrow buffer.  Turns are dealt out by
ranges of (conversation, turn), so a conversation with a third of all rows spreads over many tasks;
each task writes a conversation's turns in pieces of bounded size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, shuffle_partitions, slices, trimmed, tuned

START, SPLIT, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
#: Control strings of this template and of common others; none is a prefix of another.
CONTROL = (b"<|im_start|>", b"<|im_end|>", b"<|endoftext|>", b"<|startoftext|>", b"<s>", b"</s>", b"[INST]", b"[/INST]", b"<<SYS>>", b"<</SYS>>")
#: The role whose texts are under the loss mask.
LOSS_ROLE = "assistant"
#: Bytes of formatted text in a piece, beyond which a conversation goes on in another piece.
PIECE_BYTES = 1 << 22

_ESCAPED = re.compile(rb"\\(.)", re.S)
_TURN = re.compile(re.escape(START) + rb"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(END), re.S)


def _rows_of(places: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.searchsorted(off, places, "right") - 1


def _escape_places(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Positions after whose byte a backslash goes: backslashes and the first bytes of control strings;
    what crosses the end of a row doesn't count."""
    out = [np.flatnonzero(data == 0x5C)]
    for first in {c[0] for c in CONTROL}:
        places = np.flatnonzero(data == first)
        room = off[_rows_of(places, off) + 1] - places if places.size else places
        for control in (c for c in CONTROL if c[0] == first):
            at, left = places, room
            for k, byte in enumerate(control):  # fewer places are left with each byte
                here = left > k
                at, left = at[here], left[here]
                same = data[at + k] == byte
                at, left = at[same], left[same]
            out.append(at)
    return np.sort(np.concatenate(out))  # no control string begins another, so no place comes twice


def unescape(raw: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1", raw)


def _escaped(column: pa.Array, newline: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The escaped bytes of a column, end to end, and the rows' offsets; with `newline` a backslash goes
    before each newline too."""
    data, off = buffers(column)
    at = _escape_places(data, off)
    before, rows = at + 1, _rows_of(at, off)  # what goes in before which byte, and whose it is
    if newline:
        lines = np.flatnonzero(data == 0x0A)
        before, rows = np.concatenate([before, lines]), np.concatenate([rows, _rows_of(lines, off)])
    shift = np.cumsum(np.bincount(before, minlength=len(data) + 1))
    out = np.full(len(data) + len(before), 0x5C, np.uint8)
    out[np.arange(len(data)) + shift[: len(data)]] = data
    return out, off + np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(off) - 1))])


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The formatted turns as one binary column, and where each one's text starts and ends in it."""
    role, role_off = _escaped(roles, newline=True)
    text, text_off = _escaped(texts)
    n = len(role_off) - 1
    fixed = [np.frombuffer(x, np.uint8) for x in (START, SPLIT, END)]
    role_n, text_n = np.diff(role_off), np.diff(text_off)
    lengths = np.stack([np.full(n, len(START)), role_n, np.full(n, 1), text_n, np.full(n, len(END))], axis=1)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5) if n else np.zeros((0, 5), np.int64)
    begins = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, piece in ((0, fixed[0]), (2, fixed[1]), (4, fixed[2])):
        out[(begins[:, k, None] + np.arange(len(piece))).ravel()] = np.tile(piece, n)
    for k, data, off in ((1, role, role_off), (3, text, text_off)):
        out[np.arange(len(data)) + np.repeat(begins[:, k] - off[:-1], np.diff(off))] = data
    off = np.concatenate([[0], ends[:, -1]]) if n else np.zeros(1, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(out)]), begins[:, 3] - off[:-1], ends[:, 3] - off[:-1]


def _starts(part: pa.RecordBatch, off: np.ndarray) -> np.ndarray:
    """The rows at which a piece begins: those of another conversation than the row before, and where
    a conversation's bytes pass a multiple of PIECE_BYTES."""
    conv = part.column("conv_id")
    null = conv.is_null().to_numpy(zero_copy_only=False)
    ids = conv.fill_null(0).to_numpy()
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])])
    begin = off[np.flatnonzero(new)][np.cumsum(new) - 1]
    share = (off[:-1] - begin) // PIECE_BYTES
    return np.flatnonzero(new | np.concatenate([[True], share[1:] != share[:-1]]))


@trimmed
def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns -> (conv_id, first turn and role, turns, formatted, loss spans).  A piece is a run of
    the assembled buffer, cut by offsets; none spans two batches."""
    for batch in batches:
        for part, _, _ in slices(batch):
            formatted, begin, end = assemble(part.column("role"), part.column("text"))
            _, off, data = formatted.buffers()
            off = np.frombuffer(off, np.int64)[: part.num_rows + 1]
            starts = _starts(part, off)
            stops = np.concatenate([starts[1:], [part.num_rows]])
            piece = np.repeat(np.arange(len(starts)), stops - starts)
            body = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(off[starts], off[-1])), data]).cast(pa.binary())
            loss = np.flatnonzero(pc.equal(part.column("role"), LOSS_ROLE).fill_null(False).to_numpy(zero_copy_only=False))
            base = off[loss] - off[starts[piece[loss]]]
            spans = pa.StructArray.from_arrays([pa.array(base + begin[loss]), pa.array(base + end[loss])], ["start", "end"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(loss, np.append(starts, part.num_rows)).astype(np.int32)), spans)
            rows = pa.array(starts)
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(rows) for c in ("conv_id", "turn", "role")), pa.array(stops - starts), body, lists], ["conv_id", "turn", "role", "n_turns", "formatted", "loss"])


def format_conversations(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> (conv_id, turn, role, n_turns, formatted, loss): pieces of
    conversations; in order of (conv_id, turn, role, number) their `formatted` bytes, end to end, are
    the formatted conversations.  turn and role are those of a piece's first turn, `piece` counts on;
    loss: byte ranges of the piece that hold LOSS_ROLE's texts, escaped.

    Null roles and texts are empty strings; a null conv_id is a conversation of its own, a null turn
    comes first; ties go by role, then text; repeated rows stay.  Empty tables give no pieces.
    """
    rows = tuned(turns).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.repartitionByRange(shuffle_partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    kind = "conv_id long, turn long, role string, n_turns long, formatted binary, loss array<struct<start:bigint,end:bigint>>"
    # range partitions come in order, so this number orders the pieces of a conversation
    return rows.mapInArrow(_pieces, kind).withColumn("piece", F.monotonically_increasing_id())


def read_turns(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """The (role, text) pairs of formatted bytes."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


@trimmed
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order -> a row for each conversation, read back from the formatted bytes."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    rows: list[list] = []
    now: dict = {}

    def close() -> None:
        rows.append([now["conv"], now["n"], now["turns"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["all"]])
        now.clear()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)
        rows.clear()
        return batch

    for batch in batches:
        for conv, body, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
            if now and now["conv"] != conv:
                close()
            if not now:
                now.update(conv=conv, n=0, turns=hashlib.sha256(), loss=hashlib.sha256(), chars=0, all=0)
            for role, text in read_turns(body):
                now["turns"].update(role + b"\n" + text + b"\n")
                now["n"] += 1
            for span in loss:
                text = unescape(body[span["start"] : span["end"]])
                now["loss"].update(text)
                now["chars"] += len(text.decode())
            now["all"] += len(body.decode())
        if len(rows) > 5000:
            yield out()
    if now:
        close()
    yield out()


def conversation_digests(pieces: DataFrame) -> DataFrame:
    """What is read back from format_conversations' pieces, a row for each conversation.  A
    conversation's digests are sequential: its pieces stream through one task, one at a time."""
    rows = pieces.select("conv_id", "piece", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return rows.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
