"""Chat formatting by columnar byte assembly.

The turns of a conversation become one text: each turn is ``<|im_start|>``, the role, a line feed, the text, ``<|im_end|>`` and a
line feed. Control strings inside a role or text are escaped by a backslash after their first character (one more, where there are
some already), which can be undone and leaves no control string. Line feeds inside a role are escaped as a control string too.

The bytes of a batch are laid out by numpy: lengths of all segments, their cumulative offsets, and scatter indices along which
headers and contents are copied into one buffer that becomes the Arrow column.

The loss mask lists the code point ranges of the contents of ``assistant`` turns.

Defined results: a null text or role is the empty one; turns are ordered by turn (null first), role and text, so ties and
repeated rows have one order; a null conversation id is a conversation of its own; no rows, no conversations.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The markers of the template, and control strings of other common templates that are escaped as well.
START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "\n"
_TAIL = r"\||/?s>|/?INST\]|</?SYS>>"
_ESCAPE, _UNESCAPE = rf"([<\[])(\\*)({_TAIL})", rf"([<\[])\\(\\*)({_TAIL})"
#: A line feed in a role would end its header.
_ROLE_ESCAPE, _ROLE_UNESCAPE = ("\\", "\\\\"), ("\n", "\\n")
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
_UNDO = re.compile(_UNESCAPE)
#: Rows and bytes formatted at once, bytes from which a segment is copied as one slice, and bytes scattered at once.
ROWS, BYTES, SLICE, SCATTER = 4_000, 8 << 20, 512, 1 << 20
OUT = "turns long, formatted string, mask array<struct<start:bigint,end:bigint>>"


def escaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, _ESCAPE, r"\1\\\2\3")


def unescaped(text: str) -> str:
    return _UNDO.sub(r"\1\2\3", text)


def _escaped_roles(roles: pa.Array) -> pa.Array:
    for plain, safe in (_ROLE_ESCAPE, _ROLE_UNESCAPE):
        roles = pc.replace_substring(roles, plain, safe)
    return escaped(roles)


def _plain_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role), flags=re.S)


def read_back(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and the range of the (escaped) content, of every turn of a formatted conversation."""
    return [(_plain_role(m[1]), unescaped(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(formatted)]


def _segments(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of the values of a string array."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return np.frombuffer(data or b"", np.uint8), offsets[:-1], np.diff(offsets)


def assemble(role: pa.Array, text: pa.Array, first: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted conversations, whose first turns are at ``first``, and the code point range of each turn's content in its conversation."""
    n = len(role)
    role, body = _escaped_roles(role), escaped(text)
    parts = [pa.array([START] * n, pa.large_string()), role, pa.array([NEWLINE] * n, pa.large_string()), body,
             pa.array([END + NEWLINE] * n, pa.large_string())]
    pieces = [_segments(p) for p in parts]
    lengths = np.stack([p[2] for p in pieces], axis=1).ravel()
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    buffer = np.empty(offsets[-1], np.uint8)
    for k, (data, starts, sizes) in enumerate(pieces):
        to = offsets[k:-1:len(pieces)]
        for i in np.flatnonzero(sizes >= SLICE):
            buffer[to[i]:to[i] + sizes[i]] = data[starts[i]:starts[i] + sizes[i]]
        short = np.flatnonzero((sizes > 0) & (sizes < SLICE))
        ends = np.cumsum(sizes[short])
        at = 0
        while at < len(short):
            until = max(at + 1, int(np.searchsorted(ends, ends[at] + SCATTER)))
            own = short[at:until]
            size = sizes[own]
            # Every byte of a segment moves by the distance between its old and its new place.
            run = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            buffer[run + np.repeat(to[own], size)] = data[run + np.repeat(starts[own], size)]
            at = until
    conversation = offsets[np.append(first, n) * len(pieces)]
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(conversation.astype(np.int64)), pa.py_buffer(buffer))
    points = np.stack([pc.utf8_length(p).to_numpy(zero_copy_only=False) for p in parts], axis=1).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(points.sum(axis=1))])
    base = np.repeat(before[first], np.diff(np.append(first, n)))
    start = before[:-1] - base + points[:, :3].sum(axis=1)
    return formatted, start, start + points[:, 3]


def _format(rows: pa.Table) -> pa.RecordBatch:
    ids = rows.column("conv_id").combine_chunks()
    role = pc.fill_null(rows.column("role").combine_chunks().cast(pa.large_string()), "")
    text = pc.fill_null(rows.column("text").combine_chunks().cast(pa.large_string()), "")
    codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    formatted, start, end = assemble(role, text, first)
    spoken = pc.equal(role, "assistant").to_numpy(zero_copy_only=False)
    edges = np.concatenate([[0], np.cumsum(np.add.reduceat(spoken.astype(np.int64), first))])
    ranges = pa.StructArray.from_arrays([pa.array(start[spoken]), pa.array(end[spoken])], ["start", "end"])
    turns = np.diff(np.append(first, len(ids)))
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(first)), pa.array(turns), formatted.cast(pa.string()),
         pa.ListArray.from_arrays(pa.array(edges, pa.int32()), ranges)], ["conv_id", "turns", "formatted", "mask"])


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``ROWS`` rows and, unless one row is longer, ``BYTES`` bytes of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(sizes[at - 1]) if at else 0
        until = min(at + ROWS, max(at + 1, int(np.searchsorted(sizes, before + BYTES, "right"))))
        yield batch.slice(at, until - at)
        at = until


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations of a partition sorted by conversation, some thousand rows or some megabytes at a time."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        for part in _cut(batch):
            codes = pc.fill_null(pc.not_equal(part.column(0), part.column(0)[-1]), True).to_numpy(zero_copy_only=False)
            codes = codes if part.column(0)[-1].is_valid else part.column(0).is_valid().to_numpy(zero_copy_only=False)
            cut = int(np.flatnonzero(codes)[-1]) + 1 if codes.any() else 0
            if cut == 0 and waiting and waiting[-1].column(0)[-1].equals(part.column(0)[-1]):
                waiting.append(part)
                continue
            same = waiting and waiting[-1].column(0)[-1].equals(part.column(0)[0])
            if waiting and not same:
                yield _format(pa.Table.from_batches(waiting))
                waiting = []
            if cut:
                yield _format(pa.Table.from_batches([*waiting, part.slice(0, cut)]))
                waiting = []
            waiting.append(part.slice(cut))
    if waiting:
        yield _format(pa.Table.from_batches(waiting))


def formatted(turns: DataFrame) -> DataFrame:
    """``conv_id, turns, formatted, mask`` of every conversation of ``conv_id, turn, role, text``."""
    narrow = turns.select("conv_id", "turn", "role", "text")
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = narrow.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(_runs, f"conv_id {narrow.schema['conv_id'].dataType.simpleString()}, {OUT}")


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted texts and masks say, read back: see the query of this operator."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, mask in zip(batch.column(1), batch.column(2)):
                text, turns, loss = text.as_py(), hashlib.sha256(), hashlib.sha256()
                found = read_back(text)
                for role, said, _, _ in found:
                    turns.update(f"{role}\n{said}\n".encode())
                chars = 0
                for span in mask.as_py():
                    said = unescaped(text[span["start"]:span["end"]])
                    chars += len(said)
                    loss.update(said.encode())
                out.append((len(found), turns.hexdigest(), chars, loss.hexdigest(), len(text)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            cells = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), k) for c, k in zip(cells, kinds)]],
                                             ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = chats.schema["conv_id"].dataType.simpleString()
    return chats.select("conv_id", "formatted", "mask").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
