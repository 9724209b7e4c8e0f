"""Chat formatting by columnar byte assembly.

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``.  The bytes of a block of turns
are put together at once: lengths of all segments (header, text, end), their
cumulative offsets and the source index of every byte are computed in numpy, and one
preallocated buffer takes the copy and becomes the Arrow column.

Escapes are reversible: in texts and roles, ``<``, any backslashes and ``|`` get one
more backslash before the bar, so no control string can occur inside; a role's own
backslashes and line ends are written ``\\\\`` and ``\\n``.

Every turn is a row of its own, so a conversation of any length is spread over tasks.

Defined results: null texts and roles are empty; turns are ordered by number (null
first), then role, then text, so repeated rows are repeated turns; a null conversation
id is a conversation; an empty table gives an empty one; further columns are not read.
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

from .common import map_arrow

START, END = "<|im_start|>", "<|im_end|>\n"
LEARNED_ROLE = "assistant"
#: Bytes assembled at once, and the length from which a segment is copied as a slice.
BLOCK_BYTES, SLICE_BYTES = 1 << 22, 1 << 14

_ESCAPED = re.compile(r"<(\\*)\\\|")
_ROLE_MARK = re.compile(r"\\(.)", re.S)


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\1\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def header(role: str) -> bytes:
    marked = role.replace("\\", "\\\\").replace("\n", "\\n")
    return f"{START}{re.sub(r'<(\\*)\|', r'<\1\\|', marked)}\n".encode()


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not (segment.startswith(START) and segment.endswith(END)):
        raise ValueError("not a formatted turn")
    role, _, text = segment[len(START) : -len(END)].partition("\n")
    role = _ROLE_MARK.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(role))
    return role, unescape(text)


def _assemble(headers: list[bytes], role: np.ndarray, texts: pa.Array) -> pa.Array:
    """One string per row: its role's header, its text, the end mark."""
    n = len(role)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    content = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    fixed = np.frombuffer(b"".join(headers) + END.encode(), np.uint8)
    header_size = np.array([len(h) for h in headers], np.int64)
    header_at = np.cumsum(header_size) - header_size

    size = np.empty((n, 3), np.int64)
    size[:, 0], size[:, 1], size[:, 2] = header_size[role], np.diff(bounds), len(END)
    origin = np.empty((n, 3), np.int64)  # in fixed followed by content
    origin[:, 0] = header_at[role]
    origin[:, 1] = len(fixed) + bounds[:-1] - bounds[0]
    origin[:, 2] = len(fixed) - len(END)
    size, origin = size.ravel(), origin.ravel()
    ends = np.cumsum(size)
    target = ends - size
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)

    source = np.concatenate([fixed, content])
    short = size < SLICE_BYTES
    lengths = size[short]
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(target[short], lengths) + within] = source[np.repeat(origin[short], lengths) + within]
    for k in np.flatnonzero(~short):
        out[target[k] : ends[k]] = source[origin[k] : origin[k] + size[k]]
    offsets = np.concatenate([np.zeros(1, np.int64), ends[2::3]])
    return pa.Array.from_buffers(pa.large_utf8(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _blocks(texts: pa.Array) -> Iterator[slice]:
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // BLOCK_BYTES
    edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
    yield from (slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a)


def format_chat(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Formatted turns with their loss spans, in code points of the formatted turn.

    Columns: id, turn, ``formatted``, ``loss_start``, ``loss_length``.  Only what the
    assistant says is under the loss mask.
    """
    types = {c: turns.schema[c].dataType.simpleString() for c in (id_col, turn_col)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            roles = batch.column(2).cast(pa.string()).fill_null("").dictionary_encode()
            names = roles.dictionary.to_pylist()
            role = roles.indices.to_numpy().astype(np.int64)
            headers = [header(r) for r in names]
            texts = escape(batch.column(3).cast(pa.large_utf8()).fill_null(""))
            learned = np.array([r == LEARNED_ROLE for r in names])[role]
            begins = np.array([len(h.decode()) for h in headers], np.int64)[role]
            lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            for part in _blocks(texts):
                rows = slice(part.start, part.stop)
                formatted = _assemble(headers, role[rows], texts.slice(part.start, part.stop - part.start))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.start, part.stop - part.start),
                        batch.column(1).slice(part.start, part.stop - part.start),
                        formatted.cast(pa.string()),
                        pa.array(np.where(learned[rows], begins[rows], 0), pa.int64()),
                        pa.array(np.where(learned[rows], lengths[rows], 0), pa.int64()),
                    ],
                    names=[id_col, turn_col, "formatted", "loss_start", "loss_length"],
                )

    return map_arrow(
        turns.select(id_col, turn_col, role_col, text_col),
        run,
        f"`{id_col}` {types[id_col]}, `{turn_col}` {types[turn_col]}, formatted string,"
        " loss_start long, loss_length long",
    )


def digest_chat(formatted: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Digests per conversation, parsed back from its formatted turns.

    A digest over a whole conversation is sequential by nature.  Turns stream through
    it sorted, so a task holds one batch of turns and two running digests.
    """
    id_type = formatted.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, arrow_type = None, None, None

        def result() -> pa.RecordBatch:
            n, turns, loss_chars, loss, chars = state
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([current], arrow_type),
                    pa.array([n], pa.int64()),
                    pa.array([turns.hexdigest()]),
                    pa.array([loss_chars], pa.int64()),
                    pa.array([loss.hexdigest()]),
                    pa.array([chars], pa.int64()),
                ],
                names=[id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

        for batch in batches:
            arrow_type = batch.schema.field(0).type
            columns = (batch.column(k).to_pylist() for k in range(4))
            for conv, segment, start, length in zip(*columns, strict=True):
                if state is None or conv != current:
                    if state is not None:
                        yield result()
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(segment)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if length:
                    learned = unescape(segment[start : start + length])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(segment)
        if state is not None:
            yield result()

    return map_arrow(
        formatted.repartition(F.col(id_col))
        .sortWithinPartitions(id_col, turn_col, "formatted")
        .select(id_col, "formatted", "loss_start", "loss_length"),
        run,
        f"`{id_col}` {id_type}, n_turns long, turns_sha256 string, loss_chars long,"
        " loss_sha256 string, formatted_chars long",
    )
