"""Sum-of-squares online packing of token ids into fixed windows.

Each task packs the documents of its partition as they come, without a shuffle.  A
document longer than a window fills whole windows first; its rest is placed online
into the fill level that keeps the sum of squared counts of partially filled windows
smallest.  The level array holds, per fill level, how many open windows have it, and
only open windows are held in memory: at most ``max_open`` of them.

What is still open at the end of a partition (or beyond ``max_open``) is cut freely
into full windows; the last remainder is cut at powers of two, which need no padding.

Defined results: a null text is an empty one and packs its end id alone; an empty
table packs to nothing; repeated rows are packed once each; only the id and text
columns are read, so further columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import map_arrow
from .tokens import REMEMBERED, encoder

SCHEMA = (
    "start long, length long, token_ids binary, doc_tokens long, sequence_id long, offset long"
)
#: Sequence numbers a partition may use.
SPAN = 1 << 40
#: Output bytes sent together, at most about.
BATCH_BYTES = 1 << 23


class Packer:
    """One partition's windows.  A piece is (doc, start, ids, doc_tokens)."""

    def __init__(self, window: int, max_open: int):
        self.window, self.max_open = window, max_open
        self.counts = np.zeros(window + 1, np.int32)  # the level array
        self.never = np.iinfo(np.int32).max
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.n_open = 0
        self.n_sequences = 0
        self.done: list[tuple] = []

    def _close(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, doc_tokens in pieces:
            self.done.append((doc, start, ids, doc_tokens, self.n_sequences, offset))
            offset += len(ids)
        self.n_sequences += 1

    def level_for(self, size: int) -> int:
        """The fill level for a piece: 0 is a new window.

        Moving a window from level h to h + size changes the sum of squares by
        1 - 2 n(h) and, unless that fills it, 1 + 2 n(h + size).  Ties go to the
        fuller window.
        """
        window, n = self.window, self.counts
        best, level = 1 + 2 * int(n[size]) if size < window else 0, 0
        # Between two levels only n(h + size) - n(h) differs.
        apart = n[size:window] - n[: window - size]
        apart[n[: window - size] == 0] = self.never
        if size < window and (least := int(apart.min())) != self.never and 2 + 2 * least <= best:
            best, level = 2 + 2 * least, window - size - 1 - int(apart[::-1].argmin())
        if n[window - size] and 1 - 2 * int(n[window - size]) <= best:
            level = window - size
        return level

    def add(self, doc, ids: np.ndarray) -> None:
        total = len(ids)
        whole = total - total % self.window
        for start in range(0, whole, self.window):
            self._close([(doc, start, ids[start : start + self.window], total)])
        size = total - whole
        if not size:
            return
        level = self.level_for(size)
        if level:
            pieces = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append((doc, whole, ids[whole:], total))
        if level + size == self.window:
            self._close(pieces)
            return
        self.open[level + size].append(pieces)
        self.counts[level + size] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            self.flush(last=False)

    def flush(self, last: bool = True) -> None:
        """Cut what the open windows hold into full ones, fullest first.

        The remainder stays open, or is cut at powers of two if it is the last.
        """
        queue = [p for windows in reversed(self.open) for w in windows for p in w]
        self.counts[:] = 0
        self.open = [[] for _ in range(self.window + 1)]
        self.n_open = 0
        rest = sum(len(p[2]) for p in queue)

        def next_room() -> int:
            if last and 0 < rest < self.window:
                return 1 << (rest.bit_length() - 1)
            return self.window

        room, pieces = next_room(), []
        for doc, start, ids, total in queue:
            while len(ids):
                cut = min(room, len(ids))
                pieces.append((doc, start, ids[:cut], total))
                start, ids, room, rest = start + cut, ids[cut:], room - cut, rest - cut
                if room == 0:
                    self._close(pieces)
                    room, pieces = next_room(), []
        if pieces:
            size = self.window - room
            self.open[size].append(pieces)
            self.counts[size] += 1
            self.n_open += 1


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    window: int = 2048,
    max_open: int = 4096,
    remembered: int = REMEMBERED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of documents with their ids (little-endian unsigned 32-bit) and places.

    ``start`` counts the document's ids before the piece, ``offset`` the sequence's.
    """
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, end_id, remembered).encode
        packer = Packer(window, max_open)
        first = TaskContext.get().partitionId() * SPAN
        ids_type = None

        def drain() -> pa.RecordBatch:
            rows, packer.done = packer.done, []
            doc, start, ids, total, sequence, offset = zip(*rows, strict=True)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(4 * lengths, dtype=np.int32)])
            flat = np.concatenate(ids).astype("<u4", copy=False)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(doc, ids_type),
                    pa.array(start, pa.int64()),
                    pa.array(lengths),
                    pa.Array.from_buffers(
                        pa.binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(flat)]
                    ),
                    pa.array(total, pa.int64()),
                    pa.array(np.array(sequence, np.int64) + first),
                    pa.array(offset, pa.int64()),
                ],
                names=[id_col, "start", "length", "token_ids", "doc_tokens", "sequence_id", "offset"],
            )

        for batch in batches:
            ids_type = batch.schema.field(0).type
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, ids in zip(doc_ids, encode(texts), strict=True):
                packer.add(doc, ids)
                if len(packer.done) * window * 4 >= BATCH_BYTES:
                    yield drain()
        packer.flush()
        if packer.done:
            yield drain()

    return map_arrow(
        docs.select(id_col, text_col),
        run,
        f"`{id_col}` {id_type.simpleString()}, {SCHEMA}",
        encoder,
    )
