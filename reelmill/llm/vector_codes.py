"""Vector compression by product quantisation in exact integer arithmetic.

Components become integers, vectors are cut into equal parts, and every part position has
a codebook that a few rounds of nearest-entry assignment refine.  A round is one scan:
tasks assign their parts and emit one row per codebook place with its sum, Spark adds
these up, and the driver gets the sums of one codebook table, whose size does not depend
on the rows.  Nothing is shuffled but those sums, so a vector or label that a third of
all rows share is no hot key.

Squared distances come from matrix products of float64 that are exact: integers are
broken into limbs so narrow that no product's sum reaches 2^53, and the products of limbs
are put together again as 64-bit integers.  Integers too large for 64-bit distances take
the same way as Python's own integers.

Defined results: rows whose vector is null or holds nulls, NaN or infinities are dropped;
null ids come last in the order of ids; rows that share an id are ordered by their vector
and each has a result; fewer kept rows than entries make smaller codebooks; an empty
table, or one without kept rows, has an empty result; null labels are one label; only the
three named columns are read.  Vectors of several lengths, lengths that the parts do not
divide, and errors beyond a long are refused by an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import broadcast_if_small, map_arrow

SUMS = "part int, entry int, place int, total decimal(38,0)"
#: The place under which the number of assigned parts is summed up.
COUNT = -1
#: Vectors that are worked on together.
TOGETHER = 4096


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """``x`` as float64 limbs of ``bits`` bits, lowest first; the last one has the sign."""
    out = []
    while len(x) and (x.max(initial=0) >= 1 << bits or x.min(initial=0) < -(1 << bits)):
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact products (parts, n, width) x (parts, entries, width) -> (parts, n, entries)."""
    if x.dtype == object:
        return np.einsum("pnw,pew->pne", x, y)
    width = x.shape[2]
    bits = (52 - max(1, width).bit_length()) // 2  # width * 2^bits * 2^bits < 2^53
    total = np.zeros((x.shape[0], x.shape[1], y.shape[1]), np.int64)
    right = [part.transpose(0, 2, 1) for part in limbs(y, bits)]
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(right):
            total += (a @ b).astype(np.int64) << (bits * (i + j))
    return total


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part the first nearest entry and its squared distance, both (parts, n)."""
    most = max(int(abs(x).max(initial=0)), int(abs(books).max(initial=0)), 1)
    if 4 * most * most * max(1, x.shape[0] * x.shape[2]) >= 1 << 63:
        x, books = x.astype(object), books.astype(object)
    far = (x * x).sum(2)[:, :, None] - 2 * dots(x, books) + (books * books).sum(2)[:, None, :]
    first = far.argmin(2) if x.shape[1] else np.zeros(far.shape[:2], np.int64)
    return first, np.take_along_axis(far, first[:, :, None], 2)[:, :, 0]


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); Python's integers where 64 bits do not hold them."""
    low = np.floor(values.astype(np.float64) * scale)
    if (abs(low) < 2.0**62).all():
        return low.astype(np.int64)
    return np.array([int(v) for v in low], object)


def _parts(column: pa.Array, parts: int, width: int, scale: int) -> np.ndarray:
    """The vectors of a column as integers (parts, n, width)."""
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != parts * width).any():
        raise ValueError("all vectors must have one length, a multiple of the number of parts")
    flat = integers(column.flatten().to_numpy(zero_copy_only=False), scale)
    return flat.reshape(len(column), parts, width).transpose(1, 0, 2)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, TOGETHER):
            yield batch.slice(first, TOGETHER)


def finite(vector: str) -> F.Column:
    """Whether a vector is there, and all of its components are finite numbers."""
    return F.coalesce(
        F.forall(vector, lambda x: F.abs(x.cast("double")) < float("inf")), F.lit(False)
    )


def fit_codebooks(
    kept: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> np.ndarray:
    """Codebooks (parts, entries, width) over all rows of ``kept`` (columns id, vector)."""
    first = kept.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries)
    vectors = [r["vector"] for r in first.collect()]
    if len({len(v) for v in vectors}) > 1 or (vectors and len(vectors[0]) % parts):
        raise ValueError("all vectors must have one length, a multiple of the number of parts")
    width = len(vectors[0]) // parts if vectors else 0
    flat = integers(np.array(vectors, np.float64).reshape(-1), scale)
    books = flat.reshape(len(vectors), parts, width).transpose(1, 0, 2)
    for _ in range(rounds if vectors else 0):
        books = _refined(kept, books, scale)
    return books


def _refined(kept: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width), object)
        counts = np.zeros((parts, entries), np.int64)
        for batch in _blocks(batches):
            x = _parts(batch.column(0), parts, width, scale)
            near, _ = nearest(x, books)
            for p in range(parts):
                counts[p] += np.bincount(near[p], minlength=entries)
                for e in np.unique(near[p]):
                    mine = x[p][near[p] == e]
                    # Sums of a block stay in 64 bits unless its integers are huge.
                    if mine.dtype != object and abs(mine).max(initial=0) >= 1 << 48:
                        mine = mine.astype(object)
                    sums[p, e] += mine.sum(0).astype(object)
        rows = [
            (p, e, place, total)
            for p, e in np.argwhere(counts).tolist()
            for place, total in [(COUNT, int(counts[p, e])), *enumerate(sums[p, e].tolist())]
        ]
        if rows:
            part, entry, place, total = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part, pa.int32()),
                    pa.array(entry, pa.int32()),
                    pa.array(place, pa.int32()),
                    pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)),
                ],
                names=["part", "entry", "place", "total"],
            )

    sums = map_arrow(kept.select("vector"), run, SUMS).groupBy("part", "entry", "place")
    # At most parts x entries x (width + 1) rows, however many vectors there are.
    found = {(r[0], r[1], r[2]): int(r[3]) for r in sums.agg(F.sum("total").alias("total")).collect()}
    out = books.astype(object)
    for p, e in [(p, e) for p, e, place in found if place == COUNT]:
        n = found[p, e, COUNT]
        out[p, e] = [found[p, e, place] // n for place in range(width)]
    # Components stay between those of the vectors, so they fit where those did.
    return out if books.dtype == object else out.astype(np.int64)


def codebooks_digest(books: np.ndarray) -> str:
    """Hex SHA-256 of all integers by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
) -> DataFrame:
    """Codes of all kept vectors: id, code, error, label_error, codebooks_sha256.

    ``code`` has two hex digits per part, ``error`` is the sum of the squared distances to
    the entries it names, ``label_error`` the sum of errors over all rows of the label.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits name up to 256 entries")
    named = {"id": id_col, "label": label_col, "vector": vector_col}
    every = vectors.select(*[F.col(f"`{c}`").alias(name) for name, c in named.items()])
    kept = every.where(finite("vector"))
    books = fit_codebooks(kept, parts, entries, rounds, scale)
    digits = np.array([f"{e:02x}" for e in range(max(1, books.shape[1]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            x = _parts(batch.column(2), parts, books.shape[2], scale)
            near, far = nearest(x, books)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(["".join(d) for d in digits[near].T.tolist()], pa.string()),
                    pa.array(far.sum(0).tolist(), pa.int64()),
                ],
                names=["id", "label", "code", "error"],
            )

    types = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in ("id", "label"))
    codes = stage(map_arrow(kept, run, f"{types}, code string, error long"), "codes")
    totals = stage(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors")
    totals = broadcast_if_small(totals.withColumnRenamed("label", "of_label"))
    return codes.join(totals, F.col("label").eqNullSafe(F.col("of_label"))).select(
        F.col("id").alias(id_col),
        "code",
        "error",
        "label_error",
        F.lit(codebooks_digest(books)).alias("codebooks_sha256"),
    )
