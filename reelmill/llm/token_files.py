"""Token ids as flat binary files with 64-bit document offsets.

Documents are range-partitioned and sorted by id; every partition writes one shard:

* ``<shard>.bin``: its documents' ids one after the other, unsigned 16-bit if the
  vocabulary allows, else 32-bit, little-endian;
* ``<shard>.idx``: a header of four 64-bit integers (magic, bytes per id, documents,
  documents with a null id), then the offsets of its documents in the ``.bin`` (one
  more than documents) and their doc ids, all 64-bit little-endian;
* ``manifest``: a Parquet table with a row per shard.  Bases of shards are prefix sums
  of its token counts.

A shard's name holds the task attempt, and the manifest lists those of committed tasks
only, so a lost executor or a second attempt leaves at most a file nobody reads.

Defined results: a null text is empty and has the end id alone; null ids come first;
rows with the same id follow each other by a hash of the text, exact copies in any
order; an empty table has an empty manifest; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import map_arrow
from .tokens import encoder

MAGIC = 0x52454C4D544F4B31
MANIFEST = "shard long, file string, id_bytes long, n_docs long, n_tokens long"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI; any that pyarrow and Spark both know will do."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write ``docs`` under ``path``, a folder all executors reach."""
    vocabulary = max(Tokenizer.from_file(tokenizer_path).get_vocab().values()) + 1
    kind = np.dtype("<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        where, root = _open(path)
        file = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        encode = encoder(tokenizer_path, end_id).encode
        ends, ids_of_docs, nulls, total, out = [], [], 0, 0, None
        try:
            for batch in batches:
                if out is None:
                    where.create_dir(root, recursive=True)
                    out = where.open_output_stream(f"{root}/{file}.bin")
                nulls += batch.column(0).null_count
                ids_of_docs.append(batch.column(0).fill_null(0).to_numpy().astype("<i8"))
                lengths = []
                for ids in encode(batch.column(1).to_pylist()):
                    out.write(ids.astype(kind))
                    lengths.append(len(ids))
                ends.append(total + np.cumsum(lengths, dtype="<i8"))
                total = int(ends[-1][-1]) if lengths else total
        finally:
            if out is not None:
                out.close()
        if out is None:
            return
        n = sum(map(len, ids_of_docs))
        with where.open_output_stream(f"{root}/{file}.idx") as index:
            index.write(np.array([MAGIC, kind.itemsize, n, nulls], "<i8").tobytes())
            index.write(np.concatenate([np.zeros(1, "<i8"), *ends]).astype("<i8").tobytes())
            for part in ids_of_docs:
                index.write(part.tobytes())
        yield pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([task.partitionId()], pa.int64()),
                "file": [file],
                "id_bytes": pa.array([kind.itemsize], pa.int64()),
                "n_docs": pa.array([n], pa.int64()),
                "n_tokens": pa.array([total], pa.int64()),
            }
        )

    order = [F.col(id_col), F.xxhash64(text_col)]
    ordered = docs.select(id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order)
    shards = map_arrow(ordered, run, MANIFEST, encoder)
    shards.write.mode("errorifexists").parquet(f"{path}/manifest")


def _mapped(where: fs.FileSystem, file: str, kind: np.dtype, skip: int = 0) -> np.ndarray:
    """A file as an array: mapped into memory if it is local, else read."""
    if isinstance(where, fs.LocalFileSystem):
        return np.frombuffer(pa.memory_map(file).read_buffer(), kind, offset=skip)
    return np.frombuffer(where.open_input_file(file).read_buffer(), kind, offset=skip)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files under ``path``: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts all ids of earlier documents, over all shards.  The checksum is
    that of the ids as little-endian unsigned 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = _open(path)
        for batch in batches:
            for row in batch.to_pylist():
                index = _mapped(where, f"{root}/{row['file']}.idx", np.dtype("<i8"))
                magic, id_bytes, n, nulls = index[:4].tolist()
                if magic != MAGIC or n != row["n_docs"] or index[4 + n] != row["n_tokens"]:
                    raise ValueError(f"{row['file']} is not the shard its manifest names")
                offsets, ids_of_docs = index[4 : 5 + n], index[5 + n :]
                ids = _mapped(where, f"{root}/{row['file']}.bin", np.dtype(f"<u{id_bytes}"))
                checksums = [
                    zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(offsets[:-1], offsets[1:], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids_of_docs, pa.int64(), mask=np.arange(n) < nulls),
                        pa.array(offsets[:-1] + row["base"], pa.int64()),
                        pa.array(np.diff(offsets), pa.int64()),
                        pa.array(checksums, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    # One row per shard: small enough to be summed up in order in a single task.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    # Dealt round robin, a shard to a task; adaptive execution must not merge them again.
    shards = max(1, manifest.count())
    return map_arrow(
        based.repartition(shards), run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
