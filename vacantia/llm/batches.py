"""Texts in compressed batches, for operators that go over them more than once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .memory import forget, give_back
from .words import slices, text_bytes

BATCH_BYTES = 4 << 20
BATCH_ROWS = 1 << 20
NO_ID = -(1 << 63)
BATCHES = "batch long, n_bytes long, data binary, sizes binary, doc_ids binary"
TIES = "ties binary"


def squeezed(data: bytes, level: int = 1) -> bytes:
    """Bytes compressed by zstd; ``stretched`` gives them back."""
    return pa.Codec("zstd", level).compress(data, asbytes=True) if data else b""


def stretched(data: bytes, n_bytes: int) -> bytes:
    return pa.decompress(data, n_bytes, "zstd", asbytes=True) if n_bytes else b""


def packed(docs: DataFrame, ties: bool = False, level: int = 1) -> DataFrame:
    """doc_id and text of all rows, in batches of about ``BATCH_BYTES`` that are written once.

    Every later step sees the same batches, whatever is lost and run again.  A row is known
    by its batch's number times ``BATCH_ROWS`` plus its place.  With ``ties`` a batch also has
    the hashes of its texts.  ``level`` is that of the compression: batches that are shuffled as
    well are worth a higher one.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        n = TaskContext.get().partitionId() << 20
        for rows in batches:
            sizes = text_bytes(rows.column(1))[1]
            for at, end in slices(sizes, BATCH_BYTES):
                for begin in range(at, end, BATCH_ROWS):
                    part = rows.slice(begin, min(end, begin + BATCH_ROWS) - begin)
                    data, own = text_bytes(part.column(1))
                    ids = part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                    row = [
                        pa.array([n], pa.int64()), pa.array([len(data)], pa.int64()),
                        pa.array([squeezed(data.tobytes(), level)], pa.binary()),
                        pa.array([own.tobytes()], pa.binary()), pa.array([ids.tobytes()], pa.binary()),
                    ]
                    names = ["batch", "n_bytes", "data", "sizes", "doc_ids"]
                    if ties:
                        row.append(pa.array([part.column(2).to_numpy(zero_copy_only=False).tobytes()], pa.binary()))
                        names.append("ties")
                    yield pa.record_batch(row, names)
                    n += 1
            give_back()

    columns = [F.col("doc_id").cast("long"), F.col("text").cast("string"), *([F.xxhash64("text")] if ties else [])]
    return staged(docs.select(*columns).mapInArrow(pack, f"{BATCHES}, {TIES}" if ties else BATCHES))


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, sizes and doc_ids of a batch."""
    return (
        np.frombuffer(stretched(row["data"], row["n_bytes"]), np.uint8),
        np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["doc_ids"], np.int64)
    )
