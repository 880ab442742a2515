"""Exact dedup by recipes of content-defined chunks (operator 13).

Normalised texts (A-Z in lower case) are cut where a rolling hash of the last ``WINDOW``
bytes meets a pattern, so equal texts are cut alike and long ones share chunks.  A chunk's
identifier is a 128-bit hash; a text's recipe is the ordered list of its chunks'
identifiers, and texts are compared by these lists instead of by what they hold.

Identifiers are verified: of all texts whose recipe occurs more than once, every chunk is
grouped by its identifier, each distinct chunk of a task sent once, and least and greatest
chunk of a group must be the same bytes.  Recipes go by a 128-bit hash in the same way,
whose lists must agree.  Where either fails, all starts again with the next seed.  So
grouped texts are equal byte by byte, and a long text itself is moved for this only where
a copy of its recipe exists, once a task.

Cases: a null text counts as empty, and an empty one has an empty recipe; of equal texts
the row of the largest doc_id stays (null is smaller than any), of rows that agree in it
that of the least text hash, and of rows that agree in both one; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, staged
from .memory import forget, give_back
from .pretokens import mixed
from .words import _powers_of, lowered, slices, text_bytes

WINDOW = 32
LEAST, MEAN, MOST = 1 << 10, 1 << 12, 1 << 16  # bytes of a chunk but a text's last
SLICE_BYTES = 2 << 20
HOT_SHARE = 1024  # at most so many groups hold more than one row in so many

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = mixed(np.arange(256) + (13 << 40))

Identify = Callable[[bytes, int], bytes]


def hashed(data: bytes, seed: int) -> bytes:
    """16 bytes that stand for ``data``."""
    import xxhash

    return xxhash.xxh3_128_digest(data, seed)


def _marks(data: np.ndarray) -> np.ndarray:
    """Where a window of ``WINDOW`` bytes ends that a chunk may end with."""
    found, n = [], len(data)
    for at in range(0, n, SLICE_BYTES):
        begin = max(0, at - WINDOW)
        part = data[begin : at + SLICE_BYTES]
        if len(part) < WINDOW:
            continue
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * _powers_of(_BASE, len(part)), out=sums[1:])
        values = (sums[WINDOW:] - sums[:-WINDOW]) * _powers_of(_INVERSE, len(part) - WINDOW + 1)
        values ^= values >> np.uint64(29)
        values *= np.uint64(0xBF58476D1CE4E5B9)
        ends = np.flatnonzero(values < np.uint64((1 << 64) // (MEAN - LEAST))) + WINDOW + begin
        found.append(ends[ends > at])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def cuts(size: int, marks: list[int]) -> list[int]:
    """The ends of a text's chunks: marks that are ``LEAST`` to ``MOST`` bytes apart."""
    out, at = [], 0
    for mark in [*marks, size]:
        while mark - at > MOST:
            at += MOST
            out.append(at)
        if mark - at >= LEAST or (mark == size and mark > at):
            at = mark
            out.append(at)
    return out


def chunked(column: pa.Array) -> Iterator[tuple[bytes, list[bytes]]]:
    """Each text, normalised, and its chunks."""
    sizes = text_bytes(column)[1]
    for at, end in slices(sizes, SLICE_BYTES):
        data, own = text_bytes(column.slice(at, end - at))
        data = lowered(data)
        marks, edge, whole = _marks(data), np.append(0, np.cumsum(own)), data.tobytes()
        # a window that begins before its text is none of it
        first = np.searchsorted(marks, edge[:-1] + WINDOW)
        last = np.searchsorted(marks, edge[1:], "right")
        for i in range(len(own)):
            text = whole[edge[i] : edge[i + 1]]
            ends = cuts(len(text), (marks[first[i] : last[i]] - edge[i]).tolist()) if len(text) > LEAST else [len(text)] * bool(text)
            yield text, [text[b:e] for b, e in zip([0, *ends], ends, strict=False)]


def recipes(docs: DataFrame, seed: int, identify: Identify = hashed) -> DataFrame:
    """row, doc_id, tie, text_sha256, the recipe, and its hash ``r``, of every document; written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            sha, recipe = [], []
            for text, chunks in chunked(batch.column(1)):
                sha.append(hashlib.sha256(text).hexdigest())
                recipe.append(b"".join(identify(c, seed) for c in chunks))
            yield pa.record_batch(
                [
                    pa.array(row + np.arange(batch.num_rows)), batch.column(0), batch.column(2),
                    pa.array(sha, pa.string()), pa.array(recipe, pa.binary()),
                    pa.array([identify(r, seed) for r in recipe], pa.binary()),
                ],
                ["row", "doc_id", "tie", "text_sha256", "recipe", "r"],
            )
            row += batch.num_rows
            give_back()

    schema = "row long, doc_id long, tie long, text_sha256 string, recipe binary, r binary"
    return staged(_read(docs, True).mapInArrow(run, schema))


def _read(docs: DataFrame, tie: bool) -> DataFrame:
    ties = [F.xxhash64("text").alias("tie")] if tie else []
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *ties)


def _chunks(docs: DataFrame, seed: int, identify: Identify) -> DataFrame:
    """(r, id, chunk) of every text, but those that a task has already sent for the same recipe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            # texts of a batch that are equal are sent once: the rest is the shuffle's
            sent: dict[bytes, set[bytes]] = {}
            rows: tuple[list, list, list] = ([], [], [])
            size = 0
            for text, chunks in chunked(batch.column(0)):
                ids = [identify(c, seed) for c in chunks]
                r = identify(b"".join(ids), seed)
                digest = hashlib.sha256(text).digest()
                if digest in sent.setdefault(r, set()):
                    continue
                sent[r].add(digest)
                for i, chunk in zip(ids, chunks, strict=True):
                    for column, value in zip(rows, (r, i, chunk), strict=True):
                        column.append(value)
                    size += len(chunk)
                if size >= SLICE_BYTES:
                    yield _record(rows)
                    rows, size = ([], [], []), 0
            yield _record(rows)
            give_back()

    return _read(docs, False).select("text").mapInArrow(run, "r binary, id binary, chunk binary")


def _record(rows: tuple[list, list, list]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, pa.binary()) for x in rows], ["r", "id", "chunk"])


def _verified(docs: DataFrame, groups: DataFrame, seed: int, identify: Identify) -> bool:
    """Whether each identifier stands for one chunk, in all texts that have an equal recipe elsewhere."""
    if not groups.where("NOT same").isEmpty():
        return False
    again = groups.where("n > 1").select("r")
    chunks = _chunks(docs, seed, identify)
    few = again.limit(BROADCAST_ROWS + 1).count()
    if not few:
        return True
    if few <= BROADCAST_ROWS:
        # beyond that all chunks are grouped: a shuffle by recipe would move them twice
        chunks = chunks.join(F.broadcast(again), "r", "left_semi")
    each = chunks.groupBy("id").agg(F.min("chunk").alias("least"), F.max("chunk").alias("greatest"))
    return each.where("least <> greatest").isEmpty()


def exact_groups(docs: DataFrame, identify: Identify = hashed) -> DataFrame:
    """Every row with its group: row, doc_id, keep_id, group_size, kept, text_sha256."""
    for seed in count():
        rows = recipes(docs, seed, identify)
        keeper = F.max(F.struct("doc_id", F.bitwise_not("tie").alias("tie"), F.bitwise_not("row").alias("row")))
        groups = rows.groupBy("r").agg(
            keeper.alias("keeper"), F.count("*").alias("n"), (F.min("recipe") == F.max("recipe")).alias("same")
        )
        groups = staged(groups)
        if _verified(docs, groups, seed, identify):
            break
    total = rows.count()
    of_row = rows.select("row", "doc_id", "text_sha256", "r")
    found = groups.select(
        "r", F.col("keeper.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        F.bitwise_not("keeper.row").alias("keep_row"),
    )
    # groups of more than one row in HOT_SHARE: at most HOT_SHARE of them, so they may be broadcast
    hot = F.broadcast(found.where(F.col("group_size") * HOT_SHARE > total))
    warm = of_row.join(hot, "r")
    cold = of_row.join(hot.select("r"), "r", "left_anti").join(found, "r")
    return warm.unionByName(cold).select(
        "row", "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )
