"""Centroid clustering in exact integers, over a table of distances to pivots (operator 11).

Vectors become integers once.  A few of the first centroids are the pivots; every
vector's squared distances to them are stored beside it (the pivot table).  In each round
the distances of the centroids to the pivots are known, and by the triangle inequality
the difference of two distances to a pivot bounds the distance of vector and centroid from
below.  A vector starts with the centroid of least bound; only centroids whose bound does
not exceed the best distance so far get an exact integer distance.  A round sends one row
of sums per task and cluster to the shuffle, and k rows to the driver.

Cases: a vector that is null, has another number of components, or holds a null or
non-finite component is left out; rows that repeat a vec_id are vectors of their own, and
first centroids of one vec_id go by their components; a null vec_id is never among the
first centroids while others are left; fewer vectors than clusters make fewer clusters; an
empty table gives no rows; equal distances go to the smaller number; a component that
needs more than ``LARGEST`` raises an error, since distances would not fit a long; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .memory import give_back

LARGEST = 1 << 24  # of an integer component: distances over 2^10 components fit a long
BLOCK_ROWS = 4096
PIVOTS = 16


def quantised(vectors: DataFrame, dims: int, steps: int) -> DataFrame:
    """vec_id and ``q``, floor(steps * x) of each component, for the vectors that count."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    own = vectors.select(F.col("vec_id").cast("long"), x.cast("array<double>").alias("embedding"))
    own = own.where((F.size("embedding") == dims) & finite)

    def step(v):
        scaled = steps * v
        fits = (scaled >= -LARGEST) & (scaled <= LARGEST)
        return F.when(fits, F.floor(F.when(fits, scaled))).otherwise(F.raise_error(F.lit("a component is too large")))

    return own.select("vec_id", F.transform(x, lambda v: step(v).cast("int")).alias("q"))


@dataclass(frozen=True)
class Nearest:
    """What a task needs to find nearest centroids: they, the pivots, and the distances between."""

    centroids: np.ndarray
    pivots: np.ndarray

    def __call__(self, vectors: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each vector's nearest centroid, and how many were computed."""
        mine = np.sqrt(to_pivots.astype(np.float64))
        theirs = np.sqrt(squared(self.centroids, self.pivots).astype(np.float64))
        least = np.zeros((len(vectors), len(self.centroids)))
        for p in range(len(self.pivots)):
            np.maximum(least, np.abs(mine[:, p, None] - theirs[None, :, p]), out=least)
        # roots and their differences are off by less than this
        least -= 1e-9 + 1e-12 * (mine.max(axis=1, initial=0)[:, None] + theirs.max(initial=0))
        first = least.argmin(axis=1)
        best = rows_apart(vectors, self.centroids[first])
        number, computed = first.copy(), len(vectors)
        for c in range(len(self.centroids)):
            at = np.flatnonzero((least[:, c] <= np.sqrt(best.astype(np.float64))) & (first != c))
            apart = rows_apart(vectors[at], self.centroids[c])
            nearer = (apart < best[at]) | ((apart == best[at]) & (c < number[at]))
            at, apart, computed = at[nearer], apart[nearer], computed + len(at)
            best[at], number[at] = apart, c
        return number, best, computed


def rows_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    difference = a.astype(np.int64) - b
    return np.einsum("ij,ij->i", difference, difference)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of ``a`` to every row of ``b``, a few."""
    return np.stack([rows_apart(a, row) for row in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)


def _chosen_pivots(centroids: np.ndarray, n: int) -> np.ndarray:
    """The first centroid, and again and again the one furthest from all chosen."""
    chosen = [0]
    while len(chosen) < min(n, len(centroids)):
        apart = squared(centroids, centroids[chosen]).min(axis=1)
        if not apart.max():
            break
        chosen.append(int(apart.argmax()))
    return centroids[chosen]


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(dtype, copy=False)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(at, BLOCK_ROWS)


def pivot_table(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, q and the squared distances to the pivots; written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            apart = squared(_matrix(block.column(1), np.int32), pivots)
            offsets = np.arange(len(apart) + 1, dtype=np.int32) * len(pivots)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(apart.reshape(-1)))
            yield pa.record_batch([block.column(0), block.column(1), lists], ["vec_id", "q", "pivots"])
        give_back()

    return staged(vectors.select("vec_id", "q").mapInArrow(run, "vec_id long, q array<int>, pivots array<long>"))


def _sums(table: DataFrame, nearest: Nearest) -> dict[int, tuple[int, list[int]]]:
    """Of each non-empty cluster: the number of its vectors and their sums by component."""
    k, dims = nearest.centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for block in _blocks(batches):
            own = _matrix(block.column(0), np.int32)
            number, _, _ = nearest(own, _matrix(block.column(1), np.int64))
            count += np.bincount(number, minlength=k)
            for c in np.unique(number).tolist():
                sums[c] += own[number == c].sum(axis=0, dtype=np.int64)
        at = np.flatnonzero(count)
        offsets = np.arange(len(at) + 1, dtype=np.int32) * dims
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums[at].reshape(-1)))
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(count[at]), lists], ["cluster", "n", "sums"])
        give_back()

    parts = table.select("q", "pivots").mapInArrow(run, "cluster int, n long, sums array<long>")
    wide = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *wide).collect()
    return {r["cluster"]: (r["n"], [int(r[f"s{i}"]) for i in range(dims)]) for r in rows}


def _assigned(table: DataFrame, nearest: Nearest) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            number, best, _ = nearest(_matrix(block.column(1), np.int32), _matrix(block.column(2), np.int64))
            yield pa.record_batch(
                [block.column(0), pa.array(number.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"]
            )
        give_back()

    return table.mapInArrow(run, "vec_id long, cluster int, distance long")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of smallest hashed vec_id, in that order."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.orderBy(named.asc_nulls_last(), "q").limit(k).select("q").collect()
    return np.array([r["q"] for r in rows], np.int64)


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, steps: int = 64, seed: int = 1,
    pivots: int = PIVOTS,
) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256."""
    if dims * (2 * LARGEST) ** 2 >= 1 << 63:
        raise ValueError("distances in so many dimensions do not fit a long")
    spark = vectors.sparkSession
    whole = quantised(vectors, dims, steps)
    centroids = first_centroids(whole, k, seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    chosen = _chosen_pivots(centroids, pivots)
    table = pivot_table(whole, chosen)
    for _ in range(rounds):
        for c, (n, sums) in _sums(table, Nearest(centroids, chosen)).items():
            centroids[c] = [s // n for s in sums]
    placed = staged(_assigned(table, Nearest(centroids, chosen)))
    inertia = {
        r["cluster"]: int(r["d"])
        for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    }
    told = [
        (c, d, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
        for c, d in inertia.items()
    ]
    clusters = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # k rows at most
    return placed.join(F.broadcast(clusters), "cluster").select(*[c.split()[0] for c in schema.split(", ")])
