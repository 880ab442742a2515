"""Near-duplicate vectors by spherical k-means cells and blocked cosines (operator 6).

Equal vectors are one; a third of all rows may be copies of one vector.  Spherical
k-means, fitted on at most ``sample`` vectors, assigns every vector to the cell of its
nearest centroid.  A vector also visits a lower-numbered cell where a vector at the
threshold's angle could be at home: its distance from the plane between the two centroids
must not exceed the sine of that angle.  So every pair is met in exactly one cell, and no
link is lost.  Cells are cut into blocks, pairs of blocks are multiplied as matrices (in
single precision to sort out, in double precision to decide), and each product hands on
one row per linked vector: its number of links and its component within the product.

Cost: vectors that lie in tight groups visit few cells.  Vectors without any neighbour in
many dimensions lie near all planes and visit many; for those the exact bound comes close
to comparing all.  ``sure`` above the threshold narrows the visits: pairs of at least that
cosine are still all found, fainter ones only where their cells meet.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different lengths do not link; rows that repeat a vec_id are rows of
their own; a null vec_id counts as a linked vector but never names a component that has
another id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .components import components

SAMPLE = 20_000
CELL_VECTORS = 4096
MOST_CELLS = 1024
BLOCK = 4096
STRIP = 512  # rows of a product at a time
ROUNDS = 12
SLACK = 1e-4  # of single precision


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """One row per distinct valid vector: rep (its least vec_id), copies, dims."""
    whole = F.size("embedding") > 0
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    nonzero = F.exists("embedding", lambda x: x != 0)
    valid = vectors.where(F.col("embedding").isNotNull() & whole & finite & nonzero)
    one = valid.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    return one.select("embedding", "rep", "copies", F.size("embedding").alias("dims"))


def _unit(column: pa.Array, dims: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centroids(one: DataFrame, dims: int, n: int, sample: int = SAMPLE) -> np.ndarray:
    """Spherical k-means on the ``sample`` vectors of least hash; as many cells as ``n`` vectors ask for."""
    k = int(min(MOST_CELLS, max(1, n // CELL_VECTORS)))
    if k == 1:
        return np.eye(1, dims)
    chosen = one.select("embedding").orderBy(F.xxhash64("embedding")).limit(sample).toArrow()
    x = _unit(chosen["embedding"].combine_chunks(), dims)
    rng = np.random.default_rng(7)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        cell = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centroids)
    return centroids


def assigned(one: DataFrame, centroids: np.ndarray, sure: float) -> DataFrame:
    """Each vector at home in its cell, and as a guest in the lower cells it must visit."""
    dims, sine = centroids.shape[1], float(np.sqrt(max(0.0, 1 - sure * sure)))
    apart = np.linalg.norm(centroids[:, None] - centroids[None], axis=2)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column(0), dims)
            near = x @ centroids.T
            home = near.argmax(axis=1)
            best = near[np.arange(len(x)), home]
            visits = best[:, None] - near <= sine * apart[home] + 1e-9
            visits &= np.arange(len(centroids))[None] < home[:, None]
            row, cell = np.nonzero(visits)
            rows = np.concatenate([np.arange(len(x)), row])
            yield pa.record_batch(
                [
                    pa.array(np.concatenate([home, cell]), pa.int32()), pa.array(np.arange(len(rows)) >= len(x)),
                    batch.column(1).take(pa.array(rows)), batch.column(2).take(pa.array(rows)),
                    batch.column(0).take(pa.array(rows)),
                ],
                ["cell", "guest", "node", "copies", "v"],
            )

    kind = one.schema["embedding"].dataType.simpleString()
    return one.select("embedding", "node", "copies").mapInArrow(
        assign, f"cell int, guest boolean, node long, copies long, v {kind}"
    )


def _local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least reachable position of each of ``n`` positions under the links (a, b)."""
    label = np.arange(n)
    while True:
        now = label.copy()
        np.minimum.at(now, a, label[b])
        np.minimum.at(now, b, label[a])
        now = now[now]
        if (now == label).all():
            return label
        label = now


def _products(dims: int, threshold: float):
    def product(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        right = table["right"].to_numpy(zero_copy_only=False).astype(bool)
        alone = bool(table["alone"][0].as_py())
        x = _unit(table["v"].combine_chunks(), dims)
        node = table["node"].to_numpy(zero_copy_only=False)
        copies = table["copies"].to_numpy(zero_copy_only=False)
        left_rows = np.flatnonzero(~right)
        right_rows = left_rows if alone else np.flatnonzero(right)
        rough = x.astype(np.float32)
        links = np.zeros(len(x), np.int64)
        root = np.arange(len(x))
        for strip in range(0, len(left_rows), STRIP):
            own = left_rows[strip : strip + STRIP]
            i, j = np.nonzero(rough[own] @ rough[right_rows].T >= threshold - SLACK)
            if alone:
                i, j = i[i + strip < j], j[i + strip < j]
            a, b = own[i], right_rows[j]
            keep = np.zeros(len(a), bool)
            for at in range(0, len(a), 1 << 16):
                part = slice(at, at + (1 << 16))
                keep[part] = np.einsum("ij,ij->i", x[a[part]], x[b[part]]) >= threshold
            a, b = a[keep], b[keep]
            links += (np.bincount(a, copies[b], len(x)) + np.bincount(b, copies[a], len(x))).astype(np.int64)
            # what a strip links is joined with what the strips before have linked
            root = _local_components(len(x), np.append(a, np.arange(len(x))), np.append(b, root))
        hit = np.flatnonzero(links > 0)
        return pa.table({
            "node": pa.array(node[hit], pa.int64()), "links": pa.array(links[hit]),
            "root": pa.array(node[root[hit]], pa.int64()),
        })

    return product


def linked(one: DataFrame, dims: int, threshold: float, sure: float) -> DataFrame:
    """node, links and root rows from every product of two blocks of a cell."""
    n = one.count()
    centroids = fit_centroids(one, dims, n)
    placed = staged(assigned(one, centroids, sure))
    # every cell is cut by the number of its vectors; a row per cell comes to the driver
    sizes = placed.groupBy("cell").agg(F.count_if(~F.col("guest")).alias("h"), F.count_if("guest").alias("g"))
    blocks = sizes.select(
        "cell", F.greatest(F.ceil(F.col("h") / BLOCK), F.lit(1)).cast("int").alias("h"),
        F.ceil(F.col("g") / BLOCK).cast("int").alias("g"),
    )
    cut = placed.join(F.broadcast(blocks), "cell")  # MOST_CELLS rows at most
    own = F.pmod(F.xxhash64("node"), F.when(F.col("guest"), F.col("g")).otherwise(F.col("h"))).cast("int")
    cut = cut.withColumn("own", own)
    # a unit is a pair of blocks (home i, home j >= i) or (home i, guest j)
    home = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda j: F.struct(
            F.least("own", j).alias("i"), F.greatest("own", j).alias("j"), F.lit(False).alias("with_guest"),
            (j < F.col("own")).alias("right"), (j == F.col("own")).alias("alone"),
        )),
        F.when(F.col("g") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("g") - 1, F.lit(0))), lambda j: F.struct(
            F.col("own").alias("i"), j.alias("j"), F.lit(True).alias("with_guest"),
            F.lit(False).alias("right"), F.lit(False).alias("alone"),
        ))).otherwise(F.array()),
    )
    guest = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda i: F.struct(
        i.alias("i"), F.col("own").alias("j"), F.lit(True).alias("with_guest"),
        F.lit(True).alias("right"), F.lit(False).alias("alone"),
    ))
    sent = cut.select(
        "cell", "node", "copies", "v", F.explode(F.when(F.col("guest"), guest).otherwise(home)).alias("u")
    ).select("cell", "u.i", "u.j", "u.with_guest", "u.right", "u.alone", "node", "copies", "v")
    units = sent.groupBy("cell", "i", "j", "with_guest")
    return units.applyInArrow(_products(dims, threshold), "node long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, sure: float | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    one = staged(distinct_vectors(rows).withColumn("node", F.monotonically_increasing_id()))
    parts = []
    for dims in sorted(r["dims"] for r in one.select("dims").distinct().collect()):
        part = one.where(F.col("dims") == dims)
        parts.append(linked(part, dims, threshold, threshold if sure is None else sure))
    empty = one.limit(0).select("node", F.col("copies").alias("links"), F.col("node").alias("root"))
    every = empty
    for part in parts:
        every = every.unionByName(part)
    every = staged(every)
    counts = every.groupBy("node").agg(F.sum("links").alias("links"))
    group = components(every.select(F.col("node").alias("a"), F.col("root").alias("b")))
    nodes = one.join(counts, "node", "left").join(group, "node", "left").select(
        "embedding", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("component", "node").alias("component"),
    )
    nodes = staged(nodes)
    least = nodes.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = nodes.join(least, "component").select("embedding", "copies", "links", "component_id")
    met = rows.join(known, "embedding", "left")
    component = F.coalesce("component_id", "vec_id")
    return met.select(
        "vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
