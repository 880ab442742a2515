"""Exact Jaccard join on word shingles that uses relations between sets (operator 8).

Documents with equal sets are one class; only one set of a class is joined.  Shingles are
ordered by how many sets hold them, rare ones first, so two sets that link share one of
their first shingles (the prefix).  An index list holds the sets of a prefix shingle, in
blocks of like size, each entry with the shingle's position in its set.

* Skipping in the index: blocks more than one size step apart are never paired; a pair is
  skipped when what follows the two positions cannot hold the overlap it needs.
* Skipping in the answers: in every block one set, the pivot, is compared with all others,
  then some more in lists where several components still meet.  What that yields answers
  for the rest: sets that both overlap a pivot enough are linked without a look at them,
  sets whose differences from a pivot they share cannot make up the overlap they need are
  skipped, and sets in one component already are not asked for again.  What is left is
  compared set by set, each pair from one of its lists.

Links found are exact and lose none: what is not compared is decided by bounds or joins
two sets of one component.  Set cardinalities and overlaps are exact but for collisions of
64-bit shingle hashes.

Cases: a null or empty text has an empty set and links with nothing; fewer words than a
shingle are one shingle; rows that repeat a text are of one class; a null doc_id belongs
to its class but never names a component that has another id; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .batches import BATCH_ROWS, NO_ID, packed, unpacked
from .components import components
from .memory import give_back, rows_of
from .pretokens import mixed
from .words import from_planes, lowered, planes, words_of

COUNTED_BYTES = 5  # of a hash, for document counts: a collision there only changes the order
GROUP_SHINGLES = 2_000_000
BYTES_PER_WORD = 6
SIZE_STEP = 1.25  # at most 1 / similarity: sets further apart in size cannot link
HEAD = 16  # first prefix shingles by which a pair is taken from one list only
PIVOTS = (8, 64)  # pivots that an open list gets on an average, round by round
KNOWN = 64  # pivots' answers that a set carries; more would only skip more


def sets_of(data: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All (text, shingle hash) of a batch, distinct and in that order."""
    words = words_of(lowered(data), sizes)
    values, window = words.windows(k)
    text = words.text[window]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        # a text of fewer words is one shingle, told apart from others by its length
        sums = np.append(np.uint64(0), np.cumsum(words.hash * _places(words)))
        whole = mixed(sums[words.first[short + 1]] - sums[words.first[short]] + count[short].astype(np.uint64))
        values, text = np.concatenate([values, whole]), np.concatenate([text, short.astype(text.dtype)])
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return text[new], values[new]


def _places(words) -> np.ndarray:
    """A factor for each word by its place in its text."""
    return mixed(np.arange(len(words.hash)) - words.first[words.text] + (11 << 40)) | np.uint64(1)


def _digests(text: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two 64-bit digests of each text's set."""
    size = np.bincount(text, minlength=n)
    first = np.cumsum(size) - size
    a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    full = size > 0
    if len(values):
        a[full] = np.add.reduceat(values, first[full])
        b[full] = np.add.reduceat(mixed(values), first[full])
    return size, a, b


def _first_of_set(size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mask of the texts that come first with their set."""
    order = np.lexsort((np.arange(len(size)), b, a, size))
    new = np.ones(len(order), bool)
    new[1:] = (size[order][1:] != size[order][:-1]) | (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    out = np.zeros(len(order), bool)
    out[order[new]] = True
    return out & (size > 0)


def _counted(values: np.ndarray) -> np.ndarray:
    return values >> np.uint64(64 - 8 * COUNTED_BYTES)


def _frequencies(batches: DataFrame, k: int, bits: int) -> DataFrame:
    """For each batch and bucket of shingles: a byte per shingle, the rank of its document count."""

    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(rows):
            data, sizes, _ = unpacked(row)
            text, values = sets_of(data, sizes, k)
            alone = _first_of_set(*_digests(text, values, len(sizes)))
            shingles, count = np.unique(_counted(values[alone[text]]), return_counts=True)
            count = np.minimum(count, 0xFFFF).astype(np.uint16)
            bounds = np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(8 * COUNTED_BYTES - bits)
            cuts = np.searchsorted(shingles, bounds)
            for bucket in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[bucket], cuts[bucket + 1])
                yield pa.record_batch(
                    [
                        pa.array([bucket], pa.int32()), pa.array([row["batch"]], pa.int64()),
                        pa.array([planes(shingles[part], COUNTED_BYTES)], pa.binary()),
                        pa.array([planes(count[part], 2)], pa.binary()),
                    ],
                    ["bucket", "batch", "shingles", "count"],
                )

    def rank(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [from_planes(r["shingles"], COUNTED_BYTES, np.uint64) for r in rows]
        every, back = np.unique(np.concatenate(parts), return_inverse=True)
        count = np.concatenate([from_planes(r["count"], 2, np.uint16) for r in rows])
        total = np.bincount(back, count, len(every))
        # 0: in one set only; then by quarters of a doubling
        ranks = np.where(total == 1, 0, np.minimum(255, 1 + 4 * np.log2(total))).astype(np.uint8)[back]
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        give_back()
        return pa.table({
            "batch": pa.array([r["batch"] for r in rows], pa.int64()),
            "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
            "ranks": pa.array([x.tobytes() for x in np.split(ranks, cuts)], pa.binary()),
        })

    counted = batches.mapInArrow(emit, "bucket int, batch long, shingles binary, count binary")
    return staged(counted.groupBy("bucket").applyInArrow(rank, "batch long, bucket int, ranks binary"))


SETS = "row long, doc_id long, tie long, size long, a long, b long, shingles array<long>, leading int"


def shingle_sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per row its set's size and digests, and the set itself where it may link.

    ``shingles`` are those that more than one set holds, rare ones first; ``leading`` of
    them lie in the prefix.  Both are null where the prefix has none, since then no other
    set links, and for all but one row of equal sets in a batch.
    """
    batches = packed(docs, ties=True)
    total = batches.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(1, int(np.ceil(np.log2(max(2, total / BYTES_PER_WORD / GROUP_SHINGLES)))))
    ranks = _frequencies(batches, k, bits)

    def build(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        answers = [r["ranks"] for r in sorted(right.to_pylist(), key=lambda r: r["bucket"])]
        for row in left.to_pylist():
            data, sizes, doc_ids = unpacked(row)
            text, values = sets_of(data, sizes, k)
            size, a, b = _digests(text, values, len(sizes))
            alone = _first_of_set(size, a, b)
            keep = alone[text]
            text, values = text[keep], values[keep]
            _, back = np.unique(_counted(values), return_inverse=True)
            rank = np.frombuffer(b"".join(answers), np.uint8)[back] if len(values) else np.zeros(0, np.uint8)
            order = np.lexsort((values, rank, text))
            text, values, rank = text[order], values[order], rank[order]
            own = np.bincount(text, minlength=len(sizes))
            unique = np.bincount(text[rank == 0], minlength=len(sizes))
            prefix = np.where(own > 0, own - -(-percent * own // 100) + 1, 0)
            leading = np.maximum(0, prefix - unique)
            candidate = leading > 0
            shared = (rank > 0) & candidate[text]
            offsets = np.append(0, np.cumsum(np.where(candidate, own - unique, 0))).astype(np.int32)
            lists = pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(values[shared].view(np.int64)), mask=pa.array(~candidate)
            )
            out.append(pa.table({
                "row": pa.array(row["batch"] * BATCH_ROWS + np.arange(len(sizes)), pa.int64()),
                "doc_id": pa.array(doc_ids, pa.int64(), mask=doc_ids == NO_ID),
                "tie": pa.array(np.frombuffer(row["ties"], np.int64)),
                "size": pa.array(size, pa.int64()), "a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64)),
                "shingles": lists, "leading": pa.array(leading, pa.int32(), mask=~candidate),
            }))
        give_back()
        return pa.concat_tables(out)

    return staged(batches.groupBy("batch").cogroup(ranks.groupBy("batch")).applyInArrow(build, SETS))


def _links(overlap: Column, x: Column, y: Column, percent: int) -> Column:
    return 100 * overlap >= percent * (x + y - overlap)


def _needed(x: Column, y: Column, percent: int) -> Column:
    """The least overlap with which sets of these sizes link."""
    return F.ceil(percent * (x + y) / (100 + percent) - 1e-9)


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (x, y) with sizes and exact overlap."""
    left = sets.select(F.col("row").alias("x"), F.col("size").alias("x_size"), F.col("shingles").alias("x_set"))
    right = sets.select(F.col("row").alias("y"), F.col("size").alias("y_size"), F.col("shingles").alias("y_set"))
    met = pairs.join(left, "x").join(right, "y")
    return met.select("x", "y", "x_size", "y_size", F.size(F.array_intersect("x_set", "y_set")).alias("overlap"))


def _open_members(entries: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """Entries of the lists in which more than one component meets, once for each such list.

    A list goes by its upper block and holds that block's sets and those of the block below.
    ``widest`` is the length of the longest open list that the entry's set is in.
    """
    component = staged(components(found)).withColumnRenamed("node", "row")
    named = entries.join(component, "row", "left").withColumn("component", F.coalesce("component", "row"))
    wide = named.withColumn("upper", F.explode(F.array(F.col("block"), F.col("block") + 1)))
    lists = staged(
        wide.groupBy("shingle", "upper")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"))
        .where("lo <> hi").select("shingle", "upper", "n")
    )
    members = staged(wide.join(lists, ["shingle", "upper"]))
    widest = members.groupBy("row").agg(F.max("n").alias("widest"))
    heads = sets.select("row", F.slice("shingles", 1, F.least("leading", F.lit(HEAD))).alias("head"))
    return staged(members.join(widest, "row").join(heads, "row"))


def _met(others: DataFrame, members: DataFrame, percent: int, undecided: Column | None = None) -> DataFrame:
    """Pairs (x, y) that meet in an open list, each from the first list that their heads share.

    ``undecided`` tells which of them the answers of pivots leave open.
    """
    size_o, size_m = F.col("o.size"), F.col("m.size")
    room = 1 + F.least(size_o - F.col("o.position") - 1, size_m - F.col("m.position") - 1)
    pairs = others.alias("o").join(
        members.alias("m"),
        (F.col("o.shingle") == F.col("m.shingle")) & (F.col("o.upper") == F.col("m.upper"))
        & (F.col("o.component") != F.col("m.component"))
        & ((F.col("o.block") == F.col("o.upper")) | (F.col("m.block") == F.col("m.upper")))
        & (100 * F.least(size_o, size_m) >= percent * F.greatest(size_o, size_m))
        & (room >= _needed(size_o, size_m, percent))
        & ~F.arrays_overlap(F.slice("o.head", 1, F.col("o.at")), F.col("m.head"))
        & (F.lit(True) if undecided is None else undecided),
    )
    return pairs.select(F.least("o.row", "m.row").alias("x"), F.greatest("o.row", "m.row").alias("y")).distinct()


def _known(answers: DataFrame, pivots: DataFrame) -> DataFrame:
    """Per row a map of its overlaps with pivots; of more than ``KNOWN`` those of least hash."""
    both = answers.select(F.col("x").alias("row"), F.col("y").alias("pivot"), "overlap").unionByName(
        answers.select(F.col("y").alias("row"), F.col("x").alias("pivot"), "overlap")
    )
    one = F.struct(F.xxhash64("pivot").alias("at"), "pivot", "overlap")
    first = F.slice(F.sort_array(F.collect_list(one)), 1, KNOWN)
    pairs = F.transform(first, lambda e: F.struct(e["pivot"], e["overlap"]))
    return both.join(pivots, "pivot", "left_semi").groupBy("row").agg(F.map_from_entries(pairs).alias("known"))


def links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between rows of ``sets`` that connect what is connected by all links.

    ``sets`` has one row per class: row, size, shingles, leading.
    """
    block = F.floor(F.log(F.col("size").cast("double")) / float(np.log(SIZE_STEP)) + 1e-9)
    entries = staged(
        sets.select(
            "row", "size", block.alias("block"), (F.col("size") - F.size("shingles")).alias("before"),
            F.posexplode(F.slice("shingles", 1, F.col("leading"))).alias("at", "shingle"),
        ).select("row", "size", "block", "shingle", "at", (F.col("before") + F.col("at")).alias("position"))
    )
    linked = _links(F.col("overlap"), F.col("x_size"), F.col("y_size"), percent)
    # the first pivot of a block is its least row; each set meets that of its own block and of the one below
    least = entries.groupBy("shingle", "block").agg(F.min("row").alias("pivot"))
    reach = F.explode(F.array(F.col("block"), F.col("block") - 1)).alias("met")
    stars = entries.select("row", "shingle", reach).join(
        least.select("shingle", F.col("block").alias("met"), "pivot"), ["shingle", "met"]
    ).where("row <> pivot")
    pairs = stars.select(F.least("row", "pivot").alias("x"), F.greatest("row", "pivot").alias("y")).distinct()
    answers = staged(_compared(pairs, sets))
    members = _open_members(entries, sets, answers.where(linked).select(F.col("x").alias("a"), F.col("y").alias("b")))

    # more pivots for the lists that are still open: as many in a long list as in a short one
    pivots = None
    for wanted in PIVOTS:
        if members.isEmpty():
            break
        drawn = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) * F.col("widest") < F.lit(wanted << 30)
        chosen = members.where(drawn)
        rows = chosen.select(F.col("row").alias("pivot")).distinct()
        pivots = rows if pivots is None else pivots.unionByName(rows).distinct()
        pairs = _met(chosen, members, percent).join(answers.select("x", "y"), ["x", "y"], "left_anti")
        answers = staged(answers.unionByName(_compared(pairs, sets)))
        found = answers.where(linked).select(F.col("x").alias("a"), F.col("y").alias("b"))
        members = _open_members(entries, sets, found)
    found = answers.where(linked).select(F.col("x").alias("a"), F.col("y").alias("b"))
    if pivots is None or members.isEmpty():
        return found

    members = staged(members.join(_known(answers, pivots), "row", "left"))
    counts = members.groupBy("shingle", "upper", "component").agg(F.count("*").alias("n"))
    largest = counts.groupBy("shingle", "upper").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    # the largest component of a list is met only by the others, never by itself
    others = members.join(largest, ["shingle", "upper"]).where("component <> largest")
    size_o, size_m = F.col("o.size"), F.col("m.size")

    def may_link(pivot: Column) -> Column:
        o, m = F.try_element_at("o.known", pivot), F.try_element_at("m.known", pivot)
        enough = F.least(o, m) + F.least(size_o - o, size_m - m) >= _needed(size_o, size_m, percent)
        return F.coalesce(enough | o.isNull() | m.isNull(), F.lit(True))

    undecided = F.coalesce(F.forall(F.map_keys("o.known"), may_link), F.lit(True))
    unseen = _met(others, members, percent, undecided).join(answers.select("x", "y"), ["x", "y"], "left_anti")
    more = _compared(unseen, sets).where(linked)
    return found.unionByName(more.select(F.col("x").alias("a"), F.col("y").alias("b")))


def join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; ``row`` tells rows of one id apart.

    ``tie`` is the hash of the text; ``kept`` names one row of each component, the least by
    doc_id (null last), tie and row.
    """
    if percent * SIZE_STEP < 100 - 1e-9:
        raise ValueError("blocks of sizes are too narrow for this similarity")
    sets = shingle_sets(docs, words, percent)
    digest = ["size", "a", "b"]
    classes = sets.where("size > 0").groupBy(*digest).agg(F.min("row").alias("class"))
    chosen = sets.where("leading IS NOT NULL").groupBy(*digest).agg(F.min("row").alias("row"))
    # the set of a class is that of one of its rows, and goes by the class's name
    one = staged(
        sets.where("leading IS NOT NULL").join(chosen.select("row"), "row").join(classes, digest)
        .select(F.col("class").alias("row"), "size", "shingles", "leading")
    )
    of_class = components(links(one, percent)).withColumnRenamed("node", "class")
    placed = (
        sets.select("row", "doc_id", "tie", *digest).join(classes, digest, "left").join(of_class, "class", "left")
        .select("row", "doc_id", "tie", "size", F.coalesce("component", "class", "row").alias("component"))
    )
    placed = staged(placed)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie", "row")
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min(order).alias("first"))
    return placed.join(least, "component").select(
        "row", "doc_id", "tie", F.col("size").alias("n_shingles"), "component_id",
        (F.col("row") == F.col("first.row")).alias("kept"),
    )
