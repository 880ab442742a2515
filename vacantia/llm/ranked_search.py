"""Ranked lexical search over a length-stratified index (operator 12).

Documents of equal normaliser m (a step of their length against the mean) are one
stratum.  A stratum, cut into parts of bounded size, is one row of the index: its
documents, and the postings of each term in runs of equal tf, most occurrences first.
Within a stratum an occurrence's weight depends on tf alone, so impacts are computed once
for each tf.

A query's bound in a part is the sum over its terms of the impact of the term's largest
tf there.  Bounds order the visits: the parts of the highest bounds are visited first,
which gives each query a threshold that its last place is sure to reach; after that only
parts whose bound reaches the threshold are visited, and tasks raise it as they go.
Scores are exact integers and nothing that could be among the best is left out.

The items asked for are taken in blocks of about ``BLOCK_TERMS`` terms; what the driver
holds is the terms of a block, their document counts and a threshold for each item.

Cases: a null or empty text has no terms; a document without terms is in no stratum; items
that share an item_id are one item with the terms of all of them, null being an id too;
documents are rows, so a doc_id that is there twice may be listed twice; a null doc_id
comes last among equal scores; an item without terms, or whose terms no document has, gets
no rows, as does an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread, staged
from .memory import forget, give_back
from .words import lowered, slices, text_bytes

# fixed values: what parts terms (ASCII but digits and letters), and the weights of the score
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MEAN_LENGTH, LENGTH_SHARE, SCALE = 100, 50, 1_000_000_000
TF_FACTOR, M_FACTOR = 1000, 20

PART_POSTINGS = 1 << 18
GROUPS_PER_CORE = 16
TABLE_CELLS = 2 << 20
SLICE_BYTES = 2 << 20
TASK_BYTES = 8 << 20  # a smaller index is spread over the cores
BLOCK_TERMS = 1 << 20
SEEDS = 4  # parts that are visited first for each item
NO_ID = (1 << 63) - 1


def split_terms(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms of texts in order, dictionary encoded, and the text that each is of."""
    # laid out anew, since not all string functions go by the offset of a slice
    data, sizes = text_bytes(column)
    ends = pa.py_buffer(np.append(0, np.cumsum(sizes)))
    lower = pa.LargeStringArray.from_buffers(len(column), ends, pa.py_buffer(lowered(data)))
    lists = pc.split_pattern_regex(lower, SEPARATORS)
    text = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full).dictionary_encode(), text[full.to_numpy(zero_copy_only=False)]


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) of every item, each term once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, text = split_terms(batch.column(1))
            yield pa.record_batch(
                [batch.column(0).take(pa.array(text)), words.dictionary_decode().cast(pa.string())], ["item_id", "term"]
            )

    read = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return staged(read.mapInArrow(run, "item_id long, term string").distinct())


def bags(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Of every document: row, doc_id, n (all terms), and the terms of the vocabulary by number, with tf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        asked = pa.array(vocabulary, pa.large_string())
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at, end in slices(text_bytes(batch.column(1))[1], SLICE_BYTES):
                part = batch.slice(at, end - at)
                words, text = split_terms(part.column(1))
                n = np.bincount(text, minlength=end - at)
                number = pc.fill_null(pc.index_in(words.dictionary, value_set=asked), -1).to_numpy(zero_copy_only=False)
                term = number[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int32)
                known = term >= 0
                keys, tf = np.unique(text[known] * len(vocabulary) + term[known], return_counts=True)
                of_text = keys // max(1, len(vocabulary))
                offsets = pa.array(np.searchsorted(of_text, np.arange(end - at + 1)).astype(np.int32))
                lists = [
                    pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32)))
                    for x in (keys % max(1, len(vocabulary)), tf)
                ]
                yield pa.record_batch(
                    [pa.array(row + np.arange(end - at)), part.column(0), pa.array(n.astype(np.int64)), *lists],
                    ["row", "doc_id", "n", "terms", "tfs"],
                )
                row += end - at
                del part, words, text, keys, tf
            give_back()

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return staged(read.mapInArrow(run, "row long, doc_id long, n long, terms array<int>, tfs array<int>"))


INDEX = (
    "m long, part int, n_docs int, doc_ids array<long>, doc_rows array<long>,"
    " run_terms array<int>, run_tfs array<int>, run_ends array<int>, places array<int>"
)


def _row(m: int, part: int, docs: np.ndarray, rows: np.ndarray, own: list, tfs: list) -> dict:
    """One part of a stratum: its documents, and runs of postings by term and falling tf."""
    place = np.repeat(np.arange(len(docs), dtype=np.int32), [len(t) for t in own])
    term = np.concatenate(own) if own else np.zeros(0, np.int32)
    tf = np.concatenate(tfs) if tfs else np.zeros(0, np.int32)
    order = np.lexsort((place, -tf, term))
    term, tf, place = term[order], tf[order], place[order]
    last = np.ones(len(term), bool)
    last[:-1] = (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])
    ends = np.flatnonzero(last) + 1
    return {
        "m": m, "part": part, "n_docs": len(docs), "doc_ids": docs, "doc_rows": rows,
        "run_terms": term[ends - 1], "run_tfs": tf[ends - 1], "run_ends": ends.astype(np.int32), "places": place,
    }


def index(every: DataFrame, documents: int, length: int, part_postings: int = PART_POSTINGS) -> DataFrame:
    """The stratified index over ``bags``; written once.

    ``documents`` and ``length`` are how many documents have terms, and all their terms.
    """
    wide = F.lit(LENGTH_SHARE).cast("decimal(3,0)") * F.col("n").cast("decimal(16,0)") * F.lit(documents).cast("decimal(18,0)")
    whole = every.where(F.size("terms") > 0).withColumn("wide", wide).withColumn(
        "m", MEAN_LENGTH - LENGTH_SHARE + F.expr(f"wide div CAST({length} AS DECIMAL(18,0))")
    )
    strata = whole.groupBy("m").agg(F.sum(F.size("terms")).alias("postings"))
    strata = strata.withColumn("parts", F.ceil(F.col("postings") / part_postings))
    # a stratum is a length: a narrow table, but with no bound that would allow a broadcast
    strata = staged(strata)
    cores = every.sparkSession.sparkContext.defaultParallelism
    # about one part a group, and enough groups that small inputs use all cores alike
    units = max(GROUPS_PER_CORE * cores, math.ceil((strata.agg(F.sum("postings")).first()[0] or 0) / part_postings))
    placed = _with_parts(whole, strata).withColumn("unit", F.pmod(F.xxhash64("m", "part"), F.lit(units)))

    def build(table: pa.Table) -> pa.Table:
        stratum, part = table["m"].to_numpy(), table["part"].to_numpy()
        order = np.lexsort((table["row"].to_numpy(), part, stratum))
        table = table.take(pa.array(order)).combine_chunks()
        stratum, part = stratum[order], part[order]
        doc = pc.fill_null(table["doc_id"], NO_ID).to_numpy()
        row = table["row"].to_numpy()
        terms, tfs = (table[c].combine_chunks() for c in ("terms", "tfs"))
        ends = np.append(0, np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False)))
        term, tf = (x.flatten().to_numpy(zero_copy_only=False) for x in (terms, tfs))
        first = np.flatnonzero(np.append(True, (stratum[1:] != stratum[:-1]) | (part[1:] != part[:-1])))
        out = []
        for b, e in zip(first, np.append(first[1:], len(row)), strict=True):
            cut = ends[b + 1 : e] - ends[b]
            whole_terms, whole_tfs = term[ends[b] : ends[e]], tf[ends[b] : ends[e]]
            out.append(_row(
                int(stratum[b]), int(part[b]), doc[b:e], row[b:e], np.split(whole_terms, cut), np.split(whole_tfs, cut)
            ))
        give_back()
        return pa.Table.from_pylist(out, _arrow_schema())

    read = placed.select("unit", "m", F.col("part").cast("int"), "row", "doc_id", "terms", "tfs")
    return staged(read.groupBy("unit").applyInArrow(build, INDEX))


def _with_parts(whole: DataFrame, strata: DataFrame) -> DataFrame:
    """Documents with the part of their stratum; only strata of more than one part are joined."""
    cut = strata.where("parts > 1").select("m", "parts")
    # at most one such stratum for each part's worth of postings; the others are whole
    joined = whole.join(F.broadcast(cut), "m", "left") if cut.count() <= 100_000 else whole.join(cut, "m", "left")
    return joined.withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)))


def _arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in INDEX.split(","))])


@dataclass(frozen=True)
class Items:
    """The items of a block: ids, their terms by number, laid end to end, and what each term weighs."""

    ids: list
    terms: np.ndarray
    first: np.ndarray
    weight: np.ndarray

    def bounds(self, part: dict) -> np.ndarray:
        """The most that a document of the part can score, for each item."""
        head = np.flatnonzero(np.append(True, part["run_terms"][1:] != part["run_terms"][:-1]))
        most = np.zeros(len(self.weight), np.int64)
        most[part["run_terms"][head]] = impacts(part["run_tfs"][head], part["m"])
        sums = np.append(0, np.cumsum((most * self.weight)[self.terms]))
        return sums[self.first[1:]] - sums[self.first[:-1]]

    def scores(self, part: dict, asked: np.ndarray, cells: int = TABLE_CELLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Items of ``asked``, a few at a time, with the scores of all documents of the part.

        What an occurrence adds is worked out once for each run.  Items together are rows of a
        table of terms by documents, gathered and added up; where that table would be too
        large, an item adds up its own postings.
        """
        runs, ends, places = part["run_terms"], part["run_ends"], part["places"]
        adds = self.weight[runs] * impacts(part["run_tfs"], part["m"])
        begins = np.append(0, ends[:-1])
        present, row_of_run = np.unique(runs, return_inverse=True)
        n = part["n_docs"]
        if (len(present) + 1) * n > cells:
            for item in asked.tolist():
                out = np.zeros(n, np.int64)
                for term in self.terms[self.first[item] : self.first[item + 1]].tolist():
                    for k in range(*np.searchsorted(runs, [term, term + 1])):
                        out[places[begins[k] : ends[k]]] += adds[k]  # a document is in one run of a term
                yield np.array([item]), out[None]
            return
        table = np.zeros((len(present) + 1, n), np.int64)
        sizes = ends - begins
        table[np.repeat(row_of_run, sizes), places] = np.repeat(adds, sizes)
        row_of_term = np.full(len(self.weight), len(present))
        row_of_term[present] = np.arange(len(present))
        count = self.first[asked + 1] - self.first[asked]
        for at, end in slices(count * n, cells):
            upto = np.cumsum(count[at:end])
            begin = upto - count[at:end]
            place = np.arange(upto[-1]) + np.repeat(self.first[asked[at:end]] - begin, count[at:end])
            yield asked[at:end], np.add.reduceat(table[row_of_term[self.terms[place]]], begin, axis=0)


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (SCALE * tf) // (TF_FACTOR * tf + M_FACTOR * m)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            row = {}
            for name in names:
                value = batch.column(name)[i]
                row[name] = value.values.to_numpy(zero_copy_only=False) if isinstance(value, pa.ListScalar) else value.as_py()
            yield row


def _visits(parts: DataFrame, items: Items) -> DataFrame:
    """(item, m, part, bound) of every part that can have a score for an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            bound = items.bounds(part)
            item = np.flatnonzero(bound > 0)
            yield pa.record_batch(
                [
                    pa.array(item.astype(np.int32)), pa.array(np.full(len(item), part["m"])),
                    pa.array(np.full(len(item), part["part"], np.int32)), pa.array(bound[item]),
                ],
                ["item", "m", "part", "bound"],
            )
        give_back()

    narrow = parts.select("m", "part", "run_terms", "run_tfs")
    return narrow.mapInArrow(run, "item int, m long, part int, bound long")


def _best(score: np.ndarray, doc: np.ndarray, row: np.ndarray, limit: int) -> np.ndarray:
    """Places of the best: by falling score, then doc_id, then row."""
    if len(score) > limit:
        least = np.partition(score, len(score) - limit)[len(score) - limit]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((row[at], doc[at], -score[at]))][:limit]


def _scored(parts: DataFrame, items: Items, limit: int, least: np.ndarray, only: bool) -> DataFrame:
    """The best documents of the parts for each item, at most ``limit`` an item and task.

    ``least`` is what a score must reach; with ``only``, a part is visited for the items
    in its column ``asked`` and for no others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = least.copy()
        found: dict[int, tuple] = {}
        for part in _parts(batches):
            bound = items.bounds(part)
            asked = part["asked"] if only else np.flatnonzero(bound >= floor)
            asked = asked[np.argsort(-bound[asked], kind="stable")]
            for own, scores in items.scores(part, asked):
                reach = scores >= floor[own, None]
                for k in np.flatnonzero(reach.any(axis=1)).tolist():
                    item, at = int(own[k]), np.flatnonzero(reach[k])
                    new = (scores[k, at], part["doc_ids"][at], part["doc_rows"][at])
                    old = found.get(item)
                    new = tuple(map(np.concatenate, zip(old, new, strict=True))) if old else new
                    keep = _best(*new, limit)
                    found[item] = new = tuple(x[keep] for x in new)
                    if len(keep) == limit:
                        floor[item] = max(floor[item], new[0][-1])
        for item, (score, doc, row) in found.items():
            yield pa.record_batch(
                [
                    pa.array(np.full(len(score), item, np.int32)), pa.array(score),
                    pa.array(doc, mask=doc == NO_ID), pa.array(row),
                ],
                ["item", "score", "doc_id", "row"],
            )
        give_back()

    return parts.mapInArrow(run, "item int, score long, doc_id long, row long")


def _ranked(scored: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _search_block(docs: DataFrame, pairs: DataFrame, limit: int, part_postings: int, seeds: int) -> DataFrame:
    """``pairs`` are the (item_id, term) of a block of items."""
    spark = docs.sparkSession
    rows = pairs.orderBy("item_id", "term").collect()  # a block's terms: bounded by BLOCK_TERMS, or one item
    vocabulary = sorted({r["term"] for r in rows})
    number = {t: i for i, t in enumerate(vocabulary)}
    ids = list(dict.fromkeys(r["item_id"] for r in rows))
    own = {x: [] for x in ids}
    for r in rows:
        own[r["item_id"]].append(number[r["term"]])

    every = bags(docs, vocabulary)
    documents, length = every.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    counted = every.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # a row a term asked for
    df = {r["term"]: r["count"] for r in counted}
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))]
    items = Items(
        ids, np.array([t for x in ids for t in own[x]], np.int64), np.cumsum([0, *[len(own[x]) for x in ids]]),
        np.array(weight, np.int64),
    )
    schema = "item_id long, rank int, doc_id long, score long"
    if not length or not rows:
        return spark.createDataFrame([], schema)
    parts = spread(index(every, documents, length, part_postings), min_bytes_per_task=TASK_BYTES)

    # the first visits: for each item the parts of the highest bounds
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "m", "part")
    first = _visits(parts, items).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= seeds)
    asked = staged(first.groupBy("m", "part").agg(F.sort_array(F.collect_list("item")).alias("asked")))
    # seeds parts an item, so as small as the block of items
    opened = parts.join(F.broadcast(asked), ["m", "part"])
    at_least = np.ones(len(ids), np.int64)
    last = _ranked(_scored(opened, items, limit, at_least, True), limit).where(F.col("rank") == limit)
    for r in last.select("item", "score").collect():  # one row an item
        at_least[r["item"]] = r["score"]

    best = _ranked(_scored(parts, items, limit, at_least, False), limit)
    names = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")
    return best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, limit: int = 50, part_postings: int = PART_POSTINGS,
    block_terms: int = BLOCK_TERMS, seeds: int = SEEDS,
) -> DataFrame:
    """item_id, rank, doc_id and score of each item's best documents, scores above 0 only."""
    pairs = item_terms(items)
    blocks = max(1, math.ceil(pairs.count() / block_terms))
    out = None
    for block in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else pairs
        found = _search_block(docs, own, limit, part_postings, seeds)
        out = found if out is None else out.unionByName(found)
    return out
