"""Repeated passages by prefix-partitioned suffix trees (operator 7).

The suffixes are those that start at a word, cut off after ``depth`` words: what is below
that depth is not asked for.  A suffix is led by the codes of its first words, a byte
each, and closed by a digest of all its words.  Counts of the leading codes split the
order of suffixes into groups of about ``group_suffixes``: a prefix that too many
suffixes share is followed one word further, so prefixes vary in length and no group
outgrows a task.  In a group the sorted suffixes and what neighbours have in common are
its subtree; its internal nodes at full depth are the repeats, and runs of them in a
text its maximal repeats.

Texts travel in packed batches.  Equal suffixes of a batch are one leaf (its earliest),
so a passage that a third of all texts share is as many leaves as there are batches.
A group answers each batch with one bit per leaf: whether the node has an earlier leaf.

Cases: a null or empty text has no words; texts shorter than ``depth`` words lose none; a
null doc_id comes before all others; rows that share a doc_id are ordered as they are
packed; an empty table gives no rows; other columns are not read.  Windows are told apart
by 32 bits of codes and 48 of digest: among a billion different ones no two are to be
expected alike (4 in 10 million); ``digest_bytes=8`` gives that bound at 100 TB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .batches import NO_ID, packed, squeezed, stretched, unpacked
from .memory import give_back, rows_of
from .words import Words, from_planes, planes, words_of

LEVELS = 4  # words that lead a suffix, a byte each
GROUP_SUFFIXES = 1_000_000
PACK_LEVEL = 5  # batches are written once and shuffled once
FOLLOWED_SHARE = 1 / 1024  # a batch counts below a prefix that has this share of its suffixes


def leading_codes(words: Words, window: np.ndarray) -> np.ndarray:
    """The codes of the first words of suffixes as one number: their order is that of the prefixes."""
    code = (words.hash >> np.uint64(56)).astype(np.uint32)
    out = np.zeros(len(window), np.uint32)
    for i in range(LEVELS):
        out = out << np.uint32(8) | code[window + i]
    return out


def prefix_counts(batches: DataFrame, depth: int) -> DataFrame:
    """How many suffixes lie below each prefix: (length in words, prefix, n)."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(rows):
            words = words_of(*unpacked(row)[:2])
            codes = leading_codes(words, words.windows(depth)[1])
            out, followed = [], codes
            for level in range(1, LEVELS + 1):
                values, n = np.unique(followed >> np.uint32(8 * (LEVELS - level)), return_counts=True)
                out.append((np.full(len(values), level), values, n))
                large = values[n >= len(codes) * FOLLOWED_SHARE]
                followed = followed[np.isin(followed >> np.uint32(8 * (LEVELS - level)), large)]
            level, value, n = (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))
            yield pa.record_batch([pa.array(level), pa.array(value), pa.array(n)], ["length", "prefix", "n"])

    counted = batches.mapInArrow(count, "length long, prefix long, n long")
    return counted.groupBy("length", "prefix").agg(F.sum("n").alias("n"))


def group_bounds(counts: list[tuple[int, int, int]], group_suffixes: int) -> np.ndarray:
    """Where groups start in the order of leading codes.

    A prefix with more suffixes than a group holds is followed to its children; what
    neighbouring prefixes hold is put together up to a group.
    """
    below: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for length, prefix, n in sorted(counts):
        below.setdefault((length - 1, prefix >> 8), []).append((prefix, n))
    bounds, held = [0], 0

    def walk(length: int, prefix: int) -> None:
        nonlocal held
        for child, n in below.get((length, prefix), []):
            if n > group_suffixes and (length + 1, child) in below:
                walk(length + 1, child)
                continue
            if held and held + n > group_suffixes:
                bounds.append(child << 8 * (LEVELS - length - 1))
                held = 0
            held += n

    walk(0, 0)
    return np.array(bounds, np.uint32)


def _leaves(words: Words, depth: int, digest_bytes: int, bounds: np.ndarray, rank: np.ndarray):
    """The batch's suffixes in the order of its leaves.

    ``rank`` orders the texts.  Returns leading codes and digest of each leaf, the leaf of
    each window, each leaf's earliest window, and where groups begin among the leaves.
    """
    digest, window = words.windows(depth)
    digest &= np.uint64((1 << 8 * digest_bytes) - 1)
    codes = leading_codes(words, window)
    text = words.text[window]
    # by place first, so that the first of equal suffixes is the earliest
    place = np.argsort(rank[text], kind="stable")
    order = place[np.lexsort((digest[place], codes[place]))]
    codes, digest = codes[order], digest[order]
    new = np.ones(len(order), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (digest[1:] != digest[:-1])
    leaf = np.cumsum(new) - 1
    first = order[new]
    codes, digest = codes[new], digest[new]
    return codes, digest, order, leaf, first, window, np.searchsorted(codes, bounds), text


def _ranks(doc_ids: np.ndarray) -> np.ndarray:
    rank = np.empty(len(doc_ids), np.int64)
    rank[np.argsort(doc_ids, kind="stable")] = np.arange(len(doc_ids))
    return rank


def _steps(values: np.ndarray, width: int) -> bytes:
    """Integers as compressed differences, which are small where the integers ascend."""
    return squeezed(planes(np.diff(values, prepend=values[:1] * 0), width))


def _from_steps(data: bytes, n: int, width: int, dtype) -> np.ndarray:
    # differences are taken and added up modulo the type's range
    return np.cumsum(from_planes(stretched(data, n * width), width, dtype), dtype=dtype)


def _leaves_row(codes, digest, local, doc_ids, digest_bytes: int) -> dict:
    """A batch's leaves in a group: codes ascend, digests are as good as random, texts are few."""
    return {
        "n": len(codes), "n_texts": len(doc_ids), "codes": _steps(codes, 4), "digest": planes(digest, digest_bytes),
        "text": squeezed(planes(local.astype(np.uint32), 4)), "doc_ids": _steps(doc_ids, 8),
    }


def _leaves_of(row: dict, digest_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, digest and doc_id of each leaf of a row."""
    n, n_texts = row["n"], row["n_texts"]
    text = from_planes(stretched(row["text"], 4 * n), 4, np.uint32)
    return (
        _from_steps(row["codes"], n, 4, np.uint32), from_planes(row["digest"], digest_bytes, np.uint64),
        _from_steps(row["doc_ids"], n_texts, 8, np.int64)[text],
    )


def suffixes(batches: DataFrame, depth: int, digest_bytes: int, bounds: np.ndarray) -> DataFrame:
    """A row per batch and group: the batch's leaves in the group, packed."""

    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(rows):
            data, sizes, doc_ids = unpacked(row)
            words = words_of(data, sizes)
            codes, digest, _, _, first, _, begin, text = _leaves(words, depth, digest_bytes, bounds, _ranks(doc_ids))
            ends, of = np.append(begin[1:], len(codes)), text[first]
            for group in np.flatnonzero(ends > begin).tolist():
                part = slice(begin[group], ends[group])
                texts, local = np.unique(of[part], return_inverse=True)
                leaves = _leaves_row(codes[part], digest[part], local, doc_ids[texts], digest_bytes)
                yield pa.RecordBatch.from_pylist([{"group": group, "batch": row["batch"], **leaves}], _LEAVES)

    schema = "group int, batch long, n int, n_texts int, codes binary, digest binary, text binary, doc_ids binary"
    return batches.mapInArrow(emit, schema)


_LEAVES = pa.schema(
    [("group", pa.int32()), ("batch", pa.int64()), ("n", pa.int32()), ("n_texts", pa.int32())]
    + [(c, pa.binary()) for c in ("codes", "digest", "text", "doc_ids")]
)


def deep_nodes(codes: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of a subtree's leaves, and for each in that order the node of full depth it hangs under.

    Neighbours that agree in codes and digest have all words in common: their lowest common
    node is at full depth.  A node is numbered by its position among the nodes.
    """
    order = np.lexsort((digest, codes))
    codes, digest = codes[order], digest[order]
    opens = np.ones(len(order), bool)
    opens[1:] = (codes[1:] != codes[:-1]) | (digest[1:] != digest[:-1])
    return order, np.cumsum(opens) - 1


def _answers(digest_bytes: int):
    def answer(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["batch"])
        sizes = [r["n"] for r in rows]
        parts = zip(*[_leaves_of(r, digest_bytes) for r in rows], strict=True)
        codes, digest, ids = (np.concatenate(x) for x in parts)
        order, node = deep_nodes(codes, digest)
        # the earliest leaf of a node: least doc_id, then least batch, which is the order of rows
        position = np.lexsort((order, ids[order], node))
        earliest = np.ones(len(order), bool)
        earliest[1:] = node[1:] != node[:-1]
        later = np.zeros(len(order), bool)
        later[order[position[~earliest]]] = True
        give_back()
        bits = [np.packbits(part).tobytes() for part in np.split(later, np.cumsum(sizes)[:-1])]
        return pa.table({
            "batch": pa.array([r["batch"] for r in rows], pa.int64()),
            "group": pa.array([r["group"] for r in rows], pa.int32()), "later": pa.array(bits, pa.binary()),
        })

    return answer


def _kept_texts(words: Words, kept: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The kept words of each text with a blank between them, end to end, and each text's size."""
    text = words.text[kept]
    leads = np.ones(len(text), bool)
    leads[1:] = text[1:] != text[:-1]
    start, size = words.start[kept], words.size[kept]
    out_size = size + ~leads
    total = int(out_size.sum())
    # a word that follows another has a byte before it that parts them: there the blank goes
    begin = start - ~leads
    place = np.arange(total) - np.repeat(np.cumsum(out_size) - out_size, out_size) + np.repeat(begin, out_size)
    out = words.data[place]
    out[(np.cumsum(out_size) - out_size)[~leads]] = 32
    return out.tobytes(), np.bincount(text, out_size, len(words.first) - 1).astype(np.int64)


def remove_repeats(
    docs: DataFrame, depth: int = 20, group_suffixes: int = GROUP_SUFFIXES, digest_bytes: int = 6,
) -> DataFrame:
    """Every text without the words of passages that start earlier elsewhere.

    A row per text: doc_id, n_words, n_removed, ``kept`` (what is left, words joined by a
    blank) and ``removed``, the maximal runs of removed words as (first, n) pairs.
    """
    batches = packed(docs, level=PACK_LEVEL)
    counts = [tuple(r) for r in prefix_counts(batches, depth).where(F.col("n") > 0).collect()]
    bounds = group_bounds(counts, group_suffixes)
    grouped = suffixes(batches, depth, digest_bytes, bounds).groupBy("group")
    answers = staged(grouped.applyInArrow(_answers(digest_bytes), "batch long, group int, later binary"))

    def remove(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        bits = {r["group"]: r["later"] for r in right.to_pylist()}
        for row in left.to_pylist():
            data, sizes, doc_ids = unpacked(row)
            words = words_of(data, sizes)
            codes, _, order, leaf, first, window, begin, _ = _leaves(words, depth, digest_bytes, bounds, _ranks(doc_ids))
            later = np.zeros(len(codes), bool)
            ends = np.append(begin[1:], len(codes))
            for group in np.flatnonzero(ends > begin).tolist():
                b, e = begin[group], ends[group]
                later[b:e] = np.unpackbits(np.frombuffer(bits[group], np.uint8), count=e - b).astype(bool)
            repeats = later[leaf] | (order != first[leaf])
            # words under repeated windows
            change = np.zeros(len(words.start) + 1, np.int32)
            hit = window[order[repeats]]
            np.add.at(change, hit, 1)
            np.add.at(change, hit + depth, -1)
            gone = np.cumsum(change[:-1]) > 0
            n_texts = len(words.first) - 1
            n_words = np.diff(words.first)
            n_gone = np.bincount(words.text[gone], minlength=n_texts)
            data, sizes = _kept_texts(words, np.flatnonzero(~gone))
            offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
            kept = pa.StringArray.from_buffers(n_texts, pa.py_buffer(offsets), pa.py_buffer(data))
            opens = gone.copy()
            if len(gone):
                opens[1:] &= ~(gone[:-1] & (words.text[1:] == words.text[:-1]))
            run_first = np.flatnonzero(opens)
            run_size = np.diff(np.append(np.cumsum(gone)[run_first] - 1, gone.sum()))
            of = words.text[run_first]
            spans = pa.StructArray.from_arrays(
                [pa.array(run_first - words.first[of], pa.int64()), pa.array(run_size, pa.int64())], ["first", "n"]
            )
            runs = np.append(0, np.cumsum(np.bincount(of, minlength=n_texts))).astype(np.int32)
            ids = pa.array(doc_ids, pa.int64(), mask=doc_ids == NO_ID)
            out.append(pa.table({
                "doc_id": ids, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_gone, pa.int64()),
                "kept": kept, "removed": pa.ListArray.from_arrays(pa.array(runs), spans),
            }))
        give_back()
        return pa.concat_tables(out) if out else _EMPTY

    result = "doc_id long, n_words long, n_removed long, kept string, removed array<struct<first:long,n:long>>"
    return batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(remove, result)


_EMPTY = pa.table({
    "doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()),
    "kept": pa.array([], pa.string()),
    "removed": pa.array([], pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))),
})
