"""Benchmark decontamination by containment search, in DataFrame expressions only (operator 1).

A test item is found in a text when at least ``percent`` of its five-word shingles occur
there, however long the text is: containment, not resemblance, since a resemblance to a
long text vanishes.  Items are partitioned by size.  In each partition an item is known
by its MinHash sketch, its ``k`` least shingle hashes; ``k`` follows from the partition's
largest size, so that a text which contains enough of an item must hold one of its
sketch.  Texts that hold a sketch shingle are candidates; these are verified by counting
the item's distinct shingles in them.  Nothing is lost but by that bound.

Words are runs of letters and digits, in lower case.

Cases: null and empty texts and items hold nothing; items of fewer words than a shingle
are not searched for, since a few common words prove nothing; rows that agree in id and
text are one text (or item); a null id is an id of its own; empty tables give no pairs;
other columns are not read, and pass through ``remove`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_side, staged

WORDS = 5


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _shingled(texts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """A row per place of every text: the keys and the hash of the ``k`` words there."""
    worded = texts.where("body IS NOT NULL").select(*keys, _words(F.col("body")).alias("w"))
    worded = worded.where(F.size("w") >= k)
    ends = F.size("w") - k + 1
    side_by_side = F.arrays_zip(*[F.slice("w", i + 1, ends).alias(f"w{i}") for i in range(k)])
    each = worded.select(*keys, F.explode(side_by_side).alias("s"))
    return each.select(*keys, F.xxhash64(*[F.col(f"s.w{i}") for i in range(k)]).alias("shingle"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").alias("body"))


def item_shingles(items: DataFrame, k: int = WORDS) -> DataFrame:
    """item_id, tie, shingle: the distinct shingles of every item."""
    keyed = items.select(F.col("item_id"), F.xxhash64("text").alias("item_tie"), F.col("text").alias("body"))
    return _shingled(keyed, ["item_id", "item_tie"], k).distinct()


def sketches(shingles: DataFrame, percent: int) -> DataFrame:
    """The sketch of every item: as many of its least hashes as its size partition asks for."""
    sized = shingles.groupBy("item_id", "item_tie").agg(F.sort_array(F.collect_list("shingle")).alias("all"))
    size = F.size("all")
    # partitions end at powers of two; an item of n shingles can miss n - ceil(percent n) of them
    largest = F.pow(F.lit(2), F.ceil(F.log2(size.cast("double")) - 1e-9)).cast("int")
    k = largest - F.ceil(largest * percent / 100 - 1e-9).cast("int") + 1
    return sized.select(
        "item_id", "item_tie", size.alias("n_shingles"), largest.alias("partition"),
        F.explode(F.slice("all", 1, F.least(k, size))).alias("shingle"),
    )


def contained(docs: DataFrame, items: DataFrame, percent: int = 80, k: int = WORDS) -> DataFrame:
    """Pairs doc_id, tie (hash of the text), item_id, n_shingles, n_shared for all items found."""
    shingles = staged(item_shingles(items, k))
    sketch = staged(sketches(shingles, percent))
    texts = _texts(docs)
    probes = small_side(sketch.select("shingle").distinct())
    hit = _shingled(texts, ["doc_id", "tie"], k).join(probes, "shingle").distinct()
    candidates = staged(
        hit.join(small_side(sketch.select("shingle", "item_id", "item_tie", "n_shingles")), "shingle")
        .select("doc_id", "tie", "item_id", "item_tie", "n_shingles").distinct()
    )
    wanted = candidates.select(F.col("doc_id").alias("c_id"), F.col("tie").alias("c_tie")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("tie") == F.col("c_tie"))
    likely = texts.join(small_side(wanted), same, "left_semi")
    held = _shingled(likely, ["doc_id", "tie"], k).join(small_side(shingles), "shingle").distinct()
    shared = held.groupBy("doc_id", "tie", "item_id", "item_tie").agg(F.count("*").alias("n_shared")).alias("s")
    c = candidates.alias("c")
    on = [F.col(f"c.{x}").eqNullSafe(F.col(f"s.{x}")) for x in ("doc_id", "tie", "item_id", "item_tie")]
    both = c.join(shared, on[0] & on[1] & on[2] & on[3])
    return both.where(100 * F.col("n_shared") >= percent * F.col("n_shingles")).select(
        "c.doc_id", "c.tie", "c.item_id", F.col("n_shingles").cast("long").alias("n_shingles"), "n_shared"
    )


def remove(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item; all their columns as they are."""
    bad = staged(pairs.select(F.col("doc_id").alias("bad_id"), F.col("tie").alias("bad_tie")).distinct())
    rows = docs.select(F.struct("*").alias("doc"))
    same = F.col("doc.doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64("doc.text") == F.col("bad_tie"))
    return rows.join(small_side(bad), same, "left_anti").select("doc.*")
