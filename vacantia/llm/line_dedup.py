"""Line dedup by winnowing over line hashes, in DataFrame expressions only (operator 9).

Lines are what newlines part.  In every window of ``run`` neighbouring lines the least
line hash is a fingerprint, so two texts that share ``run`` lines in a row share a
fingerprint at the same place of them: that is guaranteed, and most lines need not be
looked up.  Windows are kept where their fingerprint occurs more than once; positions of
equal windows are joined with the first of them; matches that follow each other grow
both ways into runs, and every run but the first is deleted.

So a line goes exactly where it lies in ``run`` or more neighbouring lines that also
start earlier: in a smaller doc_id, in the same text further up, or, among texts of one
doc_id, in the one of smaller text hash.  With ``words``, a line goes as well where it lies
in fewer neighbouring lines that hold that many words together and also start earlier, so
a long passage goes whatever number of lines it fills.  Words are what ASCII white space
parts, as in operator 7.

Cases: a null text has no lines and stays null; an empty text is one empty line; texts of
fewer lines than ``run`` lose none without ``words``; a null doc_id comes first; rows that agree in doc_id
and text are one text, and change alike; an empty table gives no rows; other columns pass
through, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

RUN = 3
PASSAGE_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keyed(docs: DataFrame) -> DataFrame:
    """Text with its key: doc_id and the hash of the text."""
    return docs.select(
        F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie"), F.col("text").alias("body")
    ).where("body IS NOT NULL")


def windows(docs: DataFrame, run: int, words: int | None = None) -> DataFrame:
    """Every window of every text: id, tie, start, n (lines), the window's own hashes and its fingerprint.

    Windows have ``run`` lines; with ``words`` also fewer, where these hold so many words.
    """
    lines = _lines(F.col("body"))
    hashed = _keyed(docs).select(
        "id", "tie", F.transform(lines, lambda x: F.xxhash64(x)).alias("h"),
        *([] if words is None else [F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD))).alias("w")]),
    )

    def of_size(n: int) -> Column:
        at = F.when(F.size("h") >= n, F.sequence(F.lit(1), F.size("h") - n + 1)).otherwise(F.array().cast("array<int>"))
        if n < run:
            at = F.filter(at, lambda i: reduce(add, [F.get("w", i + k - 1) for k in range(n)]) >= words)
        return F.transform(at, lambda i: F.struct((i - 1).alias("start"), F.slice("h", i, n).alias("part")))

    sizes = [run] if words is None else range(1, run + 1)
    each = hashed.select("id", "tie", F.explode(F.concat(*map(of_size, sizes))).alias("x")).select(
        "id", "tie", "x.start", "x.part", F.size("x.part").alias("n")
    )
    return each.select(
        "id", "tie", "start", "n", F.xxhash64("part").alias("k1"), F.xxhash64("n", "part").alias("k2"),
        F.xxhash64("n", F.array_min("part")).alias("fingerprint"),
    )


def repeated_runs(docs: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """Per text with repeats: id, tie and ``runs``, the ordered (first, after) line numbers to delete."""
    every = staged(windows(docs, run, words))
    # a fingerprint that stands in one window only cannot be that of a repeated one
    common = every.groupBy("fingerprint").agg(F.count("*").alias("met")).where("met > 1").select("fingerprint")
    near = every.join(common, "fingerprint", "left_semi")
    place = F.struct("id", "tie", "start")
    first = near.groupBy("k1", "k2").agg(F.min(place).alias("source"), F.max(place).alias("last"))
    first = first.where(~F.col("source").eqNullSafe(F.col("last"))).drop("last")
    later = near.join(first, ["k1", "k2"]).where(~place.eqNullSafe(F.col("source"))).groupBy("id", "tie", "start").agg(
        (F.col("start") + F.max("n")).alias("end")
    )
    of_text = Window.partitionBy("id", "tie").orderBy("start")
    reached = F.max("end").over(of_text.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("start") > reached, F.lit(True))
    numbered = later.withColumn("opens", opens).withColumn("nth", F.sum(F.col("opens").cast("int")).over(of_text))
    grown = numbered.groupBy("id", "tie", "nth").agg(F.min("start").alias("first"), F.max("end").alias("after"))
    return grown.groupBy("id", "tie").agg(F.sort_array(F.collect_list(F.struct("first", "after"))).alias("runs"))


def _kept(lines: Column, runs: Column) -> Column:
    """What lies between the runs, in order."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), lambda i: F.slice(
        lines,
        F.when(i == 0, 1).otherwise(F.get(runs, i - 1)["after"] + 1),
        F.when(i == F.size(runs), F.size(lines)).otherwise(F.get(runs, i)["first"])
        - F.when(i == 0, 0).otherwise(F.get(runs, i - 1)["after"]),
    )))


def dedup(docs: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """``doc`` (the whole row, its text without later repeated runs), ``n_lines`` and ``n_removed``."""
    runs = repeated_runs(docs, run, words)
    rows = docs.select(
        F.struct("*").alias("doc"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_tie")
    )
    # only texts differ between the sides in size: runs are a few numbers for the texts that have any
    met = rows.join(runs, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_tie") == F.col("tie")), "left")
    text = F.col("doc.text")
    kept = F.when(F.col("runs").isNull(), text).otherwise(F.array_join(_kept(_lines(text), F.col("runs")), "\n"))
    gone = F.aggregate("runs", F.lit(0), lambda n, r: n + r["after"] - r["first"])
    return met.select(
        F.col("doc").withField("text", kept).alias("doc"),
        F.when(text.isNull(), 0).otherwise(F.size(_lines(text))).cast("long").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"),
    )
