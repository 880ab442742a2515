"""The corpus pipeline: stages over the documents, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept.  All
but the last return the columns that ``docs`` has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm import decontaminate, duck_bpe, jaccard_join, line_dedup, toxic_grammar
from vacantia.llm.queries import table, tokenizer_file
from vacantia.session import small_side, staged


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with what decisions go by: doc_id and the hash of the text."""
    return docs.select(
        F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_tie")
    )


def _met(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``rows`` of ``_keyed`` joined to distinct (doc_id, tie)."""
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_tie") == F.col("tie"))
    return rows.join(small_side(keys.select("doc_id", "tie")), same, how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the clause grammar predicts to be toxic (operator 4).

    The decision is one on rows (doc_id, null included, and text); null and empty texts are
    scored like others.
    """
    scores = toxic_grammar.score(docs, table(spark, sf_dir, "labels"))
    toxic = staged(scores.where("predicted = 1").select("doc_id", "tie").distinct())
    return _met(_keyed(docs), toxic, "left_anti").select("doc.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without line runs and long passages of any number of lines that start earlier (operator 9).

    A document that loses all its lines goes; null and empty texts stay as they are, and
    rows that agree in doc_id and text change alike.  ``n_chars``, where documents have it,
    follows the text that is left.
    """
    left = line_dedup.dedup(docs, words=line_dedup.PASSAGE_WORDS)
    left = left.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    columns = [F.col("doc")[c].alias(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_removed") > 0, F.length("doc.text")).otherwise(F.col("doc.n_chars"))
        columns[docs.columns.index("n_chars")] = changed.cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return left.select(*columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least doc_id (operator 8).

    Among rows of one doc_id it is that of the least text hash; null is the last doc_id; of
    rows that agree in both one stays.  Texts without words are in no group and all stay.
    """
    placed = jaccard_join.join(docs).where("n_shingles > 0")
    # rows that agree in doc_id and text are in one group, and go or stay together but for repeats
    keys = placed.groupBy("doc_id", "tie").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    keys = staged(keys.where("NOT kept OR n > 1"))
    left = _met(_keyed(docs), keys.where("NOT kept"), "left_anti")
    again = keys.where("kept")
    if not again.isEmpty():
        one = _met(left, again, "left_semi").groupBy("own_id", "own_tie").agg(
            F.min_by("doc", F.to_json("doc")).alias("doc")
        )
        left = _met(left, again, "left_anti").select("doc").unionByName(one.select("doc"))
    return left.select("doc.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain a benchmark item (operator 1); null and empty texts contain none."""
    return decontaminate.remove(docs, decontaminate.contained(docs, table(spark, sf_dir, "benchmark")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is kept, as token ids, with the digests of its round trip (operator 5); a null text has none."""
    ranks = tokenizer_file("byte_bpe_50k.tiktoken")
    return duck_bpe.digests(duck_bpe.encode(docs.select("doc_id", "text"), ranks, decoded="decoded"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_duplicates", dedup_near),
    ("decontamination", drop_contaminated),
    ("tokens", tokenize),
]

#: The learnt grammar and the merges have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
