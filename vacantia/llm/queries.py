"""The registered queries of the subpackage, each thin over its operator, and their SQL."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged

from . import (
    chunk_recipes, decontaminate, duck_bpe, host_reputation, jaccard_join, line_dedup, pivot_clusters, ranked_search,
    suffix_repeats, token_files, toxic_grammar, vector_cells, warc,
)
from .host_reputation import Rule
from .queries_sql import ORACLES as ORACLES

END_ID = 2
URL_RULES = [
    Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document contains, with what the two share."""
    found = decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("tie")


def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url; a labelled page of low quality is a bad one."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad")
    )
    hosts = staged(host_reputation.reputation(host_reputation.outcomes(pages, labels)))
    return host_reputation.judge(pages, hosts, URL_RULES).drop("bad_bound")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to whole-file gzip archives, normalised, and read back by index."""
    written = warc.write_stream(warc.described(table(spark, sf_dir, "pages")))
    return warc.read(spark, warc.normalise(written), payloads=False).drop("url", "payload")


def op4_toxic_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by the clause grammar, learnt from the labels of four folds."""
    return toxic_grammar.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("tie")


def op5_duck_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by ranks, decoded again, and digests of both."""
    ranks = tokenizer_file("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return duck_bpe.digests(duck_bpe.encode(docs, ranks, decoded="decoded"))


def op6_vector_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and representative of every embedding at a cosine of 0.9."""
    return vector_cells.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without passages of 20 words or more that start earlier."""
    left = suffix_repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document among those that share four fifths of their shingles."""
    return jaccard_join.join(table(spark, sf_dir, "documents")).drop("row", "tie", "kept")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without runs of three lines or more that start earlier."""
    left = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select(
        "doc.doc_id", "n_lines", "n_removed",
        F.sha2(F.coalesce("doc.text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the token files."""
    docs = table(spark, sf_dir, "documents")
    manifest = token_files.write(docs, tokenizer_file("byte_bpe_50k.json"), END_ID, added_tokens=True)
    return token_files.read_documents(
        spark, manifest, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "ids_crc32 long"
    )


def op11_pivot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's cluster after three rounds over 16 centroids, in exact integers."""
    return pivot_clusters.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, steps=64, seed=1)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), limit=50)


def op13_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row of equal text that stays."""
    return chunk_recipes.exact_groups(table(spark, sf_dir, "documents")).drop("row")


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_host_reputation": op2_host_reputation,
    "op3_warc": op3_warc,
    "op4_toxic_grammar": op4_toxic_grammar,
    "op5_duck_bpe": op5_duck_bpe,
    "op6_vector_cells": op6_vector_cells,
    "op7_suffix_repeats": op7_suffix_repeats,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_files": op10_token_files,
    "op11_pivot_clusters": op11_pivot_clusters,
    "op12_ranked_search": op12_ranked_search,
    "op13_chunk_recipes": op13_chunk_recipes,
}
