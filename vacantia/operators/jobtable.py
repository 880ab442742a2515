"""The job table in two parts: a narrow state, and the texts that it points to.

A state row holds everything of a job but its three long columns.  For each of these it
has a content hash, by which sightings are compared, and a reference to the row of the
text table that holds the content.  A text is written once, when a sighting brings it, and
read back only by who asks for it.  The state also keeps what scoring reads from title and
text, so an unchanged text is not parsed again.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lexicon
from ..schemas import JOB
from ..session import BROADCAST_ROWS, large_side, staged
from .features import FEATURE_COLUMNS, company_tier, features

#: The long columns, and what their hashes and references are called after.
WIDE = {"description_html": "html", "description_text": "text", "raw_payload": "payload"}
SLIM = [c for c in JOB.names if c not in WIDE]

_STRINGS = ["title_norm", "specialization", "seniority"]
_LISTS = ["skills_title", "skills_description", "skills", "skills_preferred", "skills_required"]
#: What scoring reads from title and text alone; the tier comes from the company's name.
TEXT_FEATURES = [c for c in FEATURE_COLUMNS if c != "company_tier"]


def _feature_type(name: str) -> T.DataType:
    if name in _STRINGS:
        return T.StringType()
    if name in _LISTS:
        return T.ArrayType(T.StringType())
    if name == "keyword_counts":
        return T.ArrayType(T.IntegerType())
    return T.BooleanType() if name == "grad_friendly" else T.IntegerType()


FEATURES = T.StructType([T.StructField(c, _feature_type(c)) for c in TEXT_FEATURES] + [T.StructField("version", T.LongType())])
STATE = T.StructType(
    [JOB[c] for c in SLIM]
    + [T.StructField(f"{p}_key", T.BinaryType()) for p in WIDE.values()]
    + [T.StructField(f"{p}_ref", T.StringType()) for p in WIDE.values()]
    + [T.StructField("features", FEATURES)]
)
#: So many hashes of keys are broadcast (see ``sifted``).
SIFTED_ROWS = 2_000_000
TEXTS = T.StructType([T.StructField("ref", T.StringType())] + [T.StructField(c, T.StringType()) for c in WIDE])


def lexicon_version() -> int:
    """Stands for the word lists: features taken with others are taken anew."""
    lists = {k: v for k, v in vars(lexicon).items() if k.isupper()}
    return zlib.crc32(repr(sorted(lists.items())).encode())


def content_key(column: str) -> Column:
    """The hash by which contents are compared; null for none."""
    return F.unhex(F.sha2(F.col(column).cast("binary"), 256))


def keys_and_refs(ref: Column) -> list[Column]:
    """Hash and reference of each long column of a row that ``ref`` stands for."""
    keys = [content_key(c).alias(f"{p}_key") for c, p in WIDE.items()]
    return keys + [F.when(F.col(c).isNotNull(), ref).alias(f"{p}_ref") for c, p in WIDE.items()]


def sifted(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """``df`` without rows outside ``keys``, as far as that needs no shuffle of ``df``.

    Keys are told by a hash of 64 bits, so that a broadcast of them is small; a row outside
    that has the hash of a key stays.  More keys than can be broadcast filter nothing: who joins
    the result loses no row, and works on more than was needed.
    """
    if keys.count() > SIFTED_ROWS:
        return df
    hashes = keys.select(F.xxhash64(*on).alias("sifted_hash"))
    return df.join(F.broadcast(hashes), F.xxhash64(*on) == F.col("sifted_hash"), "left_semi")


@dataclass(frozen=True)
class JobTable:
    """``state`` has a row a job, ``texts`` the rows its references name (and may have others)."""

    state: DataFrame
    texts: DataFrame

    @staticmethod
    def of(jobs: DataFrame) -> JobTable:
        """A whole job table taken apart; its features are taken when they are needed."""
        ref = F.concat(F.lit("job/"), "fingerprint")
        state = jobs.select(*SLIM, *keys_and_refs(ref), F.lit(None).cast(FEATURES).alias("features"))
        return JobTable(state, jobs.select(ref.alias("ref"), *WIDE))

    @staticmethod
    def empty(spark: SparkSession) -> JobTable:
        return JobTable(spark.createDataFrame([], STATE), spark.createDataFrame([], TEXTS))

    def slim(self) -> DataFrame:
        """The jobs without their long columns."""
        return self.state.select(*SLIM)

    def jobs(self, columns: Sequence[str] = tuple(JOB.names)) -> DataFrame:
        """The jobs; each long column that is asked for is one join by reference."""
        out = self.state
        for column, p in WIDE.items():
            if column in columns:
                out = out.join(self.texts.select(F.col("ref").alias(f"{p}_ref"), column), f"{p}_ref", "left")
        return out.select(*columns)

    def changed(self, delta: DataFrame, texts: DataFrame | None = None) -> JobTable:
        """The table after the rows of ``delta`` have replaced those of their keys."""
        kept = self.state.join(large_side(delta.select("fingerprint")), "fingerprint", "left_anti")
        state = kept.select(*STATE.names).unionByName(delta.select(*STATE.names))
        return JobTable(state, self.texts if texts is None else self.texts.unionByName(texts))


def _taken(df: DataFrame, *ids: str) -> DataFrame:
    """The features of rows with title and description_text."""
    read = features(df.withColumn("company_name", F.lit(None).cast("string")))
    return read.select(*ids, F.struct(*TEXT_FEATURES, F.lit(lexicon_version()).alias("version")).alias("taken"))


def with_features(rows: DataFrame, texts: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``features`` where they had none of this version.

    ``rows`` have title, text_key, text_ref, features, and ``wanted`` (others are left
    alone).  ``own`` are rows with title, text_key and description_text that most of them
    come from.  Texts are parsed where they lie; only pairs of title and hash, and what was
    parsed, are shuffled.  The exception are more pairs without a row of ``own`` than can be
    broadcast: their texts are joined by reference.
    """
    no_text = F.coalesce("text_key", F.lit(b"").cast("binary"))
    fits = F.col("features.version") == lexicon_version()
    rows = rows.withColumns({"features": F.when(fits, F.col("features")), "pair": no_text})
    lacking = rows.where(F.col("wanted") & F.col("features").isNull()).groupBy("title", "pair")
    lacking = staged(lacking.agg(F.min("text_ref").alias("ref")))
    if lacking.isEmpty():
        return rows.drop("pair")
    pair, columns = ["title", "pair"], ["title", "pair", "description_text"]
    parts, rest = [], lacking
    if own is not None:
        read = own.select("title", no_text.alias("pair"), "description_text")
        parts.append(sifted(read, lacking, pair))
        rest = lacking.join(large_side(read.select(*pair)), pair, "left_anti")
    few = rest.limit(BROADCAST_ROWS + 1).count()
    if few:
        have = texts.select("ref", "description_text")
        with_ref = rest.where("ref IS NOT NULL")
        # few: the texts stay where they are; a title without a text has no reference
        told = have.join(F.broadcast(with_ref), "ref") if few <= BROADCAST_ROWS else with_ref.join(have, "ref")
        bare = rest.where("ref IS NULL").withColumn("description_text", F.lit(None).cast("string"))
        parts += [told.select(*columns), bare.select(*columns)]
    taken = _taken(reduce(DataFrame.unionByName, parts), *pair)
    found = staged(taken.groupBy(*pair).agg(F.first("taken").alias("taken")))
    joined = rows.join(large_side(found), pair, "left")
    return joined.withColumn("features", F.coalesce("features", "taken")).drop("taken", "pair")


def scoring_columns(rows: DataFrame, wanted: Column) -> DataFrame:
    """``rows`` with what the rules read: the kept features, and the tier of company_name."""
    tier = company_tier(F.when(wanted, F.col("company_name")))
    return rows.withColumns({c: F.when(wanted, F.col(f"features.{c}")) for c in TEXT_FEATURES} | {"company_tier": tier})
