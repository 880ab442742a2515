"""Employer tiers from a table of terms, met with names by a containment join.

A tier table has rows (place, tier, term): a name is of the tier of least place that has a
term contained in it.  Names and terms can be many, so neither stands in the plan: a term
can only be in a name that holds the term's rarest gram, and only names and terms that
share such a gram are held against each other.  Names are made distinct first; however many
postings an employer has, its name is looked at once.

Cases: null and empty names are of no tier; null and empty terms are in no name; a term
that repeats counts with its least place; of two tiers at one place the lesser word counts;
an empty table places nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon
from ..functions.text import company_name_norm
from ..session import small_side, staged

TIERS = "place int, tier string, term string"
GRAM = 3  # characters; of a shorter term the term itself


def default_tiers(spark: SparkSession) -> DataFrame:
    """The tiers of the word lists as a table."""
    rows = [(i, tier, t) for i, (tier, terms) in enumerate(lexicon.COMPANY_TIERS.items()) for t in terms]
    return spark.createDataFrame(rows, TIERS)


def _grams(text: Column, size: Column) -> Column:
    """All stretches of ``size`` characters."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.transform(starts, lambda i: F.substring(text, i, size))).otherwise(F.array())


def contained(names: DataFrame, terms: DataFrame) -> DataFrame:
    """All pairs (name, term) of distinct names and terms where the name contains the term."""
    names = staged(names.select("name").where("name <> ''").distinct())
    terms = terms.select("term").where("term <> ''").distinct()
    size = F.least(F.length("term"), F.lit(GRAM))
    asked = staged(terms.select("term", size.alias("size"), F.explode(F.array_distinct(_grams(F.col("term"), size))).alias("gram")))
    sizes = sorted(r[0] for r in asked.select("size").distinct().collect())  # at most GRAM numbers
    if not sizes:
        return names.select("name", F.lit(None).cast("string").alias("term")).limit(0)
    every = F.array_distinct(F.concat(*[_grams(F.col("name"), F.lit(k)) for k in sizes]))
    # grams that no term has go before anything is shuffled
    held = names.select("name", F.explode(every).alias("gram")).join(
        small_side(asked.select("gram").distinct()), "gram", "left_semi"
    )
    counts = held.groupBy("gram").agg(F.count("*").alias("n_names"))
    n = F.coalesce("n_names", F.lit(0))
    rarest = (
        asked.join(counts, "gram", "left").groupBy("term")
        .agg(F.min(n).alias("n_names"), F.min_by("gram", F.struct(n, F.col("gram"))).alias("gram"))
        .where("n_names > 0").select("term", "gram")
    )
    # a term has one rarest gram, so a pair meets once
    return held.join(small_side(staged(rarest)), "gram").where(F.contains("name", "term")).select("name", "term")


def tiers_of(names: DataFrame, tiers: DataFrame) -> DataFrame:
    """name, tier for the names that are of a tier."""
    places = tiers.groupBy("term").agg(F.min(F.struct("place", "tier")).alias("at"))
    met = contained(names, tiers).join(small_side(places), "term")
    return met.groupBy("name").agg(F.min("at").alias("at")).select("name", F.col("at.tier").alias("tier"))


def with_tier(df: DataFrame, tiers: DataFrame, column: str) -> DataFrame:
    """``df`` with the tier of company_name, null where no term is contained."""
    norm = company_name_norm(F.col("company_name"))
    found = staged(tiers_of(df.select(norm.alias("name")), tiers)).select(
        F.col("name").alias("_tier_name"), F.col("tier").alias(column)
    )
    return df.join(small_side(found), norm == F.col("_tier_name"), "left").drop("_tier_name")
