"""Which postings are kept: by title, place and demanded experience."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon
from ..functions.patterns import fold, found, found_caseless, has_any
from ..session import settled


def title_matches(title: Column) -> Column:
    """An excluded word beats an included one; an empty title never matches."""
    excluded = found_caseless(title, lexicon.TITLE_EXCLUDE)
    return F.coalesce(~excluded & found_caseless(title, lexicon.TITLE_INCLUDE), F.lit(False))


def _absent(text: Column) -> Column:
    return text.isNull() | (text == "")


def international_country(location: Column, remote: Column) -> Column:
    """Remote, USA, Europe, or null when the place does not count.

    Tokens are substrings and USA goes first, so "us" also takes in Austria.
    """
    place = F.lower(location)
    return (
        F.when(F.coalesce(remote, F.lit(False)), "Remote")
        .when(_absent(location), None)
        .when(has_any(place, lexicon.USA_TOKENS), "USA")
        .when(has_any(place, lexicon.EUROPE_TOKENS), "Europe")
    )


def egypt_country(location: Column, remote: Column) -> Column:
    """Egypt, Egypt (Remote), or null; a missing place counts as Egypt."""
    place = F.lower(location)
    return (
        F.when(_absent(location), "Egypt")
        .when(has_any(place, lexicon.EGYPT_TOKENS), "Egypt")
        .when(F.coalesce(remote, F.lit(False)) & has_any(place, lexicon.MENA_WORDS), "Egypt (Remote)")
    )


def experience_excluded(text: Column) -> Column:
    """Three or more years demanded and no word that welcomes juniors."""
    folded = fold(text)
    demanded = found(folded, lexicon.EXPERIENCE_DEMAND)
    return F.coalesce(demanded & ~found(folded, lexicon.EXPERIENCE_JUNIOR_HINT), F.lit(False))


def region_country(region: Column, location: Column, remote: Column) -> Column:
    return F.when(region == "EGYPT", egypt_country(location, remote)).otherwise(
        international_country(location, remote)
    )


def _passes(country: Column) -> Column:
    # cheapest test first
    return (
        country.isNotNull()
        & title_matches(F.col("title"))
        & ~experience_excluded(F.col("description_text"))
    )


def passes_for_region(df: DataFrame, region: str = "region") -> DataFrame:
    """Add ``passes`` and the filter's own ``country`` (a payload's country is not kept)."""
    country = region_country(F.col(region), F.col("location"), F.col("remote"))
    return df.withColumn("passes", settled(_passes(country))).withColumn("country", F.when(F.col("passes"), country))


def accepted(df: DataFrame, region: str = "region") -> DataFrame:
    """The postings that pass, each with its country."""
    country = region_country(F.col(region), F.col("location"), F.col("remote"))
    # the test is not a column, so the regular expressions run once, in the filter
    return df.where(_passes(country)).withColumn("country", country)


def looks_remote(location: Column, words=("remote",)) -> Column:
    """A board's remote words in a location."""
    return F.coalesce(has_any(F.lower(location), words), F.lit(False))
