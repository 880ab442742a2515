"""Boards that list postings as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon
from ..functions.patterns import strip
from ..functions.text import html_to_text, last_segment, unescape_if_escaped
from ..functions.times import parse_dt, parse_epoch
from ..operators.filters import looks_remote
from ..session import small_side
from .landing import details, filled, json_items, observed

_GREENHOUSE = """id string, title string, absolute_url string, content string, first_published string,
 updated_at string, location struct<name: string>, departments array<struct<name: string>>,
 offices array<struct<location: string, name: string>>"""
_LEVER = """id string, text string, hostedUrl string, applyUrl string, descriptionHtml string,
 descriptionPlain string, additional string, additionalHtml string, workplaceType string, createdAt string,
 updatedAt string, lists array<struct<text: string, content: string>>,
 categories struct<location: string, commitment: string, department: string, team: string,
 allLocations: array<string>>"""
_ASHBY = """id string, jobId string, externalId string, title string, applyUrl string, jobUrl string,
 location string, locationName string, secondaryLocations array<string>, isRemote string,
 address struct<postalAddress: struct<addressCountry: string>>, employmentType string, department string,
 team string, descriptionHtml string, description string, descriptionPlain string, publishedAt string,
 publishedDate string, updatedAt string"""
_WORKDAY = """title string, externalPath string, locationsText string, postedOn string, bulletFields array<string>"""
_WORKDAY_DETAIL = "jobPostingInfo struct<jobDescription: string, timeType: string, location: string>"


def _first(array: str, field: str) -> Column:
    return F.get(f"j.{array}", F.lit(0))[field]


def _no_id(external_id: Column) -> Column:
    return F.when(F.coalesce(external_id, F.lit("")) == "", "item without id")


def _null_id(external_id: Column) -> Column:
    """Boards that key an item with an empty id by its link reject only a missing one."""
    return F.when(external_id.isNull(), "item without id")


def _any_remote(place: Column, places: Column) -> Column:
    more = F.exists(F.coalesce(places, F.array().cast("array<string>")), lambda p: looks_remote(p))
    return looks_remote(place) | more


def greenhouse(landing: DataFrame) -> DataFrame:
    df = json_items(landing, "greenhouse", "jobs").withColumn("j", F.from_json("item", _GREENHOUSE))
    df = df.withColumn("html", F.nullif(unescape_if_escaped(F.col("j.content")), F.lit("")))
    place = F.col("j.location.name")
    return observed(
        df, "greenhouse", _null_id(F.col("j.id")),
        external_id=F.col("j.id"),
        title=strip(F.coalesce("j.title", F.lit(""))),
        apply_url=F.coalesce("j.absolute_url", F.lit("")),
        location=place,
        country=filled(_first("offices", "location"), _first("offices", "name")),
        remote=looks_remote(place, lexicon.GREENHOUSE_REMOTE_WORDS),
        department=_first("departments", "name"),
        description_html=F.col("html"),
        description_text=html_to_text(F.col("html")),
        posted_at=parse_dt(filled(F.col("j.first_published"), F.col("j.updated_at"))),
        updated_at_source=parse_dt(F.col("j.updated_at")),
        raw_payload=F.col("item"),
    )


def lever(landing: DataFrame) -> DataFrame:
    df = json_items(landing, "lever", None).withColumn("j", F.from_json("item", _LEVER))

    def block(b: Column) -> Column:
        return F.concat(F.lit("<h3>"), F.coalesce(b["text"], F.lit("")), F.lit("</h3>"), F.coalesce(b["content"], F.lit("")))

    blocks = F.coalesce(F.transform("j.lists", block), F.array().cast("array<string>"))
    parts = F.concat(
        F.array(F.col("j.descriptionHtml")), blocks,
        F.array(filled(F.col("j.additionalHtml"), F.col("j.additional"))),
    )
    df = df.withColumn("html", F.nullif(F.array_join(F.filter(parts, lambda p: p != ""), "\n"), F.lit("")))
    place = F.col("j.categories.location")
    at_home = F.coalesce(F.lower("j.workplaceType") == "remote", F.lit(False))
    return observed(
        df, "lever", _null_id(F.col("j.id")),
        external_id=F.col("j.id"),
        title=strip(F.coalesce("j.text", F.lit(""))),
        apply_url=F.coalesce(filled(F.col("j.hostedUrl"), F.col("j.applyUrl")), F.lit("")),
        location=place,
        country=place,
        remote=at_home | _any_remote(place, F.col("j.categories.allLocations")),
        employment_type=F.col("j.categories.commitment"),
        department=F.col("j.categories.department"),
        team=F.col("j.categories.team"),
        description_html=F.col("html"),
        description_text=F.coalesce(html_to_text(F.col("html")), "j.descriptionPlain"),
        posted_at=parse_epoch(F.col("j.createdAt")),
        updated_at_source=parse_epoch(filled(F.col("j.updatedAt"), F.col("j.createdAt"))),
        raw_payload=F.col("item"),
    )


def ashby(landing: DataFrame) -> DataFrame:
    df = json_items(landing, "ashby", "jobs").withColumn("j", F.from_json("item", _ASHBY))
    df = df.withColumn("html", filled(F.col("j.descriptionHtml"), F.col("j.description")))
    key = filled(F.col("j.id"), F.col("j.jobId"), F.col("j.externalId"))
    place = filled(F.col("j.location"), F.col("j.locationName"))
    # a secondary place is a name or an object that holds one
    others = F.transform(
        "j.secondaryLocations", lambda s: F.when(s.startswith("{"), F.get_json_object(s, "$.location")).otherwise(s)
    )
    flagged = ~F.coalesce("j.isRemote", F.lit("")).isin("", "false", "0")
    return observed(
        df, "ashby", _no_id(key),
        external_id=key,
        title=strip(F.coalesce("j.title", F.lit(""))),
        apply_url=F.coalesce(filled(F.col("j.applyUrl"), F.col("j.jobUrl")), F.lit("")),
        location=place,
        country=filled(F.col("j.address.postalAddress.addressCountry"), place),
        remote=flagged | _any_remote(place, others),
        employment_type=F.col("j.employmentType"),
        department=F.col("j.department"),
        team=F.col("j.team"),
        description_html=F.col("html"),
        description_text=F.coalesce(filled(F.col("j.descriptionPlain")), html_to_text(F.col("html"))),
        posted_at=parse_dt(filled(F.col("j.publishedAt"), F.col("j.publishedDate"))),
        updated_at_source=parse_dt(filled(F.col("j.updatedAt"), F.col("j.publishedAt"))),
        raw_payload=F.col("item"),
    )


def workday(landing: DataFrame, companies: DataFrame) -> DataFrame:
    """Listing joined with the details captured by path; host and site are in the company's config."""
    df = json_items(landing, "workday", "jobPostings").withColumn("j", F.from_json("item", _WORKDAY))
    df = df.withColumn("path", F.coalesce("j.externalPath", F.lit("")))
    detail = details(landing, "workday", df.select("company_slug", F.col("path").alias("ref"))).withColumnRenamed("ref", "path")
    df = df.join(detail, ["company_slug", "path"], "left")
    df = df.withColumn("d", F.from_json("detail", _WORKDAY_DETAIL)["jobPostingInfo"])
    config = companies.select(
        F.col("slug").alias("company_slug"),
        F.try_element_at("config", F.lit("host")).alias("host"),
        F.try_element_at("config", F.lit("site")).alias("site"),
    )
    df = df.join(small_side(config), "company_slug", "left")
    key = F.when(F.col("path") != "", last_segment(F.col("path"))).otherwise(F.get("j.bulletFields", F.lit(0)))
    place = filled(F.col("j.locationsText"), F.col("d.location"))
    return observed(
        df, "workday", _no_id(key),
        external_id=key,
        title=strip(F.coalesce("j.title", F.lit(""))),
        apply_url=F.concat(F.lit("https://"), "host", F.lit("/en-US/"), "site", "path"),
        location=place,
        country=place,
        remote=looks_remote(place),
        employment_type=F.col("d.timeType"),
        description_html=F.col("d.jobDescription"),
        description_text=html_to_text(F.col("d.jobDescription")),
        posted_at=parse_dt(F.col("j.postedOn")),
        updated_at_source=parse_dt(F.col("j.postedOn")),
        raw_payload=F.col("item"),
    )
