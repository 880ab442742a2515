"""Boards that list postings as HTML cards with a detail page each.

Cards are cut out, repeats within the run dropped, titles checked, and only what
is left and not yet stored is joined with its detail page.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon
from ..functions.keys import fingerprint
from ..functions.patterns import has_any
from ..functions.text import html_to_text, strip_query
from ..functions.times import parse_dt
from ..operators.filters import looks_remote, title_matches
from ..operators.merge import known_flag
from ..operators.ordered import first_per_key
from ..session import small_side, staged
from .landing import details, listings, observed
from .markup import attribute, element, inner, node_text, opening_tag, text_nodes

_LINKEDIN_LINK = "base-card__full-link|base-search-card__link"


@dataclass(frozen=True)
class Fetched:
    """``items`` go on to the pipeline; ``cards`` are all distinct cards with what became of them."""

    items: DataFrame
    cards: DataFrame


def linkedin_cards(landing: DataFrame) -> DataFrame:
    rows = listings(landing, "linkedin")
    found = F.regexp_extract_all("payload", F.lit(r"(?is)<li\b.*?</li>"), F.lit(0))
    df = rows.select("run_id", "company_slug", "page", F.posexplode(found).alias("pos", "card"))
    card = F.col("card")
    div = opening_tag(card, "div", "class", "base-search-card|base-card")
    link = opening_tag(card, "a", "class", _LINKEDIN_LINK)
    href = F.coalesce(attribute(link, "href"), F.lit(""))
    urn = F.regexp_extract(F.coalesce(attribute(div, "data-entity-urn"), F.lit("")), r"jobPosting:(\d+)", 1)
    key = F.when(urn != "", urn).otherwise(F.regexp_extract(href, r"/jobs/view/[^/?]*-(\d+)(?:\?|$)", 1))
    made_up = F.concat(F.lit("https://www.linkedin.com/jobs/view/"), F.col("external_id"))
    df = df.where(div != "").withColumns({"external_id": key, "href": href}).where("external_id <> ''")
    df = df.select(
        "run_id", "company_slug", "page", "pos", "external_id",
        inner(card, r"\w+", "class", "base-search-card__title").alias("title"),
        inner(card, r"\w+", "class", "base-search-card__subtitle").alias("card_company"),
        inner(card, r"\w+", "class", "job-search-card__location").alias("location"),
        F.when(F.col("href") != "", strip_query(F.col("href"))).otherwise(made_up).alias("apply_url"),
        parse_dt(attribute(F.regexp_extract(card, r"(?is)<time\b[^>]*>", 0), "datetime")).alias("posted_at"),
    )
    return df.where("title IS NOT NULL")


def _href(card: Column) -> Column:
    return attribute(F.regexp_extract(card, r"(?s)^<a\b[^>]*>", 0), "href")


def _segments(landing: DataFrame, source: str, link: str, key: str) -> DataFrame:
    """A page cut at its job links: a card is what runs from one link to the next.

    Of links to one posting on a page the first counts, with or without a title.
    That is settled inside the page's row, before any shuffle.
    """
    cut = F.split("payload", rf"(?is)(?=<a\b[^>]*\bhref\s*=\s*[\"']{link}[\"'])")
    ids = F.transform("cut", lambda c: F.coalesce(F.regexp_extract(_href(c), key, 1), F.lit("")))
    rows = listings(landing, source).select("run_id", "company_slug", "page", cut.alias("cut")).withColumn("ids", ids)
    df = rows.select("run_id", "company_slug", "page", "ids", F.posexplode("cut").alias("pos", "card"))
    own = F.get("ids", F.col("pos"))
    first = (own != "") & (F.array_position("ids", own) == F.col("pos") + 1)
    return df.where(first).withColumns({"number": own, "href": _href(F.col("card"))}).drop("ids")


def _link_text(card: Column) -> Column:
    return node_text(F.regexp_extract(card, r"(?is)^<a\b[^>]*>(.*?)</a\s*>", 1))


def _place(card: Column, words) -> Column:
    """The first text node that names a known place."""
    return F.get(F.filter(text_nodes(card), lambda s: has_any(F.lower(s), words)), F.lit(0))


def _company(card: Column, href: str) -> Column:
    link = F.regexp_extract(card, rf"(?is)<a\b[^>]*\bhref\s*=\s*[\"']{href}[^\"']*[\"'][^>]*>(.*?)</a\s*>", 1)
    return node_text(link)


def wuzzuf_cards(landing: DataFrame) -> DataFrame:
    df = _segments(landing, "wuzzuf", "/jobs/p/[^\"']*", r"/jobs/p/([^/?#]+)")
    card = F.col("card")
    df = df.select(
        "run_id", "company_slug", "page", "pos", F.col("number").alias("external_id"), _link_text(card).alias("title"),
        _company(card, "/jobs/companies/").alias("card_company"),
        _place(card, lexicon.WUZZUF_PLACES).alias("location"),
        F.concat(F.lit("https://wuzzuf.net"), "href").alias("apply_url"),
        F.lit(None).cast("timestamp").alias("posted_at"),
    )
    return df.where("title IS NOT NULL")


def bayt_cards(landing: DataFrame) -> DataFrame:
    df = _segments(landing, "bayt", r"/en/[^/\"']+/jobs/[^/?#\"']+-\d+/?", r"-(\d+)/?$")
    card = F.col("card")
    # a link around an icon only: the heading next to it is the title
    heading = node_text(F.regexp_extract(card, r"(?is)<h2\b[^>]*>(.*?)</h2\s*>", 1))
    own = _link_text(card)
    title = F.when(F.length(own) >= 4, own).otherwise(F.coalesce(heading, own))
    df = df.select(
        "run_id", "company_slug", "page", "pos", F.concat(F.lit("bayt-"), "number").alias("external_id"), title.alias("title"),
        _company(card, "[^\"']*/companies/").alias("card_company"),
        _place(card, lexicon.BAYT_PLACES).alias("location"),
        F.concat(F.lit("https://www.bayt.com"), "href").alias("apply_url"),
        F.lit(None).cast("timestamp").alias("posted_at"),
    )
    return df.where("title IS NOT NULL")


def linkedin_detail(page: Column) -> Column:
    return element(page, r"\w+", "class", "show-more-less-html__markup|description__text")


def wuzzuf_detail(page: Column) -> Column:
    return F.coalesce(
        element(page, "div", "class", "css-1uobp1k|e1tkpvjy0|job-description"),
        element(page, "section", "class", "css-ssjg3"),
    )


def bayt_detail(page: Column) -> Column:
    return F.coalesce(
        element(page, "div", "class", "job-description|details-section"),
        element(page, "section", "class", "card-content"),
        element(page, "div", "itemprop", "description"),
    )


_BOARDS = {
    "linkedin": (linkedin_cards, linkedin_detail, None),
    "wuzzuf": (wuzzuf_cards, wuzzuf_detail, "Egypt"),
    "bayt": (bayt_cards, bayt_detail, "Egypt"),
}


def distinct_cards(cards: DataFrame) -> DataFrame:
    """A posting listed again in the run counts once, the first time."""
    return first_per_key(cards, ["run_id", "company_slug", "external_id"], ["page", "pos"])


def fetch(landing: DataFrame, companies: DataFrame, jobs: DataFrame | None, source: str) -> Fetched:
    """Cards of one board as observations.

    Cards are parsed once and written.  The title check and the stored keys come before
    the detail pages, which hold the bulk of the bytes: only pages of cards that still
    need them are read on.  Cards of stored jobs go on as stubs without text.
    """
    parse, detail, default_place = _BOARDS[source]
    cards = distinct_cards(parse(landing)).withColumns(
        {"fingerprint": fingerprint(F.lit(source), F.col("external_id")), "title_ok": title_matches(F.col("title"))}
    )
    cards = staged(known_flag(cards, jobs))
    wanted = cards.where("title_ok").withColumn("ref", F.when(~F.col("known"), F.col("external_id")))
    pages = details(landing, source, wanted)
    full = wanted.join(pages, ["company_slug", "ref"], "left").withColumn("html", detail(F.col("detail"))).drop("detail")

    setting = lambda key: F.try_element_at("config", F.lit(key))
    config = companies.select(
        F.col("slug").alias("company_slug"), setting("keywords").alias("keywords"), setting("location").alias("where"),
    )
    full = full.join(small_side(config), "company_slug", "left")
    payload = [F.col("card_company").alias("company_name"), F.col("keywords").alias("search_keywords")]
    if source == "linkedin":
        payload.append(F.col("where").alias("search_location"))
    place = F.col("location") if default_place is None else F.coalesce("location", F.lit(default_place))
    items = observed(
        full, source, F.lit(None).cast("string"),
        external_id=F.col("external_id"), title=F.col("title"), apply_url=F.col("apply_url"),
        location=place, country=place, remote=looks_remote(F.col("location")),
        description_html=F.col("html"), description_text=html_to_text(F.col("html")),
        posted_at=F.col("posted_at"), updated_at_source=F.col("posted_at"),
        raw_payload=F.to_json(F.struct(*payload)),
    )
    return Fetched(items, cards.drop("known"))


def fetch_tallies(cards: DataFrame, jobs: DataFrame) -> DataFrame:
    """Distinct cards per company, and how many went on, failed on title, or were known."""
    known = jobs.select("company_slug", "fingerprint").withColumn("known", F.lit(True))
    rows = cards.join(known, ["company_slug", "fingerprint"], "left")
    ok = F.col("title_ok")
    return rows.groupBy("company_slug").agg(
        F.count("*").alias("total_cards"),
        F.count_if(ok).alias("accepted"),
        F.count_if(~ok).alias("skipped_by_title"),
        F.count_if(ok & F.col("known").isNotNull()).alias("skipped_known"),
    )
