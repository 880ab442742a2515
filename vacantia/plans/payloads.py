"""Board payloads derived from the ``postings`` view: what a capture step would have stored.

Every posting is put on every board it is asked for, at most PAGE postings of a
company to a page, so that no response grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .postings import companies as pool_companies

# fixed values of the derived payloads
PAGE = 200
BROKEN_EVERY = 37
EMPTY_ID_EVERY = 41
REPEATED_EVERY = 11
DETAIL_MISSING_EVERY = 3
FETCHED_AT = "2024-02-01 06:00:00"


def companies(spark) -> DataFrame:
    """The pool's companies with the settings every kind of search needs."""
    config = {
        "host": F.concat("slug", F.lit(".jobs.example.com")), "tenant": F.col("slug"), "site": F.lit("Careers"),
        "keywords": F.lit("java"), "location": F.lit("Egypt"),
    }
    pairs = [x for k, v in config.items() for x in (F.lit(k), v)]
    return pool_companies(spark).withColumns(
        {
            "config": F.create_map(*pairs),
            "careers_url": F.concat(F.lit("https://jobs.example.com/"), "slug"),
            "created_at": F.lit("2024-01-01 00:00:00").cast("timestamp"),
        }
    )


def escape(text: Column) -> Column:
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(ref))
    return text


def paragraph(text: Column) -> Column:
    return F.concat(F.lit("<p>"), escape(text), F.lit("</p>"))


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _landing(df: DataFrame, source: str, kind: str, ref: Column, page: Column, payload: Column) -> DataFrame:
    return df.select(
        F.lit("1").alias("run_id"), F.lit(source).alias("source"), "company_slug", F.lit(kind).alias("kind"),
        ref.cast("string").alias("ref"), page.cast("int").alias("page"),
        F.lit(FETCHED_AT).cast("timestamp").alias("fetched_at"), payload.alias("payload"),
    )


def _page() -> Column:
    return F.floor(F.col("doc_id") / PAGE).cast("int")


def dealt(df: DataFrame) -> DataFrame:
    """The postings dealt by company and page, so that boards made from them share one shuffle.

    They are grouped whole and unfolded again: a shuffle from which each board's unused columns
    were pruned would be another one for each board.
    """
    rest = [c for c in df.columns if c != "company_slug"]
    grouped = df.withColumn("page", _page()).groupBy("company_slug", "page").agg(F.collect_list(F.struct(*rest)).alias("rows"))
    return grouped.select("company_slug", "page", F.inline("rows"))


def _pages(df: DataFrame, source: str, item: Column, head: str, tail: str, glue: str = ",") -> DataFrame:
    page = F.col("page") if "page" in df.columns else _page()
    rows = df.select("company_slug", page.alias("page"), "doc_id", item.alias("item"))
    grouped = rows.groupBy("company_slug", "page").agg(F.array_sort(F.collect_list(F.struct("doc_id", "item"))).alias("items"))
    body = F.array_join(F.transform("items", lambda i: i["item"]), glue)
    return _landing(grouped, source, "listing", F.lit(None), F.col("page"), F.concat(F.lit(head), body, F.lit(tail)))


def _good_id() -> Column:
    return F.when(F.col("doc_id") % BROKEN_EVERY != 0, F.col("external_id"))


def _id_or_empty() -> Column:
    return F.when((F.col("doc_id") % EMPTY_ID_EVERY == 0) & _good_id().isNotNull(), "").otherwise(_good_id())


def captured_twice(pages: DataFrame, empty: str) -> DataFrame:
    """Every page with an older, empty capture, and every other page stored twice."""
    older = pages.withColumns(
        {"payload": F.lit(empty), "fetched_at": F.col("fetched_at") - F.expr("INTERVAL 1 HOUR")}
    )
    return pages.unionByName(older).unionByName(pages.where("page % 2 = 0"))


def greenhouse(df: DataFrame) -> DataFrame:
    more = [
        F.concat(F.lit(" "), "title", F.lit(" ")).alias("title"),
        F.col("apply_url").alias("absolute_url"), F.struct(F.col("location").alias("name")).alias("location"),
        escape(paragraph(F.col("description_text"))).alias("content"),
        F.array(F.struct(F.lit("Engineering").alias("name"))).alias("departments"),
        F.array(F.struct(F.lit("HQ").alias("name"))).alias("offices"),
        _iso(F.col("posted_at")).alias("updated_at"),
    ]
    # ids are numbers where there are any
    item = F.when(_id_or_empty() == "", F.to_json(F.struct(F.lit("").alias("id"), *more))).otherwise(
        F.to_json(F.struct(_good_id().cast("long").alias("id"), *more))
    )
    return _pages(df, "greenhouse", item, '{"jobs":[', "]}")


def lever(df: DataFrame) -> DataFrame:
    item = F.struct(
        _id_or_empty().alias("id"), F.col("title").alias("text"), F.col("apply_url").alias("hostedUrl"),
        F.struct(
            "location", F.lit("Full-time").alias("commitment"), F.lit("Core").alias("team"),
            F.array(F.when(F.col("doc_id") % 8 == 0, "REMOTE (EU)").otherwise("Office")).alias("allLocations"),
        ).alias("categories"),
        paragraph(F.col("description_text")).alias("descriptionHtml"),
        F.array(F.struct(F.lit("About").alias("text"), F.lit("<li>We hire</li>").alias("content"))).alias("lists"),
        F.when(F.col("doc_id") % 9 == 0, "remote").otherwise("onsite").alias("workplaceType"),
        F.unix_millis(F.col("posted_at").cast("timestamp")).alias("createdAt"),
    )
    return _pages(df, "lever", F.to_json(item), "[", "]")


def ashby(df: DataFrame) -> DataFrame:
    fields = [
        _good_id().alias("jobId"), F.col("title"), F.col("apply_url").alias("jobUrl"),
        F.col("location").alias("locationName"), (F.col("doc_id") % 10 == 0).alias("isRemote"),
        F.struct(F.struct(F.when(F.col("doc_id") % 2 == 0, "Egypt").alias("addressCountry")).alias("postalAddress")).alias("address"),
        paragraph(F.col("description_text")).alias("descriptionHtml"),
        F.date_format("posted_at", "yyyy-MM-dd").alias("publishedAt"),
    ]
    names = F.array(F.lit("Lisbon"), F.lit("Remote EU"))
    objects = F.array(F.struct(F.lit("Lisbon").alias("location")))
    item = F.when(F.col("doc_id") % 6 == 0, F.to_json(F.struct(*fields, names.alias("secondaryLocations")))).otherwise(
        F.to_json(F.struct(*fields, objects.alias("secondaryLocations")))
    )
    return _pages(df, "ashby", item, '{"jobs":[', "]}")


def workday(df: DataFrame) -> DataFrame:
    path = F.when(
        F.col("doc_id") % BROKEN_EVERY != 0, F.concat(F.lit("/job/City/"), "company_slug", F.lit("_R-"), "external_id")
    )
    item = F.struct(
        "title", path.alias("externalPath"), F.nullif("location", F.lit("")).alias("locationsText"),
        F.lit("Posted Today").alias("postedOn"), F.array(F.lit("")).alias("bulletFields"),
    )
    listed = _pages(df, "workday", F.to_json(item), '{"total":1,"jobPostings":[', "]}")
    detail = F.to_json(
        F.struct(
            F.struct(
                paragraph(F.col("description_text")).alias("jobDescription"), F.lit("Full time").alias("timeType"),
                F.lit("Cairo").alias("location"),
            ).alias("jobPostingInfo")
        )
    )
    with_detail = df.where((F.col("doc_id") % DETAIL_MISSING_EVERY != 0) & path.isNotNull())
    return listed.unionByName(_landing(with_detail, "workday", "detail", path, F.lit(None), detail))


def _twice(item: Column) -> Column:
    return F.when(F.col("doc_id") % REPEATED_EVERY == 0, F.concat(item, item)).otherwise(item)


def _html(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])


def linkedin(df: DataFrame) -> DataFrame:
    urn = F.when(
        F.col("doc_id") % 7 != 0, F.concat(F.lit(' data-entity-urn="urn:li:jobPosting:'), "external_id", F.lit('"'))
    )
    card = _html(
        '<li><div class="base-card base-search-card"', urn,
        '><a class="base-card__full-link" href="https://www.linkedin.com/jobs/view/a-job-', F.col("external_id"),
        '?trk=x"><span>open</span></a><h3 class="base-search-card__title"> ', F.col("title"),
        ' </h3><h4 class="base-search-card__subtitle"><a href="/c"> ', escape(F.col("company_name")),
        ' </a></h4><span class="job-search-card__location">', F.col("location"), '</span><time class="t" datetime="',
        F.date_format("posted_at", "yyyy-MM-dd"), '"></time></div></li>',
    )
    listed = _pages(df, "linkedin", _twice(card), "<ul><li>no card</li>", "</ul>", "\n")
    detail = _html(
        '<body><div class="top"><section class="show-more-less-html__markup more"><section>',
        paragraph(F.coalesce("description_text", F.lit(""))), "</section> tail</section></div><div>footer</div></body>",
    )
    return listed.unionByName(_landing(df, "linkedin", "detail", F.col("external_id"), F.lit(None), detail))


def wuzzuf(df: DataFrame) -> DataFrame:
    key = F.concat("external_id", F.lit("-"), "company_slug")
    card = _html(
        '<div class="css-1"><h2><a class="css-2" href="/jobs/p/', key, '">', F.col("title"),
        '</a></h2><div><a href="/jobs/companies/', F.col("company_slug"), '">', escape(F.col("company_name")),
        "</a> <span> ", F.col("location"), " </span></div></div>",
    )
    listed = _pages(df, "wuzzuf", _twice(card), "<html><body>", "</body></html>", "\n")
    text = F.coalesce("description_text", F.lit(""))
    detail = F.when(
        F.col("doc_id") % 2 == 0, _html('<div class="a job-description"><div>', paragraph(text), "</div></div><div>x</div>")
    ).otherwise(_html('<section class="css-ssjg3">', paragraph(text), "</section><div>x</div>"))
    return listed.unionByName(_landing(df, "wuzzuf", "detail", key, F.lit(None), detail))


def bayt(df: DataFrame) -> DataFrame:
    link = F.concat(F.lit("/en/egypt/jobs/some-job-"), "external_id", F.lit("/"))
    inside = F.when(F.col("doc_id") % 2 == 0, F.col("title")).otherwise(F.lit("<i>+</i>"))
    card = _html(
        '<li><a data-x="1" href="', link, '">', inside, "</a><h2>", F.col("title"),
        '</h2><b><a href="/en/egypt/companies/', F.col("company_slug"), '">', escape(F.col("company_name")),
        "</a></b><span>", F.col("location"), "</span></li>",
    )
    listed = _pages(df, "bayt", _twice(card), "<ul>", "</ul>", "\n")
    text = paragraph(F.coalesce("description_text", F.lit("")))
    detail = (
        F.when(F.col("doc_id") % 3 == 0, _html('<div class="details-section">', text, "</div>"))
        .when(F.col("doc_id") % 3 == 1, _html('<section class="card-content">', text, "</section>"))
        .otherwise(_html('<p>x</p><div itemprop="description">', text, "</div>"))
    )
    key = F.concat(F.lit("bayt-"), "external_id")
    return listed.unionByName(_landing(df, "bayt", "detail", key, F.lit(None), detail))


def wellfound(df: DataFrame) -> DataFrame:
    item = F.struct(
        _good_id().cast("long").alias("id"), "title", F.concat(F.lit("job-"), "external_id").alias("slug"),
        F.array("location").alias("locations"), F.struct(F.col("company_name").alias("name")).alias("startup"),
        paragraph(F.col("description_text")).alias("description"), (F.col("doc_id") % 5 == 0).alias("remote"),
    )
    head = '<html><script id="__NEXT_DATA__" type="application/json">{"props":{"title":"no job","a":[{"jobs":['
    return _pages(df, "wellfound", F.to_json(item), head, "]}]}}</script></html>")
