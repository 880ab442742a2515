"""Pages that carry their postings in an embedded JSON blob of unknown depth."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import strip
from ..functions.text import html_to_text
from ..operators.filters import looks_remote
from .landing import filled, listings, observed

_BLOB = r'(?s)<script id="__NEXT_DATA__" type="application/json">(.*?)</script>'


@F.udf(T.ArrayType(T.StringType()), useArrow=False)
def _objects_with_title(blob):
    """Every JSON object that has a title, outer before inner; none when unreadable.

    Row by row, in the small batches of a plain function: an Arrow batch of 10,000 pages is all
    their blobs and objects at once, in the memory of the Python beside the executor.
    """
    try:
        todo = [json.loads(blob)]
    except (TypeError, ValueError):
        return []
    out = []
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            if node.get("title"):
                out.append(json.dumps(node, ensure_ascii=False))
            todo.extend(reversed(node.values()))
        elif isinstance(node, list):
            todo.extend(reversed(node))
    return out


def _field(name: str) -> Column:
    return F.get_json_object("item", f"$.{name}")


def _truthy(value: Column) -> Column:
    return ~F.coalesce(value, F.lit("")).isin("", "false", "0", "[]", "{}", "0.0")


def place_list(places: Column) -> Column:
    """The places of an array that are not empty, as one text."""
    return F.array_join(F.filter(places, lambda s: F.coalesce(s, F.lit("")) != ""), ", ")


def wellfound(landing: DataFrame) -> DataFrame:
    """Objects that look like a posting: an id, a title, and a slug or public id."""
    pages = listings(landing, "wellfound").withColumn("blob", F.regexp_extract("payload", _BLOB, 1))
    df = pages.where("blob <> ''").select(
        "run_id", "company_slug", "page", F.posexplode(_objects_with_title("blob")).alias("pos", "item")
    )
    truthy = lambda name: F.when(_truthy(_field(name)), _field(name))
    df = df.withColumns(
        {
            "jid": F.coalesce(truthy("id"), truthy("jobId")),
            "slug": F.coalesce(truthy("slug"), truthy("jobSlug")),
            "public_id": truthy("publicId"),
            "place": F.coalesce(truthy("locations"), truthy("location")),
            "html": filled(_field("description"), _field("jobDescription")),
        }
    ).where("jid IS NOT NULL AND (slug IS NOT NULL OR public_id IS NOT NULL)")
    names = place_list(F.from_json("place", "array<string>"))
    place = F.when(F.col("place").startswith("["), names).otherwise(F.col("place"))
    df = df.withColumn("location", F.nullif(place, F.lit("")))
    link = F.concat(F.lit("https://wellfound.com/jobs/"), F.coalesce("slug", "public_id"))
    company = F.coalesce(truthy("startupName"), _field("startup.name"))
    return observed(
        df, "wellfound", F.lit(None).cast("string"),
        external_id=F.col("jid"), title=strip(_field("title")),
        apply_url=F.coalesce(truthy("jobUrl"), link),
        location=F.col("location"), country=F.col("location"),
        remote=_truthy(_field("remote")) | looks_remote(F.col("location")),
        description_html=F.col("html"), description_text=html_to_text(F.col("html")),
        raw_payload=F.to_json(F.struct(company.alias("company"), F.col("jid").alias("id"))),
    )
