"""Captured payloads: reading them, and telling good ones from bad ones."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import lexicon
from ..functions.patterns import let
from ..schemas import COMPANY, LANDING, OBSERVATION
from ..session import settled, small_side, staged

# fixed values: what a board's listing must be, and what a search must be configured with
PAYLOAD_OPENS = {"greenhouse": "{", "lever": "[", "ashby": "{", "workday": "{"}
LIST_FIELDS = {"greenhouse": "jobs", "ashby": "jobs", "workday": "jobPostings"}
EMPTY_JSON = ["{}", '""', "0", "false"]
REQUIRED_CONFIG = {
    "workday": ["host", "tenant", "site"],
    "linkedin": ["keywords", "location"],
    "wuzzuf": ["keywords"],
    "bayt": ["keywords"],
}


#: A column that tells rows of a written landing table apart, and so many of its values are broadcast.
NUMBER, NUMBERS = "landed_row", 2_000_000


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """One JSON line per captured response."""
    return spark.read.schema(LANDING).json(path)


def stage_landing(landing: DataFrame, path: str) -> None:
    """Landing rows as Parquet by run, source and kind, so that a reader reads its own part only."""
    landing.write.mode("append").partitionBy("run_id", "source", "kind").parquet(path)


def read_staged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LANDING).parquet(path).select(*LANDING.names)


def stream_landing(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(LANDING).json(path)


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """Companies from JSON lines, with their ``position``: unknown sources are left out, unknown
    regions are international."""
    return seed_rules(spark.read.schema(COMPANY).json(path).withColumn("position", F.monotonically_increasing_id()))


def seed_rules(seed: DataFrame) -> DataFrame:
    seed = seed.where(F.col("source").isin(*lexicon.SOURCES))
    region = F.when(F.col("target_region").isin(*lexicon.REGIONS), F.col("target_region"))
    config = F.coalesce("config", F.create_map().cast("map<string,string>"))
    return seed.withColumns(
        {"target_region": F.coalesce(region, F.lit("INTERNATIONAL")), "config": config, "active": F.lit(True)}
    )


def filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def _hashed(rows: DataFrame) -> DataFrame:
    """Rows with their payload's hash: who needs no more of a payload than that shuffles none."""
    return rows.withColumn("payload_hash", F.xxhash64("payload"))


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The latest capture of each page (of equally late ones that of the greatest hash).

    Nothing is written out.  Of rows that were written with a number the stale ones are found from keys,
    times and numbers, and no payload is shuffled while those can be broadcast.  Of others each
    task drops its stale ones before a shuffle; rows that are dealt by these keys already, or are
    joined by them afterwards, are not shuffled for it.
    """
    if NUMBER not in rows.columns:
        by_time = Window.partitionBy(*keys).orderBy(F.desc("fetched_at"), F.desc("payload_hash"))
        return rows.withColumn("nth", F.row_number().over(by_time)).where("nth = 1").drop("nth", "payload_hash")
    narrow = rows.select(*keys, F.struct("fetched_at", "payload_hash", NUMBER).alias("at"))
    best = narrow.groupBy(*keys).agg(F.max("at").alias("best"), F.count("*").alias("n")).where("n > 1")
    best = staged(best.select(*[F.col(c).alias(f"of_{c}") for c in keys], F.col("best").alias("kept")))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in keys])
    stale = narrow.join(small_side(best), same).where(f"at.{NUMBER} <> kept.{NUMBER}").select(f"at.{NUMBER}")
    return rows.join(small_side(staged(stale), NUMBERS), NUMBER, "left_anti").drop(NUMBER, "payload_hash")


def listings(landing: DataFrame, source: str) -> DataFrame:
    """Captured listing pages, the latest of each (of a stream: see ``streaming.latest_captures``)."""
    rows = landing.where((F.col("source") == source) & (F.col("kind") == "listing"))
    return rows if landing.isStreaming else _latest(_hashed(rows), ["run_id", "company_slug", "page"])


def details(landing: DataFrame, source: str, wanted: DataFrame) -> DataFrame:
    """Captured detail pages of the ``wanted`` (company_slug, ref), the latest of each.

    Pages that nobody asks for are dropped before anything is grouped or joined: they hold
    most of the bytes.
    """
    rows = landing.where((F.col("source") == source) & (F.col("kind") == "detail"))
    number = [NUMBER] if NUMBER in landing.columns else []
    rows = _hashed(rows.select("company_slug", "ref", "fetched_at", "payload", *number))
    keys = small_side(wanted.select("company_slug", "ref").where("ref IS NOT NULL").distinct())
    asked = rows.join(keys, ["company_slug", "ref"], "left_semi")
    return _latest(asked, ["company_slug", "ref"]).select("company_slug", "ref", F.col("payload").alias("detail"))


def json_items(landing: DataFrame, source: str, path: str | None) -> DataFrame:
    """One row per listed item, as JSON text: a bad item cannot spoil its neighbours."""
    rows = listings(landing, source)
    if path is None:
        items = F.from_json("payload", "array<string>")
    else:
        items = F.from_json("payload", f"struct<{path}: array<string>>")[path]
    return rows.select("run_id", "company_slug", "page", F.posexplode(items).alias("pos", "item"))


def observed(df: DataFrame, source: str, reject: Column, **columns: Column) -> DataFrame:
    """Items in the observation schema, with why an item is rejected (null when it is not)."""
    types = {f.name: f.dataType for f in OBSERVATION.fields}
    given = {
        "run_id": F.col("run_id"),
        "company_slug": F.col("company_slug"),
        # page and place are 32 bits each, so no page runs into the next
        "seq": F.shiftleft(F.coalesce("page", F.lit(0)).cast("long"), 32) + F.col("pos"),
        "source": F.lit(source),
        "remote": F.lit(False),
        **columns,
    }
    if "description_text" in given:  # long to work out and read many times above
        given["description_text"] = settled(given["description_text"])
    return df.select(
        *[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()], reject.alias("reject")
    )


def good(items: DataFrame) -> DataFrame:
    return items.where("reject IS NULL").drop("reject")


def rejects(items: DataFrame) -> DataFrame:
    return items.where("reject IS NOT NULL").select("run_id", "company_slug", "source", "seq", "reject", "raw_payload")


def _wrong_list(parsed: Column) -> Column:
    """Whether the field of a parsed payload that should list postings holds something else.

    Absent, null and empty values list nothing.  Anything else is no listing: taking it
    for an empty one would close all jobs of the company.  (All boards are held to this.)
    """
    wrong = F.lit(False)
    for source, name in LIST_FIELDS.items():
        value = F.try_variant_get(parsed, f"$.{name}", "variant")
        is_list = F.try_variant_get(parsed, f"$.{name}", "array<variant>").isNotNull()
        empty = value.isNull() | F.is_variant_null(value) | F.to_json(value).isin(*EMPTY_JSON)
        wrong = wrong | ((F.col("source") == source) & ~(empty | is_list))
    return wrong


def payload_errors(landing: DataFrame) -> DataFrame:
    """Companies that got a listing of the wrong shape: their run has failed."""
    opens = F.substring(F.ltrim("payload"), 1, 1)
    expected = F.create_map(*[F.lit(x) for kv in PAYLOAD_OPENS.items() for x in kv])
    fits = opens == F.try_element_at(expected, F.col("source"))
    # pages are large: each is parsed once
    unfit = let(F.try_parse_json("payload"), lambda parsed: ~(fits & parsed.isNotNull()) | _wrong_list(parsed))
    wrong = F.when(F.col("source").isin(*PAYLOAD_OPENS), unfit).otherwise(F.col("payload").isNull())
    bad = landing.where("kind = 'listing'").where(F.coalesce(wrong, F.lit(True)))
    message = F.concat("source", F.lit(": unexpected payload for "), "company_slug")
    return bad.select("company_slug", message.alias("error_message")).distinct()


def config_errors(companies: DataFrame) -> DataFrame:
    """Searches without a setting their source needs."""
    missing = F.lit(False)
    wanted = F.lit(None).cast("string")
    for source, keys in REQUIRED_CONFIG.items():
        has_all = F.lit(True)
        for k in keys:
            has_all = has_all & (F.coalesce(F.try_element_at("config", F.lit(k)), F.lit("")) != "")
        missing = missing | ((F.col("source") == source) & ~has_all)
        wanted = F.when(F.col("source") == source, "/".join(keys)).otherwise(wanted)
    message = F.concat("source", F.lit(": company "), "slug", F.lit(" missing "), wanted, F.lit(" config"))
    return companies.where(F.coalesce(missing, F.lit(False))).select(
        F.col("slug").alias("company_slug"), message.alias("error_message")
    )


def run_status(companies: DataFrame, landing: DataFrame) -> DataFrame:
    """Companies with ``status`` ok or failed, and why; nothing captured is a failure too."""
    errors = config_errors(companies).unionByName(payload_errors(landing))
    # a line a company, written out: the pages behind it would be parsed for its count and again for the join
    errors = staged(errors.groupBy("company_slug").agg(F.min("error_message").alias("error_message")))
    got = landing.select("company_slug").distinct().withColumn("captured", F.lit(True))
    joined = (
        companies.withColumn("company_slug", F.col("slug"))
        .join(small_side(errors), "company_slug", "left")
        .join(small_side(got), "company_slug", "left")
    )
    message = F.coalesce(
        "error_message",
        F.when(F.col("captured").isNull(), F.concat("source", F.lit(": nothing captured for "), "company_slug")),
    )
    failed = message.isNotNull()
    return joined.select(
        *companies.columns, F.when(failed, "failed").otherwise("ok").alias("status"), message.alias("error_message"),
        F.when(failed, "ScraperError").alias("error_kind"),
    )
