"""Three run snapshots over the ``postings`` view, and their merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import job_fingerprint
from ..operators.jobtable import JobTable
from ..operators.merge import Merged, merge
from ..session import pin_utc, spread, staged
from .postings import companies, postings

# fixed values of the derived runs
RUNS = (1, 2, 3)
FAILED = {2: ["asana"]}
REPEATER = "zz-search"
STUB_SOURCES = ("linkedin", "wuzzuf", "bayt")
TOMBSTONE_EVERY = 29


def clock_of(run: int) -> str:
    return f"2024-02-{run:02d} 12:00:00"


def snapshot_sql(run: int, postings: str = "postings", ts: str = "TIMESTAMP") -> str:
    """What is listed in a run, all of it in the first; the same text in both engines."""
    stub = (
        f"(doc_id * 7 + {run - 1}) % 5 <> 0 AND {run} > 1 AND source IN {STUB_SOURCES}"
    )
    return f"""
SELECT doc_id, company_slug, doc_id AS seq, source, external_id,
  CASE WHEN doc_id % 17 = {run} THEN CONCAT(title, ' (Updated)') ELSE title END AS title,
  apply_url, location, remote, CASE WHEN doc_id % 2 = 0 THEN 'Engineering' END AS department,
  CASE WHEN {stub} THEN NULL ELSE description_text END AS description_text, posted_at,
  CASE WHEN doc_id % 4 = 0 THEN {ts} '2024-01-0{run} 00:00:00' END AS updated_at_source
FROM {postings} WHERE {run} = 1 OR (doc_id * 7 + {run}) % 5 <> 0"""


def repeated_sql(snapshot: str) -> str:
    """The snapshot, and every 31st posting listed once more by the search."""
    return (
        f"SELECT * FROM {snapshot} UNION ALL SELECT * REPLACE ('{REPEATER}' AS company_slug) "
        f"FROM {snapshot} WHERE doc_id % 31 = 0"
    )


def observations(spark: SparkSession, source: DataFrame, run: int) -> DataFrame:
    listed = spark.sql(snapshot_sql(run, "{postings}", "TIMESTAMP_NTZ"), postings=source)
    again = listed.where("doc_id % 31 = 0").withColumn("company_slug", F.lit(REPEATER))
    df = listed.unionByName(again)
    missing = ["employment_type", "team", "description_html", "raw_payload"]
    return df.select(
        F.lit(str(run)).alias("run_id"), "*", *[F.lit(None).cast("string").alias(c) for c in missing],
    ).withColumns({c: F.col(c).cast("timestamp") for c in ("posted_at", "updated_at_source")})


def tombstones(source: DataFrame) -> DataFrame:
    gone = source.where(F.col("doc_id") % TOMBSTONE_EVERY == 0)
    return gone.select(
        job_fingerprint(F.col("source"), F.col("external_id"), F.col("apply_url")).alias("fingerprint"),
        F.lit(None).cast("timestamp").alias("deleted_at"), "title", "source",
    )


def ran(spark: SparkSession, run: int) -> DataFrame:
    """The companies with how their run went."""
    failed = F.col("slug").isin(FAILED.get(run, [])) if run in FAILED else F.lit(False)
    return companies(spark).withColumn("status", F.when(failed, "failed").otherwise("ok"))


def step(spark: SparkSession, sf_dir: str, table: JobTable | None, run: int) -> tuple[Merged, DataFrame, DataFrame]:
    """One run merged into the jobs of the run before: the merge, its sightings, its companies."""
    pin_utc(spark)
    source = spread(postings(spark, sf_dir))
    went = ran(spark, run)
    seen = observations(spark, source, run)
    before = JobTable.empty(spark) if table is None else table
    # tombstones are a stored table
    result = merge(before, seen, went.where("status = 'ok'"), staged(tombstones(source)), clock_of(run))
    return result, seen, went
