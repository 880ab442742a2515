"""Searches, pages, counts and exports over the job table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon
from ..functions.times import clock
from ..session import small_side

# fixed values: page sizes
LIST_LIMIT, DASHBOARD_LIMIT, LOG_LIMIT = 200, 500, 100

# fixed values: saved views as arguments of ``search``
SAVED_VIEWS = {
    "Active": {},
    "Applied": {"statuses": ["APPLIED"], "lifecycles": ["ACTIVE", "CLOSED", "ARCHIVED"]},
    "Favorites": {"favorites_only": True},
    "Closed": {"lifecycles": ["CLOSED"]},
    "Archived": {"lifecycles": ["ARCHIVED"]},
}
_VIEW_DEFAULTS = {"lifecycles": ["ACTIVE"], "statuses": ["NOT_APPLIED"]}


def parse_list(value: str | None, domain: Sequence[str], strict: bool = False) -> list[str] | None:
    """A comma list as filter values; an unknown value is dropped, or refused when strict."""
    parts = [p.strip() for p in (value or "").split(",") if p.strip()]
    unknown = [p for p in parts if p not in domain]
    if strict and unknown:
        raise ValueError(f"not one of {', '.join(domain)}: {', '.join(unknown)}")
    return [p for p in parts if p in domain] or None


def text_matches(query: str) -> Column:
    """Title or description, ignoring case; % and _ in the query are wildcards."""
    like = F.lit(f"%{query.lower()}%")
    return F.like(F.lower("title"), like) | F.like(F.lower("description_text"), like)


def search(
    jobs: DataFrame,
    *,
    region: str | None = None,
    lifecycles: Sequence[str] | None = None,
    statuses: Sequence[str] | None = None,
    sources: Sequence[str] | None = None,
    countries: Sequence[str] | None = None,
    remote_only: bool = False,
    favorites_only: bool = False,
    min_score: float | None = None,
    query: str | None = None,
) -> DataFrame:
    """Jobs that meet all given conditions.  Cheap ones go first, text search last."""
    for test in conditions(region, lifecycles, statuses, sources, countries, remote_only, favorites_only, min_score, query):
        jobs = jobs.where(test)
    return jobs


def conditions(
    region=None, lifecycles=None, statuses=None, sources=None, countries=None, remote_only=False, favorites_only=False,
    min_score=None, query=None,
) -> list[Column]:
    """The tests of a search, cheap ones first."""
    tests: list[Column] = []
    if region is not None:
        tests.append(F.col("region") == region)
    for column, values in (
        ("lifecycle", lifecycles), ("application_status", statuses), ("source", sources), ("country", countries),
    ):
        if values:
            tests.append(F.col(column).isin(*values))
    if remote_only:
        tests.append(F.col("remote"))
    if favorites_only:
        tests.append(F.col("favorite"))
    if min_score is not None:
        tests.append(F.col("heuristic_score") >= min_score)
    if query:
        tests.append(text_matches(query))
    return tests


def ordering(order_by: str = "score") -> list[Column]:
    """Sort keys; the fingerprint breaks ties, so that pages do not overlap."""
    newest = F.desc("first_seen_at")
    keys = {
        "score": [F.desc_nulls_last("heuristic_score"), newest],
        "newest": [newest],
        "company": [F.asc("company_slug"), newest],
    }
    return [*keys.get(order_by, []), F.asc("fingerprint")]


def page(jobs: DataFrame, order_by: str = "score", limit: int = LIST_LIMIT, offset: int = 0) -> DataFrame:
    """One page of a list: a top-k, no full sort."""
    jobs = jobs.orderBy(*ordering(order_by))
    return (jobs.offset(offset) if offset else jobs).limit(limit)


def saved_view(jobs: DataFrame, name: str, region: str | None = None) -> DataFrame:
    return search(jobs, region=region, **{**_VIEW_DEFAULTS, **SAVED_VIEWS[name]})


def views_of(jobs: DataFrame, region: str | None = None) -> DataFrame:
    """A row per job and saved view that shows it, with ``view``; the table is read once."""
    shown = [
        F.when(reduce(and_, conditions(region=region, **{**_VIEW_DEFAULTS, **view}), F.lit(True)), F.lit(name))
        for name, view in SAVED_VIEWS.items()
    ]
    return jobs.select("fingerprint", F.explode(F.filter(F.array(*shown), lambda v: v.isNotNull())).alias("view"))


def with_company(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Add the company's name; a job without a company keeps null."""
    names = companies.select(F.col("slug").alias("company_slug"), F.col("name").alias("company"))
    return jobs.join(small_side(names), "company_slug", "left")


def by_fingerprint(jobs: DataFrame, fingerprint: str) -> DataFrame:
    return jobs.where(F.col("fingerprint") == fingerprint)


def keys_of_company(jobs: DataFrame, slug: str, active_only: bool = False) -> DataFrame:
    rows = jobs.where(F.col("company_slug") == slug)
    return (rows.where("lifecycle = 'ACTIVE'") if active_only else rows).select("fingerprint")


def _label() -> Column:
    return F.col("score_breakdown.quality_label").alias("quality_label")


def list_record(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Rows as the job list exports them.  Names before the join: only columns needed are read."""
    return with_company(jobs, companies).select(
        "fingerprint", "title", "company", "location", "country", "remote", "source", "apply_url", "posted_at",
        F.col("heuristic_score").alias("score"), F.col("heuristic_confidence").alias("confidence"), _label(),
        "lifecycle", "application_status", "favorite",
    )


def detail_record(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Rows as the job detail exports them."""
    return with_company(jobs, companies).select(
        "fingerprint", "title", "company", "location", "country", "remote", "employment_type", "department",
        "source", "apply_url", "posted_at", "first_seen_at", F.col("heuristic_score").alias("score"),
        F.col("heuristic_confidence").alias("confidence"), _label(), "score_breakdown", "lifecycle",
        "application_status", "favorite", "notes", "description_text",
    )


def serving_row(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """A line of the dashboard."""
    return with_company(jobs, companies).select(
        "fingerprint", F.col("heuristic_score").cast("int").alias("score"), "company", "title", "location",
        "source", F.date_format("posted_at", "yyyy-MM-dd").alias("posted_date"),
    )


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def company_record(companies: DataFrame) -> DataFrame:
    rows = companies.where("active").orderBy("slug")
    return rows.select("slug", "name", "source", "external_id", "careers_url", "active")


def active_companies(companies: DataFrame, source: str | None = None, slug: str | None = None) -> DataFrame:
    rows = companies.where("active")
    if source is not None:
        rows = rows.where(F.col("source") == source)
    if slug is not None:
        rows = rows.where(F.col("slug") == slug)
    return rows.orderBy("slug")


def count_by_status(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("application_status").agg(F.count("*").alias("n_jobs"))


def region_counts(jobs: DataFrame) -> DataFrame:
    """Open jobs per region: real counts, not lengths of a capped list."""
    return jobs.groupBy("region").agg(
        F.count_if((F.col("lifecycle") == "ACTIVE") & (F.col("application_status") == "NOT_APPLIED")).alias("n_open")
    )


def recent_logs(logs: DataFrame, limit: int = LOG_LIMIT) -> DataFrame:
    return logs.orderBy(F.desc("started_at"), F.asc("company_slug")).limit(limit)


def log_record(logs: DataFrame) -> DataFrame:
    """Run log lines as they are exported, the latest first."""
    return logs.orderBy(F.desc("started_at"), F.asc("company_slug")).select(
        "run_id", "source", "company_slug", "status", "started_at", "finished_at", "jobs_seen", "jobs_new",
        "jobs_updated", "jobs_closed", "error_message", "error_kind",
    )


def last_success(logs: DataFrame) -> DataFrame:
    """When a company last went well; null before that."""
    return logs.where("status = 'ok'").agg(F.max("finished_at").alias("last_success"))


def state_value(state: DataFrame, key: str = lexicon.LAST_SUCCESS_KEY) -> DataFrame:
    """A stored time, null when absent or unreadable; one row in any case."""
    value = F.max(F.when(F.col("key") == key, F.col("value").try_cast("timestamp")))
    return state.agg(value.alias("last_success"))


def is_stale(companies: DataFrame, last: DataFrame, as_of, hours: int = lexicon.CATCHUP_THRESHOLD_HOURS) -> DataFrame:
    """Whether a run is due; never so without active companies."""
    active = companies.where("active").agg(F.count("*").alias("n"))
    facts = last.select(F.col("last_success").cast("timestamp")).unionByName(active, allowMissingColumns=True)
    facts = facts.agg(F.max("last_success").alias("last_success"), F.max("n").alias("n"))
    age = (F.unix_micros(clock(as_of)) - F.unix_micros("last_success")) / 3_600_000_000
    due = (F.col("n") > 0) & (F.col("last_success").isNull() | (age >= hours))
    return facts.select(due.alias("stale"))
