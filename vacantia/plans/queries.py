"""The registered queries: one per operator, over the given tables.

Each takes a session and a data folder.  Times come out as text and sets as
joined text, so that results compare across engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon
from ..functions import keys, text, times
from ..functions.patterns import fold
from ..operators import actions as acts
from ..operators import constraints, features, filters, merge, ordered, rules, scoring, serving
from ..operators.jobtable import JobTable
from ..session import checkpoint_dir, pin_utc, spread, staged
from ..schemas import BREAKDOWN
from ..sinks.store import Store
from ..sources import boards, cards, embedded, landing, registry
from ..streaming import incremental
from . import payloads, runs
from .postings import AS_OF, postings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def ts_text(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def joined(column: str) -> Column:
    return F.array_join(F.array_sort(column), ",")


def posts(spark: SparkSession, sf: str) -> DataFrame:
    pin_utc(spark)
    return postings(spark, sf)


def worked(spark: SparkSession, sf: str) -> DataFrame:
    """Postings spread over the cores, for work that is heavy per row."""
    return spread(posts(spark, sf))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    pin_utc(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def placed(df: DataFrame) -> DataFrame:
    """All postings with their region's country, also those the filter rejects."""
    return df.withColumn(
        "country", filters.region_country(F.col("region"), F.col("location"), F.col("remote"))
    )


# ------------------------------------------------------------------- filters
@query("f01_title_match")
def _(spark, sf):
    return posts(spark, sf).select("doc_id", filters.title_matches(F.col("title")).alias("matches"))


@query("f03_loc_international")
def _(spark, sf):
    c = filters.international_country(F.col("location"), F.col("remote"))
    return posts(spark, sf).select("doc_id", c.alias("country"))


@query("f04_loc_egypt")
def _(spark, sf):
    return posts(spark, sf).select("doc_id", filters.egypt_country(F.col("location"), F.col("remote")).alias("country"))


@query("f05_experience_excluded")
def _(spark, sf):
    return worked(spark, sf).select("doc_id", filters.experience_excluded(F.col("description_text")).alias("excluded"))


@query("f06_passes_region")
def _(spark, sf):
    return filters.accepted(posts(spark, sf)).select("doc_id", "region", "country")


@query("f07_precheck")
def _(spark, sf):
    wanted = posts(spark, sf).where(filters.title_matches(F.col("title")))
    return wanted.groupBy("source").agg(F.count("*").alias("n_details"))


@query("f14_remote")
def _(spark, sf):
    place = F.col("location")
    return posts(spark, sf).select(
        "doc_id", filters.looks_remote(place).alias("remote_plain"),
        filters.looks_remote(place, lexicon.GREENHOUSE_REMOTE_WORDS).alias("remote_wide"),
    )


# ------------------------------------------------------------------- scalars
@query("x01_html_text")
def _(spark, sf):
    return spread(table(spark, sf, "pages")).select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query("x02_fingerprint")
def _(spark, sf):
    eid = F.when(F.col("doc_id") % 5 != 0, F.col("external_id"))
    key = keys.job_fingerprint(F.col("source"), eid, F.col("apply_url"))
    return posts(spark, sf).select("doc_id", key.alias("fingerprint"))


@query("x04_text_hash")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", keys.text_hash(F.col("text")).alias("text_hash"))


@query("x05_parse_dt")
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.date_trunc("second", "ts").alias("t"))
    seconds = F.unix_seconds(F.col("t").cast("timestamp"))
    written = (
        F.when(F.col("event_id") % 6 == 0, seconds.cast("string"))
        .when(F.col("event_id") % 6 == 1, F.concat(seconds.cast("string"), F.lit("123")))
        .when(F.col("event_id") % 6 == 2, F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("event_id") % 6 == 3, F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
        .when(F.col("event_id") % 6 == 4, F.date_format("t", "yyyy-MM-dd"))
        .otherwise("Posted Today")
    )
    return df.select(
        "event_id", ts_text(times.parse_dt(written)).alias("parsed"),
        ts_text(times.parse_epoch(seconds * 1000)).alias("from_millis"),
    )


@query("x07_unescape")
def _(spark, sf):
    escaped = payloads.escape(payloads.paragraph(F.col("text")))
    return table(spark, sf, "documents").select(
        "doc_id", text.unescape_if_escaped(escaped).alias("markup")
    )


@query("x08_normalize_title")
def _(spark, sf):
    return posts(spark, sf).select("doc_id", text.normalize_title(F.col("title")).alias("title_norm"))


@query("x13_section")
def _(spark, sf):
    folded = fold(F.coalesce("description_text", F.lit("")))
    return worked(spark, sf).select(
        "doc_id",
        text.section(folded, lexicon.PREFERRED_HEADINGS).alias("preferred"),
        text.section(folded, lexicon.REQUIRED_HEADINGS).alias("required"),
    )


@query("x16_keyword_stuffing")
def _(spark, sf):
    folded = fold(F.coalesce("description_text", F.lit("")))
    return posts(spark, sf).select(
        "doc_id", *[text.occurrences(folded, w).alias(f"n_{w}") for w in lexicon.STUFFING_KEYWORDS]
    )


@query("x17_age_days")
def _(spark, sf):
    return posts(spark, sf).select("doc_id", times.age_days(F.col("posted_at"), times.clock(AS_OF)).alias("age_days"))


@query("x22_url_id")
def _(spark, sf):
    link = text.strip_query(F.col("apply_url"))
    return posts(spark, sf).select("doc_id", link.alias("link"), text.last_segment(link).alias("link_id"))


@query("x24_location_list")
def _(spark, sf):
    places = F.array("lang", F.when(F.col("doc_id") % 3 == 0, ""), "source")
    rows = table(spark, sf, "documents").select(embedded.place_list(places).alias("places"))
    return rows.groupBy("places").agg(F.count("*").alias("n_rows"))


# ------------------------------------------------------------------- features
def _featured(spark, sf) -> DataFrame:
    return features.features(placed(worked(spark, sf)))


@query("x09_seniority")
def _(spark, sf):
    return _featured(spark, sf).select("doc_id", "seniority")


@query("x10_specialization")
def _(spark, sf):
    title = text.normalize_title(F.col("title"))
    return posts(spark, sf).select("doc_id", features.detect_specialization(title).alias("specialization"))


@query("x11_experience")
def _(spark, sf):
    return _featured(spark, sf).select(
        "doc_id", "required_years", "preferred_years", "range_min", "range_max", "grad_friendly"
    )


@query("x12_stack")
def _(spark, sf):
    rows = features.skill_map(_featured(spark, sf)).select("doc_id", F.explode("stack").alias("skill", "m"))
    return rows.select("doc_id", "skill", "m.in_title", "m.in_description", "m.is_required", "m.is_preferred")


@query("x14_signal_counts")
def _(spark, sf):
    return _featured(spark, sf).select("doc_id", *[f"hits_{b}" for b in lexicon.PHRASE_BANKS])


@query("x15_company_tier")
def _(spark, sf):
    return posts(spark, sf).select("doc_id", features.company_tier(F.col("company_name")).alias("tier"))


@query("p02_feature_view")
def _(spark, sf):
    view = features.feature_view(worked(spark, sf), "doc_id")
    return view.withColumns({c: F.array_join(c, ",") for c in ("stack_title", "stack_desc")})


# ------------------------------------------------------------------- scores
def scored(spark, sf) -> DataFrame:
    return scoring.score(placed(worked(spark, sf)), AS_OF)


@query("r_score")
def _(spark, sf):
    return scored(spark, sf).select("doc_id", "score", "raw_score", "confidence", "quality_label", "strategy")


@query("r_rules")
def _(spark, sf):
    return scoring.explain_rules(scored(spark, sf), "doc_id").drop("rule_no")


@query("g05_score_only")
def _(spark, sf):
    return scoring.score_only(placed(worked(spark, sf)), AS_OF, "doc_id")


@query("g03_tuned_weights")
def _(spark, sf):
    tuned = {
        "EGYPT": {"stack_java_title": 0.0, "spec_backend": 2.0},
        "INTERNATIONAL": {"seniority_junior": 0.5},
    }
    rows = scoring.explain_rules(scoring.score(placed(worked(spark, sf)), AS_OF, tuned), "doc_id")
    return rows.groupBy("name").agg(F.count("*").alias("n_rules"), F.sum("final_points").alias("points"))


# rules laid over the given ones: one changed, one out, one more in a slot, one alone, two that exclude each other
OWN_RULES = [
    (1, "stack_kafka", "stack", "array_contains(skills_required, 'kafka')", "6", "'Kafka wanted'", None),
    (2, "stack_redis", None, None, None, None, None),
    (3, "seniority_open", "seniority", "seniority = 'unknown'", "-1", "'Level not told'", "seniority_intern"),
    (4, "stack_wide", "stack", "size(skills) >= 6", "least(size(skills) - 5, 4)",
     "concat('Wide stack (', size(skills), ' skills)')", None),
    (6, "text_medium", "quality", "description_chars > 1000", "1", "'Some text'", "text_size"),
    (5, "text_long", "quality", "description_chars > 2500", "3", "concat('Long text: ', description_chars)", "text_size"),
]


@query("g02_extra_rule")
def _(spark, sf):
    """All postings scored with a table of rules over the given ones; every rule that fires, in order."""
    own = rules.slots(spark.createDataFrame(OWN_RULES, rules.RULES), scoring.rule_slots(times.clock(AS_OF)))
    rows = scoring.score(placed(worked(spark, sf)), AS_OF, slots=own)
    said = F.transform("triggered_rules", lambda r: F.concat_ws("|", r["name"], r["final_points"].cast("string"), r["reason"]))
    return rows.select("doc_id", "score", "raw_score", F.array_join(said, " ; ").alias("rules"))


@query("g04_own_tiers")
def _(spark, sf):
    """Postings of the customers, scored with employer tiers by parts of the suppliers' names."""
    part = F.when(F.col("s_suppkey") % 3 == 0, F.substring("s_name", -2, 2)).otherwise(F.substring("s_name", -4, 4))
    place = (F.col("s_nationkey") % 4).cast("int")
    own = table(spark, sf, "supplier").select(
        place.alias("place"), F.element_at(F.array(*map(F.lit, lexicon.COMPANY_TIERS)), place + 1).alias("tier"), part.alias("term")
    )
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("own"))
    given = placed(worked(spark, sf)).join(names, "doc_id", "left")
    # a third keep their names
    given = given.withColumn("company_name", F.when(F.col("doc_id") % 3 > 0, F.col("own")).otherwise(F.col("company_name")))
    rows = scoring.apply_rules(features.features(given, tiers=own), AS_OF)
    return rows.select("doc_id", F.col("company_tier").alias("tier"), "score", "raw_score")


@query("x18_quality_label")
def _(spark, sf):
    return scored(spark, sf).groupBy("quality_label").agg(F.count("*").alias("n_postings"))


def _why(breakdown: str) -> list[Column]:
    """Everything a breakdown says, its rules in their order, as text."""
    said = ("name", "category", "base_points", "final_points", "reason")
    rules = F.transform(
        F.col(f"{breakdown}.triggered_rules"), lambda r: F.concat_ws("|", *[r[f].cast("string") for f in said])
    )
    return [
        F.col(f"{breakdown}.raw_score").alias("raw_score"), F.col(f"{breakdown}.quality_label").alias("quality_label"),
        F.col(f"{breakdown}.strategy").alias("strategy"), F.array_join(rules, " ; ").alias("rules"),
        *[F.array_join(f"{breakdown}.{c}", " ; ").alias(c) for c in ("positives", "negatives")],
    ]


@query("x20_breakdown_json")
def _(spark, sf):
    """The whole breakdown, written as JSON and read back."""
    rows = scored(spark, sf).select("doc_id", F.to_json(scoring.breakdown()).alias("json"))
    rows = rows.select("doc_id", F.from_json("json", BREAKDOWN).alias("b"))
    return rows.select("doc_id", F.col("b.score").alias("score"), F.col("b.confidence").alias("confidence"), *_why("b"))


@query("p05_summary")
def _(spark, sf):
    df = scored(spark, sf).withColumn("score_breakdown", scoring.breakdown())
    up, down = scoring.summary()
    return df.select(
        "doc_id", F.array_join(up, " | ").alias("top_positives"), F.array_join(down, " | ").alias("top_negatives")
    )


@query("t00_best_postings")
def _(spark, sf):
    """The 50 best postings of the international region, with label and reasons."""
    kept = filters.accepted(worked(spark, sf)).where("region = 'INTERNATIONAL'")
    df = scoring.score(kept, AS_OF).withColumn("score_breakdown", scoring.breakdown())
    best = df.orderBy(F.desc("score"), F.asc("doc_id")).limit(50)
    return best.select(
        "doc_id", "title", "company_name", "country", "score", "confidence", "quality_label",
        F.array_join(scoring.summary()[0], " | ").alias("top_positives"),
    )


# ------------------------------------------------------------------- merge
_MERGED: dict = {}


def merged(spark: SparkSession, sf: str, upto: int):
    """Runs 1 to upto merged one after another; the last merge, its sightings and companies.

    Each run is merged once per session and folder: the rows it changed and its texts are
    written out, and later runs and queries read the tables that result.
    """
    key = (spark.sparkContext.applicationId, sf, upto)
    if key not in _MERGED:
        before = merged(spark, sf, upto - 1)[0].table if upto > 1 else None
        _MERGED[key] = runs.step(spark, sf, before, upto)
    return _MERGED[key]


_JOB_TEXT = ["title", "location", "country", "remote", "department", "description_text", "apply_url"]


def _state(df: DataFrame) -> DataFrame:
    return df.select(
        "fingerprint", "company_slug", "region", *_JOB_TEXT, ts_text("updated_at_source").alias("updated_at_source"),
        ts_text("posted_at").alias("posted_at"), "lifecycle", ts_text("closed_at").alias("closed_at"),
        F.col("heuristic_score").cast("int").alias("score"), F.col("heuristic_confidence").cast("int").alias("confidence"),
        ts_text("first_seen_at").alias("first_seen_at"), ts_text("last_seen_at").alias("last_seen_at"),
    )


for _run in runs.RUNS:
    QUERIES[f"m02_job_upsert_run{_run}"] = partial(
        lambda spark, sf, run: merged(spark, sf, run)[0].events.select(
            "fingerprint", "company_slug", "seq", "kind", "outcome", F.col("score").cast("int").alias("score")
        ),
        run=_run,
    )


@query("m03_field_merge")
def _(spark, sf):
    return _state(merged(spark, sf, 3)[0].jobs)


@query("m04_rescore_on_update")
def _(spark, sf):
    jobs = merged(spark, sf, 2)[0].slim
    return jobs.select(
        "fingerprint", F.col("heuristic_score").cast("int").alias("score"),
        F.col("heuristic_confidence").cast("int").alias("confidence"),
        F.col("score_breakdown.quality_label").alias("quality_label"),
    )


@query("m05_reactivate")
def _(spark, sf):
    """Jobs closed in run 2 and open again after run 3."""
    was = merged(spark, sf, 2)[0].slim.where("lifecycle = 'CLOSED'").select("fingerprint")
    now = merged(spark, sf, 3)[0].slim.where("lifecycle = 'ACTIVE'")
    return now.join(was, "fingerprint", "left_semi").select("fingerprint", "title", ts_text("closed_at").alias("closed_at"))


@query("m06_close_unseen")
def _(spark, sf):
    jobs = merged(spark, sf, 2)[0].slim
    return jobs.where("lifecycle = 'CLOSED'").select(
        "fingerprint", "company_slug", ts_text("closed_at").alias("closed_at")
    )


@query("m07_last_seen")
def _(spark, sf):
    jobs = merged(spark, sf, 3)[0].slim
    return jobs.groupBy(ts_text("last_seen_at").alias("last_seen_at")).agg(F.count("*").alias("n_jobs"))


@query("m08_failed_company")
def _(spark, sf):
    """Jobs of the company whose second run failed: as they were."""
    jobs = merged(spark, sf, 2)[0].slim.where("company_slug = 'asana'")
    return jobs.select("fingerprint", "lifecycle", ts_text("last_seen_at").alias("last_seen_at"))


@query("w02_ordered_sightings")
def _(spark, sf):
    """Keys with several sightings in run 1, by company order."""
    events = merged(spark, sf, 1)[0].events.where("kind = 'sighting'")
    return events.groupBy("fingerprint").agg(
        F.min("company_slug").alias("first_company"), F.max("company_slug").alias("last_company"),
        F.count("*").alias("n_sightings"),
    ).where("n_sightings > 1")


def _seen(spark, sf, run: int) -> DataFrame:
    return merge.with_fingerprint(runs.observations(spark, posts(spark, sf), run))


@query("j02_tombstone_anti")
def _(spark, sf):
    gone = runs.tombstones(posts(spark, sf))
    return merge.drop_tombstoned(_seen(spark, sf, 1), gone).groupBy("company_slug").agg(F.count("*").alias("n_kept"))


@query("j03_tombstoned")
def _(spark, sf):
    gone = runs.tombstones(posts(spark, sf))
    return merge.tombstoned(_seen(spark, sf, 1), gone).select("fingerprint", "company_slug")


@query("j04_unseen")
def _(spark, sf):
    jobs = merged(spark, sf, 2)[0].slim
    ok = runs.ran(spark, 3).where("status = 'ok'")
    return merge.unseen(jobs, _seen(spark, sf, 3), ok).select("fingerprint", "company_slug")


@query("j05_known_split")
def _(spark, sf):
    jobs = merged(spark, sf, 1)[0].slim
    needed, stubs = merge.known_split(_seen(spark, sf, 2), jobs)
    both = needed.withColumn("known", F.lit(False)).unionByName(stubs.withColumn("known", F.lit(True)))
    return both.groupBy("company_slug", "known").agg(F.count("*").alias("n_cards"))


@query("j09_rule_weights")
def _(spark, sf):
    """Triggered rules joined with the weight table, 1 where it has no row."""
    weights = [(r, n, float(m)) for r, table_ in lexicon.STRATEGIES.items() for n, m in table_.items()]
    dim = spark.createDataFrame(weights, "strategy string, name string, weight double")
    rules = scoring.explain_rules(scored(spark, sf), "doc_id", "strategy")
    rows = rules.join(F.broadcast(dim), ["strategy", "name"], "left")  # a few dozen fixed rows
    return rows.groupBy("strategy", "name").agg(
        F.first(F.coalesce("weight", F.lit(1.0))).alias("weight"), F.count("*").alias("n_rules")
    )


@query("w01_first_listing")
def _(spark, sf):
    """Of postings listed several times in a run, the first by company and place in the listing."""
    df = runs.observations(spark, posts(spark, sf), 1)
    first = ordered.first_per_key(df.select("external_id", "source", "company_slug", "seq", "title"), ["source", "external_id"], ["company_slug", "seq"])
    return first.select("source", "external_id", "company_slug", "title")


@query("a03_run_counters")
def _(spark, sf):
    return merge.run_counters(*merged(spark, sf, 3))


@query("a03_run_counters_failed")
def _(spark, sf):
    return merge.run_counters(*merged(spark, sf, 2))


@query("a04_run_totals")
def _(spark, sf):
    return merge.run_totals(merge.run_counters(*merged(spark, sf, 2)))


@query("a04_run_report")
def _(spark, sf):
    """Counters by company, source and run at once."""
    return merge.run_report(merge.run_counters(*merged(spark, sf, 2)))


@query("a05_source_tallies")
def _(spark, sf):
    return merge.source_tallies(merge.run_counters(*merged(spark, sf, 3)))


@query("m13_rescore_all")
def _(spark, sf):
    """Every job scored anew a month later, with all that is stored of why."""
    again = merge.rescored(merged(spark, sf, 3)[0].table, runs.companies(spark), "2024-03-03 12:00:00")
    return again.select(
        "fingerprint", F.col("heuristic_score").cast("int").alias("score"),
        F.col("heuristic_confidence").cast("int").alias("confidence"), *_why("score_breakdown"),
    )


@query("a09_rescore_summary")
def _(spark, sf):
    """Rescoring right after an insert changes only what a second company's sighting had scored."""
    table = merged(spark, sf, 1)[0].table
    return merge.rescore_summary(merge.rescored(table, runs.companies(spark), runs.clock_of(1)))


@query("m14_source_run")
def _(spark, sf):
    """The first run of the companies of one source only."""
    went = runs.ran(spark, 1).where("source = 'lever'")
    source = spread(posts(spark, sf))
    seen = runs.observations(spark, source, 1)
    result = merge.merge(JobTable.empty(spark), seen, went, runs.tombstones(source), runs.clock_of(1))
    return merge.run_counters(result, seen, went)


# ------------------------------------------------------------------- actions and serving
def user_actions(df: DataFrame) -> DataFrame:
    """A batch of actions derived from document numbers; some jobs get several."""
    key = keys.job_fingerprint(F.col("source"), F.col("external_id"), F.col("apply_url"))
    n = F.col("doc_id")

    def some(when: Column, action: str, arg: Column, minute: int) -> Column:
        ts = F.timestamp_seconds(F.lit(1706900000) + n + 60 * minute)
        what = F.struct(
            F.lit(action).alias("action"), arg.alias("arg"), ts.alias("ts"), F.lit(minute).cast("long").alias("seq")
        )
        return F.when(when, what)

    none = F.lit(None).cast("string")
    batch = F.array(
        some(n % 7 == 1, "status", F.lit("APPLIED"), 1),
        some(n % 14 == 1, "status", F.lit("NOT_APPLIED"), 2),
        some(n % 28 == 1, "status", F.lit("APPLIED"), 3),
        some(n % 7 == 2, "status", F.lit("REJECTED"), 1),
        some(n % 7 == 3, "status", F.lit("NO_SUCH_STATUS"), 1),
        some(n % 5 == 1, "favorite", none, 4),
        some(n % 10 == 1, "favorite", none, 5),
        some(n % 23 == 1, "archive", none, 6),
        some(n % 6 == 1, "notes", F.concat(F.lit("note "), "external_id"), 7),
        some(n % 12 == 1, "notes", F.lit(""), 8),
        some(n % 41 == 1, "delete", none, 9),
    )
    rows = df.select(key.alias("fingerprint"), F.explode_outer(batch).alias("a")).where("a IS NOT NULL")
    return rows.select("fingerprint", "a.*")


def served(spark, sf, texts: bool = False) -> DataFrame:
    """The job table after three runs and the user's actions; with its long columns where they are asked for."""
    result = merged(spark, sf, 3)[0]
    return acts.apply_actions(result.jobs if texts else result.slim, user_actions(posts(spark, sf)))


def _companies(spark) -> DataFrame:
    return payloads.companies(spark)


@query("m09_set_status")
def _(spark, sf):
    return served(spark, sf).select("fingerprint", "application_status", ts_text("applied_at").alias("applied_at"))


@query("m10_toggle_favorite")
def _(spark, sf):
    return served(spark, sf).select("fingerprint", "favorite")


@query("m11_archive_notes")
def _(spark, sf):
    return served(spark, sf).select("fingerprint", "lifecycle", "notes")


@query("m12_tombstone")
def _(spark, sf):
    jobs, todo = merged(spark, sf, 3)[0].slim, user_actions(posts(spark, sf))
    gone = acts.add_tombstones(runs.tombstones(posts(spark, sf)), jobs, todo)
    return gone.select("fingerprint", ts_text("deleted_at").alias("deleted_at"), "title", "source")


_LINE = ["fingerprint", "title", "company_slug", "source", "country"]


def _lines(df: DataFrame) -> DataFrame:
    return df.select(*_LINE, F.col("heuristic_score").cast("int").alias("score"))


@query("f08_search")
def _(spark, sf):
    return _lines(
        serving.search(
            served(spark, sf), region="INTERNATIONAL", lifecycles=["ACTIVE", "CLOSED"], statuses=["NOT_APPLIED"],
            sources=["greenhouse", "ashby", "lever"], countries=["USA", "Europe", "Remote"], min_score=20,
        )
    )


@query("f09_remote_favorites")
def _(spark, sf):
    return _lines(serving.search(served(spark, sf), remote_only=True, favorites_only=True))


@query("f11_text_search")
def _(spark, sf):
    return _lines(serving.search(served(spark, sf, texts=True), query="VISA Sp_nsor"))


@query("f12_filter_lists")
def _(spark, sf):
    wanted = serving.parse_list("ACTIVE, NOPE ,CLOSED", lexicon.LIFECYCLES)
    return served(spark, sf).where(F.col("lifecycle").isin(*wanted)).groupBy("lifecycle").agg(F.count("*").alias("n_jobs"))


@query("f13_constraints")
def _(spark, sf):
    """Violations in a job table whose rows were spoilt on purpose."""
    jobs = served(spark, sf).withColumns(
        {
            "title": F.when(F.col("notes").isNotNull(), F.repeat(F.lit("x"), 501)).otherwise(F.col("title")),
            "lifecycle": F.when(F.col("favorite"), "LOST").otherwise(F.col("lifecycle")),
            "company_slug": F.when(F.col("country") == "Europe", "nobody").otherwise(F.col("company_slug")),
        }
    )
    twice = jobs.unionByName(jobs.where("country = 'USA'"))
    return constraints.violations(twice, _companies(spark)).groupBy("check").agg(F.sum("n").alias("n_violations"))


@query("f13_other_tables")
def _(spark, sf):
    """Violations in companies, run log, tombstones and state derived from other tables and spoilt on purpose."""
    none, long = F.lit(None).cast("string"), lambda n: F.repeat(F.lit("x"), n)
    supplier, number = table(spark, sf, "supplier"), F.col("s_suppkey")

    def every(n: int, at: int, bad, good):
        return F.when(number % n == at, bad).otherwise(good)

    companies = supplier.select(
        every(11, 1, none, every(11, 2, long(121), F.col("s_name"))).alias("slug"),
        every(11, 3, none, every(11, 4, long(201), F.col("s_name"))).alias("name"),
        every(11, 5, none, every(11, 6, F.lit("nowhere"), F.lit("lever"))).alias("source"),
        every(11, 7, none, every(11, 8, F.repeat(F.lit("y"), 201), F.col("s_name"))).alias("external_id"),
        every(11, 9, long(501), none).alias("careers_url"),
        F.when(number % 11 != 10, True).alias("active"),
        every(13, 1, none, every(13, 2, F.lit("MARS"), F.lit("EGYPT"))).alias("target_region"),
    )
    logs = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.when(F.col("o_orderkey") % 17 != 3, F.col("o_orderdate")).alias("started_at"),
        F.when(F.col("o_orderpriority") == "5-LOW", "nowhere").when(F.col("o_orderkey") % 2 == 0, "bayt").alias("source"),
        F.when(F.col("o_orderkey") % 19 == 4, long(121)).otherwise("s").alias("company_slug"),
        F.when(F.col("o_orderkey") % 23 == 5, long(41)).when(F.col("o_orderstatus") != "P", "ok").alias("status"),
        F.when(F.col("o_orderkey") % 29 == 6, long(81)).alias("error_kind"),
    )
    part = table(spark, sf, "part")
    tombstones = part.select(
        F.when(F.col("p_partkey") % 31 == 7, long(65)).when(F.col("p_partkey") % 37 != 8, F.sha2("p_name", 256))
        .alias("fingerprint"),
        F.when(F.col("p_size") == 9, long(501)).otherwise(F.col("p_name")).alias("title"),
        F.when(F.col("p_size") == 10, long(41)).otherwise("lever").alias("source"),
    )
    state = table(spark, sf, "customer").select(
        F.when(F.col("c_custkey") % 41 == 1, long(81)).when(F.col("c_custkey") % 43 != 2, F.col("c_mktsegment"))
        .alias("key"),
        F.when(F.col("c_custkey") % 47 != 3, F.col("c_name")).alias("value"),
    )
    found = constraints.violations(served(spark, sf), companies, logs, tombstones, state)
    # here most jobs have no company; the query above counts those
    return found.where("check <> 'job without company'").groupBy("check").agg(F.sum("n").alias("n_violations"))


@query("f15_saved_views")
def _(spark, sf):
    """Every job under the views that show it, in one pass over the table."""
    return serving.views_of(served(spark, sf)).select("view", "fingerprint")


@query("t01_top_by_score")
def _(spark, sf):
    return _lines(serving.page(served(spark, sf), "score", 25))


@query("t02_newest")
def _(spark, sf):
    return _lines(serving.page(served(spark, sf), "newest", 25))


@query("t03_by_company")
def _(spark, sf):
    return _lines(serving.page(served(spark, sf), "company", 25))


@query("t04_page")
def _(spark, sf):
    return _lines(serving.page(served(spark, sf), "score", 20, offset=40))


@query("a01_count_by_status")
def _(spark, sf):
    return serving.count_by_status(served(spark, sf))


@query("a02_region_counts")
def _(spark, sf):
    return serving.region_counts(served(spark, sf))


@query("p03_serving_row")
def _(spark, sf):
    return serving.serving_row(served(spark, sf), _companies(spark))


def _exported(record: DataFrame) -> DataFrame:
    """Records as they come back from their JSON, whole, times as text."""
    rows = serving.as_json(record).select(F.from_json("json", record.schema).alias("r")).select("r.*")
    times_ = [f.name for f in record.schema.fields if f.dataType.typeName() == "timestamp"]
    return rows.withColumns({c: ts_text(c) for c in times_}).withColumns(
        {c: F.col(c).cast("int") for c in ("score", "confidence")}
    )


@query("k05_list_export")
def _(spark, sf):
    return _exported(serving.list_record(served(spark, sf), _companies(spark)))


@query("k06_detail_export")
def _(spark, sf):
    """All fields of the detail; of the breakdown the score (m13 and x20 have it whole)."""
    rows = _exported(serving.detail_record(served(spark, sf, texts=True), _companies(spark)))
    return rows.withColumn("score_breakdown", F.col("score_breakdown.score"))


@query("k07_company_export")
def _(spark, sf):
    """Companies with at least one job, as exported."""
    used = served(spark, sf).select(F.col("company_slug").alias("slug")).distinct()
    return serving.company_record(_companies(spark).join(used, "slug", "left_semi"))


@query("s14_active_companies")
def _(spark, sf):
    jobs = served(spark, sf).groupBy(F.col("company_slug").alias("slug")).agg(F.count("*").alias("n_jobs"))
    return serving.active_companies(_companies(spark), source="lever").join(jobs, "slug", "left").select("slug", "name", "n_jobs")


@query("s15_point_lookup")
def _(spark, sf):
    """The least key that a job of one board is stored under."""
    key = served(spark, sf).where("source = 'ashby'").agg(F.min("fingerprint")).first()[0]
    row = serving.with_company(serving.by_fingerprint(served(spark, sf), key), _companies(spark))
    return row.select("fingerprint", "title", "company")


def run_logs(spark, sf) -> DataFrame:
    """Log rows of all three runs."""
    parts = []
    for run in runs.RUNS:
        result, seen, went = merged(spark, sf, run)
        at = F.lit(runs.clock_of(run)).cast("timestamp")
        counted = merge.run_counters(result, seen, went)
        parts.append(counted.select(F.lit(str(run)).alias("run_id"), at.alias("started_at"), at.alias("finished_at"), "*"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("t05_recent_logs")
def _(spark, sf):
    rows = serving.recent_logs(run_logs(spark, sf), 20)
    return rows.select("run_id", "company_slug", "status", "jobs_seen", "jobs_new", "jobs_updated", "jobs_closed")


def _states(spark, sf) -> dict[str, DataFrame]:
    """State tables: the runs' last success as stored, none yet, and one that cannot be read."""
    last = serving.last_success(run_logs(spark, sf))
    stored = last.select(
        F.lit(lexicon.LAST_SUCCESS_KEY).alias("key"), F.date_format("last_success", "yyyy-MM-dd HH:mm:ss").alias("value"),
        F.col("last_success").alias("updated_at"),
    )
    return {
        "stored": stored, "absent": stored.withColumn("key", F.lit("another")),
        "unreadable": stored.withColumn("value", F.lit("soon")),
    }


@query("a10_last_success")
def _(spark, sf):
    """The stored time in each case of the state table."""
    parts = [
        serving.state_value(state).select(F.lit(case).alias("state"), ts_text("last_success").alias("last_success"))
        for case, state in _states(spark, sf).items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("x23_stale")
def _(spark, sf):
    """Whether a run is due: by time, by state, and never without active companies."""
    states, pool = _states(spark, sf), _companies(spark)
    cases = [("stored", pool, "2024-02-04 07:59:59"), ("stored", pool, "2024-02-04 08:00:00")]
    cases += [(state, pool, "2024-02-04 07:59:59") for state in ("absent", "unreadable")]
    cases += [("no company", pool.withColumn("active", F.lit(False)), "2024-02-04 08:00:00")]
    flags = [
        serving.is_stale(some, serving.state_value(states.get(case, states["stored"])), at).select(
            F.lit(case).alias("state"), F.lit(at).alias("as_of"), "stale"
        )
        for case, some, at in cases
    ]
    out = flags[0]
    for flag in flags[1:]:
        out = out.unionByName(flag)
    return out


@query("m01_company_upsert")
def _(spark, sf):
    """A seed over the stored companies: suppliers become companies, some known, some new."""
    rows = table(spark, sf, "supplier").select(
        F.concat(F.lit("s-"), "s_suppkey").alias("slug"), F.col("s_name").alias("name"), F.lit("lever").alias("source"),
        F.col("s_suppkey").cast("string").alias("external_id"), F.lit(None).cast("string").alias("careers_url"),
        F.lit(None).cast("map<string,string>").alias("config"), F.lit("EGYPT").alias("target_region"), "s_suppkey",
    )
    stored = rows.where("s_suppkey % 3 <> 0").withColumns(
        {"active": F.col("s_suppkey") % 2 == 0, "created_at": F.lit("2024-01-01").cast("timestamp")}
    )
    seed = rows.where("s_suppkey % 5 <> 0").withColumn("name", F.concat("name", F.lit(" Inc."))).withColumn("position", F.col("s_suppkey"))
    later = seed.where("s_suppkey % 4 = 0").withColumns({"name": F.concat("name", F.lit(" & Co.")), "position": F.col("position") + 1_000_000_000})
    out = merge.upsert_companies(stored.drop("s_suppkey"), later.unionByName(seed).drop("s_suppkey"), "2024-02-01")
    return out.select(
        "slug", "name", "source", "target_region", "active", F.size("config").alias("n_config"), ts_text("created_at").alias("created_at")
    )


@query("s12_seed")
def _(spark, sf):
    """Suppliers as a seed list: sources that no reader has are left out, regions are made known ones."""
    n = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(
        F.concat(F.lit("s-"), n).alias("slug"), F.col("s_name").alias("name"),
        F.when(n % 4 == 0, "carrier-pigeon").when(n % 4 == 1, "ashby").otherwise("lever").alias("source"),
        F.lit(None).cast("map<string,string>").alias("config"),
        F.when(n % 3 == 0, "EGYPT").when(n % 3 == 1, "MARS").alias("target_region"),
    )
    return landing.seed_rules(rows).select("slug", "name", "source", "target_region", "active", F.size("config").alias("n_config"))


@query("j06_active_keys")
def _(spark, sf):
    """The keys of a company's open jobs, for the company that has most jobs."""
    jobs = served(spark, sf)
    most = jobs.groupBy("company_slug").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "company_slug").first()[0]
    return serving.keys_of_company(jobs, most, active_only=True).select(F.lit(most).alias("company_slug"), "fingerprint")


@query("k07_log_export")
def _(spark, sf):
    """Every run's log lines as they are exported, with how a failed company failed."""
    rows = run_logs(spark, sf).withColumns({
        "error_message": F.when(F.col("status") == "failed", F.concat("source", F.lit(": nothing captured for "), "company_slug")),
        "error_kind": F.when(F.col("status") == "failed", "ScraperError"),
    })
    return serving.log_record(rows).withColumns({c: ts_text(c) for c in ("started_at", "finished_at")})


@query("f12_strict")
def _(spark, sf):
    """Jobs by a strict list of life cycles, and whether an unknown one is refused."""
    chosen = serving.parse_list("CLOSED, ARCHIVED", ["ACTIVE", "CLOSED", "ARCHIVED"], strict=True)
    try:
        serving.parse_list("CLOSED,LOST", ["ACTIVE", "CLOSED", "ARCHIVED"], strict=True)
        refused = False
    except ValueError:
        refused = True
    found = serving.search(served(spark, sf), lifecycles=chosen).groupBy("lifecycle").agg(F.count("*").alias("n_jobs"))
    return found.withColumn("refused", F.lit(refused))


# ------------------------------------------------------------------- sinks
def _stored(spark, sf) -> Store:
    """A store of its own with runs 1 and 2 committed, and a replay of run 2 that must do nothing."""
    store = Store(spark, f"{checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}")
    for run in (1, 2, 2):
        at = runs.clock_of(run)
        if store.is_committed(str(run), "all"):
            continue
        result, seen, went = merged(spark, sf, run)
        log = merge.run_counters(result, seen, went).select(
            F.lit(str(run)).alias("run_id"), times.clock(at).alias("started_at"), times.clock(at).alias("finished_at"), "*",
            F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("string").alias("error_kind"),
        )
        store.write_run_log(log, str(run), "all")
        store.commit_delta(result.delta, result.texts, str(run), "all", at)
        store.mark_success(at)
    return store


@query("k01_commit")
def _(spark, sf):
    """The table read back after two commits and a replay, with the number of its version."""
    store = _stored(spark, sf)
    return _state(store.jobs()).withColumn("version", F.lit(store.current()))


@query("s15_stored_lookup")
def _(spark, sf):
    """The job of the least key of every source, with its text, from the files that may hold it."""
    store = _stored(spark, sf)
    keys = store.table().state.groupBy("source").agg(F.min("fingerprint").alias("key"))  # a key for each of the sources
    return store.lookup([r["key"] for r in keys.collect()], ["fingerprint", "source", "title", "description_text", "lifecycle"])


@query("k02_run_log")
def _(spark, sf):
    """The log read back: a replay replaces its lines, a run that is not committed shows none."""
    store = _stored(spark, sf)
    log = staged(store.run_log())
    store.write_run_log(log.where("run_id = '2'"), "2", "all")
    store.write_run_log(log, "3", "all")
    return store.run_log().where("run_id = '2'").select(
        "run_id", "company_slug", "source", "status", "jobs_seen", "jobs_new", "jobs_updated", "jobs_closed"
    )


@query("k03_state")
def _(spark, sf):
    """The state after two successes: the last one counts."""
    return _stored(spark, sf).state().select("key", "value", ts_text("updated_at").alias("updated_at"))


# ------------------------------------------------------------------- sources
_ITEM = ["company_slug", "external_id", "title", "apply_url", "location", "country", "remote", "description_text"]


def _good(items: DataFrame, *more) -> DataFrame:
    return landing.good(items).select(*_ITEM, *more)


@query("s01_greenhouse")
def _(spark, sf):
    """Ids may be empty, and pages captured more than once."""
    items = boards.greenhouse(payloads.captured_twice(payloads.greenhouse(worked(spark, sf)), '{"jobs":[]}'))
    return _good(items, "department", ts_text("posted_at").alias("posted_at"))


@query("s02_lever")
def _(spark, sf):
    items = boards.lever(payloads.captured_twice(payloads.lever(worked(spark, sf)), "[]"))
    return _good(items, "employment_type", "team", ts_text("posted_at").alias("posted_at"))


@query("s03_ashby")
def _(spark, sf):
    return _good(boards.ashby(payloads.ashby(worked(spark, sf))), ts_text("posted_at").alias("posted_at"))


@query("s04_workday")
def _(spark, sf):
    return _good(boards.workday(payloads.workday(worked(spark, sf)), _companies(spark)), "employment_type")


def _fetched(spark, sf, board: str) -> cards.Fetched:
    pages = getattr(payloads, board)(worked(spark, sf))
    return cards.fetch(pages, _companies(spark), None, board)


@query("s05_linkedin")
def _(spark, sf):
    return _good(_fetched(spark, sf, "linkedin").items, ts_text("posted_at").alias("posted_at"))


@query("j05_hydrate")
def _(spark, sf):
    """Cards with their details, but for those of stored jobs."""
    pages = payloads.linkedin(worked(spark, sf))
    stored = cards.fetch(pages, _companies(spark), None, "linkedin").cards.where("external_id % 4 = 0")
    items = cards.fetch(pages, _companies(spark), stored.select("company_slug", "fingerprint"), "linkedin").items
    return _good(items, ts_text("posted_at").alias("posted_at"))


@query("s13_registry")
def _(spark, sf):
    """All eight boards through the registry: what each lists for each company.

    Pages are made as they are read: written out, all boards' pages would be the texts eight times.
    """
    df = staged(posts(spark, sf), "zstd")  # once, for eight boards and what each asks beforehand
    with_texts = payloads.dealt(df)  # boards whose listings hold the texts
    pages = None
    for board in registry.READERS:
        more = getattr(payloads, board)(with_texts if board in registry.STATELESS else df)
        pages = more if pages is None else pages.unionByName(more)
    seen = registry.read_observations(pages, _companies(spark))
    return seen.groupBy("source", "company_slug").agg(F.count("*").alias("n_items"))


@query("s07_wuzzuf")
def _(spark, sf):
    return _good(_fetched(spark, sf, "wuzzuf").items)


@query("s09_bayt")
def _(spark, sf):
    return _good(_fetched(spark, sf, "bayt").items)


@query("s11_wellfound")
def _(spark, sf):
    return _good(embedded.wellfound(payloads.wellfound(worked(spark, sf))))


@query("s16_rejects")
def _(spark, sf):
    df = worked(spark, sf)
    bad = [landing.rejects(read(getattr(payloads, name)(df))) for name, read in (
        ("greenhouse", boards.greenhouse), ("lever", boards.lever), ("ashby", boards.ashby))]
    out = bad[0].unionByName(bad[1]).unionByName(bad[2])
    return out.groupBy("source", "company_slug", "reject").agg(F.count("*").alias("n_items"))


@query("s17_bad_payload")
def _(spark, sf):
    """Boards of half the companies answer with something else than a listing."""
    pages = payloads.greenhouse(posts(spark, sf))
    odd = F.when(F.col("company_slug") > "local-shop", F.concat(F.lit("["), "payload", F.lit("]"))).otherwise(F.col("payload"))
    return landing.payload_errors(pages.withColumn("payload", odd))


@query("s17_wrong_list")
def _(spark, sf):
    """Where the list of postings is an object, a text or a number, the company has failed."""
    odd = F.when(F.length("company_slug") % 4 == 1, '{"jobs":{"error":"rate limited"}}').when(
        F.length("company_slug") % 4 == 2, '{"jobs":"none"}'
    ).when(F.length("company_slug") % 4 == 3, '{"jobs":7}')
    out = None
    for board in (payloads.greenhouse, payloads.ashby):
        pages = board(posts(spark, sf)).withColumn("payload", F.coalesce(odd, "payload"))
        bad = landing.payload_errors(pages)
        out = bad if out is None else out.unionByName(bad)
    return out


@query("s18_bad_config")
def _(spark, sf):
    used = posts(spark, sf).select(F.col("company_slug").alias("slug")).distinct()
    spoilt = _companies(spark).join(used, "slug", "left_semi").withColumn(
        "config", F.map_filter("config", lambda k, v: ~k.isin("keywords", "site"))
    )
    return landing.config_errors(spoilt)


@query("a11_fetch_tallies")
def _(spark, sf):
    got = _fetched(spark, sf, "linkedin")
    known = got.cards.where("external_id % 4 = 0").select("company_slug", "fingerprint")
    return cards.fetch_tallies(got.cards, known)


# ------------------------------------------------------------------- streams
def _landed_in_parts(spark, sf) -> tuple[str, list[DataFrame]]:
    """A landing folder, and what lands in it: half of the pages, the others, end markers, and markers again.

    Every page was captured before with nothing on it, and some are captured twice.
    """
    # grouping them into pages deals them to the cores
    pages = payloads.captured_twice(payloads.greenhouse(posts(spark, sf)), '{"jobs":[]}')
    nobody = F.lit(None).cast("string")
    marker = spark.range(1).select(
        F.lit("1").alias("run_id"), F.lit("greenhouse").alias("source"), nobody.alias("company_slug"),
        F.lit("end_of_run").alias("kind"), nobody.alias("ref"), F.lit(0).alias("page"),
        (F.lit(payloads.FETCHED_AT).cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias("fetched_at"), F.lit("").alias("payload"),
    )
    one = _companies(spark).limit(1).select("slug")
    of_one = marker.drop("company_slug").join(one.withColumnRenamed("slug", "company_slug")).select(*marker.columns)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/landing-{uuid.uuid4().hex}"
    first, other = pages.where("page % 2 = 0"), pages.where("page % 2 = 1")
    return folder, [first, other, of_one, marker, marker.unionByName(of_one)]


@query("r01_score_stream")
def _(spark, sf):
    """Pages of a landing folder scored as they come: the latest capture of each, twice stopped and started."""
    folder, parts = _landed_in_parts(spark, sf)
    out, ckpt = f"{folder}-scored", f"{folder}-ckpt"
    for part in (parts[0], parts[1], parts[3]):
        part.write.mode("append").option("compression", "gzip").json(folder)
        stream = landing.stream_landing(spark, folder)
        scores = incremental.score_stream(stream, _companies(spark), AS_OF, ["greenhouse"])
        incremental.write_scored(scores, out, ckpt).awaitTermination()
    return spark.read.parquet(out).drop("run_id")


@query("r02_merge_stream")
def _(spark, sf):
    """Runs merged when their markers come; stopped and started from the checkpoint, markers replayed."""
    folder, parts = _landed_in_parts(spark, sf)
    store = Store(spark, f"{folder}-store")
    store.write_companies(_companies(spark).withColumn("source", F.lit("greenhouse")))
    for part in parts:
        part.write.mode("append").option("compression", "gzip").json(folder)
        stream = landing.stream_landing(spark, folder)
        incremental.merge_stream(store, stream, lambda run: AS_OF, f"{folder}-ckpt").awaitTermination()
    jobs = store.table().slim()
    return jobs.select(
        "fingerprint", "company_slug", "title", "country", F.col("heuristic_score").cast("int").alias("score"),
        F.col("heuristic_confidence").cast("int").alias("confidence"),
        F.col("score_breakdown.quality_label").alias("quality_label"),
    )
