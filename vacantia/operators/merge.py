"""A run's sightings merged into the job table.

Everything that happens to a key in a run is an event, in one fixed order: the
stored row, then company by company (by slug) its accepted sightings, and after
a company's sightings the closing of those of its jobs that it no longer lists.
The order replaces the arrival order of concurrent companies, so a key listed
twice ends up the same way in every run, and no two writers can collide.

Events are narrow: the long columns take part as content hashes and references
(``jobtable``), so neither HTML nor text nor payload is ever shuffled, and only keys that
a run touches are folded.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import job_fingerprint
from ..functions.times import clock
from ..schemas import JOB
from ..session import large_side, small_side, staged
from .filters import passes_for_region
from .jobtable import STATE, WIDE, JobTable, keys_and_refs, scoring_columns, sifted, with_features
from .ordered import HOT_ROWS, hot_keys, running
from .scoring import apply_rules, breakdown, score

# fixed values: which columns a later sighting may change (a null never does) ...
VOLATILE = [
    "title", "location", "country", "remote", "employment_type", "department", "team",
    "description_html", "description_text", "apply_url", "updated_at_source",
]
# ... and which are set by the first sighting only.
ON_INSERT = ["company_slug", "source", "external_id", "region", "posted_at", "raw_payload"]
USER_OWNED = ["application_status", "applied_at", "favorite", "notes"]
_STORED = USER_OWNED + ["lifecycle", "closed_at", "first_seen_at", "last_seen_at"]
_SCORED = ["heuristic_score", "heuristic_confidence", "score_breakdown"]
# The same without long columns: hashes are compared, references go along with them.
_KEYS = [f"{WIDE[c]}_key" if c in WIDE else c for c in VOLATILE]
_REFS = [f"{WIDE[c]}_ref" for c in VOLATILE if c in WIDE]
_FIXED = [c for c in ON_INSERT if c not in WIDE] + [f"{WIDE[c]}_{x}" for c in ON_INSERT if c in WIDE for x in ("key", "ref")]
_KNOWN = ["title", *[c for c in _KEYS if c.endswith("_key")], *_REFS, "features"]

_ORDER = ["slug", "phase", "seq"]
# Blocks of a hot key along that order: companies by range, a company, its rows by thousands.
_BLOCKS = ["slug_range", "slug", "phase", "seq_block"]
_SLUG_RANGE_CHARS, _SEQ_BLOCK_ROWS = 3, 10_000


@dataclass(frozen=True)
class Merged:
    """``table`` is the next job table, ``events`` what each sighting and closing did.

    ``delta`` are the state rows that the run has touched, ``texts`` the texts they point to
    that were not in the table before: what has to be written.  ``seen`` are the sightings of the
    companies whose run succeeded, those that the filter rejects without texts.
    """

    table: JobTable
    events: DataFrame
    delta: DataFrame
    texts: DataFrame
    seen: DataFrame

    @property
    def jobs(self) -> DataFrame:
        """The whole job table, its texts joined."""
        return self.table.jobs()

    @property
    def slim(self) -> DataFrame:
        """The job table without its long columns."""
        return self.table.slim()


def with_fingerprint(observations: DataFrame) -> DataFrame:
    return observations.withColumn(
        "fingerprint", job_fingerprint(F.col("source"), F.col("external_id"), F.col("apply_url"))
    )


def of_companies(observations: DataFrame, companies: DataFrame) -> DataFrame:
    """Sightings of the run's succeeded companies, with the company's name and region."""
    ok = companies.select(
        F.col("slug").alias("company_slug"), F.col("name").alias("company_name"),
        F.col("target_region").alias("region"),
    )
    return observations.join(small_side(ok), "company_slug")


def drop_tombstoned(df: DataFrame, tombstones: DataFrame) -> DataFrame:
    keys = tombstones.select("fingerprint").distinct()
    return df.join(small_side(keys), "fingerprint", "left_anti")


def tombstoned(df: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The rows whose key was deleted for good."""
    return df.join(large_side(tombstones.select("fingerprint").distinct()), "fingerprint", "left_semi")


def unseen(jobs: DataFrame, observations: DataFrame, companies: DataFrame) -> DataFrame:
    """Keys of stored jobs that their company, whose run succeeded, no longer lists.

    Everything a company listed counts as seen, also what the filter rejects; a
    company with an empty listing has seen nothing.
    """
    open_jobs = jobs.where("lifecycle <> 'ARCHIVED'").select("company_slug", "fingerprint")
    ok = companies.select(F.col("slug").alias("company_slug"))
    seen = observations.select("company_slug", "fingerprint").distinct()
    return open_jobs.join(small_side(ok), "company_slug", "left_semi").join(
        large_side(seen), ["company_slug", "fingerprint"], "left_anti"
    )


def known_flag(cards: DataFrame, jobs: DataFrame | None) -> DataFrame:
    """Cards with ``known``: whether the company has the job stored."""
    if jobs is None:
        return cards.withColumn("known", F.lit(False))
    keys = jobs.select("company_slug", "fingerprint").distinct().withColumn("known", F.lit(True))
    return cards.join(large_side(keys), ["company_slug", "fingerprint"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def known_split(cards: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cards whose details are still needed, and cards of stored jobs, which go on as stubs."""
    known = large_side(jobs.select("company_slug", "fingerprint"))
    on = ["company_slug", "fingerprint"]
    return cards.join(known, on, "left_anti"), cards.join(known, on, "left_semi")


def _origin(**given: Column) -> Column:
    """What the first event of a key fixes; types as in the state."""
    names = _FIXED + _STORED
    return F.struct(*[given.get(n, F.lit(None)).cast(STATE[n].dataType).alias(n) for n in names])


def _events(state: DataFrame, sightings: DataFrame, closings: DataFrame) -> DataFrame:
    new = _origin(**{c: F.col(c) for c in _FIXED})
    sighted = sightings.select(
        "fingerprint", F.lit("sighting").alias("kind"), F.col("company_slug").alias("slug"),
        F.lit(0).alias("phase"), "seq", "company_name", *_KEYS, *_REFS, new.alias("origin"),
    )
    closed = closings.select(
        "fingerprint", F.lit("close").alias("kind"), F.col("company_slug").alias("slug"),
        F.lit(1).alias("phase"), F.lit(0).cast("long").alias("seq"),
    )
    # stored rows that nothing happens to stay as they are
    touched = sighted.select("fingerprint").unionByName(closed.select("fingerprint")).distinct()
    base = state.join(large_side(touched), "fingerprint", "left_semi").select(
        "fingerprint", F.lit("base").alias("kind"), F.lit("").alias("slug"), F.lit(0).alias("phase"),
        F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("string").alias("company_name"),
        *_KEYS, *_REFS, _origin(**{c: F.col(c) for c in _FIXED + _STORED}).alias("origin"), *_SCORED,
        F.struct(*_KNOWN).alias("known"),
    )
    return base.unionByName(sighted, allowMissingColumns=True).unionByName(closed, allowMissingColumns=True)


def _after(events: DataFrame, blocks) -> DataFrame:
    """Per event: the row after it, what it was before, and the features kept for it, if any."""
    key = "fingerprint"
    marked = events.withColumn("happened", F.when(F.col("kind") != "base", F.col("kind")))
    run = running(marked, key, _ORDER, [*_KEYS, *_REFS, "happened"], ["origin", "kind", "known"], blocks)

    is_sighting = F.col("kind") == "sighting"
    is_new = is_sighting & (F.col("first_kind") == "sighting") & F.col("prior_happened").isNull()
    field_changed = reduce(or_, [F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"prior_{c}")) for c in _KEYS])
    stored = F.col("first_origin.lifecycle")
    before = (
        F.when(stored == "ARCHIVED", stored)
        .when(F.col("prior_happened") == "sighting", "ACTIVE")
        .when(F.col("prior_happened") == "close", "CLOSED")
        .otherwise(stored)
    )
    after = {c: F.coalesce(c, f"prior_{c}") for c in [*_KEYS, *_REFS]}
    run = run.select(
        key, *_ORDER, *[c for c in blocks if c not in _ORDER], "kind", "company_name",
        is_new.alias("is_new"), field_changed.alias("field_changed"), before.alias("lifecycle_before"),
        "first_origin", "first_known", *[F.col(c).alias(f"stored_{c}") for c in _SCORED],
        F.struct(*[v.alias(c) for c, v in after.items()]).alias("after"), is_sighting.alias("wanted"),
    )
    of_after = ("title", "text_key", "text_ref", "remote", "country")
    run = run.withColumns({c: F.when(is_sighting, F.col(f"after.{c}")) for c in of_after})
    run = run.withColumns({"region": F.col("first_origin.region"), "posted_at": F.col("first_origin.posted_at")})
    same = (F.col("title") == F.col("first_known.title")) & F.col("text_key").eqNullSafe(F.col("first_known.text_key"))
    return run.withColumn("features", F.when(is_sighting & same, F.col("first_known.features")))


def _fold(run: DataFrame, as_of, blocks) -> DataFrame:
    """Per event of ``_after`` with its features: its score, and what it did."""
    key, is_sighting = "fingerprint", F.col("kind") == "sighting"
    # stored rows and closings are not scored: with nothing to read, rules cost next to nothing
    scored = apply_rules(scoring_columns(run, is_sighting), as_of)
    scored = scored.withColumn("breakdown", F.when(is_sighting, breakdown()))
    scored = scored.withColumn(
        "known_score", F.when(is_sighting, F.col("score").cast("double")).otherwise(F.col("stored_heuristic_score"))
    )
    scored = scored.select(*run.columns, "breakdown", "confidence", "known_score")

    run = running(scored, key, _ORDER, ["known_score"], (), blocks)
    moved = is_sighting & ~F.col("known_score").eqNullSafe(F.col("prior_known_score"))
    revived = F.col("lifecycle_before") == "CLOSED"
    outcome = (
        F.when(F.col("is_new"), "new")
        .when(is_sighting & (F.col("field_changed") | F.col("score_moved") | revived), "updated")
        .when((F.col("kind") == "close") & (F.col("lifecycle_before") == "ACTIVE"), "closed")
        .otherwise("noop")
    )
    lifecycle_after = (
        F.when(F.col("lifecycle_before") == "ARCHIVED", "ARCHIVED")
        .when(is_sighting, "ACTIVE")
        .when(F.col("kind") == "close", "CLOSED")
        .otherwise(F.col("first_origin.lifecycle"))
    )
    run = run.withColumn("score_moved", moved).withColumns(
        {"outcome": outcome, "lifecycle_after": lifecycle_after}
    )
    return run.select(
        key, *_ORDER, "kind", "outcome", "lifecycle_after", "score_moved", "after", "first_origin", "first_known",
        "features",
        # a score is stored when it moves; the stored row brings its own
        F.when(is_sighting, F.col("known_score")).otherwise(F.col("stored_heuristic_score")).alias("heuristic_score"),
        F.when(is_sighting, F.col("confidence").cast("double"))
        .otherwise(F.col("stored_heuristic_confidence")).alias("heuristic_confidence"),
        F.coalesce("breakdown", "stored_score_breakdown").alias("score_breakdown"),
    )


def _next_rows(events: DataFrame, as_of) -> DataFrame:
    """The state rows of all keys that something happened to."""
    at = F.struct(*_ORDER)
    kept_score = F.when((F.col("kind") == "base") | F.col("score_moved"), at)
    rows = events.groupBy("fingerprint").agg(
        F.max_by("after", at).alias("after"),
        F.max_by("first_origin", at).alias("origin"),
        F.max_by("first_known", at).alias("known"),
        F.max_by("lifecycle_after", at).alias("lifecycle"),
        F.max_by(F.struct(*_SCORED), kept_score).alias("scored"),
        F.max_by("features", F.when(F.col("kind") == "sighting", at)).alias("features"),
        F.bool_or(F.col("outcome") == "closed").alias("closed_now"),
        F.bool_or(F.col("kind") == "sighting").alias("sighted"),
        F.bool_or(F.col("outcome") == "new").alias("is_new"),
    )
    now, o = clock(as_of), lambda c: F.col(f"origin.{c}")
    reopened = (o("lifecycle") == "CLOSED") | F.col("closed_now")
    closed_at = (
        F.when(F.col("lifecycle") == "CLOSED", F.when(F.col("closed_now"), now).otherwise(o("closed_at")))
        .when((F.col("lifecycle") == "ACTIVE") & reopened, None)
        .otherwise(o("closed_at"))
    )
    out = {c: F.col(f"after.{c}") for c in _KEYS}
    # what is as it was stays where it was
    for ref in _REFS:
        k = ref.replace("_ref", "_key")
        same = F.col(f"after.{k}") == F.col(f"known.{k}")
        out[ref] = F.when(same, F.col(f"known.{ref}")).otherwise(F.col(f"after.{ref}"))
    out |= {c: o(c) for c in _FIXED + USER_OWNED}
    out |= {c: F.col(f"scored.{c}") for c in _SCORED}
    out |= {
        "fingerprint": F.col("fingerprint"),
        "application_status": F.coalesce(o("application_status"), F.lit("NOT_APPLIED")),
        "favorite": F.coalesce(o("favorite"), F.lit(False)),
        "lifecycle": F.coalesce("lifecycle", F.lit("ACTIVE")),
        "closed_at": closed_at,
        "first_seen_at": F.when(F.col("is_new"), now).otherwise(o("first_seen_at")),
        "last_seen_at": F.when(F.col("sighted"), now).otherwise(o("last_seen_at")),
        "features": F.when(F.col("sighted"), F.col("features")).otherwise(F.col("known.features")),
    }
    return rows.select(*[out[f.name].alias(f.name) for f in STATE.fields])


def merge(
    jobs: DataFrame | JobTable, observations: DataFrame, companies: DataFrame, tombstones: DataFrame, as_of,
    hot_rows: int = HOT_ROWS,
) -> Merged:
    """Fold a run into the job table (or into whole jobs, which are taken apart first).

    ``companies`` are those whose run succeeded; others' sightings are ignored and
    their jobs stay as they are.  Sightings are written out once, accepted ones with their texts,
    where they lie; of all that follows only hashes, references and features are shuffled.
    """
    table = jobs if isinstance(jobs, JobTable) else JobTable.of(jobs)
    batch = uuid.uuid4().hex
    rows = passes_for_region(with_fingerprint(of_companies(observations, companies)))
    # one pass over the run: what the filter rejects counts as seen, but its texts are dropped here
    rows = rows.withColumns({c: F.when(F.col("passes"), F.col(c)) for c in WIDE}).withColumn(
        "ref", F.concat(F.lit(f"{batch}/"), F.monotonically_increasing_id().cast("string"))
    )
    seen = staged(rows.select("*", *keys_and_refs(F.col("ref"))), "zstd")
    sightings = seen.where("passes")

    closings = unseen(table.state, seen, companies)
    events = staged(_events(table.state, drop_tombstoned(sightings.drop(*WIDE), tombstones), closings))
    parts = [(events, ())]
    hot = hot_keys(events, "fingerprint", hot_rows)
    if not hot.isEmpty():
        blocked = events.withColumn("slug_range", F.substring("slug", 1, _SLUG_RANGE_CHARS)).withColumn(
            "seq_block", F.floor(F.col("seq") / _SEQ_BLOCK_ROWS)
        )
        parts = [
            (events.join(hot, "fingerprint", "left_anti"), ()), (blocked.join(hot, "fingerprint", "left_semi"), _BLOCKS)
        ]
    contents = table.texts.unionByName(sightings.select("ref", *WIDE))
    folded = None
    for part, blocks in parts:
        after = staged(_after(part, blocks))
        more = _fold(with_features(after, contents, sightings), as_of, blocks)
        folded = more if folded is None else folded.unionByName(more)
    folded = staged(folded)
    outcomes = folded.where("kind <> 'base'").select(
        "fingerprint", F.col("slug").alias("company_slug"), "seq", "kind", "outcome",
        F.col("heuristic_score").alias("score"),
    )
    delta = staged(_next_rows(folded, as_of))
    pointed = F.explode(F.array(*[f"{p}_ref" for p in WIDE.values()]))
    fresh = delta.select(pointed.alias("ref")).where(F.startswith("ref", F.lit(batch))).distinct()
    texts = staged(sifted(sightings.select("ref", *WIDE), fresh, ["ref"]), "zstd")
    return Merged(table.changed(delta, texts), outcomes, delta, texts, seen)


def run_counters(merged: Merged, observations: DataFrame, companies: DataFrame) -> DataFrame:
    """Seen, new, updated and closed per active company; failed companies count nothing.

    ``companies`` has a status column, ``ok`` or ``failed``.
    """
    did = merged.events.groupBy("company_slug").agg(
        *[F.count_if(F.col("outcome") == o).alias(f"jobs_{o}") for o in ("new", "updated", "closed")]
    )
    listed = observations.groupBy("company_slug").agg(F.count("*").alias("jobs_seen"))
    base = companies.select(F.col("slug").alias("company_slug"), "source", "status")
    joined = base.join(listed, "company_slug", "left").join(did, "company_slug", "left")
    ok = F.col("status") == "ok"
    counts = [
        F.when(ok, F.coalesce(c, F.lit(0))).otherwise(0).cast("int").alias(c)
        for c in ("jobs_seen", "jobs_new", "jobs_updated", "jobs_closed")
    ]
    return joined.select("company_slug", "source", "status", *counts)


def run_totals(counters: DataFrame) -> DataFrame:
    """Totals of a run over all its companies."""
    return counters.agg(
        F.count("*").alias("companies"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        *[F.sum(f"jobs_{c}").alias(c) for c in ("new", "updated", "closed")],
    )


def source_tallies(counters: DataFrame) -> DataFrame:
    return counters.groupBy("source").agg(
        *[F.sum(f"jobs_{c}").alias(c) for c in ("new", "updated", "closed")],
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def run_report(counters: DataFrame) -> DataFrame:
    """Counters of each company, of each source and of the whole run, from one aggregate.

    ``level`` is company, source or run; columns that a level does not go by are null there.
    Without companies there are no rows.
    """
    # a missing source or company is a group of its own, told from a subtotal by the grouping id
    grouped = counters.rollup("source", "company_slug").agg(
        F.grouping_id().alias("gid"),
        F.count("*").alias("companies"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        *[F.sum(f"jobs_{c}").alias(c) for c in ("seen", "new", "updated", "closed")],
    )
    level = F.when(F.col("gid") == 0, "company").when(F.col("gid") == 1, "source").otherwise("run")
    return grouped.withColumn("level", level).select(
        "level", "source", "company_slug", "companies", "failed", "seen", "new", "updated", "closed"
    )


def rescore(jobs: DataFrame, companies: DataFrame, as_of) -> DataFrame:
    """Every job scored anew; ``changed`` where score, confidence or breakdown differ.

    Unlike in a merge, the three move independently of each other.
    """
    names = companies.select(F.col("slug").alias("company_slug"), F.col("name").alias("company_name"))
    scored = score(jobs.join(small_side(names), "company_slug", "left"), as_of)
    return _with_changes(scored.withColumn("new_breakdown", breakdown()), JOB.names)


def _with_changes(fresh: DataFrame, columns) -> DataFrame:
    changed = ~(
        F.col("heuristic_score").eqNullSafe(F.col("score").cast("double"))
        & F.col("heuristic_confidence").eqNullSafe(F.col("confidence").cast("double"))
        & F.to_json("score_breakdown").eqNullSafe(F.to_json("new_breakdown"))
    )
    new = {
        "heuristic_score": F.col("score").cast("double"),
        "heuristic_confidence": F.col("confidence").cast("double"),
        "score_breakdown": F.col("new_breakdown"),
    }
    return fresh.withColumn("changed", changed).select(*[new.get(c, F.col(c)).alias(c) for c in columns], "changed")


def rescored(table: JobTable, companies: DataFrame, as_of) -> DataFrame:
    """The state rows of all jobs, scored anew from their kept features; ``changed`` as in ``rescore``."""
    names = companies.select(F.col("slug").alias("company_slug"), F.col("name").alias("company_name"))
    rows = table.state.withColumn("wanted", F.lit(True))
    rows = with_features(rows, table.texts).join(small_side(names), "company_slug", "left")
    scored = apply_rules(scoring_columns(rows, F.lit(True)), as_of).withColumn("new_breakdown", breakdown())
    return _with_changes(scored, STATE.names)


def rescore_summary(again: DataFrame) -> DataFrame:
    return again.agg(
        F.count("*").alias("scanned"),
        F.count_if("changed").alias("updated"),
        F.count_if(~F.col("changed")).alias("unchanged"),
    )


def upsert_companies(companies: DataFrame, seed: DataFrame, as_of=None) -> DataFrame:
    """Seeded companies replace stored ones by slug and become active; none is deleted.

    Of a slug that is seeded more than once the last by ``position`` wins (without that
    column, the greatest row).  A new company is created ``as_of``.
    """
    fields = ["name", "source", "external_id", "careers_url", "config", "target_region"]
    order = ["position"] if "position" in seed.columns else [f for f in fields if f != "config"]
    seed = seed.groupBy("slug").agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("row")).select("slug", "row.*")
    old, new = companies.alias("o"), seed.withColumn("seeded", F.lit(True)).alias("n")
    joined = old.join(new, "slug", "full_outer")
    seeded = F.col("n.seeded").isNotNull()
    config = F.coalesce(F.col("n.config"), F.create_map().cast("map<string,string>"))
    fresh = {c: F.col(f"n.{c}") for c in fields} | {"config": config}
    return joined.select(
        "slug",
        *[F.when(seeded, fresh[c]).otherwise(F.col(f"o.{c}")).alias(c) for c in fields],
        (seeded | F.col("o.active")).alias("active"),
        F.coalesce("o.created_at", F.lit(None).cast("timestamp") if as_of is None else clock(as_of)).alias("created_at"),
    )
