"""A run from captured payloads to the next job table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import clock
from ..operators import actions as acts
from ..operators import merge, serving
from ..schemas import OBSERVATION, RUN_LOG
from ..session import pin_utc, staged
from ..sinks.store import Store
from ..sources.landing import good, rejects, run_status
from ..sources.registry import no_items, read_items


@dataclass(frozen=True)
class Refreshed:
    """What a run did; ``ran`` is false when it was in the table already."""

    ran: bool
    version: int
    counters: DataFrame | None = None
    rejects: DataFrame | None = None


def refresh(
    store: Store, landing: DataFrame, run_id: str, as_of: str, companies: DataFrame | None = None, part: str = "all",
) -> Refreshed:
    """Merge one run into the store.

    ``companies`` (default: the active ones stored) may be those of one source or a
    single one; ``part`` names such a group.  A failed company changes no job and has
    its own line in the log; without any good company the run is no success.
    """
    pin_utc(store.spark)
    if store.is_committed(run_id, part):
        if not store.run_log().where((F.col("run_id") == run_id) & (F.col("status") == "ok")).isEmpty():
            store.mark_success(as_of)  # in case the first try died right after its commit
        return Refreshed(False, store.current())
    chosen = (store.companies() if companies is None else companies).where("active")
    landed = landing.where(F.col("run_id") == run_id)
    went = staged(run_status(chosen, landed))
    ok = went.where("status = 'ok'")

    table = store.table()
    pages = landed.join(ok.select(F.col("slug").alias("company_slug")), "company_slug", "left_semi")
    # the sources in play are at most the eight that exist
    sources = [r[0] for r in ok.select("source").distinct().orderBy("source").collect()]
    # read once, by the merge, which writes what it has seen; texts of items would be three times the pages
    items = read_items(pages.select(*landed.columns), ok, table.slim(), sources) if sources else no_items(store.spark)
    merged = merge.merge(table, good(items).select(*OBSERVATION.names), ok, store.tombstones(), as_of)
    counters = merge.run_counters(merged, merged.seen, went)
    notes = went.select(F.col("slug").alias("company_slug"), "error_message", "error_kind")
    log = counters.join(notes, "company_slug", "left").select(
        F.lit(run_id).alias("run_id"), clock(as_of).alias("started_at"), clock(as_of).alias("finished_at"), "source",
        "company_slug", "status", "jobs_seen", "jobs_new", "jobs_updated", "jobs_closed", "error_message", "error_kind",
    )
    store.write_run_log(log.select(*RUN_LOG.names), run_id, part)
    version = store.commit_delta(merged.delta, merged.texts, run_id, part, as_of)
    if not ok.isEmpty():
        store.mark_success(as_of)
    return Refreshed(True, version, counters, rejects(items))


def refresh_source(store: Store, landing: DataFrame, run_id: str, as_of: str, source: str) -> Refreshed:
    chosen = serving.active_companies(store.companies(), source=source)
    return refresh(store, landing, run_id, as_of, chosen, part=f"source-{source}")


def refresh_company(store: Store, landing: DataFrame, run_id: str, as_of: str, slug: str) -> Refreshed:
    chosen = serving.active_companies(store.companies(), slug=slug)
    return refresh(store, landing, run_id, as_of, chosen, part=f"company-{slug}")


def catch_up(store: Store, landing: DataFrame, run_id: str, as_of: str) -> Refreshed | None:
    """Run only when the last success is too old, or there was none; never without companies."""
    last = serving.state_value(store.state())
    due = serving.is_stale(store.companies(), last, as_of).first()[0]
    return refresh(store, landing, run_id, as_of) if due else None


def apply_user_actions(store: Store, actions: DataFrame, batch_id: str, as_of: str) -> int:
    """Fold a batch of actions into the store.  Tombstones first: a deleted job must not come back."""
    part = f"actions-{batch_id}"
    if store.is_committed(batch_id, part):
        return store.current()
    table = store.table()
    store.write_tombstones(acts.add_tombstones(store.tombstones(), table.slim(), actions))
    return store.commit_delta(staged(acts.acted_rows(table.state, actions)), None, batch_id, part, as_of)


def rescore_all(store: Store, as_of: str, batch_id: str) -> DataFrame:
    """Score the whole table anew, for new weights; returns scanned, updated and unchanged.

    Only rows whose score, confidence or reasons have changed are written.
    """
    again = staged(merge.rescored(store.table(), store.companies(), as_of))
    store.commit_delta(again.where("changed").drop("changed"), None, batch_id, "rescore", as_of)
    return merge.rescore_summary(again)


def seed_companies(store: Store, seed: DataFrame, as_of: str | None = None) -> None:
    store.write_companies(merge.upsert_companies(store.companies(), seed, as_of))
