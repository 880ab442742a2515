"""User actions folded into the job table in bulk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicon
from ..schemas import TOMBSTONE
from ..session import large_side


def fold_actions(actions: DataFrame) -> DataFrame:
    """What a batch of actions comes to, one row per job.

    Only sums, firsts and lasts, so a job with very many actions is reduced before
    the shuffle.  Unknown statuses and actions are ignored.
    """
    at = F.struct("ts", "seq")
    is_ = lambda name: F.col("action") == name
    status = is_("status") & F.col("arg").isin(*lexicon.APPLICATION_STATUSES)
    return actions.groupBy("fingerprint").agg(
        F.max_by("arg", F.when(status, at)).alias("status"),
        F.min(F.when(status & (F.col("arg") == "APPLIED"), F.col("ts"))).alias("applied_first"),
        (F.count_if(is_("favorite")) % 2 == 1).alias("toggled"),
        F.bool_or(is_("archive")).alias("archived"),
        # in a struct, so that emptied notes differ from no notes action
        F.max_by(F.struct(F.nullif("arg", F.lit("")).alias("text")), F.when(is_("notes"), at)).alias("notes"),
        F.min(F.when(is_("delete"), F.col("ts"))).alias("deleted_at"),
    )


def apply_actions(jobs: DataFrame, actions: DataFrame) -> DataFrame:
    """The job table after status, favorite, archive and notes actions; deleted jobs are gone.

    The first APPLIED sets applied_at, nothing clears it.  ``jobs`` may be any columns of
    the table that include those that actions change.
    """
    done = fold_actions(actions)
    done = large_side(done.withColumnRenamed("notes", "new_notes"))
    return _acted(jobs.join(done, "fingerprint", "left"), jobs.columns).where("deleted_at IS NULL").drop("deleted_at")


def acted_rows(state: DataFrame, actions: DataFrame) -> DataFrame:
    """Only the rows that the actions are about, as they are after them; ``deleted`` marks those that go."""
    done = fold_actions(actions).withColumnRenamed("notes", "new_notes")
    rows = _acted(state.join(large_side(done), "fingerprint"), state.columns)
    return rows.withColumn("deleted", F.col("deleted_at").isNotNull()).drop("deleted_at")


def _acted(joined: DataFrame, columns: list[str]) -> DataFrame:
    new = {
        "application_status": F.coalesce("status", "application_status"),
        "applied_at": F.coalesce("applied_at", "applied_first"),
        "favorite": F.col("favorite") != F.coalesce("toggled", F.lit(False)),
        "lifecycle": F.when(F.col("archived"), "ARCHIVED").otherwise(F.col("lifecycle")),
        "notes": F.when(F.col("new_notes").isNotNull(), F.col("new_notes.text")).otherwise(F.col("notes")),
    }
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in columns], "deleted_at")


def add_tombstones(tombstones: DataFrame, jobs: DataFrame, actions: DataFrame) -> DataFrame:
    """Tombstones with those of jobs deleted by the actions; deleting twice is deleting once."""
    deletes = actions.where("action = 'delete'").groupBy("fingerprint").agg(F.min("ts").alias("deleted_at"))
    fresh = deletes.join(large_side(jobs.select("fingerprint", "title", "source")), "fingerprint")
    both = tombstones.select(*TOMBSTONE.names).unionByName(fresh.select(*TOMBSTONE.names))
    first = F.struct(F.coalesce("deleted_at", F.lit("9999-12-31").cast("timestamp")))
    row = both.groupBy("fingerprint").agg(F.min_by(F.struct(*TOMBSTONE.names), first).alias("row"))
    return row.select("row.*")
