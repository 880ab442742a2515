"""Ingest and merge on streams of captured payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.filters import accepted
from ..operators.merge import of_companies, with_fingerprint
from ..operators.scoring import score
from ..plans.refresh import refresh
from ..schemas import LANDING
from ..session import small_side, staged
from ..sinks.store import Store
from ..sources.landing import NUMBER
from ..sources.registry import STATELESS, read_observations

APART, LATE = "6 hours", "10 minutes"
# state lies on disk; what RocksDB keeps in memory is bounded for an executor, not for each of its stores
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
}
#: Waiting pages are dealt to so many parts by run and company, so that a company's marker reads one of them;
#: end markers are a part of their own.
PARTS, MARKERS = 16, -1


def _state_on_disk(spark: SparkSession) -> None:
    """Payloads wait in the state: in the default store they would fill the executors' heap."""
    for key, value in _STATE.items():
        spark.conf.set(key, value)


def latest_captures(landing: DataFrame, apart: str = APART, late: str = LATE) -> DataFrame:
    """The latest capture of each page, once no later one is to be expected.

    Captures of a page less than ``apart`` from each other are one session; it is handed on
    when the watermark, ``late`` behind the latest time seen, has passed its end, and its
    state goes.  The end-of-run marker is what moves the watermark past the last pages.  A
    capture without a time cannot be placed and is left out.  Of equally late captures that of
    the greatest hash counts, as in batch, so the state holds each payload once.
    """
    _state_on_disk(landing.sparkSession)
    place = ["run_id", "company_slug", "ref", "page"]
    rows = landing.withWatermark("fetched_at", late)
    capture, latest = F.struct("source", "kind", "fetched_at", "payload"), F.struct("fetched_at", F.xxhash64("payload"))
    best = F.max_by(capture, latest).alias("best")
    # source and kind are read from the best row: a filter on grouping columns would be pushed
    # below the watermark and keep the markers from moving it
    what = [F.col("source").alias("of_source"), F.col("kind").alias("of_kind")]
    sessions = rows.groupBy(F.session_window("fetched_at", apart), *place, *what).agg(best)
    return sessions.select(*place, "best.*").select(*LANDING.names)


def score_stream(landing: DataFrame, companies: DataFrame, as_of: str, sources=STATELESS) -> DataFrame:
    """New payloads to accepted, scored postings: as in batch, the latest capture of a page counts.

    One static join with the companies.  Boards with detail pages need a whole run; see
    ``merge_stream``.
    """
    parts = []
    for source in sources:
        pages = landing
        if landing.isStreaming:
            mine = (F.col("source") == source) & (F.col("kind") == "listing")
            pages = latest_captures(landing.where(mine | (F.col("kind") == "end_of_run")))
        parts.append(read_observations(pages, companies, sources=[source]))
    seen = with_fingerprint(of_companies(reduce(DataFrame.unionByName, parts), companies))
    return score(accepted(seen), as_of)


def write_scored(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is there now and stop."""
    return (
        scored.select("run_id", "company_slug", "fingerprint", "title", "country", "score", "confidence", "quality_label")
        .writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def part_of(run_id: Column, slug: Column, parts: int = PARTS) -> Column:
    """The part of the waiting pages that a company's run lies in."""
    return F.pmod(F.xxhash64(run_id, slug), F.lit(parts)).cast("int")


def keep_waiting(batch: DataFrame, folder: str, batch_id: int) -> None:
    """Write what has landed, once, numbered and dealt to parts by run and company; end markers to a part of their own.

    A replayed batch replaces what it wrote before.
    """
    part = F.when(F.col("kind") == "end_of_run", MARKERS).otherwise(part_of(F.col("run_id"), F.col("company_slug")))
    number = F.struct(F.lit(batch_id).cast("long").alias("batch"), F.monotonically_increasing_id().alias("row"))
    rows = batch.where("kind IS NOT NULL").select(*LANDING.names, number.alias(NUMBER), part.alias("part"))
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(f"{folder}/batch={batch_id}")


def read_waiting(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """What has landed up to a batch."""
    number = T.StructType([T.StructField("batch", T.LongType()), T.StructField("row", T.LongType())])
    places = [T.StructField("batch", T.LongType()), T.StructField("part", T.IntegerType())]
    schema = T.StructType([*LANDING.fields, T.StructField(NUMBER, number), *places])
    return spark.read.schema(schema).parquet(folder).where(F.col("batch") <= batch_id)


def merge_batch(store: Store, as_of_by_run, folder: str, batch: DataFrame, batch_id: int) -> None:
    """Keep a batch's pages, and merge the runs that its markers end, with all that has landed of them.

    A marker names a company, or none for all active ones of the run.  What is in the log of
    the run already is left out, and a batch that was committed is not merged again, so
    replayed batches and repeated markers change nothing.
    """
    keep_waiting(batch, folder, batch_id)
    landed = read_waiting(store.spark, folder, batch_id)
    markers = staged(
        landed.where((F.col("part") == MARKERS) & (F.col("batch") == batch_id) & F.col("run_id").isNotNull())
        .select("run_id", "company_slug").distinct()
    )
    # one merge per finished run, all its marked companies together; run ids only reach the driver
    for (run_id,) in markers.select("run_id").distinct().orderBy("run_id").toLocalIterator():
        marked = markers.where(F.col("run_id") == run_id).select(F.col("company_slug").alias("slug"))
        chosen = store.companies().where("active")
        if marked.where("slug IS NULL").isEmpty():
            chosen = chosen.join(marked, "slug", "left_semi")
        logged = store.run_log().where(F.col("run_id") == run_id).select(F.col("company_slug").alias("slug"))
        chosen = staged(chosen.join(logged, "slug", "left_anti"))
        # the parts that hold them: at most as many as there are
        parts = [r[0] for r in chosen.select(part_of(F.lit(run_id), F.col("slug"))).distinct().collect()]
        if parts:
            pages = landed.where(F.col("part").isin(parts)).drop("batch", "part")
            own = pages.join(small_side(chosen.select(F.col("slug").alias("company_slug"))), "company_slug", "left_semi")
            refresh(store, own.select(*pages.columns), run_id, as_of_by_run(run_id), chosen, part=f"batch-{batch_id}")


def merge_stream(store: Store, landing: DataFrame, as_of_by_run, checkpoint: str) -> StreamingQuery:
    """Merge runs as they end; ``as_of_by_run`` gives a run's clock.

    What lands is read once, and waits for its marker in a table beside the checkpoint.
    """
    waiting = f"{checkpoint.rstrip('/')}-waiting"
    return (
        landing.writeStream
        .foreachBatch(lambda df, n: merge_batch(store, as_of_by_run, waiting, df, n))
        .outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
