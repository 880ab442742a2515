"""Session settings the engine relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A dimension is broadcast only up to this many rows (see ``small_side``).
BROADCAST_ROWS = 200_000


def local_session(cores: int | str = 8, app: str = "vacantia", memory: str = "8g") -> SparkSession:
    """Session for tests and the bench.  On a cluster pass your own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        # call sites of every column expression are not needed and slow to collect
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def pin_utc(spark: SparkSession) -> SparkSession:
    """Zone-less times are UTC everywhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def once_per_session(build):
    """Build large column trees once: they never change, and each node is a gateway call."""
    kept = {}

    @wraps(build)
    def get(*args):
        sc = SparkContext._active_spark_context
        key = (sc.applicationId if sc else None, *args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return get


def settled(column: Column) -> Column:
    """A column that filters above it cannot be pushed through.

    Pushing a filter below a projection copies the projected expressions into the
    filter.  For layers that read each other many times, as features and scores do,
    the copies multiply until planning itself runs out of memory.  Reading the
    partition number makes the projection non-deterministic for the optimizer and
    costs nothing.  Filter on plain columns before such a layer, not after it.
    """
    return F.when(F.spark_partition_id() >= 0, column)


def spread(df: DataFrame, *keys: str, min_bytes_per_task: int = 128 << 20) -> DataFrame:
    """Spread a small input over all cores before heavy work per row.

    One small file is one task, however many cores wait.  Inputs large enough to
    fill the cores by themselves are left alone, so nothing large is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    # what the scans read; sizes estimated above joins are far too large
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size >= cores * min_bytes_per_task:
        return df
    return df.repartition(cores, *keys)


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one where none is set on a local master."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(path)
    return path


def staged(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write a frame that several results read, once, and go on from the written table.

    It lies in the shared checkpoint folder, so a lost executor costs a re-read and
    no re-run.  Unlike an RDD checkpoint it is columnar: who needs two columns of
    it reads two columns.  With the codec zstd texts take two thirds of what the default takes.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/staged-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a dimension for broadcast when a bounded count shows that it is small.

    Beyond the bound the frame is returned as it is and Spark shuffles the join.
    """
    if df.limit(rows + 1).count() <= rows:
        return F.broadcast(df)
    return df


def large_side(df: DataFrame) -> DataFrame:
    """Mark a join's side that grows with the input: it is shuffled, however small it seems to be.

    Spark broadcasts what it takes for less than 10 MB.  In a chain of merges dozens of joins have
    such a side, and up to that bound all that they send to the driver grows with the input.
    """
    return df.hint("shuffle_merge")
