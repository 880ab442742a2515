"""The job store: a versioned job table, a run log, tombstones and state, all Parquet.

A version of the job table is a base and the deltas since: a commit writes the state rows
that have changed, and the texts they point to that are new, and becomes current when one
row that names it is appended to the version table.  Readers take each key's latest row.
After ``deltas`` of them the next commit writes a base.  A job that dies in between leaves
the old version current; readers never see half a table.  One writer at a time is assumed.

The state rows of a version are dealt to files by ranges of their keys, and a manifest holds
each file's first and last key, so a lookup opens one file per partition folder and version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from .. import lexicon
from ..operators.jobtable import STATE as JOB_STATE
from ..operators.jobtable import TEXTS, WIDE, JobTable
from ..schemas import COMPANY, JOB, RUN_LOG, STATE, TOMBSTONE
from ..session import large_side, staged

VERSIONS = "version long, run_id string, companies string, committed_at timestamp, base long"
PARTITIONS = ["region", "lifecycle"]
DELTAS = 8
MOST_KEYS = 1000  # of one lookup: they are literals of its filter
MANIFEST = "file string, first string, last string, v long"
_ROWS = T.StructType([*JOB_STATE.fields, T.StructField("deleted", T.BooleanType())])


class Store:
    """Tables under one folder of a shared file system."""

    def __init__(self, spark: SparkSession, path: str, deltas: int = DELTAS):
        self.spark, self.path, self.deltas = spark, path.rstrip("/"), deltas

    def _read(self, name: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:  # not written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    # ---- the job table
    def versions(self) -> DataFrame:
        return self._read("versions", VERSIONS)

    def current(self) -> int:
        """The current version, 0 before the first."""
        return self.versions().agg(F.max("version")).first()[0] or 0

    def _base(self, version: int) -> int:
        """The version that holds the whole table as it was then; later ones up to ``version`` are deltas."""
        return self.versions().where(F.col("version") == version).agg(F.max("base")).first()[0] or 0

    def table(self, version: int | None = None) -> JobTable:
        version = self.current() if version is None else version
        if version == 0:
            return JobTable.empty(self.spark)
        base = self._base(version)
        rows = self._read(f"jobs/v={base}", _ROWS)
        if version > base:
            deltas = self._read_versions("jobs", base + 1, version, _ROWS)
            last = deltas.groupBy("fingerprint").agg(F.max_by(F.struct(*_ROWS.names), "v").alias("row")).select("row.*")
            rows = rows.join(large_side(last.select("fingerprint")), "fingerprint", "left_anti").unionByName(last)
        state = rows.where(~F.coalesce("deleted", F.lit(False))).select(*JOB_STATE.names)
        return JobTable(state, self._texts(version))

    def _texts(self, version: int) -> DataFrame:
        return self._read_versions("texts", 1, version, TEXTS).select(*TEXTS.names)

    def _read_versions(self, name: str, first: int, last: int, schema: T.StructType) -> DataFrame:
        """The rows of committed versions, with their number ``v``; what a dead writer left is not among them."""
        rows = self._read(name, T.StructType([*schema.fields, T.StructField("v", T.LongType())]))
        return rows.where((F.col("v") >= first) & (F.col("v") <= last))

    def jobs(self, version: int | None = None) -> DataFrame:
        """The whole job table with its texts."""
        return self.table(version).jobs()

    def files_of(self, keys: Sequence[str], version: int | None = None) -> list[str]:
        """The files of state rows that may hold one of these keys, by the manifest."""
        version = self.current() if version is None else version
        if version == 0:
            return []
        base = self._base(version)
        rows = self._read("manifest", MANIFEST).where((F.col("v") >= base) & (F.col("v") <= version))
        wanted = F.array(*map(F.lit, keys)).cast("array<string>")
        held = rows.where(
            F.col("file").isNull() | F.exists(wanted, lambda k: (k >= F.col("first")) & (k <= F.col("last")))
        ).collect()  # at most a file per key, folder and version, and a row without a file per version
        if {r["v"] for r in held if r["file"] is None} != set(range(base, version + 1)):
            raise ValueError("versions without a manifest: commit a base first")
        return sorted(f"{self.path}/jobs/{r['file']}" for r in held if r["file"] is not None)

    def lookup(
        self, keys: str | Sequence[str], columns: Sequence[str] = tuple(JOB.names), version: int | None = None,
    ) -> DataFrame:
        """The jobs of few keys, read from the files that may hold them.

        A long column that is asked for costs a scan of the text table for at most three
        references a key, which its row group statistics prune.
        """
        keys = sorted({keys} if isinstance(keys, str) else {k for k in keys if k is not None})
        if len(keys) > MOST_KEYS:
            raise ValueError(f"more than {MOST_KEYS} keys: join the table instead")
        version = self.current() if version is None else version
        files = self.files_of(keys, version)
        schema = T.StructType([*_ROWS.fields, T.StructField("v", T.LongType())])
        if not files:
            return self.spark.createDataFrame([], JOB).select(*columns)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/jobs").parquet(*files)
        rows = rows.where(F.col("fingerprint").isin(keys))
        last = rows.groupBy("fingerprint").agg(F.max_by(F.struct(*_ROWS.names), "v").alias("row")).select("row.*")
        state = last.where(~F.coalesce("deleted", F.lit(False))).select(*JOB_STATE.names)
        asked = [p for c, p in WIDE.items() if c in columns]
        if not asked:
            return state.select(*columns)
        state = staged(state)
        refs = [r[0] for r in state.select(F.explode(F.array(*[f"{p}_ref" for p in asked]))).distinct().collect() if r[0]]
        return JobTable(state, self._texts(version).where(F.col("ref").isin(refs))).jobs(columns)

    def commit_delta(
        self, delta: DataFrame, texts: DataFrame | None, run_id: str, companies: str, at,
    ) -> int:
        """Make the rows of ``delta`` current: state rows, where ``deleted`` (if there) marks keys that go.

        ``texts`` are those the rows point to that the store does not have yet.
        """
        version = self.current() + 1
        base = self._base(version - 1) if version > 1 else 0
        if "deleted" not in delta.columns:
            delta = delta.withColumn("deleted", F.lit(False))
        if texts is not None:
            # ordered by reference, so that a reader who wants few finds them in few files
            texts = texts.sortWithinPartitions("ref").write.mode("overwrite").option("compression", "zstd")
            texts.parquet(f"{self.path}/texts/v={version}")
        if not base or version - base > self.deltas:
            went = large_side(delta.select("fingerprint"))
            kept = self.table(version - 1).state.join(went, "fingerprint", "left_anti")
            # written first, since ranges are found by a look at the rows
            delta = staged(kept.withColumn("deleted", F.lit(False)).unionByName(delta.where("NOT deleted").select(*_ROWS.names)))
            base = version
        rows = delta.select(*_ROWS.names).repartitionByRange(*PARTITIONS, "fingerprint")
        rows = rows.sortWithinPartitions(*PARTITIONS, "fingerprint")
        rows.write.mode("overwrite").partitionBy(*PARTITIONS).parquet(f"{self.path}/jobs/v={version}")
        self._write_manifest(version)
        row = self.spark.range(1).select(
            F.lit(version).cast("long").alias("version"), F.lit(run_id).alias("run_id"),
            F.lit(companies).alias("companies"), F.lit(at).cast("timestamp").alias("committed_at"),
            F.lit(base).cast("long").alias("base"),
        )
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
        return version

    def _write_manifest(self, version: int) -> None:
        """First and last key of each file of a version, from its key column; a row without a file ends the list."""
        file = F.regexp_extract("_metadata.file_path", rf"/jobs/(v={version}/.*)$", 1)
        rows = self._read(f"jobs/v={version}", _ROWS).groupBy(file.alias("file")).agg(
            F.min("fingerprint").alias("first"), F.max("fingerprint").alias("last")
        )
        end = self.spark.range(1).select(*[F.lit(None).cast("string").alias(c) for c in rows.columns])
        rows.unionByName(end).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={version}")

    def is_committed(self, run_id: str, companies: str) -> bool:
        """Whether a run of these companies is in the table already, so that a replay does nothing."""
        done = self.versions().where((F.col("run_id") == run_id) & (F.col("companies") == companies))
        return not done.isEmpty()

    # ---- run log: one folder per run and group of companies, so a replay replaces it
    def write_run_log(self, log: DataFrame, run_id: str, part: str) -> None:
        log.select(*RUN_LOG.names).write.mode("overwrite").parquet(f"{self.path}/run_log/run={run_id}/part={part}")

    def run_log(self) -> DataFrame:
        """Log lines of committed runs; the log is written just before the commit."""
        rows = self._read("run_log", T.StructType([*RUN_LOG.fields, *[T.StructField(c, T.StringType()) for c in ("run", "part")]]))
        done = self.versions().select(F.col("run_id").alias("run"), F.col("companies").alias("part")).distinct()
        return rows.join(done, ["run", "part"], "left_semi").select(*RUN_LOG.names)

    # ---- small tables, replaced as a whole under the next number
    def _replace(self, name: str, df: DataFrame) -> None:
        numbers = self._read(f"{name}/numbers", "n long").agg(F.max("n")).first()[0] or 0
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/n={numbers + 1}")
        number = self.spark.range(1).select(F.lit(numbers + 1).cast("long").alias("n"))
        number.coalesce(1).write.mode("append").parquet(f"{self.path}/{name}/numbers")

    def _latest(self, name: str, schema) -> DataFrame:
        n = self._read(f"{name}/numbers", "n long").agg(F.max("n")).first()[0]
        return self._read(f"{name}/n={n or 0}", schema)

    def tombstones(self) -> DataFrame:
        return self._latest("tombstones", TOMBSTONE)

    def write_tombstones(self, df: DataFrame) -> None:
        self._replace("tombstones", df.select(*TOMBSTONE.names))

    def companies(self) -> DataFrame:
        return self._latest("companies", COMPANY)

    def write_companies(self, df: DataFrame) -> None:
        self._replace("companies", df.select(*COMPANY.names))

    # ---- state
    def state(self) -> DataFrame:
        """The last value of each key."""
        rows = self._read("state", STATE)
        row = F.max_by(F.struct(*STATE.names), F.struct("updated_at", "value")).alias("row")
        return rows.groupBy("key").agg(row).select("row.*")

    def set_state(self, key: str, value: str, at) -> None:
        row = self.spark.range(1).select(
            F.lit(key).alias("key"), F.lit(value).alias("value"), F.lit(at).cast("timestamp").alias("updated_at")
        )
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/state")

    def mark_success(self, at: str) -> None:
        self.set_state(lexicon.LAST_SUCCESS_KEY, at, at)


def export_json(df: DataFrame, path: str) -> None:
    """Records as JSON lines, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
