"""The narrow job table: what is shuffled, what is written, and that reading puts it together again."""

import re
import subprocess
import sys

from pyspark.sql import functions as F
from test_merge import AS_OF, companies_df, fingerprints, frame, sighting

import check_oracles
from vacantia.operators import jobtable, merge
from vacantia.operators.jobtable import JobTable
from vacantia.schemas import JOB, OBSERVATION, TOMBSTONE
from vacantia.sinks.store import Store

LONG = re.compile("description_html|description_text|raw_payload")


def exchanged(df) -> list[str]:
    """The columns that go through each exchange of a plan."""
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"\) (?:Exchange|BroadcastExchange)[^\n]*\nInput \[\d+\]: \[([^\n]*)\]", plan)


def run(spark, table, seen, tombs=()):
    none = frame(spark, [{"fingerprint": f, "deleted_at": None, "title": None, "source": None} for f in tombs], TOMBSTONE)
    return merge.merge(table, frame(spark, seen, OBSERVATION), companies_df(spark, ["a"]), none, AS_OF)


def listed(n, **more):
    return [sighting("a", i, f"k{i}", text=f"Java text {i}", description_html="<p>", raw_payload="{}", **more) for i in range(n)]


def texts_of(df):
    return {r["external_id"]: (r["title"], r["description_text"], r["description_html"], r["raw_payload"]) for r in df.collect()}


def test_no_long_column_is_shuffled_and_only_new_texts_are_written(spark, monkeypatch):
    first = run(spark, JobTable.empty(spark), listed(6))
    moved, write = [], merge.staged

    def spy(df):
        moved.extend(exchanged(df))
        return write(df)

    monkeypatch.setattr(merge, "staged", spy)
    monkeypatch.setattr(jobtable, "staged", spy)
    again = listed(6)
    again[1]["description_text"] = "Another text"
    again[2].update(title="Backend Engineer", description_text=None, description_html=None)  # a stub with another title
    again[3]["title"] = "Senior Chef"  # rejected, but seen
    second = run(spark, first.table, again)
    assert len(moved) > 10 and not [columns for columns in moved if LONG.search(columns)]
    assert first.texts.count() == 6 and second.texts.count() == 1
    assert sorted(r["description_text"] for r in second.texts.collect()) == ["Another text"]
    jobs = texts_of(second.jobs)
    assert jobs["k1"] == ("Software Engineer", "Another text", "<p>", "{}")
    assert jobs["k2"] == ("Backend Engineer", "Java text 2", "<p>", "{}")
    assert jobs["k3"][1] == "Java text 3" and jobs["k0"][1] == "Java text 0"


def test_kept_features_score_as_fresh_ones(spark):
    table = run(spark, run(spark, JobTable.empty(spark), listed(5)).table, listed(3, department="X")).table
    companies = companies_df(spark, ["a"])
    kept = merge.rescored(table, companies, "2024-05-01 12:00:00")
    parsed = merge.rescore(table.jobs(), companies, "2024-05-01 12:00:00")
    pick = ["fingerprint", "heuristic_score", "heuristic_confidence", F.to_json("score_breakdown").alias("why"), "changed"]
    assert sorted(kept.select(*pick).collect()) == sorted(parsed.select(*pick).collect())
    stale = JobTable(table.state.withColumn("features", F.col("features").withField("version", F.lit(1).cast("long"))), table.texts)
    assert sorted(merge.rescored(stale, companies, "2024-05-01 12:00:00").select(*pick).collect()) == sorted(kept.select(*pick).collect())


def test_deltas_hold_what_changed_and_add_up(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), deltas=1)
    first = run(spark, JobTable.empty(spark), listed(8))
    store.commit_delta(first.delta, first.texts, "r1", "all", AS_OF)
    fp = fingerprints(spark, [f"k{i}" for i in range(8)])
    gone = store.table().state.where(F.col("fingerprint") == fp["k7"]).withColumn("deleted", F.lit(True))
    assert store.commit_delta(gone, None, "b1", "actions", AS_OF) == 2
    assert spark.read.parquet(f"{store.path}/jobs/v=2").count() == 1  # a delta of one row
    assert set(texts_of(store.jobs())) == {f"k{i}" for i in range(7)}
    second = run(spark, store.table(), listed(2), [fp["k7"]])  # six are no longer listed
    store.commit_delta(second.delta, second.texts, "r2", "all", AS_OF)
    assert spark.read.parquet(f"{store.path}/jobs/v=3").count() == 7  # a base again
    assert store.table().state.where("lifecycle = 'CLOSED'").count() == 5
    assert texts_of(store.jobs())["k5"] == ("Software Engineer", "Java text 5", "<p>", "{}")
    assert store.jobs().columns == JOB.names and set(texts_of(store.jobs(1))) == set(fp)


def test_a_lookup_opens_one_file_a_folder_and_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), deltas=2)
    assert store.lookup("none").count() == 0 and store.lookup("none").columns == JOB.names
    first = run(spark, JobTable.empty(spark), listed(60))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many files as many rows would make
    try:
        store.commit_delta(first.delta, first.texts, "r1", "all", AS_OF)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    fp = fingerprints(spark, [f"k{i}" for i in range(60)])
    all_files = store.table().state.inputFiles()
    assert len(all_files) > 3
    by_key = {k: store.files_of([f]) for k, f in fp.items()}
    assert {len(files) for files in by_key.values()} == {1} and len({f for files in by_key.values() for f in files}) == len(all_files)
    assert len(store.lookup(fp["k7"], ["fingerprint", "title"]).inputFiles()) == 1
    gone = store.table().state.where(F.col("fingerprint") == fp["k7"]).withColumn("deleted", F.lit(True))
    store.commit_delta(gone, None, "b1", "actions", AS_OF)
    store.commit_delta(gone.limit(0), None, "b2", "actions", AS_OF)  # a version without rows
    assert len(store.files_of([fp["k7"]])) == 2 and store.lookup(fp["k7"]).count() == 0
    assert store.lookup(fp["k7"], version=1).count() == 1
    want = store.jobs().where(F.col("fingerprint").isin(fp["k3"], fp["k5"])).select(*JOB.names)
    got = store.lookup([fp["k5"], fp["k3"], fp["k7"], "zz"])
    assert texts_of(got) == texts_of(want) and len(texts_of(got)) == 2
    assert got.select(*[c for c in JOB.names if c != "score_breakdown"]).exceptAll(
        want.select(*[c for c in JOB.names if c != "score_breakdown"])
    ).isEmpty()


def test_the_entry_works_without_the_training_data_operators(tmp_path):
    """Also where an empty folder is left of them."""
    (tmp_path / "__spark_entry__.py").symlink_to(check_oracles.ROOT / "__spark_entry__.py")
    (tmp_path / "vacantia").mkdir()
    for path in (check_oracles.ROOT / "vacantia").iterdir():
        if path.name != "llm":
            (tmp_path / "vacantia" / path.name).symlink_to(path)
    (tmp_path / "vacantia" / "llm").mkdir()
    code = "import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q.startswith('op') or q == 'pipeline'])"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[1] == "[]" and int(out.stdout.split()[0]) > 100


def test_texts_are_sifted_also_by_very_many_keys(spark):
    """More keys than a broadcast of whole keys may hold: texts that nobody asked for are still left out."""
    n = jobtable.BROADCAST_ROWS + 5
    keys = spark.range(n).select(F.concat(F.lit("t"), "id").alias("title"), F.col("id").cast("string").cast("binary").alias("pair"))
    asked = spark.range(n - 3, n + 4).select("id", F.concat(F.lit("t"), "id").alias("title"), F.col("id").cast("string").cast("binary").alias("pair"))
    got = jobtable.sifted(asked, keys, ["title", "pair"])
    assert sorted(r["id"] for r in got.collect()) == [n - 3, n - 2, n - 1]
