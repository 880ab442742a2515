"""Captured payloads through readers, store, refresh and streams."""

import json

import pytest
from pyspark.sql import functions as F

from vacantia.plans import payloads, refresh
from vacantia.schemas import ACTION, LANDING
from vacantia.sinks.store import Store, export_json
from vacantia.sources import boards, cards, embedded, landing
from vacantia.streaming import incremental

T0, T1, T2 = "2024-02-01 12:00:00", "2024-02-02 12:00:00", "2024-02-03 12:00:00"
SEED = [
    {"slug": "acme", "name": "Acme", "source": "greenhouse", "external_id": "acme", "target_region": "INTERNATIONAL"},
    {"slug": "lev", "name": "Lev", "source": "lever", "external_id": "lev", "target_region": "MARS"},
    {"slug": "li", "name": "Search", "source": "linkedin", "external_id": "li", "target_region": "EGYPT",
     "config": {"keywords": "java", "location": "Egypt"}},
    {"slug": "bad", "name": "Bad", "source": "bayt", "external_id": "bad", "target_region": "EGYPT"},
    {"slug": "odd", "name": "Odd", "source": "no-such-board", "external_id": "odd"},
]


def gh(*jobs):
    return json.dumps({"jobs": [
        {"id": i, "title": t, "absolute_url": f"https://x/{i}", "location": {"name": "Remote - US"}, "content": c}
        for i, t, c in jobs
    ]})


def li(*cards_):
    return "<ul>" + "".join(
        f'<li><div class="base-card" data-entity-urn="urn:li:jobPosting:{i}"><h3 class="base-search-card__title">{t}</h3>'
        f'<span class="job-search-card__location">Cairo, Egypt</span></div></li>' for i, t in cards_
    ) + "</ul>"


def row(run, source, slug, kind, payload, ref=None, page=0):
    return {"run_id": run, "source": source, "company_slug": slug, "kind": kind, "ref": ref, "page": page,
            "fetched_at": "2024-02-01T00:00:00.000Z", "payload": payload}


def write(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in rows))


@pytest.fixture
def world(spark, tmp_path):
    seed = tmp_path / "seed.jsonl"
    write(seed, *SEED)
    store = Store(spark, str(tmp_path / "store"))
    refresh.seed_companies(store, landing.read_seed(spark, str(seed)))
    return store, tmp_path / "landing"


RUN1 = [
    row("r1", "greenhouse", "acme", "listing", gh((1, "Software Engineer", "&lt;p&gt;Java &amp;amp; APIs&lt;/p&gt;"),
                                                  (2, "Sales Lead", ""), (3, "Backend Engineer", ""))),
    row("r1", "lever", "lev", "listing", '{"not": "a list"}'),
    row("r1", "linkedin", "li", "listing", li((7, "Java Developer"), (7, "Java Developer"), (8, "Chef"))),
    row("r1", "linkedin", "li", "detail", '<div class="description__text"><div>Spring</div> Boot</div>', ref="7"),
]
RUN2 = [
    row("r2", "greenhouse", "acme", "listing", gh((1, "Software Engineer I", "x"))),
    row("r2", "lever", "lev", "listing", "[]"),
    row("r2", "linkedin", "li", "listing", li((7, "Java Developer"))),
    row("r2", "linkedin", "li", "detail", '<div class="description__text">Other</div>', ref="7"),
]


def jobs_of(store):
    return {r["external_id"]: r for r in store.jobs().collect()}


def test_seed_rules(world):
    store, _ = world
    got = {r["slug"]: r["target_region"] for r in store.companies().collect()}
    assert got == {"acme": "INTERNATIONAL", "lev": "INTERNATIONAL", "li": "EGYPT", "bad": "EGYPT"}


def test_shipped_seed(spark):
    from pathlib import Path

    import vacantia

    df = landing.read_seed(spark, str(Path(vacantia.__file__).parent / "data" / "companies.jsonl"))
    assert {r["target_region"]: r["count"] for r in df.groupBy("target_region").count().collect()} == {
        "INTERNATIONAL": 25, "EGYPT": 13,
    }
    assert landing.config_errors(df).count() == 0


def test_two_runs_then_actions(spark, world, tmp_path):
    store, folder = world
    write(folder / "1.json", *RUN1)
    write(folder / "2.json", *RUN2)
    landed = landing.read_landing(spark, str(folder))

    assert refresh.catch_up(store, landed, "r1", T0).ran
    assert refresh.catch_up(store, landed, "r1b", "2024-02-01 13:00:00") is None
    jobs = jobs_of(store)
    assert set(jobs) == {"1", "3", "7"}
    assert jobs["1"]["description_text"] == "Java & APIs" and jobs["1"]["country"] == "Remote"
    assert jobs["7"]["description_text"] == "Spring Boot" and jobs["7"]["country"] == "Egypt"
    log = {r["company_slug"]: r for r in store.run_log().collect()}
    assert {s: r["status"] for s, r in log.items()} == {"acme": "ok", "li": "ok", "lev": "failed", "bad": "failed"}
    assert log["lev"]["error_message"] == "lever: unexpected payload for lev"
    assert log["bad"]["error_message"] == "bayt: company bad missing keywords config"
    assert (log["acme"]["jobs_seen"], log["acme"]["jobs_new"]) == (3, 2)

    assert not refresh.refresh(store, landed, "r1", T1).ran  # a replay does nothing
    second = refresh.refresh(store, landed, "r2", T1)
    counted = {r["company_slug"]: r.asDict() for r in second.counters.collect()}
    jobs = jobs_of(store)
    assert jobs["3"]["lifecycle"] == "CLOSED" and counted["acme"]["jobs_closed"] == 1
    assert jobs["1"]["title"] == "Software Engineer I"
    # the known card passed as a stub: its text stays although a detail page was there
    assert jobs["7"]["description_text"] == "Spring Boot"
    assert counted["li"]["jobs_updated"] in (0, 1) and counted["lev"]["status"] == "ok"

    fp = {k: r["fingerprint"] for k, r in jobs.items()}
    at = F.lit(T2).cast("timestamp")
    todo = spark.createDataFrame(
        [(fp["1"], "status", "APPLIED", None, 1), (fp["7"], "delete", None, None, 2)], ACTION
    ).withColumn("ts", at)
    refresh.apply_user_actions(store, todo, "b1", T2)
    jobs = jobs_of(store)
    assert "7" not in jobs and jobs["1"]["application_status"] == "APPLIED"
    assert [r["fingerprint"] for r in store.tombstones().collect()] == [fp["7"]]
    refresh.refresh_source(store, landed.withColumn("run_id", F.lit("r3")), "r3", T2, "linkedin")
    assert "7" not in jobs_of(store)  # tombstoned keys never come back

    summary = refresh.rescore_all(store, T2, "w1").first()
    assert summary["scanned"] == 2
    export_json(store.jobs(), str(tmp_path / "export"))
    assert spark.read.json(str(tmp_path / "export")).count() == 2


def test_stream_merges_on_the_marker_only(spark, world, tmp_path):
    store, folder = world
    ckpt = str(tmp_path / "ckpt")
    clocks = {"r1": T0, "r2": T1}

    def pump():
        stream = landing.stream_landing(spark, str(folder))
        q = incremental.merge_stream(store, stream, clocks.__getitem__, ckpt)
        q.awaitTermination()
        assert q.exception() is None

    write(folder / "1.json", *RUN1)
    pump()
    assert store.current() == 0  # no marker, no merge, nothing closed
    write(folder / "2.json", row("r1", "greenhouse", "acme", "end_of_run", ""))
    pump()
    assert set(jobs_of(store)) == {"1", "3"}
    write(folder / "3.json", row("r1", None, None, "end_of_run", ""))
    pump()
    assert set(jobs_of(store)) == {"1", "3", "7"}
    version = store.current()
    write(folder / "4.json", row("r1", "greenhouse", "acme", "end_of_run", ""))
    pump()
    assert store.current() == version


def test_score_stream_equals_batch(spark, world, tmp_path):
    store, folder = world
    older = {**RUN1[0], "payload": gh((1, "Software Engineer", ""), (9, "Java Developer", "")), "fetched_at": "2024-01-31T23:00:00.000Z"}
    marker = {**row("r1", None, None, "end_of_run", ""), "fetched_at": "2024-02-02T00:00:00.000Z"}
    write(folder / "1.json", RUN1[0], older, RUN1[0])
    write(folder / "2.json", marker)
    out = str(tmp_path / "scored")
    companies = store.companies()
    stream = landing.stream_landing(spark, str(folder))
    q = incremental.write_scored(incremental.score_stream(stream, companies, T0), out, str(tmp_path / "c"))
    q.awaitTermination()
    assert q.exception() is None
    batch = incremental.score_stream(landing.read_landing(spark, str(folder)), companies, T0)
    assert {r["title"] for r in batch.collect()} == {"Software Engineer", "Backend Engineer"}
    cols = ["fingerprint", "title", "score", "confidence"]
    assert sorted(map(tuple, spark.read.parquet(out).select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))


# ------------------------------------------------------------------- readers
def land(spark, source, payload, kind="listing", ref=None):
    return spark.createDataFrame([("r", source, "c", kind, ref, 0, None, payload)], LANDING)


def test_a_bad_item_does_not_spoil_its_neighbours(spark):
    items = boards.greenhouse(land(spark, "greenhouse", json.dumps({"jobs": [
        {"title": "no id"}, {"id": 5, "title": "ok", "location": "not an object", "offices": [{"location": "Oslo"}]}, 17]})))
    ok = landing.good(items).collect()
    assert [(r["external_id"], r["location"], r["country"]) for r in ok] == [("5", None, "Oslo")]
    assert landing.rejects(items).count() == 2


def test_lever_text_and_remote(spark):
    r = landing.good(boards.lever(land(spark, "lever", json.dumps([{
        "id": "a", "text": " T ", "categories": {"location": "Paris", "allLocations": ["Remote, FR"]},
        "lists": [{"text": "Need", "content": "<li>Java</li>"}], "additional": "Bye", "createdAt": 1700000000500}])))).first()
    assert (r["title"], r["remote"]) == ("T", True)
    assert r["description_html"] == "<h3>Need</h3><li>Java</li>\nBye"
    assert r["description_text"] == "Need Java Bye"
    assert r["posted_at"].microsecond == 500000


def test_ashby_fallbacks(spark):
    items = boards.ashby(land(spark, "ashby", json.dumps({"jobs": [
        {"id": "", "jobId": "j", "title": "x", "locationName": "Rome", "secondaryLocations": ["Remote"]},
        {"externalId": "e", "title": "y", "secondaryLocations": [{"location": "Bonn"}], "address": {"postalAddress": {"addressCountry": "DE"}}},
        {"title": "none"}]})))
    got = [(r["external_id"], r["country"], r["remote"]) for r in landing.good(items).orderBy("seq").collect()]
    assert got == [("j", "Rome", True), ("e", "DE", False)]


def test_nested_detail_element(spark):
    page = '<section class="x job-description">a<section>b</section>c</section><section>d</section>'
    df = spark.createDataFrame([(page,)], "p string")
    html = '<DIV class="job-description"><div>one</div><div>two</div></DIV><div>three</div>'
    df2 = spark.createDataFrame([(html,), ("<p>none</p>",)], "p string")
    assert df.select(cards.wuzzuf_detail(F.col("p"))).first()[0] is None
    got = [r[0] for r in df2.select(cards.wuzzuf_detail(F.col("p"))).collect()]
    assert got[0].startswith("<DIV") and "two" in got[0] and "three" not in got[0] and got[1] is None


def test_wuzzuf_first_link_counts(spark):
    page = ('<a href="/jobs/p/1-x"><img></a><a href="/jobs/p/1-x">Late title</a>'
            '<a href="/jobs/p/2-y">Java Developer</a><a href="/jobs/companies/z">Zed</a><i>Giza</i>')
    got = cards.wuzzuf_cards(land(spark, "wuzzuf", page)).collect()
    assert [(r["external_id"], r["title"], r["card_company"], r["location"]) for r in got] == [("2-y", "Java Developer", "Zed", "Giza")]


def test_wellfound_any_depth(spark):
    deep = {"id": 9, "title": "T", "publicId": "p9", "locations": ["A", None, "Remote B"], "startupName": "S"}
    blob = {"title": "x", "k": [[{"a": {"b": [deep, {"id": 1, "title": "no slug"}]}}]]}
    page = f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(blob)}</script>'
    rows = embedded.wellfound(land(spark, "wellfound", page)).collect()
    assert [(r["external_id"], r["apply_url"], r["location"], r["remote"]) for r in rows] == [
        ("9", "https://wellfound.com/jobs/p9", "A, Remote B", True)]
    assert embedded.wellfound(land(spark, "wellfound", page.replace("}", "", 1))).count() == 0


def test_wellfound_pages_reach_python_in_small_batches(spark, capsys):
    """An Arrow batch would be 10,000 pages and all their objects at once."""
    embedded.wellfound(land(spark, "wellfound", "<html>")).explain()
    plan = capsys.readouterr().out
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_nothing_captured_is_a_failure(spark):
    got = landing.run_status(payloads.companies(spark), land(spark, "greenhouse", "{}").withColumn("company_slug", F.lit("stripe")))
    assert {r["slug"] for r in got.where("status = 'ok'").collect()} == {"stripe"}


def test_a_page_is_parsed_once_to_be_judged(spark):
    rows = [
        ("greenhouse", "a", '{"jobs":[]}'), ("greenhouse", "b", '{"jobs":{"x":1}}'), ("ashby", "c", '{"jobs":'),
        ("greenhouse", "d", None), ("workday", "e", '{"jobPostings":0,"jobs":7}'), ("lever", "f", "[]"), ("lever", "g", "{}"),
        ("ashby", "h", '{"jobs":"x"}'), ("linkedin", "i", "no json"), ("linkedin", "j", None), ("greenhouse", "k", '{"jobs":null}'),
    ]
    pages = spark.createDataFrame(rows, "source string, company_slug string, payload string").withColumn("kind", F.lit("listing"))
    bad = landing.payload_errors(pages.repartition(2))
    assert sorted(r.company_slug for r in bad.collect()) == ["b", "c", "d", "g", "h", "j"]
    plan = bad._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") + plan.lower().count("parse_json") == 1


# --------------------------------------------------------------- what is written
def written(spark):
    """Bytes in the checkpoint folder."""
    from pathlib import Path

    from vacantia.session import checkpoint_dir

    root = Path(checkpoint_dir(spark).removeprefix("file:"))
    return sum(f.stat().st_size for f in root.rglob("*") if f.is_file())


def test_the_latest_capture_is_found_without_writing_pages(spark):
    at = "2024-02-01 06:00:00"
    rows = [
        ("a", 1, at, "new"), ("a", 1, "2024-02-01 05:00:00", "old"), ("a", 1, at, "new"), ("a", 2, None, "no time"),
        ("a", 2, at, "x"), ("a", 2, at, "y"), ("a", None, None, None), ("b", 1, None, "only"),
    ]
    pages = spark.createDataFrame(rows, "company_slug string, page int, at string, payload string").select(
        F.lit("r").alias("run_id"), F.lit("lever").alias("source"), "company_slug", F.lit("listing").alias("kind"),
        F.lit(None).cast("string").alias("ref"), "page", F.col("at").cast("timestamp").alias("fetched_at"), "payload",
    )
    before = written(spark)
    got = {(r.company_slug, r.page): r.payload for r in landing.listings(pages.repartition(3), "lever").collect()}
    hashes = {r.payload: r.h for r in pages.select("payload", F.xxhash64("payload").alias("h")).collect()}
    assert got == {("a", 1): "new", ("a", 2): max("xy", key=hashes.get), ("a", None): None, ("b", 1): "only"}
    assert written(spark) == before


def test_all_boards_pages_are_not_written(spark):
    """Eight boards hold each text eight times; what is written holds it once."""
    from pathlib import Path

    from vacantia.plans.queries import QUERIES

    sf, before = "/root/testdata/sf0.01", written(spark)
    listed = QUERIES["s13_registry"](spark, sf)
    assert len(listed.collect()) == 88
    assert written(spark) - before < Path(f"{sf}/documents.parquet").stat().st_size * 1.5
    # four boards list the texts: one shuffle of them, read by all
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.index("Initial Plan")].count("ReusedExchange") >= 3


def test_waiting_captures_lie_on_disk_and_once(spark, world, tmp_path):
    """In the executors' heap, and once more as what decides between equally late ones, they would grow with the input."""
    import base64
    import random

    store, folder = world
    noise = lambda n: base64.b64encode(random.Random(n).randbytes(300_000)).decode()
    rows = [row("r1", "greenhouse", "acme", "listing", gh((n, "Software Engineer", noise(n))), page=n) for n in range(4)]
    tied = [row("r1", "greenhouse", "acme", "listing", gh((9, f"{w} Engineer", "")), page=9) for w in ("Software", "Backend", "Data")]
    write(folder / "1.json", *rows, *tied)
    marker = {**row("r1", None, None, "end_of_run", ""), "fetched_at": "2024-02-02T00:00:00.000Z"}
    out, ckpt = tmp_path / "scored", tmp_path / "c"

    def pump():
        stream = incremental.score_stream(landing.stream_landing(spark, str(folder)), store.companies(), T0, ["greenhouse"])
        incremental.write_scored(stream, str(out), str(ckpt)).awaitTermination()

    pump()
    state = [f for f in (ckpt / "state").rglob("*") if f.is_file()]
    assert any(f.suffix == ".sst" for f in state)
    assert 1_600_000 < sum(f.stat().st_size for f in state) < 2_400_000
    write(folder / "2.json", marker)
    pump()
    batch = incremental.score_stream(landing.read_landing(spark, str(folder)), store.companies(), T0, ["greenhouse"])
    streamed = spark.read.parquet(str(out))
    assert streamed.count() == 5
    assert sorted(r.title for r in streamed.collect()) == sorted(r.title for r in batch.collect())


def test_a_merged_stream_writes_pages_once(spark):
    """Waiting in a stream's state, numbered and taken apart, pages were written a dozen times."""
    from pathlib import Path

    from vacantia.plans.queries import QUERIES

    sf, before = "/root/testdata/sf0.01", written(spark)
    assert QUERIES["r02_merge_stream"](spark, sf).count() > 0
    assert written(spark) - before < Path(f"{sf}/documents.parquet").stat().st_size * 5


def test_waiting_pages_are_numbered_and_replayed(spark, world, tmp_path):
    store, _ = world
    folder = str(tmp_path / "waiting")
    at = lambda r, h: {**r, "fetched_at": f"2024-02-01T0{h}:00:00.000Z"}
    old, new = gh((1, "Software Engineer", "old")), gh((1, "Software Engineer", "new"))
    page = row("r1", "greenhouse", "acme", "listing", new)
    batches = [
        [at(page, 3), at(page, 3), at({**page, "payload": old}, 2), at({**page, "run_id": "r2", "payload": old}, 4)],
        [at({**page, "payload": old}, 1), row("r1", "linkedin", "li", "listing", li((7, "Java Developer")))],
        [row("r1", "greenhouse", "acme", "end_of_run", "")],
    ]
    frames = []
    for n, rows in enumerate(batches):
        write(tmp_path / "in" / f"{n}.json", *rows)
        frames.append(landing.read_landing(spark, str(tmp_path / "in" / f"{n}.json")).repartition(2))
    for n in (0, 1, 1):  # a replayed batch replaces its rows
        incremental.merge_batch(store, lambda run: T0, folder, frames[n], n)
    kept = incremental.read_waiting(spark, folder, 1)
    assert (kept.count(), kept.select("landed_row").distinct().count()) == (6, 6)
    assert incremental.read_waiting(spark, folder, 0).count() == 4
    latest = landing.listings(kept.drop("batch", "part"), "greenhouse").collect()
    assert {(r.run_id, r.payload) for r in latest} == {("r1", new), ("r2", old)} and len(latest) == 2
    assert store.current() == 0
    for _ in range(2):
        incremental.merge_batch(store, lambda run: T0, folder, frames[2], 2)
        assert {k: r["description_text"] for k, r in jobs_of(store).items()} == {"1": "new"}
        assert store.current() == 1


def test_items_of_a_run_are_not_written_apart(spark, world, tmp_path):
    """Its merge writes what it has seen, without the texts of what the filter rejects."""
    store, folder = world
    import random

    text = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz ", k=400_000))
    write(folder / "1.json", row("r1", "greenhouse", "acme", "listing", gh((1, "Sales Lead", text), (2, "Software Engineer", "x"))))
    before = written(spark)
    done = refresh.refresh(store, landing.read_landing(spark, str(folder)), "r1", T0)
    counted = {r.company_slug: (r.jobs_seen, r.jobs_new) for r in done.counters.collect()}
    assert counted["acme"] == (2, 1) and done.rejects.count() == 0
    assert written(spark) - before < len(text) / 2
