"""The merge against a serial simulation, hand-worked scenarios, and hot keys."""

from datetime import datetime
from random import Random

import pytest
from pyspark.sql import functions as F

from vacantia.operators import actions as acts
from vacantia.operators import constraints, merge, ordered, scoring
from vacantia.operators.jobtable import JobTable
from vacantia.schemas import ACTION, COMPANY, JOB, OBSERVATION, TOMBSTONE
from vacantia.session import staged

NOW, OLD = datetime(2024, 2, 2, 12), datetime(2024, 1, 1)
AS_OF = "2024-02-02 12:00:00"
SLUGS = ["a", "b", "c", "d", "e"]
FIELDS = merge.VOLATILE


def companies_df(spark, slugs):
    rows = [(s, f"Name {s}", "lever", s, None, {}, True, "INTERNATIONAL", None) for s in slugs]
    return spark.createDataFrame(rows, COMPANY)


def sighting(slug, seq, key, title="Software Engineer", text="Java", location="Remote", remote=True, **more):
    row = {n: None for n in OBSERVATION.names}
    row.update(run_id="r", company_slug=slug, seq=seq, source="lever", external_id=key, title=title, apply_url=f"u{key}",
               location=location, remote=remote, description_text=text, posted_at=OLD, **more)
    return row


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(r[n] for n in schema.names) for r in rows], schema)


def fingerprints(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    return dict(df.select("k", merge.job_fingerprint(F.lit("lever"), F.col("k"), F.lit(""))).collect())


def stored(fp, key, owner, lifecycle="ACTIVE", **more):
    row = {n: None for n in JOB.names}
    row.update(fingerprint=fp, company_slug=owner, source="lever", external_id=key, title="Software Engineer",
               location="Remote", country="Remote", remote=True, description_text="Java", apply_url=f"u{key}",
               region="INTERNATIONAL", posted_at=OLD, lifecycle=lifecycle, application_status="NOT_APPLIED",
               favorite=False, first_seen_at=OLD, last_seen_at=OLD, closed_at=OLD if lifecycle == "CLOSED" else None,
               heuristic_score=1.0, heuristic_confidence=2.0)
    row.update(more)
    return row


def passes(s):
    return s["title"].lower().startswith(("software engineer", "backend engineer"))


def simulate(jobs, seen, ok, tombs, fps, score_of):
    """One company after the other, one sighting after the other."""
    table = {j["fingerprint"]: dict(j) for j in jobs}
    did = []
    for slug in sorted(ok):
        mine = sorted((s for s in seen if s["company_slug"] == slug), key=lambda s: s["seq"])
        for s in mine:
            fp = fps[s["external_id"]]
            if not passes(s) or fp in tombs:
                continue
            new = {**{f: s[f] for f in FIELDS}, "country": "Remote"}
            job = table.get(fp)
            if job is None:
                job = table[fp] = stored(fp, s["external_id"], slug, **new)
                job.update(first_seen_at=NOW, last_seen_at=NOW, heuristic_score=score_of(job, slug)[0],
                           heuristic_confidence=score_of(job, slug)[1])
                did.append((fp, slug, s["seq"], "new"))
                continue
            changed = False
            for f in FIELDS:
                if new[f] is not None and new[f] != job[f]:
                    job[f], changed = new[f], True
            points, confidence = score_of(job, slug)
            if points != job["heuristic_score"]:
                job["heuristic_score"], job["heuristic_confidence"], changed = points, confidence, True
            if job["lifecycle"] == "CLOSED":
                job["lifecycle"], job["closed_at"], changed = "ACTIVE", None, True
            job["last_seen_at"] = NOW
            did.append((fp, slug, s["seq"], "updated" if changed else "noop"))
        listed = {fps[s["external_id"]] for s in mine}
        for fp, job in table.items():
            if job["company_slug"] == slug and job["lifecycle"] == "ACTIVE" and fp not in listed:
                job["lifecycle"], job["closed_at"] = "CLOSED", NOW
                did.append((fp, slug, 0, "closed"))
    return table, did


def scorer(spark, images):
    rows = [(i, t, d, s) for i, (t, d, s) in enumerate(images)]
    df = spark.createDataFrame(rows, "i int, title string, description_text string, slug string").select(
        "*", F.lit(True).alias("remote"), F.lit("Remote").alias("country"), F.lit("INTERNATIONAL").alias("region"),
        F.lit(OLD).alias("posted_at"), F.concat(F.lit("Name "), "slug").alias("company_name"))
    got = {r["i"]: (float(r["score"]), float(r["confidence"])) for r in scoring.score(df, AS_OF).collect()}
    table = {image: got[i] for i, image in enumerate(images)}
    return lambda job, slug: table[(job["title"], job["description_text"], slug)]


TITLES = ["Software Engineer", "Software Engineer I", "Backend Engineer", "Senior Chef"]
TEXTS = ["Java", "Visa sponsorship", "", None]


def check(spark, jobs, seen, ok, tomb_keys, keys, **options):
    fps = fingerprints(spark, keys)
    images = [(t, d, s) for t in TITLES for d in TEXTS for s in SLUGS]
    want, did = simulate(jobs, seen, ok, {fps[k] for k in tomb_keys}, fps, scorer(spark, images))
    tombs = frame(spark, [{"fingerprint": fps[k], "deleted_at": None, "title": None, "source": None} for k in tomb_keys], TOMBSTONE)
    out = merge.merge(frame(spark, jobs, JOB), frame(spark, seen, OBSERVATION), companies_df(spark, ok), tombs, AS_OF, **options)
    got = {r["fingerprint"]: r.asDict() for r in out.jobs.collect()}
    assert set(got) == set(want)
    names = [n for n in JOB.names if n not in ("score_breakdown", "raw_payload")]
    for fp, job in want.items():
        assert {n: got[fp][n] for n in names} == {n: job[n] for n in names}
        if got[fp]["score_breakdown"] is not None:
            assert got[fp]["score_breakdown"]["score"] == job["heuristic_score"]
    events = [(r["fingerprint"], r["company_slug"], r["seq"], r["outcome"]) for r in out.events.collect()
              if r["kind"] == "sighting" or r["outcome"] == "closed"]
    assert sorted(events) == sorted(did)


@pytest.mark.parametrize("seed,hot", [(1, None), (2, 2), (3, 2)])
def test_random_runs_equal_the_simulation(spark, monkeypatch, seed, hot):
    """With ``hot`` every key of more than two events goes through blocks of two rows."""
    monkeypatch.setattr(merge, "_SEQ_BLOCK_ROWS", 2)
    rng, keys = Random(seed), [f"k{i}" for i in range(24)]
    fps = fingerprints(spark, keys)
    ok = rng.sample(SLUGS, 4)
    jobs = [stored(fps[k], k, rng.choice(SLUGS), rng.choice(["ACTIVE", "ACTIVE", "CLOSED", "ARCHIVED"]),
                   title=rng.choice(TITLES[:3]), description_text=rng.choice(TEXTS), notes=rng.choice([None, "n"]))
            for k in keys[:14]]
    seen, n = [], 0
    for slug in SLUGS:
        for k in rng.choices(keys, k=14):
            n += 1
            seen.append(sighting(slug, n, k, rng.choice(TITLES), rng.choice(TEXTS), department=rng.choice([None, "X", "Y"])))
    check(spark, jobs, seen, ok, keys[12:13] + keys[20:22], keys, **({"hot_rows": hot} if hot else {}))


def test_scenarios(spark):
    """Owner b; a comes before, c after; d fails."""
    keys = [f"s{i}" for i in range(16)]
    fps = fingerprints(spark, keys)
    job = lambda i, **kw: stored(fps[f"s{i}"], f"s{i}", kw.pop("owner", "b"), **kw)
    jobs = [job(2), job(3, lifecycle="CLOSED"), job(4, owner="d"), job(5), job(6, lifecycle="ARCHIVED"), job(8), job(9, notes="N", favorite=True),
            job(10), job(11), job(14, owner="e")]
    seen = [sighting("b", 1, "s1"), sighting("b", 2, "s3"), sighting("b", 3, "s5", title="Senior Chef"), sighting("b", 4, "s7"),
            sighting("b", 5, "s8", text=None), sighting("b", 6, "s9", title="Backend Engineer"), sighting("c", 7, "s10"),
            sighting("a", 8, "s11"), sighting("b", 9, "s12"), sighting("b", 10, "s12", title="Backend Engineer"), sighting("d", 11, "s4")]
    check(spark, jobs, seen, ["a", "b", "c", "e"], ["s7"], keys)
    # and as written down by hand
    tombs = frame(spark, [{"fingerprint": fps["s7"], "deleted_at": None, "title": None, "source": None}], TOMBSTONE)
    out = merge.merge(frame(spark, jobs, JOB), frame(spark, seen, OBSERVATION), companies_df(spark, ["a", "b", "c", "e"]), tombs, AS_OF)
    got = {r["external_id"]: r for r in out.jobs.collect()}
    life = {k: r["lifecycle"] for k, r in got.items()}
    assert life == {"s1": "ACTIVE", "s2": "CLOSED", "s3": "ACTIVE", "s4": "ACTIVE", "s5": "ACTIVE", "s6": "ARCHIVED", "s8": "ACTIVE",
                    "s9": "ACTIVE", "s10": "ACTIVE", "s11": "CLOSED", "s12": "ACTIVE", "s14": "CLOSED"}
    assert got["s2"]["closed_at"] == NOW and got["s3"]["closed_at"] is None and got["s4"]["last_seen_at"] == OLD
    assert got["s8"]["description_text"] == "Java" and got["s8"]["last_seen_at"] == NOW
    assert (got["s9"]["title"], got["s9"]["notes"], got["s9"]["favorite"]) == ("Backend Engineer", "N", True)
    assert got["s12"]["title"] == "Backend Engineer"
    again = merge.merge(out.jobs, frame(spark, seen, OBSERVATION), companies_df(spark, ["a", "b", "c", "e"]), tombs, AS_OF)
    assert again.events.where("outcome = 'new'").count() == 0


def test_running_blocks_equal_plain(spark):
    df = spark.range(400).select(
        (F.col("id") % 3).cast("string").alias("k"), F.col("id").alias("n"),
        F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"), F.floor(F.col("id") / 50).alias("b1"), F.floor(F.col("id") / 5).alias("b2"))
    plain = ordered.running(df, "k", ["n"], ["v"], ["n"])
    cut = ordered.running(df, "k", ["n"], ["v"], ["n"], ["b1", "b2"])
    pick = ["k", "n", "prior_v", "first_n"]
    assert sorted(map(tuple, plain.select(pick).collect()), key=repr) == sorted(map(tuple, cut.select(pick).collect()), key=repr)


def test_actions(spark):
    jobs = frame(spark, [stored("f1", "1", "b"), stored("f2", "2", "b"), stored("f3", "3", "b", notes="old")], JOB)
    t = [datetime(2024, 2, d) for d in range(1, 9)]
    todo = spark.createDataFrame(
        [("f1", "status", "APPLIED", t[0], 1), ("f1", "status", "NOT_APPLIED", t[1], 2), ("f1", "status", "APPLIED", t[2], 3),
         ("f1", "favorite", None, t[0], 4), ("f1", "status", "BOGUS", t[7], 5), ("f2", "delete", None, t[3], 6),
         ("f2", "delete", None, t[4], 7), ("f3", "notes", "", t[0], 8), ("f3", "archive", None, t[0], 9),
         ("f3", "favorite", None, t[0], 10), ("f3", "favorite", None, t[0], 11), ("zz", "delete", None, t[0], 12)], ACTION)
    got = {r["fingerprint"]: r for r in acts.apply_actions(jobs, todo).collect()}
    assert set(got) == {"f1", "f3"}
    assert (got["f1"]["application_status"], got["f1"]["applied_at"], got["f1"]["favorite"]) == ("APPLIED", t[0], True)
    assert (got["f3"]["notes"], got["f3"]["lifecycle"], got["f3"]["favorite"]) == (None, "ARCHIVED", False)
    gone = acts.add_tombstones(spark.createDataFrame([], TOMBSTONE), jobs, todo).collect()
    assert [(r["fingerprint"], r["deleted_at"], r["title"]) for r in gone] == [("f2", t[3], "Software Engineer")]


def test_constraints(spark):
    good = frame(spark, [stored("f1", "1", "b")], JOB)
    co = companies_df(spark, SLUGS)
    assert constraints.violations(good, co).isEmpty()
    bad = frame(spark, [stored("f1", "1", "b"), stored("f1", "1", "nobody", title=None, region="MARS")], JOB)
    found = {r["check"] for r in constraints.violations(bad, co.unionByName(co.where("slug = 'a'"))).collect()}
    assert found == {"duplicate fingerprint", "job without company", "title is null", "region not in domain",
                     "duplicate slug", "duplicate source and id"}


def test_constraints_of_all_tables(spark):
    t = datetime(2024, 1, 1)
    jobs, co = frame(spark, [stored("f1", "1", "b")], JOB), companies_df(spark, SLUGS)
    logs = spark.createDataFrame([("r", t, "lever", "ok"), ("r", None, "nowhere", "o" * 41)], "run_id string, started_at timestamp, source string, status string")
    logs = logs.selectExpr("*", "cast(null as string) AS company_slug", "cast(null as string) AS error_kind")
    gone = spark.createDataFrame([("f", "t", "s"), ("f", "t", "s"), ("f", "t", "s"), (None, None, None), (None, None, None)], "fingerprint string, title string, source string")
    state = spark.createDataFrame([("k", "v"), ("k" * 81, None)], "key string, value string")
    found = {(r["check"], r["n"]) for r in constraints.violations(jobs, co, logs, gone, state).collect()}
    assert found == {("log started_at is null", 1), ("log source not in domain", 1), ("log status longer than 40", 1),
                     ("duplicate tombstone", 2), ("tombstone fingerprint is null", 2), ("state key longer than 80", 1),
                     ("state value is null", 1)}
    assert constraints.violations(jobs, co, logs.limit(0), gone.limit(0), state.limit(0)).isEmpty()


def test_sides_that_grow_are_not_broadcast(spark):
    """Tables this small would be broadcast, and so would larger ones, a join after another, up to 10 MB each."""
    jobs = frame(spark, [stored(f"f{i}", str(i), "a") for i in range(3)], JOB)
    table = JobTable.of(jobs)
    seen = jobs.select("company_slug", "fingerprint").limit(2)
    actions = frame(spark, [dict(fingerprint="f1", action="favorite", arg=None, ts=OLD, seq=1)], ACTION)
    delta = staged(table.state.where("fingerprint <> 'f0'"))
    listed = companies_df(spark, ["a"]).repartition(2)
    for df, n in (
        (table.changed(delta).state, 3), (acts.apply_actions(jobs, actions), 3), (acts.acted_rows(table.state, actions), 1),
        (merge.known_flag(seen, jobs), 2), (merge.unseen(table.state, seen, listed), 1),
    ):
        assert df.count() == n
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "fingerprint" in x]
