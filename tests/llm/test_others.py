"""Hosts, archives, the clause grammar, vector cells, components and the pipeline."""

import gzip
import hashlib
import io
import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from vacantia.llm import host_reputation, toxic_grammar, vector_cells, warc
from vacantia.llm.components import components
from vacantia.llm.files import opened
from vacantia.llm.host_reputation import Rule
from vacantia.llm.toxic_grammar import DIRECTED, INSULT, NEGATION, OTHER, REPORT, TARGET, grammar


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, host string, n long")


def test_hosts_lean_on_their_domain(spark):
    rows = [(i, f"http://a{i % 5}.bad.net/x", "") for i in range(50)] + [(100 + i, f"https://b{i % 5}.good.net/", "") for i in range(50)]
    rows += [(200, "http://new.bad.net", ""), (201, "HTTP://NEW.good.net?q", ""), (202, None, ""), (203, "no scheme", "")]
    labels = spark.createDataFrame([(i, 1) for i in range(50)] + [(100 + i, 0) for i in range(50)] + [(7, None), (None, 1)], "page_id long, bad int")
    counts = host_reputation.outcomes(pages(spark, rows), labels)
    hosts = host_reputation.reputation(counts)
    got = {r.page_id: r for r in host_reputation.judge(pages(spark, rows), hosts, []).collect()}
    assert got[0].verdict == "block" and got[200].verdict == "block" and got[201].verdict == "allow"
    assert (got[201].host, got[201].path, got[202].host, got[203].path) == ("new.good.net", "", "", "")
    none = host_reputation.reputation(host_reputation.outcomes(pages(spark, rows), labels.limit(0)))
    assert {r.verdict for r in host_reputation.judge(pages(spark, rows), none, []).collect()} == {"allow"}
    assert host_reputation.judge(pages(spark, rows).limit(0), hosts, []).count() == 0


def test_longest_rule(spark):
    rules = [Rule("org", "/", "allow"), Rule("a.org", "/x", "block"), Rule("com", "/", "block")]
    rows = [(1, "http://a.org/xy", ""), (2, "http://b.a.org/y", ""), (3, "http://ba.org/x", ""), (4, "http://acom/", ""), (5, "http://org", "")]
    hosts = spark.createDataFrame([], "host string, bad_rate double, bad_bound double")
    got = {r.page_id: (r.rule, r.verdict) for r in host_reputation.judge(pages(spark, rows), hosts, rules).collect()}
    assert got == {1: ("a.org/x", "block"), 2: ("org/", "allow"), 3: ("org/", "allow"), 4: (None, "allow"), 5: (None, "allow")}


def test_archives(spark):
    big = "é" * 600
    rows = [(1, "http://a/\r\nb", big), (2, None, big), (3, "u", None), (4, "u", "short"), (5, "v", "short"), (7, "w", big)]
    rows += [(None, "w", big), (8, "y", "<p>\r\n\r\nWARC/1.1\r\n" * 90), (9, "z", "0" * 900_000), (9, "z", "0" * 900_000)]
    written = warc.write_stream(warc.described(pages(spark, rows)))
    done = warc.normalise(written)
    got = warc.read(spark, done).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.page_id, []).append(r)
    for i, _, html in rows:
        payload = (html or "").encode()
        for r in by_id[i]:
            assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
            assert r.payload is None or bytes(r.payload) == payload
    assert [(by_id[i][0].record_type, by_id[i][0].refers_to) for i in (1, 2, 7, None, 4)] == [
        ("revisit", 7), ("revisit", 7), ("response", None), ("revisit", 7), ("response", None)
    ]
    assert [r.record_type for r in by_id[9]] == ["response"] * 2 and by_id[2][0].url == "urn:page:2"
    for place in [r.file for r in done.collect()]:
        fs, path = opened(place)
        whole = fs.open_input_file(path).read()
        for line in fs.open_input_stream(path + ".idx").read().decode().splitlines():
            offset, length, name = line.split("\t")
            member = whole[int(offset) : int(offset) + int(length)]
            assert gzip.decompress(member).startswith(b"WARC/1.1\r\n") and name.encode() in gzip.decompress(member)
    assert warc.read(spark, warc.normalise(warc.write_stream(warc.described(pages(spark, rows).limit(0))))).count() == 0


@pytest.mark.parametrize("cut", [1, 10, 200])
def test_broken_archives_are_errors(cut):
    header, block = warc.record(1, "u", b"payload " * 50, 400, "d", None)
    stream = gzip.compress((header + block + b"\r\n\r\n") * 3)
    sink = io.BytesIO()
    assert len(list(warc.normalise_file(pa.PythonFile(io.BytesIO(stream), "r"), sink))) == 3
    two = stream + stream  # members may follow each other
    assert len(list(warc.normalise_file(pa.PythonFile(io.BytesIO(two), "r"), sink))) == 6
    with pytest.raises(ValueError):
        list(warc.normalise_file(pa.PythonFile(io.BytesIO(stream[:-cut]), "r"), sink))


def clause(*symbols):
    machine, state, out = grammar(), 0, []
    for s in symbols:
        out.append(int(machine.gives[state, s]))
        state = machine.goes[state, s]
    return out


def test_grammar():
    assert clause(INSULT) == [INSULT]
    assert clause(NEGATION, OTHER, INSULT)[-1] == toxic_grammar.DENIED
    assert clause(NEGATION, OTHER, OTHER, OTHER, INSULT)[-1] == INSULT
    assert clause(REPORT, OTHER, OTHER, OTHER, OTHER, INSULT)[-1] == toxic_grammar.QUOTED
    assert clause(TARGET, OTHER, INSULT)[-1] == DIRECTED
    assert clause(INSULT, OTHER, TARGET)[-1] == DIRECTED
    assert clause(TARGET, NEGATION, INSULT)[-1] == toxic_grammar.DENIED


def test_clauses_not_words():
    matcher = toxic_grammar.Matcher({"foozle": 3.0})
    plain, bits = matcher.clauses("Some words. What a foozled thing; more.")
    directed, more = matcher.clauses("Some words. You foozled thing; more.")
    denied, least = matcher.clauses("Some words. It is not a foozle; more.")
    assert denied < plain < directed and least < bits < more
    assert matcher.clauses("unfoozled") == (0.0, 0) and matcher.clauses("") == (0.0, 0)
    # one clause's negation does not reach into the next
    assert matcher.clauses("Not this. A foozle")[1] == bits


def test_toxicity_is_learnt(spark):
    pick = random.Random(2)
    words = ["".join(pick.choice("abdeilmnorst") for _ in range(pick.randint(3, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(1200):
        own = [pick.choice(words) for _ in range(pick.randint(5, 60))]
        toxic = i % 8 == 0
        for _ in range(2 * toxic):
            own[pick.randrange(len(own))] = "grump" + pick.choice(["y", "ish", "ed", "er"])
        rows.append((i, " ".join(own) + ".", "x"))
        labels.append((i, int(toxic), "y"))
    rows += [(5000, None, "x"), (5001, "", "x"), (None, "words", "x"), (5002, "grumpy " * 20_000, "x"), (5003, "not grumpy", "x")]
    labels += [(None, 1, "y"), (5001, None, "y"), (0, 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, weight string")
    given = spark.createDataFrame(labels, "doc_id long, toxic int, patterns string")
    got = {r.doc_id: r for r in toxic_grammar.score(docs, given).collect()}
    held = [i for i in range(1200) if got[i].held_out]
    assert 150 < len(held) < 330
    assert np.mean([got[i].predicted == (i % 8 == 0) for i in held]) > 0.97
    assert got[5002].predicted == 1 and got[5000].score == got[5001].score < 0.5 and got[None].predicted == 0
    assert got[5003].score < got[5002].score
    unlabelled = toxic_grammar.score(docs, given.limit(0)).collect()
    assert len(unlabelled) == len(rows) and all(0 <= r.score <= 1 for r in unlabelled)
    assert toxic_grammar.score(docs.limit(0), given).count() == 0


@pytest.mark.parametrize("cell", [10_000, 60])
def test_vectors(spark, monkeypatch, cell):
    monkeypatch.setattr(vector_cells, "CELL_VECTORS", cell)
    monkeypatch.setattr(vector_cells, "BLOCK", 32)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    data = [(i, (centres[rng.integers(12)] + rng.normal(size=8) * rng.choice([0.1, 0.3, 2.0])).tolist()) for i in range(500)]
    data += [(600 + i, data[3][1]) for i in range(150)]
    data += [(800, None), (801, []), (802, [0.0] * 8), (803, [None] + [1.0] * 7), (804, [float("nan")] * 8), (805, [1.0, 0.0]), (806, [2.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in data], "vec_id long, embedding array<double>, node int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_cells.near_duplicates(frame).collect()}
    valid = {i: np.array(v) for i, v in data if v and None not in v and np.isfinite(v).all() and any(v)}
    links = []
    for a in valid:
        for b in valid:
            if a < b and len(valid[a]) == len(valid[b]):
                if valid[a] @ valid[b] / np.linalg.norm(valid[a]) / np.linalg.norm(valid[b]) >= 0.9:
                    links.append((a, b))
    component = brute.least_reachable([i for i, _ in data], links)
    count = dict.fromkeys(component, 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert got == {i: (count[i], component[i], component[i] == i) for i in component}
    assert vector_cells.near_duplicates(frame.limit(0)).count() == 0


def test_components(spark):
    pick = random.Random(4)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert got == brute.least_reachable(nodes, [e for e in edges if e[0] != e[1]])


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "tokens"]
    clean = steps["toxicity"](spark, docs, folder)
    toxic = {r.doc_id for r in toxic_grammar.score(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - toxic

    lined = steps["line_dedup"](spark, docs, folder)
    expected = brute.lines([(r.doc_id, r.text) for r in docs.collect()], words=50)
    assert {r.doc_id: r.text for r in lined.collect()} == {i: t for i, (n, gone, t) in expected.items() if not gone or gone < n}
    assert lined.columns == docs.columns and lined.where("n_chars <> length(text)").count() == docs.where("n_chars <> length(text)").count()

    near = steps["near_duplicates"](spark, docs, folder)
    groups = brute.jaccard([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in near.collect()} == {c for _, c in groups.values()}

    kept = steps["decontamination"](spark, docs, folder)
    bad = {x[0] for x in brute.items_found([(r.doc_id, r.text) for r in docs.collect()], items)}
    assert bad and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - bad
    assert steps["tokens"](spark, docs, folder).count() == docs.count()
    assert 0 < corpus_pipeline.run(spark, folder).count() < docs.count()
    assert all(f(spark, docs.limit(0), folder).count() == 0 for f in steps.values())


def test_pipeline_drops_long_passages(spark):
    import corpus_pipeline

    passage, far = (" ".join(f"{k}{i}" for i in range(60)) for k in "pq")
    own = [" ".join(f"{k}{i}" for i in range(200)) for k in "abc"]
    rows = [(1, f"{own[0]}\n{passage}"), (2, f"{passage}\n{own[1]}"), (3, f"{own[2]}\n{passage}\n{far}"), (4, "")]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars int")
    steps = dict(corpus_pipeline.STAGES)
    left = steps["line_dedup"](spark, docs, "")
    want = {1: rows[0][1], 2: own[1], 3: f"{own[2]}\n{far}", 4: ""}
    assert {r.doc_id: (r.text, r.n_chars) for r in left.collect()} == {i: (t, len(t)) for i, t in want.items()}


def test_pipeline_stages_go_by_rows(spark, monkeypatch):
    """Null and repeated doc_ids: what holds for one text does not hold for others of its doc_id."""
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcd")
    near = a + " more"
    steps = dict(corpus_pipeline.STAGES)

    def left(stage, rows):
        docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
        return sorted(((r.doc_id, r.text) for r in steps[stage](spark, docs, "").collect()), key=str)

    rows = [(1, a), (None, near), (None, b), (2, a), (2, c), (3, d), (3, d), (3, d), (4, None), (4, None), (None, ""), (None, "")]
    want = [(1, a), (None, b), (2, c), (3, d), (4, None), (4, None), (None, ""), (None, "")]
    assert left("near_duplicates", rows) == sorted(want, key=str)
    assert len(left("near_duplicates", [(None, b), (None, b), (None, b + " x"), (7, c + " y"), (7, c)])) == 2

    bad = "you are an idiot, you idiot, you moron. "
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: spark.createDataFrame([], "doc_id long, toxic int"))
    rows = [(None, bad * 5), (None, b), (5, bad * 4), (5, c), (5, c), (6, d), (None, None)]
    assert left("toxicity", rows) == sorted([(None, b), (5, c), (5, c), (6, d), (None, None)], key=str)
