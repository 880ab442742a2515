"""Centroid clustering, ranked search and exact dedup against brute force, and their edge cases."""

import hashlib
import math
import random
from collections import Counter

import brute
import numpy as np
import pytest

from vacantia.llm import chunk_recipes, pivot_clusters, ranked_search

VECTORS = "vec_id long, embedding array<double>, cluster string"
DOCS = "doc_id long, text string, row string, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS)


def some_vectors(n, seed, dims=64):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 0.4) for _ in range(dims)] for _ in range(5)]
    return [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(middles)]) for i in range(n)]


def placed(df):
    return sorted((r["vec_id"], r["cluster"], r["distance"]) for r in df.collect())


def test_clusters_are_those_of_brute_force(spark):
    rows = some_vectors(300, 1)
    found = pivot_clusters.cluster(vectors(spark, rows)).collect()
    expected, centroids = brute.clusters(rows)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in found) == sorted(expected)
    spread = Counter()
    for _, c, d in expected:
        spread[c] += d
    for r in found:
        assert r["cluster_inertia"] == spread[r["cluster"]] and r["inertia"] == sum(spread.values())
        told = ",".join(map(str, centroids[r["cluster"]]))
        assert r["centroid_sha256"] == hashlib.sha256(told.encode()).hexdigest()


def test_clusters_of_odd_vectors(spark):
    good = some_vectors(40, 2, 4)
    odd = [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 0.0, 0.0]), (904, [math.inf] * 4), (905, [math.nan] * 4)]
    tied = [(i, [0.5, 0.5, 0.0, -0.25]) for i in range(50, 60)]
    rows = good + odd + tied + tied[:2]  # repeated rows are vectors of their own
    found = pivot_clusters.cluster(vectors(spark, rows), k=6, dims=4)
    assert placed(found) == sorted(brute.clusters(rows, k=6, dims=4)[0])
    few = pivot_clusters.cluster(vectors(spark, tied[:3]), k=6, dims=4)
    assert placed(few) == [(50, 0, 0), (51, 0, 0), (52, 0, 0)]
    nameless = pivot_clusters.cluster(vectors(spark, [(None, [1.0] * 4), (1, [0.0] * 4)]), k=1, rounds=0, dims=4)
    assert {r["vec_id"]: r["distance"] for r in nameless.collect()} == {1: 0, None: 4 * 64**2}
    assert pivot_clusters.cluster(vectors(spark, odd), dims=4).collect() == []
    assert pivot_clusters.cluster(vectors(spark, []), dims=4).collect() == []


def test_components_that_fit_no_distance_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        pivot_clusters.cluster(vectors(spark, [(1, [1e12] * 4), (2, [0.0] * 4)]), dims=4).collect()


def test_pivots_spare_distances_and_lose_none():
    rng = np.random.default_rng(3)
    middles = rng.integers(-3000, 3000, (24, 16))
    own = middles[rng.integers(0, 24, 4000)] + rng.integers(-40, 40, (4000, 16))
    nearest = pivot_clusters.Nearest(middles, middles[:8])
    number, best, computed = nearest(own, pivot_clusters.squared(own, middles[:8]))
    whole = pivot_clusters.squared(own, middles)
    assert (number == whole.argmin(axis=1)).all() and (best == whole.min(axis=1)).all()
    assert computed < 2 * len(own)  # of 24 for each vector


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "r", 1) for i, t in rows], DOCS)


def found_for(spark, docs, items, **how):
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = ranked_search.search(texts(spark, docs), asked, **how).collect()
    return sorted((r["item_id"] is None, r["item_id"] or 0, r["rank"], r["doc_id"], r["score"]) for r in got)


def expected_for(docs, items, limit=50):
    return sorted((i is None, i or 0, k, d, s) for i, k, d, s in brute.ranked(docs, items, limit))


def some_texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(4000)] + ["Überé", "X-1", "naïve"]
    return [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 8, 20, 20, 60])))) for i in range(n)]


@pytest.mark.parametrize("part, seeds", [(1 << 18, 4), (64, 1)])
def test_search_finds_what_brute_force_finds(spark, part, seeds):
    docs, items = some_texts(400, 4), some_texts(30, 5)
    assert found_for(spark, docs, items, part_postings=part, seeds=seeds, limit=7) == expected_for(docs, items, 7)


def test_scores_do_not_hang_on_the_size_of_the_table():
    rng = np.random.default_rng(9)
    own = [np.unique(rng.integers(0, 50, 12)).astype(np.int32) for _ in range(40)]
    tfs = [rng.integers(1, 4, len(t)).astype(np.int32) for t in own]
    part = ranked_search._row(120, 0, np.arange(40), np.arange(40), own, tfs)
    terms = [np.unique(rng.integers(0, 60, 9)) for _ in range(20)]
    first = np.cumsum([0, *map(len, terms)])
    items = ranked_search.Items(list(range(20)), np.concatenate(terms), first, rng.integers(0, 9000, 60))
    expected = np.array([[
        sum(int(items.weight[t]) * int(ranked_search.impacts(f, 120)) for t, f in zip(own[d], tfs[d]) if t in terms[i])
        for d in range(40)] for i in range(20)])
    asked = np.array([7, 3, 19, 0, 11])
    for cells in (1, 2100, 1 << 20):
        got = [(i, s) for at, scores in items.scores(part, asked, cells) for i, s in zip(at.tolist(), scores)]
        assert [i for i, _ in got] == asked.tolist()
        assert all((s == expected[i]).all() for i, s in got)
    assert (items.bounds(part) >= expected.max(axis=1)).all()


def test_search_of_odd_texts(spark):
    long = " ".join(["common"] * 5000 + ["rare", "Rare,RARE"])
    docs = [(1, None), (2, ""), (3, " .,! "), (4, "common"), (5, "COMMON"), (5, "common"), (6, long), (None, "common")]
    items = [(1, "common rare"), (1, "absent"), (2, None), (3, "Common common"), (None, "rare"), (4, "absent")]
    assert found_for(spark, docs, items) == expected_for(docs, items)
    assert found_for(spark, docs, items, block_terms=1) == expected_for(docs, items)
    assert found_for(spark, [], items) == [] and found_for(spark, docs, []) == []


def groups(df):
    return sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"]) for r in df.collect())


def equal_texts(rows):
    same = {}
    for i, t in rows:
        same.setdefault((t or "").translate(brute.LOWER), []).append(i)
    return sorted((i, max(ids), len(ids), i == max(ids)) for ids in same.values() for i in ids)


def copies(n, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdeABCDE \n", k=rng.choice([0, 5, 900, 5000, 90_000]))) for _ in range(12)]
    base += ["x" * 200_000, "xX" * 100_000, base[3] + "!", "É", "é"]
    return [(i, rng.choice(base)) for i in range(1, n)]


def test_exact_groups_are_equal_texts(spark):
    rows = [*copies(150, 6), (1000, None), (1001, "")]
    found = chunk_recipes.exact_groups(texts(spark, rows))
    assert groups(found) == equal_texts(rows)
    told = {r["doc_id"]: r["text_sha256"] for r in found.collect()}
    assert all(told[i] == hashlib.sha256((t or "").translate(brute.LOWER).encode()).hexdigest() for i, t in rows)


def test_colliding_identifiers_are_found_out(spark):
    def weak(data, seed):
        return b"same" if seed == 0 else chunk_recipes.hashed(data, seed)

    def weak_for_chunks(data, seed):
        return b"%02d" % (sum(data) % 3) if seed < 2 and len(data) > 900 else chunk_recipes.hashed(data, seed)

    rows = copies(60, 7)
    for identify in (weak, weak_for_chunks):
        assert groups(chunk_recipes.exact_groups(texts(spark, rows), identify)) == equal_texts(rows)


def test_exact_groups_of_repeated_and_nameless_rows(spark):
    rows = [(1, "a"), (1, "a"), (1, "A"), (None, "a"), (None, "b"), (2, "c")]
    found = chunk_recipes.exact_groups(texts(spark, rows)).collect()
    assert sorted((r["keep_id"] or -1, r["group_size"], r["kept"]) for r in found) == [
        (-1, 1, True), (1, 4, False), (1, 4, False), (1, 4, False), (1, 4, True), (2, 1, True),
    ]
    assert chunk_recipes.exact_groups(texts(spark, [])).collect() == []


def test_chunks_follow_content():
    rng = random.Random(8)
    text = bytes(rng.choices(range(97, 123), k=400_000))
    ends = [len(c) for c in next(iter(chunk_recipes.chunked(_column(text))))[1]]
    moved = next(iter(chunk_recipes.chunked(_column(b"new start " + text))))[1]
    assert sum(ends) == len(text) and max(ends) <= chunk_recipes.MOST and min(ends[:-1]) >= chunk_recipes.LEAST
    own = set(next(iter(chunk_recipes.chunked(_column(text))))[1])
    assert len(own & set(moved)) > 0.9 * len(own)


def _column(text):
    import pyarrow as pa

    return pa.array([text.decode()])
