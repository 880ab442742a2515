"""Repeats, joins, lines and items: random texts against brute force, and odd rows."""

import random

import brute
import numpy as np
import pytest

from vacantia.llm import batches, decontaminate, jaccard_join, line_dedup, suffix_repeats

ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "A b c"), (905, "a B c"), (906, "é \x1c ü")]


@pytest.fixture(autouse=True)
def small_batches(monkeypatch):
    monkeypatch.setattr(batches, "BATCH_BYTES", 2000)


def mixed_texts(seed, n=250):
    pick = random.Random(seed)
    base = [[pick.choice("abcdefgh") + str(pick.randint(0, 9)) for _ in range(pick.randint(4, 50))] for _ in range(10)]
    rows = []
    for i in range(n):
        words = list(pick.choice(base))
        for _ in range(pick.randint(0, 5)):
            at = pick.randrange(len(words) + 1)
            words[at:at] = pick.choice(base)[: pick.randint(1, 8)] if pick.random() < 0.4 else [pick.choice("xyz")]
        rows.append((i, "".join(w + pick.choice([" ", " ", "  ", "\n", "\t"]) for w in words)))
    return rows + ODD + [(907, rows[0][1].upper()), (908, "w " * 3000)]


def frame(spark, rows):
    """With columns whose names the operators use themselves."""
    more = "text string, doc_id long, row long, batch long, size long, runs string, n_lines string, doc string"
    return spark.createDataFrame([(t, i, 1, 2, 3, "r", "n", "d") for i, t in rows], more)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats(spark, seed):
    rows = mixed_texts(seed)
    got = suffix_repeats.remove_repeats(frame(spark, rows), depth=6, group_suffixes=100).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == brute.repeats(rows, 6)
    assert all(sum(x.n for x in r.removed) == r.n_removed for r in got)


def test_leaves_are_narrow():
    """Ascending codes and ids cost less than their width; extremes come back as they were."""
    pick = np.random.default_rng(1)
    codes = np.sort(pick.integers(0, 1 << 32, 5000, dtype=np.uint32))
    codes[[0, -1]] = 0, (1 << 32) - 1
    digest = pick.integers(0, 1 << 48, 5000, dtype=np.uint64)
    ids = np.arange(-500, 500) * 7
    ids[[0, -1]] = batches.NO_ID, (1 << 63) - 1
    local = pick.integers(0, 1000, 5000)
    row = suffix_repeats._leaves_row(codes, digest, local, ids, 6)
    size = {c: len(v) for c, v in row.items() if isinstance(v, bytes)}
    assert size["codes"] < 3 * 5000 and size["text"] < 2 * 5000 and size["doc_ids"] < 2 * 1000
    for got, want in zip(suffix_repeats._leaves_of(row, 6), (codes, digest, ids[local]), strict=True):
        assert (got == want).all()


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard(spark, seed):
    rows = mixed_texts(seed)
    got = jaccard_join.join(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.jaccard(rows)


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (5, text), (None, text), (None, None), (2, "other words entirely")]
    got = jaccard_join.join(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 5), (2, 2), (5, 5), (5, 5)]
    left = suffix_repeats.remove_repeats(frame(spark, rows)).collect()
    assert sorted(r.n_removed for r in left) == [0, 0, 0, 30, 30]


@pytest.mark.parametrize("seed", [5, 6])
def test_lines(spark, seed):
    pick = random.Random(seed)
    rows = [(i, "\n".join(pick.choice("abcde") for _ in range(pick.randint(0, 9)))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "\n\n\n\n"), (903, "a\n" * 500)]
    got = line_dedup.dedup(frame(spark, rows)).collect()
    assert {r.doc.doc_id: (r.n_lines, r.n_removed, r.doc.text) for r in got} == brute.lines(rows)
    assert got[0].doc.asDict().keys() == set(frame(spark, rows).columns)


def test_lines_of_one_text_twice(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc"), (2, "x\na\nb\nc")]
    got = sorted((r.doc.doc_id or 0, r.n_removed) for r in line_dedup.dedup(frame(spark, rows)).collect())
    assert got == [(0, 0), (1, 3), (1, 3), (2, 3)]


def lines_with_words(rows, words, run=3):
    """As brute.lines, and without repeated runs of fewer lines that hold ``words`` words."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        if text is None:
            out[doc_id] = (0, 0, None)
            continue
        each, gone = text.split("\n"), set()
        for n in range(1, run + 1):
            for i in range(len(each) - n + 1):
                window = tuple(each[i : i + n])
                if n < run and sum(len(brute.WORD.findall(x)) for x in window) < words:
                    continue
                if window in seen:
                    gone.update(range(i, i + n))
                seen.add(window)
        out[doc_id] = (len(each), len(gone), "\n".join(x for i, x in enumerate(each) if i not in gone))
    return out


@pytest.mark.parametrize("seed", [8, 9])
def test_long_passages_of_few_lines(spark, seed):
    pick = random.Random(seed)
    some = [" ".join(f"w{k}x{i}" for i in range(n)) for k, n in enumerate([1, 2, 4, 5, 6, 9, 10, 11, 30, 49, 50, 51])]
    rows = [(i, "\n".join(pick.choice([*some, f"own{i}"]) for _ in range(pick.randint(0, 6)))) for i in range(60)]
    rows += [(900, None), (901, ""), (902, some[-1]), (903, f"{some[8]}\n{some[9]}"), (904, f"{some[-1]}\t\n" * 40)]
    for words in (10, line_dedup.PASSAGE_WORDS):
        got = line_dedup.dedup(frame(spark, rows), words=words).collect()
        want = lines_with_words(rows, words)
        assert {r.doc.doc_id: (r.n_lines, r.n_removed, r.doc.text) for r in got} == want != brute.lines(rows)
    assert want[902][1] == 1


def test_items(spark):
    pick = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(pick.choice(words) for _ in range(pick.randint(3, 60)))) for i in range(30)]
    items += [(50, None), (51, ""), (52, "only four words here")]
    docs = []
    for i in range(150):
        parts = [pick.choice(words) for _ in range(pick.randint(0, 300))]
        own = pick.choice(items)[1] or ""
        own = own.split()[: pick.choice([None, None, 20])]
        for _ in range(pick.randint(0, 3)):
            if own:
                own[pick.randrange(len(own))] = "changed"
        at = pick.randrange(len(parts) + 1)
        docs.append((i, ", ".join(parts[:at] + own + parts[at:]).upper()))
    docs += ODD
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, shingle long")
    pairs = decontaminate.contained(frame(spark, docs), bench)
    found = {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in pairs.collect()}
    assert found == brute.items_found(docs, items) and found
    left = decontaminate.remove(frame(spark, docs), pairs)
    assert {r.doc_id for r in left.collect()} == {i for i, _ in docs} - {f[0] for f in found}
    assert left.columns == frame(spark, docs).columns


def test_sketches_are_long_enough(spark):
    """A text that holds four fifths of an item holds one of its sketch, at every size."""
    rows = [(n, " ".join(f"w{n}x{i}" for i in range(n + 4))) for n in range(1, 40)]
    shingles = decontaminate.item_shingles(spark.createDataFrame(rows, "item_id long, text string"))
    sizes = {r.item_id: r["count"] for r in decontaminate.sketches(shingles, 80).groupBy("item_id").count().collect()}
    assert all(sizes[n] >= n - -(-80 * n // 100) + 1 for n in range(1, 40))


def test_empty_tables(spark):
    none = frame(spark, ODD).limit(0)
    assert suffix_repeats.remove_repeats(none).count() == 0
    assert jaccard_join.join(none).count() == 0
    assert line_dedup.dedup(none).count() == 0
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contained(none, items).count() == 0
    assert decontaminate.contained(frame(spark, ODD), items.limit(0)).count() == 0


def test_jaccard_of_many_texts_that_overlap_by_a_half_or_nearly_link(spark):
    draw = random.Random(12)
    passages = [" ".join(f"p{p}w{w}" for w in range(8)) for p in range(20)]
    halves = [" ".join(draw.sample(passages, 12)) for _ in range(60)]
    base = [f"b{w}" for w in range(60)]
    near = []
    for n in range(60):
        words = list(base)
        for at in draw.sample(range(60), 1):
            words[at] = f"c{n % 25}"
        near.append(" ".join(words))
    rows = list(enumerate(halves + near))
    got = jaccard_join.join(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.jaccard(rows)
