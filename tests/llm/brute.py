"""Plain single-process versions of the operators, for comparison."""

import hashlib
import math
import re
from collections import Counter
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeats(rows, depth=20):
    """doc_id: (words, removed words, what is left)."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        words, gone = WORD.findall(text or ""), set()
        for i in range(len(words) - depth + 1):
            window = tuple(words[i : i + depth])
            if window in seen:
                gone.update(range(i, i + depth))
            seen.add(window)
        out[doc_id] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    return out


def least_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, k=5):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def jaccard(rows, k=5, percent=80):
    """doc_id: (size of the set, component)."""
    sets = {i: shingles(t, k) for i, t in rows}
    links = [
        (a, b) for a, b in combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    component = least_reachable(sets, links)
    return {i: (len(s), component[i]) for i, s in sets.items()}


def lines(rows, run=3, words=None):
    """doc_id: (lines, removed lines, text left); with ``words`` fewer lines that hold so many go as well."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        if text is None:
            out[doc_id] = (0, 0, None)
            continue
        each, gone = text.split("\n"), set()
        for n in range(1 if words else run, run + 1):
            for i in range(len(each) - n + 1):
                window = tuple(each[i : i + n])
                if n < run and len(WORD.findall("\n".join(window))) < words:
                    continue
                if window in seen:
                    gone.update(range(i, i + n))
                seen.add(window)
        out[doc_id] = (len(each), len(gone), "\n".join(x for i, x in enumerate(each) if i not in gone))
    return out


def items_found(docs, items, k=5, percent=80):
    def of(text):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}

    wanted = {i: of(t) for i, t in items}
    out = set()
    for doc_id, text in docs:
        own = of(text)
        for i, need in wanted.items():
            shared = len(need & own)
            if need and 100 * shared >= percent * len(need):
                out.add((doc_id, i, len(need), shared))
    return out


def clusters(rows, k=16, rounds=3, dims=64, steps=64, seed=1):
    """(vec_id, cluster, distance) of every vector that counts, and the centroids."""
    kept = [
        (i, [math.floor(steps * x) for x in v]) for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        for n, vectors in members.items():
            centroids[n] = [sum(x) // len(vectors) for x in zip(*vectors)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], centroids


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, limit=50):
    """(item_id, rank, doc_id, score) of each item's best rows."""
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    size = [sum(b.values()) for _, b in bags]
    n_docs, length = sum(s > 0 for s in size), sum(size)
    asked, out = {}, []
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    for item, terms in asked.items():
        df = {t: sum(t in b for _, b in bags) for t in terms}
        scores = []
        for (doc, bag), n in zip(bags, size):
            if n:
                m = 50 + (50 * n * n_docs) // length
                scores.append((sum(
                    math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m))
                    for t in terms if t in bag
                ), doc))
        best = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:limit]
        out += [(item, k + 1, doc, score) for k, (score, doc) in enumerate(best)]
    return out
