"""Toxicity by a weighted finite-state grammar over clauses (operator 4).

Words become symbols: insult, threat, target, negation, reported speech, other.  Small
transducers rewrite a clause's symbols one after the other - negation turns an insult in
its reach into a denied one, reported speech into a quoted one, a target near it into a
directed one - and are composed into one table before any text is read.  What a clause
comes to is its pattern; a document is scored by the weights and the patterns of its
clauses, by a logistic model of them, never by the words alone.

Insults are learnt too: a word, or the beginning that a family of words shares, is one
where its documents are toxic far beyond chance (likelihood ratio against the overall
rate, above the number of candidates tried); its weight is its log odds.  Counts are taken over all labelled rows of
the training part; at most ``most_entries`` of the strongest are kept as the lexicon.

Cases: a null or empty text has no pattern and gets the score of such texts; a null
doc_id counts as an empty text for the fold, hence as held out; labels that are null are
not used, without any label the prior weights hold; rows repeat as they are given; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_side, staged

# fixed values: closed word classes of the grammar
TARGETS = ["you", "your", "yours", "u", "he", "she", "they", "them", "him", "her", "his", "their", "all", "everyone"]
NEGATIONS = ["not", "no", "never", "none", "nobody", "nor", "neither", "cannot", "without", "hardly"]
REPORTS = ["said", "says", "say", "called", "calls", "wrote", "writes", "claimed", "quoted", "reported", "told"]
THREATS = ["kill", "murder", "hurt", "strangle", "stab", "shoot", "smash", "destroy", "burn", "hang"]
INSULTS = ["idiot", "moron", "imbecile"]

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, DENIED, QUOTED, DIRECTED = range(9)
SYMBOLS = 9
#: What a clause can come to, weakest first, and the share of its words' weight that it counts with.
PATTERNS = {"denied": 0.25, "quoted": 0.25, "threat": 1.0, "insult": 1.0, "directed": 1.5}
REACH = 3
CLAUSE_END = re.compile(r"[.!?;\n]+")
WORD = re.compile(r"[^\W_]+")
PREFIX_CHARS = range(4, 11)
CLOSED_WEIGHT = 4.0  # of words that are given, not learnt
STEPS = 4  # steps of the model's two quantities per doubling
#: The model without labels, and what fitting is drawn to: constant, weight, density, patterns.
PRIOR = [-4.0, 1.0, 0.5, 0.0, 0.0, 0.0, 0.5, 0.5]


class Transducer:
    """A deterministic transducer: (state, symbol) to (state, symbol).  State 0 starts a clause;
    pairs that are not given copy the symbol and go to ``otherwise(state)``."""

    def __init__(self, states: int, arcs: dict[tuple[int, int], tuple[int, int]], otherwise: Iterable[int]):
        self.goes = np.zeros((states, SYMBOLS), np.int32)
        self.gives = np.zeros((states, SYMBOLS), np.int32)
        for s, rest in zip(range(states), otherwise, strict=True):
            for x in range(SYMBOLS):
                self.goes[s, x], self.gives[s, x] = arcs.get((s, x), (rest, x))

    def then(self, after: Transducer) -> Transducer:
        """The composition: what this one gives is what ``after`` reads."""
        n, m = len(self.goes), len(after.goes)
        out = Transducer(n * m, {}, [0] * (n * m))
        for s in range(n):
            for t in range(m):
                for x in range(SYMBOLS):
                    mid = self.gives[s, x]
                    out.goes[s * m + t, x] = self.goes[s, x] * m + after.goes[t, mid]
                    out.gives[s * m + t, x] = after.gives[t, mid]
        return out


def _within(opener: int, changes: dict[int, int], reach: int = REACH) -> Transducer:
    """For ``reach`` symbols after ``opener`` symbols change; state k: k symbols are left."""
    arcs = {(s, opener): (reach, opener) for s in range(reach + 1)}
    arcs |= {(s, x): (s - 1, y) for s in range(1, reach + 1) for x, y in changes.items()}
    return Transducer(reach + 1, arcs, [max(0, s - 1) for s in range(reach + 1)])


def _reported(changes: dict[int, int]) -> Transducer:
    """From a verb of reporting to the end of the clause."""
    return Transducer(2, {(0, REPORT): (1, REPORT)} | {(1, x): (1, y) for x, y in changes.items()}, [0, 1])


def grammar() -> Transducer:
    """Negation, then reported speech, then targets on either side of an insult or threat."""
    denied = _within(NEGATION, {INSULT: DENIED, THREAT: DENIED})
    quoted = _reported({INSULT: QUOTED, THREAT: QUOTED})
    at_target = _within(TARGET, {INSULT: DIRECTED, THREAT: DIRECTED})
    # an insult or threat first, its target after it: the target gives the pattern
    hit = {(s, x): (REACH, x) for s in range(REACH + 1) for x in (INSULT, THREAT)}
    at_insult = Transducer(
        REACH + 1, hit | {(s, TARGET): (0, DIRECTED) for s in range(1, REACH + 1)},
        [max(0, s - 1) for s in range(REACH + 1)],
    )
    return denied.then(quoted).then(at_target).then(at_insult)


_PATTERN_OF = {DENIED: 0, QUOTED: 1, THREAT: 2, INSULT: 3, DIRECTED: 4}
_SHARES = list(PATTERNS.values())


class Matcher:
    """Finds what the clauses of a text come to, for a lexicon of weighted word beginnings."""

    def __init__(self, beginnings: dict[str, float]):
        import ahocorasick

        machine = grammar()
        self.goes, self.gives = machine.goes.tolist(), machine.gives.tolist()
        self.closed = {w: k for k, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
        self.automaton = ahocorasick.Automaton()
        for word, weight in (dict.fromkeys(INSULTS, CLOSED_WEIGHT) | beginnings).items():
            self.automaton.add_word(word, (len(word), INSULT, weight, False))
        for word in THREATS:
            if word not in self.automaton:
                self.automaton.add_word(word, (len(word), THREAT, CLOSED_WEIGHT / 2, True))
        self.automaton.make_automaton()

    def hits(self, text: str) -> dict[int, tuple[int, float]]:
        """Where a word of the open classes starts, its class and its weight."""
        found: dict[int, tuple[int, float]] = {}
        for end, (size, kind, weight, whole) in self.automaton.iter(text):
            start = end - size + 1
            if start and text[start - 1].isalnum():
                continue
            if whole and end + 1 < len(text) and text[end + 1].isalnum():
                continue
            if start not in found or found[start][1] < weight:
                found[start] = (kind, weight)
        return found

    def clauses(self, text: str) -> tuple[float, int]:
        """The sum of the clauses' weights, and the bits of the patterns they come to."""
        text = text.lower()
        hits = self.hits(text)
        total, mask, clause_end = 0.0, 0, -1
        for at in sorted(hits):
            if at < clause_end:
                continue
            begin = max(text.rfind(c, 0, at) for c in ".!?;\n") + 1
            stop = CLAUSE_END.search(text, at)
            clause_end = stop.start() if stop else len(text)
            state, best, weight = 0, -1, 0.0
            for word in WORD.finditer(text, begin, clause_end):
                kind, own = hits.get(word.start()) or (self.closed.get(word[0], OTHER), 0.0)
                best = max(best, _PATTERN_OF.get(self.gives[state][kind], -1))
                state = self.goes[state][kind]
                weight += own
            if best >= 0:
                mask |= 1 << best
                total += weight * _SHARES[best]
        return total, mask


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def learn_insults(train: DataFrame, most_entries: int = 5000, margin: float = 3.0) -> dict[str, float]:
    """Beginnings of words whose documents are toxic beyond chance, weighted; ``train`` has text and toxic."""
    base = train.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    if not base["t"] or base["t"] == base["n"]:
        return {}
    rate = base["t"] / base["n"]
    words = F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("word")
    counted = (
        train.select(F.col("toxic").cast("long").alias("toxic"), words)
        .groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
        .where(F.length("word") >= PREFIX_CHARS[0])
    )
    begins = F.explode(F.array(*[
        F.when(F.length("word") >= k, F.substring("word", 1, k)) for k in PREFIX_CHARS
    ])).alias("begin")
    share = F.col("bad") / F.col("n")
    gain = F.col("bad") * F.log(share / rate) + F.when(
        F.col("bad") < F.col("n"), (F.col("n") - F.col("bad")) * F.log((1 - share) / (1 - rate))
    ).otherwise(0.0)
    families = staged(
        counted.select("bad", "n", begins).where("begin IS NOT NULL")
        .groupBy("begin").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    )
    tried = families.count()
    pure = families.where((share > max(0.5, rate)) & (gain > math.log(max(tried, 2)) + margin))
    kept: dict[str, float] = {}
    for row in pure.orderBy(F.length("begin"), gain.desc(), "begin").limit(most_entries).collect():
        if not any(row["begin"][:k] in kept for k in PREFIX_CHARS):
            odds = (row["bad"] + 0.5) / (row["n"] - row["bad"] + 0.5)
            kept[row["begin"]] = math.log(odds * (1 - rate) / rate)
    return kept


def matched(docs: DataFrame, beginnings: dict[str, float]) -> DataFrame:
    """Per text, from the composed grammar: doc_id, tie (hash of the text), steps of weight and density, pattern bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(beginnings)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                weight, mask = matcher.clauses(text)
                density = 1000 * weight / (len(text) + 50)
                rows.append((int(STEPS * math.log2(1 + weight)), int(STEPS * math.log2(1 + density)), mask))
            names = ["doc_id", "tie", "weight", "density", "patterns"]
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.record_batch([batch.column(0), batch.column(2), *(pa.array(c, pa.int32()) for c in columns)], names)

    fields = "doc_id long, tie long, weight int, density int, patterns int"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    return rows.mapInArrow(run, fields)


def fit(train: DataFrame, ridge: float = 0.5) -> list[float]:
    """Logistic coefficients from matched rows with their toxic label.

    What reaches the driver is a count per combination of steps and bits: steps are
    logarithms, so their number is bounded whatever the rows.
    """
    cells = train.groupBy("weight", "density", "patterns").agg(
        F.sum("toxic").alias("bad"), F.count("*").alias("n")
    ).collect()
    prior = np.array(PRIOR)
    if not cells:
        return PRIOR
    bits = [[c["patterns"] >> k & 1 for k in range(len(PATTERNS))] for c in cells]
    x = np.array([[1, c["weight"] / STEPS, c["density"] / STEPS, *b] for c, b in zip(cells, bits, strict=True)])
    bad, n = (np.array([c[k] for c in cells], float) for k in ("bad", "n"))
    beta = prior.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (bad - n * p) - ridge * (beta - prior)
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta += step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return beta.tolist()


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, tie, held_out, score and predicted for every text; labels of fold 0 are not looked at."""
    known = labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0)).select("doc_id", "toxic").distinct()
    known = small_side(staged(known))
    beginnings = learn_insults(docs.select("doc_id", "text").where("text IS NOT NULL").join(known, "doc_id"))
    found = staged(matched(docs, beginnings))
    beta = fit(found.join(known, "doc_id"))
    bits = [F.col("patterns").bitwiseAND(1 << k) != 0 for k in range(len(PATTERNS))]
    terms = [F.lit(beta[0]), beta[1] * F.col("weight") / STEPS, beta[2] * F.col("density") / STEPS]
    terms += [F.when(bit, F.lit(b)).otherwise(0.0) for bit, b in zip(bits, beta[3:], strict=True)]
    scored = found.select(
        "doc_id", "tie", (fold(F.col("doc_id")) == 0).alias("held_out"), (1 / (1 + F.exp(-reduce(add, terms)))).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
