"""Regular expressions as columns.

Patterns are tested on a *folded* text, so they need no case-insensitive flag,
and only where the text holds a literal that every match must contain: a
substring scan costs a small fraction of a regex scan, and most postings
mention few of the skills and phrases.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache, reduce
from operator import add, and_, or_
from os.path import commonprefix

from pyspark.sql import Column
from pyspark.sql import functions as F

try:  # the parse tree is a CPython detail; without it patterns run ungated
    from re import _constants as _sc
    from re import _parser as _sp
except ImportError:  # pragma: no cover
    _sp = None

# \b, \s, \w and \d follow Unicode, as they do in Python.
UNICODE = "(?U)"
CASELESS = "(?iU)"

# Non-ASCII characters whose case-insensitive match is an ASCII letter.
_FOLD_FROM, _FOLD_TO = "ıſK", "isk"

_MIN_GATE = 2
_HANDFUL = 5

# Letters from frequent to rare; words are looked for from one of the rare ones on.
_LETTERS = "etaoinsrhldcumfpgwybvkxjqz"
_RARE, _MIN_ANCHOR = _LETTERS.index("c"), 4

# Decimal digits of every script, and their ASCII value by rule.
_DIGITS = [c for c in map(chr, range(128, 0x10000)) if unicodedata.category(c) == "Nd"]
_DIGITS_FROM = "".join(_DIGITS)
_DIGITS_TO = "".join(str(unicodedata.digit(c)) for c in _DIGITS)

# What str.strip() removes.
WHITESPACE = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())


def fold(text: Column) -> Column:
    """Lower case, with the few letters that fold to ASCII replaced."""
    odd = reduce(or_, (text.contains(c) for c in _FOLD_FROM))
    return F.lower(F.when(odd, F.translate(text, _FOLD_FROM, _FOLD_TO)).otherwise(text))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Trim Unicode white space, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def to_int(digits: Column) -> Column:
    """Digits of any script to int; null when empty."""
    return F.nullif(F.translate(digits, _DIGITS_FROM, _DIGITS_TO), F.lit("")).cast("int")


def any_of(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _shortest(literals: frozenset) -> int:
    return min(map(len, literals))


def _required(tree) -> list[frozenset]:
    """Sets of literals; a match holds at least one literal of every set."""
    sets, run = [], []

    def close():
        if run:
            sets.append(frozenset(["".join(run)]))
            run.clear()

    for op, arg in tree:
        if op is _sc.LITERAL:
            run.append(chr(arg))
        elif op in (_sc.AT, _sc.ASSERT, _sc.ASSERT_NOT):  # zero width
            continue
        elif op is _sc.BRANCH:
            lead = [(_sc.LITERAL, ord(c)) for c in run]
            close()
            sides = [_required(lead + list(side)) for side in arg[1]]
            if all(sides):
                sets.append(frozenset().union(*[max(s, key=_shortest) for s in sides]))
        else:
            close()
            if op is _sc.SUBPATTERN:
                sets += _required(arg[-1])
            elif op in (_sc.MAX_REPEAT, _sc.MIN_REPEAT) and arg[0] > 0:
                sets += _required(arg[2])
    close()
    return sets


@lru_cache(maxsize=None)
def gate_literals(pattern: str) -> tuple[tuple[str, ...], ...]:
    """The two most telling sets of literals that every match must meet, lower case."""
    if _sp is None:
        return ()
    # a literal inside which another one lies adds nothing
    sets = [{w for w in s if not any(o != w and o in w for o in s)} for s in _required(_sp.parse(pattern))]
    useful = {tuple(sorted(w.lower() for w in s)) for s in sets if _shortest(s) >= _MIN_GATE}
    return tuple(sorted(useful, key=lambda s: (-_shortest(s), s))[:2])


def _trie(words, handful: int = 0) -> str:
    """Pattern of the longest of the words that starts at a place."""
    after = {}
    for w in words:
        after.setdefault(w[:1], []).append(w[1:])
    end = after.pop("", None)
    if not after:
        return ""

    def side(c: str) -> str:
        common = commonprefix(after[c])
        return re.escape(c + common) + _trie([w[len(common) :] for w in after[c]])

    letters = sorted(after)
    sides = [side(c) for c in letters]
    if handful:  # letters by the handful, so that most places are left after a few looks
        cuts = range(0, len(letters), handful)
        sides = [rf"{_one_of(letters[i : i + handful])}(?:{'|'.join(sides[i : i + handful])})" for i in cuts]
    return f"(?:{'|'.join(sides)}){'' if end is None else '?'}"


def _one_of(letters) -> str:
    return f"(?=[{''.join(c if len(c) > 1 else re.escape(c) for c in letters)}])"


def held(text: Column, patterns, words=()) -> Column:
    """What a folded text holds of the words and of the literals that gate the patterns, a line each.

    Each stands by its anchor.  Two passes over the text, for rare and for frequent first letters,
    find at every place the longest anchor; a shorter one that is there lies inside a line.  Gates look here (``seen``) instead of
    scanning the text for each.
    """
    literals = {_anchor(w) for p in patterns for s in _seen_literals(p) for w in s} | set(map(_anchor, words))
    common = sorted(w for w in literals if _rarity(w[0]) < _RARE)
    lines = []
    for some in (sorted(literals.difference(common)), common):
        if some:
            starts = _one_of(sorted({w[0] for w in some}))
            at = F.regexp_extract_all(text, F.lit(f"{starts}(?=({_trie(some, _HANDFUL)}))"), F.lit(1))
            lines.append(F.array_join(F.array_distinct(at), "\n"))
    return F.concat_ws("\n", *lines)


def _seen_literals(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Those of ``gate_literals`` that are looked for; sets with frequent starts only where there is no other."""
    sets = gate_literals(pattern)
    rare = tuple(s for s in sets if all(_rarity(_anchor(w)[0]) >= _RARE for w in s))
    return rare or sets[:1]


def _rarity(c: str) -> int:
    return _LETTERS.index(c) if c in _LETTERS else -1 if c.isspace() else len(_LETTERS)


@lru_cache(maxsize=None)
def _anchor(word: str) -> str:
    """What is looked for instead of a word: its end from its rarest letter on, if that is long enough.

    Who holds the word holds it too, and most places of a text are passed by at a glance.
    """
    starts = [0, *range(1, len(word) - _MIN_ANCHOR + 1)]
    return word[max(starts, key=lambda i: (_rarity(word[i]), -i)) :]


def holds(text: Column, word: str, seen: Column | None = None) -> Column:
    """Whether a text holds a word; by what is seen of it, whether it may."""
    return text.contains(word) if seen is None else seen.contains(_anchor(word))


def _gate(folded: Column, pattern: str, seen: Column | None = None) -> Column | None:
    sets = gate_literals(pattern) if seen is None else _seen_literals(pattern)
    any_of_set = [reduce(or_, (holds(folded, w, seen) for w in s)) for s in sets]
    return reduce(and_, any_of_set) if any_of_set else None


def found(folded: Column, pattern: str, seen: Column | None = None) -> Column:
    """Whether the pattern occurs in a folded text; ``seen`` is what it holds (see ``held``), if known."""
    hit = folded.rlike(UNICODE + _quick(pattern))
    gate = _gate(folded, pattern, seen)
    return hit if gate is None else gate & hit


def hits(folded: Column, pattern: str, seen: Column | None = None) -> Column:
    """Number of non-overlapping matches in a folded text; 0 for null."""
    n = F.regexp_count(folded, F.lit(UNICODE + _quick(pattern)))
    gate = _gate(folded, pattern, seen)
    return F.coalesce(n if gate is None else F.when(gate, n), F.lit(0))


def found_any(folded: Column, patterns, seen: Column | None = None) -> Column:
    """``found`` of any of the patterns, each behind its own gate."""
    return reduce(or_, [found(folded, p, seen) for p in patterns])


def _starts(tree) -> set[str] | None:
    """The characters that a match can start with (``\\d`` for digits); None where the pattern does not tell."""
    for op, arg in tree:
        if op is _sc.LITERAL:
            return {chr(arg)}
        if op is _sc.AT:  # zero width
            continue
        if op is _sc.IN and all(o is _sc.LITERAL for o, _ in arg):
            return {chr(c) for _, c in arg}
        if op is _sc.IN and list(arg) == [(_sc.CATEGORY, _sc.CATEGORY_DIGIT)]:
            return {r"\d"}
        if op in (_sc.MAX_REPEAT, _sc.MIN_REPEAT) and arg[0] > 0:
            return _starts(arg[2])
        sides = arg[1] if op is _sc.BRANCH else [arg[-1]] if op is _sc.SUBPATTERN else []
        starts = [_starts(side) for side in sides]
        return set().union(*starts) if starts and None not in starts else None
    return None


@lru_cache(maxsize=None)
def _quick(pattern: str) -> str:
    """The pattern behind a look at its first character, where that is one of few.

    Most places of a text are passed by at that look, before a Unicode word boundary is worked out.
    """
    starts = None if _sp is None else _starts(_sp.parse(pattern))
    return pattern if starts is None else f"{_one_of(sorted(starts))}(?:{pattern})"


def hits_any(folded: Column, patterns, seen: Column) -> Column:
    """``hits`` of the alternatives taken together.

    All at once they are tried at every place.  Where the gates leave one that can be there, it
    alone is counted.
    """
    count = lambda p: F.regexp_count(folded, F.lit(UNICODE + _quick(p)))
    gates = [F.lit(True) if gate is None else gate for gate in (_gate(folded, p, seen) for p in patterns)]
    can_be = reduce(add, [gate.cast("int") for gate in gates])
    alone = reduce(lambda chain, gp: chain.when(gp[0], count(gp[1])), zip(gates, patterns), F)
    n = F.when(can_be == 1, alone).when(can_be > 1, count(_quick(any_of(patterns))))
    return F.coalesce(n, F.lit(0))


def group(folded: Column, pattern: str, idx: int = 1, seen: Column | None = None) -> Column:
    """A group of the first match, '' without one."""
    got = F.regexp_extract(folded, UNICODE + _quick(pattern), idx)
    gate = _gate(folded, pattern, seen)
    return got if gate is None else F.when(gate, got).otherwise("")


def found_caseless(text: Column, patterns) -> Column:
    """Whether any pattern occurs in a short raw text, ignoring case."""
    return text.rlike(CASELESS + any_of(patterns))


def has_any(text: Column, tokens) -> Column:
    """Whether a lower-cased text holds any of the tokens."""
    return reduce(or_, (text.contains(t) for t in tokens))


def quoted(tokens) -> str:
    """Pattern of literal alternatives."""
    return "|".join(re.escape(t) for t in tokens)


def first_match(text: Column, labelled, test=found, otherwise: Column | None = None) -> Column:
    """Label of the first pattern that occurs."""
    chain = F
    for label, pattern in labelled:
        chain = chain.when(test(text, pattern), F.lit(label))
    return chain.otherwise(F.lit("unknown") if otherwise is None else otherwise)
