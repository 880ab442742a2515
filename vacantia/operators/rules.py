"""Scoring rules as data: a table of rules compiled to columns.

A row has a name, a category, and three SQL texts over the columns of a parsed posting (see
``features.FEATURE_COLUMNS``): the condition, the points, and the reason.  The table is laid
over the given slots:

* a row with the name of a rule takes that rule's place; without a condition it takes the rule out;
* a new row whose ``slot`` is the name of a rule comes last in that rule's slot, and fires only
  where none before it does;
* other new rows come after all slots: rows of one ``slot`` share a new one, rows without have
  one each.

Rows go by ``place``, then name.  A rule is a part of the plan, hence ``MOST_RULES``.  A name
that repeats, and a rule that lacks points or a reason, is refused.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scoring import Rule

RULES = "place int, name string, category string, condition string, points string, reason string, slot string"
MOST_RULES = 1000


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule table from JSON lines."""
    return spark.read.schema(RULES).json(path)


def _rows(table: DataFrame) -> list:
    rows = table.limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    names = [r["name"] for r in rows]
    again = sorted({str(n) for n in names if not n or names.count(n) > 1})
    if again:
        raise ValueError(f"rules without a name of their own: {', '.join(again)}")
    bad = [r["name"] for r in rows if r["condition"] is not None and None in (r["points"], r["reason"], r["category"])]
    if bad:
        raise ValueError(f"rules without points, reason or category: {', '.join(sorted(bad))}")
    return sorted(rows, key=lambda r: (r["place"] is None, r["place"] or 0, r["name"]))


def _compiled(row) -> Rule:
    return Rule(row["name"], row["category"], F.expr(row["points"]), F.expr(row["reason"]), F.expr(row["condition"]))


def slots(table: DataFrame, base: Sequence[Iterable[Rule]] = ()) -> list[list[Rule]]:
    """The slots of ``base`` with the table laid over them."""
    rows = _rows(table)
    given = {r["name"]: r for r in rows}
    known = {rule.name: i for i, slot in enumerate(base) for rule in slot}
    out: list[list[Rule]] = []
    for slot in base:
        changed = [_compiled(given[r.name]) if r.name in given else r for r in slot if _stays(given.get(r.name))]
        out.append(changed)
    fresh: dict[str, list[Rule]] = {}
    for row in rows:
        if row["name"] in known or row["condition"] is None:
            continue
        if row["slot"] in known:
            out[known[row["slot"]]].append(_compiled(row))
        else:
            fresh.setdefault(row["slot"] or f"\0{row['name']}", []).append(_compiled(row))
    return [slot for slot in [*out, *fresh.values()] if slot]


def _stays(row) -> bool:
    return row is None or row["condition"] is not None
