"""Rules and employer tiers as tables."""

import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from vacantia.operators import features, rules, tiers
from vacantia.operators.scoring import Rule


def base():
    return [
        [Rule("a", "c", 1, "A", F.lit(True)), Rule("b", "c", 2, "B", F.lit(True))],
        [Rule("c", "c", 3, "C", F.lit(True))],
    ]


def laid(spark, rows):
    return [[r.name for r in slot] for slot in rules.slots(spark.createDataFrame(rows, rules.RULES), base())]


def row(place, name, condition="true", slot=None, points="1"):
    return (place, name, "c", condition, points, "'x'", slot)


def test_a_table_of_rules_is_laid_over_the_slots(spark):
    assert laid(spark, [row(1, "b")]) == [["a", "b"], ["c"]]
    assert laid(spark, [row(1, "c", None)]) == [["a", "b"]]
    assert laid(spark, [row(2, "d", slot="a"), row(1, "e", slot="b")]) == [["a", "b", "e", "d"], ["c"]]
    assert laid(spark, [row(2, "f", slot="s"), row(1, "g", slot="s"), row(0, "h")]) == [["a", "b"], ["c"], ["h"], ["g", "f"]]
    assert laid(spark, [row(1, "gone", None)]) == [["a", "b"], ["c"]]
    assert laid(spark, []) == [["a", "b"], ["c"]]


@pytest.mark.parametrize("rows", [[row(1, "d"), row(2, "d")], [row(1, None)], [row(1, "d", points=None)]])
def test_rules_that_are_no_rules_are_refused(spark, rows):
    with pytest.raises(ValueError):
        laid(spark, rows)


NAMES = ["acme inc", "acme egypt", "x", "", None, "ab", "aab", "the acme shop", "zz top", "zz top", "booking.com", "%_", "abcabcabc"]
TERMS = ["acme", "a", "ab", "zz", "cabc", "booking.com", "b", "%", "", None, "not there", "acme egypt", "ab"]


def test_containment_is_that_of_all_pairs(spark):
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    found = sorted(map(tuple, tiers.contained(names, terms).collect()))
    assert found == sorted({(n, t) for n, t in product(NAMES, TERMS) if n and t and t in n})
    assert tiers.contained(names, terms.limit(0)).count() == 0
    assert tiers.contained(names.limit(0), terms).count() == 0


def test_the_first_tier_counts(spark):
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    own = spark.createDataFrame([(2, "b", "acme"), (1, "a", "egypt"), (3, "s", "acme"), (None, "n", None)], tiers.TIERS)
    got = {r["name"]: r["tier"] for r in tiers.tiers_of(names, own).collect()}
    assert got == {"acme inc": "b", "acme egypt": "a", "the acme shop": "b"}


def test_the_table_of_the_word_lists_gives_what_the_patterns_give(spark):
    names = ["Stripe", "Okta, Inc.", "ABC Staffing Agency", "Confidential", "IBM Egypt", None, "", "Nobody", "Meta X.AI", "Red Hat"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "company_name string, i int")
    by_table = tiers.with_tier(df, tiers.default_tiers(spark), "t")
    by_table = by_table.select("i", features.company_tier(F.col("company_name"), F.col("t")).alias("tier"))
    by_pattern = df.select("i", features.company_tier(F.col("company_name")).alias("tier"))
    assert sorted(by_table.collect()) == sorted(by_pattern.collect())


def test_no_pair_of_names_and_terms_is_met_without_a_gram(spark):
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    found = tiers.tiers_of(names, tiers.default_tiers(spark))
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert not re.search("NestedLoop|CartesianProduct", plan)
