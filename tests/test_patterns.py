"""Regular expressions: same as Python's, gates never lose a match."""

import re

import pytest
from pyspark.sql import functions as F

from vacantia import lexicon
from vacantia.functions import patterns, text, times

EDGE = ["JavaScript Engineer", "Java Script dev", "Java dev", "C# dev", "uses C#x", ".NET dev", "asp.net dev",
        "Sr. Backend Engineer", "Sr.Backend Engineer", "caféjava", "0–2 years", "a\xa0b", "Éjava", "٣ years of experience",
        "go developer", "x-go engineer", "ts - x", "ts", "minimum ٣ years", "new grads\xa0welcome", "!!!!", "REST", ""]
ALL = {**{k: patterns.any_of(v) for k, v in lexicon.SKILLS.items()},
       **{f"bank_{k}": patterns.any_of(v) for k, v in lexicon.PHRASE_BANKS.items()},
       "hard": lexicon.YEARS_HARD, "soft": lexicon.YEARS_SOFT, "generic": lexicon.YEARS_GENERIC,
       "range": lexicon.YEARS_RANGE, "grad": lexicon.GRAD_FRIENDLY, "demand": lexicon.EXPERIENCE_DEMAND}


def test_search_and_count_agree_with_python(spark):
    texts = EDGE + [" ".join(EDGE), "Visa sponsorship; sponsors visa. H1-B transfer", "k8s, Kubernetes & GOLANG",
                    "Minimum 5+ years; 3 yrs of exp", "0 - 2 yrs, 10-12 years", "help desk helpdesk L1 support"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("f", patterns.fold(F.col("t")))
    cols = [F.struct(patterns.found(F.col("f"), p).alias("found"), patterns.hits(F.col("f"), p).alias("n")).alias(k) for k, p in ALL.items()]
    for r in df.select("i", *cols).collect():
        for k, p in ALL.items():
            want = list(re.finditer(p, texts[r["i"]], re.IGNORECASE))
            assert (r[k]["found"], r[k]["n"]) == (bool(want), len(want)), (k, texts[r["i"]])


@pytest.mark.parametrize("pattern", ALL.values())
def test_gate_literals_are_in_every_match(pattern):
    """Texts made by walking the pattern hold a literal of each gate set."""
    from random import Random

    from re import _constants as c
    from re import _parser as p

    rng = Random(7)

    def make(tree):
        out = ""
        for op, arg in tree:
            if op is c.LITERAL:
                out += chr(arg)
            elif op is c.IN:
                pick = rng.choice(arg)
                out += {c.LITERAL: lambda a: chr(a), c.RANGE: lambda a: chr(rng.randint(*a)),
                        c.CATEGORY: lambda a: " " if a is c.CATEGORY_SPACE else "1", c.NEGATE: lambda a: "~"}[pick[0]](pick[1])
            elif op is c.BRANCH:
                out += make(rng.choice(arg[1]))
            elif op is c.SUBPATTERN:
                out += make(arg[-1])
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
                out += "".join(make(arg[2]) for _ in range(rng.randint(arg[0], arg[0] + 1)))
        return out

    for _ in range(200):
        text_ = make(p.parse(pattern))
        for literals in patterns.gate_literals(pattern):
            assert any(w in text_ for w in literals), (text_, literals)


def test_numbers_in_other_scripts(spark):
    df = spark.createDataFrame([("٣",), ("12",), ("",), ("१२",)], "t string")
    assert [r[0] for r in df.select(patterns.to_int(F.col("t"))).collect()] == [3, 12, None, 12]


def test_title_normalization(spark):
    want = {"SWE II (Jr.)": "software engineer 2 junior", " Sr. Dev  [Remote] ": "senior developer remote",
            "SSE": "software engineer", "Developer IV": "developer 4", None: ""}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r[0]: r[1] for r in df.select("t", text.normalize_title(F.col("t"))).collect()} == want


def test_entities_decode_once(spark):
    df = spark.createDataFrame([("&amp;lt; &#233;&#x1F600;&eacute;&bogus; &#150;&#0; a & b",)], "t string")
    assert df.select(text.unescape(F.col("t"))).first()[0] == "&lt; é😀é&bogus; –� a & b"


def test_html_to_text(spark):
    want = {"<p>a<br>b</p><script>x<y</script><!-- <p>z -->&nbsp;q": "a b q", "<style>p{}</style>": None,
            "<a title='>'>k</a>\n t": "k t", "2 < 3 and 4 > 1": "2 < 3 and 4 > 1", None: None, "": None}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r[0]: r[1] for r in df.select("t", text.html_to_text(F.col("t"))).collect()} == want


def test_times(spark):
    want = {"1700000000": "2023-11-14 22:13:20", "1700000000123": "2023-11-14 22:13:20", "2024-01-02": "2024-01-02 00:00:00",
            "2024-01-02T03:04:05+02:00": "2024-01-02 01:04:05", "Posted Today": None, "99999999999999999999": None, "": None}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    out = df.select("t", F.date_format(times.parse_dt(F.col("t")), "yyyy-MM-dd HH:mm:ss")).collect()
    assert {r[0]: r[1] for r in out} == want


def test_gates_by_what_is_seen_change_no_result(spark):
    """Literals looked for once by their anchors, alternatives counted alone: as with everything tried on the text."""
    pieces = [
        "maintain legacy system", "legacy code", "legacy", "visa sponsorship", "sponsor visa", "cobol", "maintain  legacy",
        "jsp", "help desk", "it support", "api platform", "platform team", "scalable problems", "!!", "go", "golang",
        "java", "javascript", "must have", "nice to have", "3 years of experience", "2-4 yrs", "engineer", "x",
    ]
    rows = [(" ".join(pieces[(i * k + j) % len(pieces)] for k in range(1, 2 + i % 6)),) for i in range(24) for j in (0, 5)]
    df = spark.createDataFrame([*rows, ("",)], "t string")
    gated = [p for ps in [*lexicon.SKILLS.values(), *lexicon.PHRASE_BANKS.values()] for p in ps]
    df = df.withColumn("seen", patterns.held(F.col("t"), gated, lexicon.REQUIRED_HEADINGS))
    t, seen = F.col("t"), F.col("seen")
    for bank, ps in lexicon.PHRASE_BANKS.items():
        whole = F.regexp_count(t, F.lit(patterns.UNICODE + patterns.any_of(ps)))
        assert df.where(patterns.hits_any(t, ps, seen) != whole).collect() == [], bank
    for skill, ps in lexicon.SKILLS.items():
        whole = t.rlike(patterns.UNICODE + patterns.any_of(ps))
        assert df.where(patterns.found_any(t, ps, seen) != whole).collect() == [], skill
    for word in lexicon.REQUIRED_HEADINGS:
        assert df.where(t.contains(word) & ~patterns.holds(t, word, seen)).collect() == []


def test_first_characters_are_looked_at_first(spark):
    """A pattern that starts with digits, or a boundary and digits, is tried at digits only; matches are the same."""
    assert patterns._quick(lexicon.YEARS_GENERIC).startswith(r"(?=[\d])")
    assert patterns._quick(r"(?:ab)+c").startswith("(?=[a])") and patterns._quick(r"a?\d") == r"a?\d"
    texts = ["x 3+ years of experience", "x3 years of exp", "٣ yrs of exp", "é5 years of exp", "2 – 5 yrs", "12 years", "1-2years 3 years of exp", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in (lexicon.YEARS_GENERIC, lexicon.YEARS_RANGE, lexicon.GRAD_FRIENDLY, r"\bjava\b", r"\d{1,2}"):
        plain = patterns.UNICODE + pattern
        want = df.select(F.regexp_extract("t", plain, 0), F.col("t").rlike(plain), F.regexp_count("t", F.lit(plain))).collect()
        t = F.col("t")
        got = df.select(patterns.group(t, pattern, 0), patterns.found(t, pattern), patterns.hits(t, pattern)).collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in want]
