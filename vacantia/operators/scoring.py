"""Explainable score: rules over features, weighted by region.

A *slot* is a list of rules of which at most one fires, the first whose
condition holds.  To add a rule, add a slot (or a rule in one) here, or lay a table of rules over the
slots (``rules``); to tune weights, pass other strategies.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon
from ..functions.patterns import has_any
from ..functions.times import age_days, clock
from ..session import once_per_session, settled
from .features import FEATURE_COLUMNS, features

DEFAULT_REGION = "INTERNATIONAL"


@dataclass(frozen=True)
class Rule:
    name: str
    category: str
    points: float | Column
    reason: str | Column
    when: Column


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _plural(n: Column) -> Column:
    return F.when(n == 1, "").otherwise("s")


def _has(skill: str, where: str = "skills") -> Column:
    return F.array_contains(where, skill)


def _any(*skills: str) -> Column:
    return F.arrays_overlap(F.col("skills"), F.array(*map(F.lit, skills)))


def _shared(skills) -> Column:
    return F.array_intersect(F.col("skills"), F.array(*map(F.lit, skills)))


def _steps(n: Column, first: int, *points: int) -> Column:
    """Points for n = first, first + 1, ...; the last for more."""
    chain = F
    for i, p in enumerate(points[:-1]):
        chain = chain.when(n == first + i, p)
    return chain.otherwise(points[-1])


def _seniority() -> list[list[Rule]]:
    table = [
        ("staff", -50, "Staff/Principal (too senior)"),
        ("lead", -45, "Lead/Manager/Architect (too senior)"),
        ("senior", -40, "Senior level (too senior)"),
        ("mid", 6, "Mid-level (acceptable)"),
        ("junior", 18, "Junior / Associate / Entry-level"),
        ("graduate", 20, "New Grad / Graduate Program"),
        ("intern", -30, "Internship (not applicable)"),
    ]
    return [[Rule(f"seniority_{k}", "seniority", p, r, F.col("seniority") == k) for k, p, r in table]]


def _specialization() -> list[list[Rule]]:
    spec, heavy = F.col("specialization"), F.col("hits_eng_heavy")
    generic, full = spec == "generic_swe", spec == "fullstack"

    def rule(name, points, reason, when):
        return Rule(name, "specialization", points, reason, when)

    out_of_scope = [
        ("penalty_frontend_heavy", "frontend", -35, "Frontend specialization (out of scope)"),
        ("penalty_mobile", "mobile", -40, "Mobile (out of scope)"),
        ("penalty_ml", "ml", -35, "ML/AI (out of scope)"),
        ("penalty_data", "data", -35, "Data engineering (out of scope)"),
        ("penalty_devops", "devops", -25, "DevOps/SRE (adjacent)"),
        ("penalty_qa", "qa", -35, "QA/Testing (out of scope)"),
        ("penalty_security", "security", -30, "Security engineering (out of scope)"),
        ("penalty_embedded", "embedded", -25, "Embedded/Firmware (out of scope)"),
        ("penalty_game", "game", -30, "Game development (out of scope)"),
    ]
    return [
        [
            rule("spec_backend", 15, "Backend specialization", spec == "backend"),
            rule(
                "spec_generic_swe_engineering_heavy", 15,
                _text("Generic SWE but engineering-heavy (", heavy, " signals)"), generic & (heavy >= 2),
            ),
            rule("spec_generic_swe", 8, "Generic SWE with some engineering content", generic & (heavy == 1)),
            rule("spec_generic_swe_thin", 2, "Generic SWE (no strong engineering signals)", generic),
            rule(
                "spec_fullstack_backend_leaning", 4, "Fullstack but backend-leaning",
                full & _any("java", "spring", "kafka", "microservices"),
            ),
            rule("spec_fullstack_neutral", -12, "Fullstack (less backend focus)", full),
        ]
        + [rule(name, points, reason, spec == key) for name, key, points, reason in out_of_scope]
    ]


def _stack() -> list[list[Rule]]:
    def one(name, points, reason, when):
        return [Rule(name, "stack", points, reason, when)]

    def described(skill, label):
        need = _has(skill, "skills_required")
        return one(
            f"stack_{skill}_desc", F.when(need, 9).otherwise(5),
            _text(f"{label} in description (", F.when(need, "required").otherwise("preferred"), ")"),
            _has(skill) & ~_has(skill, "skills_title"),
        )

    java = F.size(_shared(lexicon.JAVA_CORE))
    modern = F.size(_shared(lexicon.MODERN_CORE))
    frontend = F.size(_shared(lexicon.FRONTEND_SKILLS))
    core = list(dict.fromkeys(lexicon.JAVA_CORE + lexicon.MODERN_CORE))
    others = F.array_sort(_shared(lexicon.OTHER_BACKEND_LANGS))
    return [
        one("stack_java_title", 14, "Java in title", _has("java", "skills_title")),
        one("stack_spring_title", 14, "Spring in title", _has("spring", "skills_title")),
        one("stack_microservices_title", 8, "Microservices in title", _has("microservices", "skills_title")),
        described("java", "Java"),
        described("spring", "Spring"),
        one("stack_hibernate_jpa", 5, "JPA / Hibernate mentioned", _any("hibernate", "jpa")),
        one("stack_kafka", 4, "Kafka mentioned", _has("kafka")),
        one(
            "stack_microservices_desc", 3, "Microservices in description",
            _has("microservices") & ~_has("microservices", "skills_title"),
        ),
        one("stack_redis", 2, "Redis mentioned", _has("redis")),
        one("stack_relational_db", 2, "Postgres/MySQL mentioned", _any("postgres", "mysql")),
        one("stack_containerization", 3, "Docker / Kubernetes mentioned", _any("docker", "kubernetes")),
        one("stack_rest_api", 2, "REST APIs mentioned", _has("rest")),
        one("stack_auth", 2, "JWT/OAuth/Keycloak mentioned", _any("jwt", "oauth", "keycloak")),
        one(
            "stack_java_backend_synergy", _steps(java, 3, 5, 8, 11),
            _text("Coherent Java backend stack (", java, "/5)"), java >= 3,
        ),
        one(
            "stack_modern_backend_synergy", _steps(modern, 4, 5, 8, 10),
            _text("Modern backend stack (", modern, " components)"), modern >= 4,
        ),
        one(
            "penalty_frontend_heavy_stack", -18, "Frontend-heavy stack with no backend balance",
            (frontend >= 2) & (F.size(_shared(core)) < 2),
        ),
        one(
            "penalty_non_java_backend", -8,
            _text("Backend role in ", F.array_join(others, ", "), " (no Java)"),
            (F.col("specialization") == "backend") & (F.size(others) > 0) & ~_has("java"),
        ),
    ]


def _experience() -> list[list[Rule]]:
    years, low, high = F.col("required_years"), F.col("range_min"), F.col("range_max")

    def rule(name, points, reason, when):
        return Rule(name, "experience", points, reason, when)

    return [
        [rule("exp_grad_friendly", 10, "Grad-friendly wording", F.col("grad_friendly"))],
        [
            rule(
                "exp_range_0_2", 6,
                _text("Experience range ", F.coalesce(low, F.lit(0)), "–", high, " years"), high <= 2,
            )
        ],
        [
            rule("exp_required_low", 6, _text("Required: ", years, "+ years"), years <= 1),
            rule("exp_required_two", 2, "Required: 2+ years", years == 2),
            rule("exp_required_three", -8, "Required: 3+ years", years == 3),
            rule("exp_required_four", -14, "Required: 4+ years", years == 4),
            rule("exp_required_high", -25, _text("Required: ", years, "+ years (out of range)"), years >= 5),
        ],
    ]


def _location() -> list[list[Rule]]:
    country = F.lower(F.coalesce("country", F.lit("")))
    egypt = F.col("region") == "EGYPT"
    usa = country.contains("usa") | country.contains("united states") | (country == "us")
    europe = country.contains("europe") | (country == "eu") | has_any(country, lexicon.EUROPE_COUNTRY_WORDS)
    local = has_any(country, ["egypt", *lexicon.EGYPT_CITIES])
    return [
        [Rule("location_remote", "location", 7, "Remote-friendly", F.col("remote"))],
        [
            Rule("location_egypt", "location", 6, "Located in Egypt", egypt & local),
            Rule("location_usa", "location", 3, "USA location", ~egypt & usa),
            Rule("location_europe", "location", 3, "Europe location", ~egypt & europe),
        ],
    ]


def _company() -> list[list[Rule]]:
    tier, name = F.col("company_tier"), F.col("company_name")
    return [
        [
            Rule("company_tier_s", "company", 15, _text("Tier-S iconic company (", name, ")"), tier == "s"),
            Rule(
                "company_tier_a", "company", 9,
                _text("Tier-A strong international company (", name, ")"), tier == "a",
            ),
            Rule("company_tier_b", "company", 4, _text("Tier-B recognized company (", name, ")"), tier == "b"),
            Rule(
                "company_tier_eg_t1", "company", 7,
                _text("Recognized Egypt employer (", name, ")"), tier == "eg_t1",
            ),
            Rule("penalty_company_spam", "company", -18, "Staffing / recruitment-agency posting", tier == "spam"),
            Rule("penalty_company_vague", "company", -8, "Vague employer (Confidential / Our Client)", tier == "vague"),
        ]
    ]


def _recency(as_of: Column) -> list[list[Rule]]:
    # days are rounded down: "today" covers less than 48 hours and all the future
    age = age_days(F.col("posted_at"), as_of)
    return [
        [
            Rule("recency_today", "recency", 3, "Posted within 24h", age <= 1),
            Rule("recency_three_days", "recency", 2, "Posted within 3 days", age <= 3),
            Rule("recency_week", "recency", 1, "Posted within a week", age <= 7),
            Rule("recency_stale", "recency", -3, _text("Posted ", age, " days ago"), age > 60),
        ]
    ]


def _phrases() -> list[list[Rule]]:
    """Capped points per hit of a phrase bank."""

    def bank(key, name, category, each, cap, *reason, free=0):
        n = F.col(f"hits_{key}")
        sign = 1 if each > 0 else -1
        points = F.least((n - free) * abs(each), F.lit(cap)) * sign
        words = [n if part is Ellipsis else _plural(n) if part == "{s}" else part for part in reason]
        return [Rule(name, category, points, _text(*words), n > free)]

    return [
        bank("visa", "visa_relocation", "visa", 6, 14,
             "Visa sponsorship / relocation language (", ..., " phrase", "{s}", ")"),
        bank("scale", "modern_scale_signals", "modern_eng", 4, 12,
             "Scale/distributed-systems language (", ..., " signals)"),
        bank("platform", "modern_platform_signals", "modern_eng", 3, 9,
             "Platform/infrastructure language (", ..., " signals)"),
        bank("growth", "growth_signals", "growth", 3, 9, "Career-growth language (", ..., " phrase", "{s}", ")"),
        bank("support", "penalty_support_role", "role_intent", -8, 20,
             "Support/helpdesk language (", ..., " signals)"),
        bank("legacy", "penalty_legacy_stack", "role_intent", -5, 14,
             "Legacy maintenance language (", ..., " signals)"),
        bank("low_eng", "penalty_low_eng", "role_intent", -6, 14,
             "Low-eng / CMS / low-code (", ..., " signals)"),
        _length(),
        bank("spam", "penalty_spam_phrasing", "quality", -6, 14, "Spammy phrasing (", ..., " phrase", "{s}", ")"),
        bank("buzzword", "penalty_buzzword_stuffing", "quality", -3, 9,
             "Buzzword-heavy (", ..., " buzzwords)", free=2),
        _stuffing(),
    ]


def _length() -> list[Rule]:
    chars = F.col("description_chars")
    return [
        Rule("penalty_thin_description", "quality", -6, "Very short job description (<200 chars)", chars < 200),
        Rule("quality_substantive_description", "quality", 2, "Detailed job description", chars > 1500),
    ]


def _stuffing() -> list[Rule]:
    rules = []
    for i, word in enumerate(lexicon.STUFFING_KEYWORDS):
        n = F.col("keyword_counts")[i]
        reason = _text(f"Keyword '{word}' repeated ", n, " times")
        rules.append(Rule(f"penalty_keyword_stuffing_{word}", "quality", -4, reason, n >= 8))
    return rules


def rule_slots(as_of: Column) -> list[list[Rule]]:
    """All rules in the order in which they are reported and summed."""
    return [
        *_seniority(), *_specialization(), *_stack(), *_experience(), *_location(),
        *_company(), *_recency(as_of), *_phrases(),
    ]


def multiplier(name: str, strategies: Mapping[str, Mapping[str, float]]) -> Column:
    """A rule's weight in the posting's region; regions without a strategy use the default one."""
    base = strategies[DEFAULT_REGION].get(name, 1.0)
    chain = F
    for region, weights in strategies.items():
        if weights.get(name, 1.0) != base:
            chain = chain.when(F.col("region") == region, F.lit(float(weights.get(name, 1.0))))
    return F.lit(float(base)) if chain is F else chain.otherwise(float(base))


def _fire(slot: list[Rule], strategies) -> Column:
    chain = F
    for rule in slot:
        points = rule.points.cast("double") if isinstance(rule.points, Column) else F.lit(float(rule.points))
        reason = rule.reason if isinstance(rule.reason, Column) else F.lit(rule.reason)
        chain = chain.when(
            rule.when,
            F.struct(
                F.lit(rule.name).alias("name"),
                F.lit(rule.category).alias("category"),
                points.alias("base_points"),
                (points * multiplier(rule.name, strategies)).alias("final_points"),
                reason.alias("reason"),
            ),
        )
    return chain.otherwise(None)


def quality_label(score: Column) -> Column:
    chain = F
    for low, label in lexicon.QUALITY_LABELS[:-1]:
        chain = chain.when(score >= low, label)
    return chain.otherwise(lexicon.QUALITY_LABELS[-1][1])


def _confidence() -> Column:
    rules = F.col("triggered_rules")
    ups = F.size(F.filter(rules, lambda r: r["final_points"] > 0))
    downs = F.size(F.filter(rules, lambda r: r["final_points"] < 0))
    seniority = F.col("seniority")
    doubt = seniority.isin("junior", "graduate", "intern") & (F.col("required_years") >= 4)
    total = (
        F.lit(30)
        + F.least(F.lit(35), ups * 4)
        + F.least(F.lit(10), downs * 2)
        + F.when(F.col("description_chars") >= 500, 12).otherwise(0)
        + F.when(seniority != "unknown", 6).otherwise(0)
        + F.when(F.col("specialization") != "unknown", 6).otherwise(0)
        - F.when(doubt, 18).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int")


def _triggered(as_of, strategies, slots=None) -> Column:
    slots = rule_slots(clock(as_of)) if slots is None else slots
    fired = F.array(*[_fire(slot, strategies) for slot in slots])
    return F.filter(fired, lambda r: r.isNotNull() & (r["final_points"] != 0))


@once_per_session
def _default_triggered(as_of: str) -> Column:
    return _triggered(as_of, lexicon.STRATEGIES)


def apply_rules(df: DataFrame, as_of, strategies=None, slots=None) -> DataFrame:
    """Score parsed postings: adds triggered_rules, raw_score, score, confidence and label.

    ``slots`` are rules to be taken for those of ``rule_slots``.
    """
    common = strategies is None and slots is None and isinstance(as_of, str)
    strategies = strategies or lexicon.STRATEGIES
    triggered = _default_triggered(as_of) if common else _triggered(as_of, strategies, slots)
    df = df.withColumn("triggered_rules", settled(triggered))
    # summed in rule order, so that halves round the same way everywhere
    raw = F.aggregate("triggered_rules", F.lit(0.0), lambda acc, r: acc + r["final_points"])
    df = df.withColumns({"raw_score": settled(raw), "confidence": _confidence()})
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.rint("raw_score").cast("int")))
    df = df.withColumn("score", score)
    strategy = F.when(F.col("region").isin(*strategies), F.col("region")).otherwise(DEFAULT_REGION)
    return df.withColumns({"quality_label": quality_label(F.col("score")), "strategy": strategy})


def score(df: DataFrame, as_of, strategies=None, slots=None, **tuned) -> DataFrame:
    """Postings to scored postings; the features used on the way are dropped.

    Needs title, description_text, remote, country, region, posted_at and company_name.
    ``tuned`` are vocabulary, banks and tiers of ``features``.
    """
    return apply_rules(features(df, **tuned), as_of, strategies, slots).drop(*FEATURE_COLUMNS)


def score_only(df: DataFrame, as_of, *ids: str, strategies=None) -> DataFrame:
    return score(df, as_of, strategies).select(*ids, "score")


def breakdown() -> Column:
    """What is stored with a job: the score and why, points rounded for display."""
    rules = F.col("triggered_rules")
    shown = F.transform(rules, lambda r: r.withField("final_points", F.bround(r["final_points"], 2)))
    return F.struct(
        F.col("score"),
        F.bround("raw_score", 2).alias("raw_score"),
        F.col("confidence"),
        F.col("quality_label"),
        F.col("region"),
        F.col("strategy"),
        shown.alias("triggered_rules"),
        F.transform(F.filter(rules, lambda r: r["final_points"] > 0), lambda r: r["reason"]).alias("positives"),
        F.transform(F.filter(rules, lambda r: r["final_points"] < 0), lambda r: r["reason"]).alias("negatives"),
    )


def explain_rules(df: DataFrame, *ids: str) -> DataFrame:
    """One row per triggered rule, with the weight that was in effect."""
    rows = df.select(*ids, F.posexplode("triggered_rules").alias("rule_no", "r"))
    return rows.select(
        *ids,
        "rule_no",
        F.col("r.name").alias("name"),
        F.col("r.category").alias("category"),
        F.col("r.base_points").alias("base_points"),
        F.col("r.final_points").alias("final_points"),
        F.bround(F.col("r.final_points") / F.col("r.base_points"), 2).alias("multiplier"),
        F.col("r.reason").alias("reason"),
    )


def summary(up: int = 4, down: int = 3) -> list[Column]:
    """The first reasons for and against, from a stored breakdown."""
    return [
        F.slice("score_breakdown.positives", 1, up).alias("top_positives"),
        F.slice("score_breakdown.negatives", 1, down).alias("top_negatives"),
    ]
