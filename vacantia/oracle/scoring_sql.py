"""Filters, features and scores as SQL.

Written apart from the Spark operators; only the fixed values are shared.  RE2
knows no look-around and its \\b is ASCII, so accented letters become ``_`` (a
word character in no pattern) and three skills are matched another way.
"""

from __future__ import annotations

from .. import lexicon as L
from ..plans.postings import AS_OF, postings_sql


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(text: str) -> str:
    """Text prepared for RE2: lower case, accented letters as word characters."""
    return f"regexp_replace(lower({text}), '[ªµºÀ-ÖØ-öø-ʯͰ-῿]', '_', 'g')"


def any_of(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(pattern)})"


def contains_any(text: str, tokens) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(t)})" for t in tokens) + ")"


def case(pairs, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {otherwise} END"


POSTINGS = f"postings AS MATERIALIZED ({postings_sql()})"


def title_matches(title: str) -> str:
    return (
        f"(coalesce({matches(words(title), any_of(L.TITLE_INCLUDE))}, false)"
        f" AND NOT coalesce({matches(words(title), any_of(L.TITLE_EXCLUDE))}, false))"
    )


def country_international(loc="location", remote="remote") -> str:
    return case(
        [
            (remote, "'Remote'"),
            (f"coalesce({loc}, '') = ''", "NULL"),
            (contains_any(f"lower({loc})", L.USA_TOKENS), "'USA'"),
            (contains_any(f"lower({loc})", L.EUROPE_TOKENS), "'Europe'"),
        ],
        "NULL",
    )


def country_egypt(loc="location", remote="remote") -> str:
    return case(
        [
            (f"coalesce({loc}, '') = ''", "'Egypt'"),
            (contains_any(f"lower({loc})", L.EGYPT_TOKENS), "'Egypt'"),
            (f"{remote} AND {contains_any(f'lower({loc})', L.MENA_WORDS)}", "'Egypt (Remote)'"),
        ],
        "NULL",
    )


def experience_excluded(text="description_text") -> str:
    t = words(f"coalesce({text}, '')")
    return f"({matches(t, L.EXPERIENCE_DEMAND)} AND NOT {matches(t, L.EXPERIENCE_JUNIOR_HINT)})"


def country(region="region") -> str:
    return f"CASE WHEN {region} = 'EGYPT' THEN {country_egypt()} ELSE {country_international()} END"


def passes(region="region") -> str:
    return f"({title_matches('title')} AND ({country(region)}) IS NOT NULL AND NOT {experience_excluded()})"


def filtered(src: str, region: str = "region", columns: str = "*") -> str:
    """Rows of a relation that pass, with their country."""
    return f"SELECT {columns}, {country(region)} AS country FROM {src} WHERE {passes(region)}"


def title_norm(title="title") -> str:
    t = f"trim(coalesce({title}, ''))"
    for pattern, value in L.TITLE_LEVELS + L.TITLE_ABBREVIATIONS:
        t = f"regexp_replace({t}, {q(pattern)}, {q(value.replace('$1', chr(92) + '1'))}, 'gi')"
    t = f"regexp_replace({t}, '[()\\[\\]]', ' ', 'g')"
    return f"lower(trim(regexp_replace({t}, '\\s+', ' ', 'g')))"


def skill_test(text: str, skill: str) -> str:
    if skill == "java":
        return matches(f"regexp_replace({text}, '\\bjava\\s*script', '#', 'g')", r"\bjava\b")
    if skill == "typescript":
        return matches(f"regexp_replace({text}, '\\bts\\s*-', '#', 'g')", r"\btypescript\b|\bts\b")
    if skill == "go":
        return matches(text, r"\bgolang\b|\bgo\s+lang\b|(?:^|[^\w-])go\s+(developer|engineer|programmer)")
    return matches(text, any_of(L.SKILLS[skill]))


def skill_list(text: str) -> str:
    items = ", ".join(f"CASE WHEN {skill_test(text, s)} THEN {q(s)} END" for s in L.SKILLS)
    return f"list_filter([{items}], lambda s: s IS NOT NULL)"


def section(text: str, headings) -> str:
    at = "least(" + ", ".join(f"coalesce(nullif(strpos({text}, {q(h)}), 0), 999999999)" for h in headings) + ")"
    return f"CASE WHEN {at} = 999999999 THEN '' ELSE substr({text}, {at}, {L.SECTION_CHARS}) END"


def years(text: str, pattern: str, group: int = 1) -> str:
    return f"TRY_CAST(nullif(regexp_extract({text}, {q(pattern)}, {group}), '') AS INTEGER)"


def count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {q(pattern)}))"


def name_norm(name="company_name") -> str:
    return f"regexp_replace(lower(trim({name})), '[^a-z0-9. ]', '', 'g')"


def tier(name="company_name", given: str | None = None) -> str:
    """``given`` is a tier found otherwise, taken instead of the terms."""
    norm = name_norm(name)
    pairs = [(f"coalesce({name}, '') = ''", "'unknown'")]
    pairs += [(contains_any(norm, terms), q(t)) for t, terms in L.COMPANY_TIERS.items()] if given is None else [
        (f"{given} IS NOT NULL", given)]
    pairs += [(matches(norm, p), q(t)) for t, p in L.COMPANY_PATTERNS.items()]
    return case(pairs, "'unknown'")


def occurrences(text: str, word: str) -> str:
    return f"((length({text}) - length(replace({text}, {q(word)}, ''))) // {len(word)})"


def feature_ctes(src: str, p: str = "", given_tier: str | None = None) -> list[str]:
    """CTEs ``{p}feat`` over a relation with key ``k`` and the scoring inputs."""
    t, tn = "t", "title_norm"
    seniority = case(
        [(matches(tn, pat), q(s)) for s, pat in L.SENIORITY]
        + [
            ("required_years >= 7", "'staff'"), ("required_years >= 5", "'senior'"),
            ("required_years >= 3", "'mid'"), ("required_years <= 2", "'junior'"),
            (matches(t, L.GRADUATE_PROGRAMME), "'graduate'"),
        ],
        "'unknown'",
    )
    banks = ", ".join(
        count(f"{t} || ' ' || {tn}" if b in L.BANKS_WITH_TITLE else t, any_of(pats)) + f" AS hits_{b}"
        for b, pats in L.PHRASE_BANKS.items()
    )
    stuffing = ", ".join(f"{occurrences(t, w)} AS n_{w}" for w in L.STUFFING_KEYWORDS)
    return [
        f"{p}f1 AS MATERIALIZED (SELECT *, {title_norm()} AS {tn}, {words(chr(99) + 'oalesce(description_text, {})'.format(q('')))} AS t FROM {src})",
        f"""{p}f2 AS MATERIALIZED (SELECT *, {years(t, L.YEARS_HARD)} AS hard, {years(t, L.YEARS_SOFT)} AS soft,
 {years(t, L.YEARS_RANGE, 1)} AS range_min, {years(t, L.YEARS_RANGE, 2)} AS range_max,
 {years(t, L.YEARS_GENERIC)} AS generic, {matches(t, L.GRAD_FRIENDLY)} AS grad_friendly,
 {section(t, L.PREFERRED_HEADINGS)} AS pref, {section(t, L.REQUIRED_HEADINGS)} AS req,
 {case([(matches(tn, pat), q(s)) for s, pat in L.SPECIALIZATION], "'unknown'")} AS specialization,
 length(coalesce(description_text, '')) AS description_chars,
 {skill_list(tn)} AS skills_title, {skill_list(t)} AS skills_description,
 {tier(given=given_tier)} AS company_tier, {banks}, {stuffing} FROM {p}f1)""",
        f"""{p}f3 AS MATERIALIZED (SELECT *,
 CASE WHEN hard IS NULL AND soft IS NULL AND range_min IS NULL THEN generic ELSE hard END AS required_years,
 soft AS preferred_years,
 list_concat(skills_title, list_filter(skills_description, lambda s: NOT list_contains(skills_title, s))) AS skills,
 {skill_list("pref")} AS in_pref, {skill_list("req")} AS in_req FROM {p}f2)""",
        f"""{p}f4 AS MATERIALIZED (SELECT *, {seniority} AS seniority,
 list_filter(skills, lambda s: list_contains(in_pref, s) AND NOT list_contains(in_req, s)) AS skills_preferred
 FROM {p}f3)""",
        f"""{p}feat AS MATERIALIZED (SELECT *, list_filter(skills, lambda s: (list_contains(in_req, s) OR
 list_contains(skills_title, s)) AND NOT list_contains(skills_preferred, s)) AS skills_required FROM {p}f4)""",
    ]


def _has(skill: str, where: str = "skills") -> str:
    return f"list_contains({where}, '{skill}')"


def _shared(skills) -> str:
    return f"len(list_filter(skills, lambda s: s IN ({', '.join(map(q, skills))})))"


def _age(as_of: str) -> str:
    return f"CAST(floor((epoch_us(TIMESTAMP '{as_of}') - epoch_us(posted_at)) / 86400000000.0) AS INTEGER)"


def rule_rows(as_of: str = AS_OF):
    """(name, category, points, reason, condition); conditions exclude each other where needed."""
    sen = [("staff", -50, "Staff/Principal (too senior)"), ("lead", -45, "Lead/Manager/Architect (too senior)"),
           ("senior", -40, "Senior level (too senior)"), ("mid", 6, "Mid-level (acceptable)"),
           ("junior", 18, "Junior / Associate / Entry-level"), ("graduate", 20, "New Grad / Graduate Program"),
           ("intern", -30, "Internship (not applicable)")]
    for s, pts, why in sen:
        yield f"seniority_{s}", "seniority", pts, q(why), f"seniority = '{s}'"

    spec = "specialization"
    g, fs = "specialization = 'generic_swe'", "specialization = 'fullstack'"
    lean = "(" + " OR ".join(map(_has, ("java", "spring", "kafka", "microservices"))) + ")"
    yield "spec_backend", spec, 15, q("Backend specialization"), "specialization = 'backend'"
    yield ("spec_generic_swe_engineering_heavy", spec, 15,
           "'Generic SWE but engineering-heavy (' || hits_eng_heavy || ' signals)'", f"{g} AND hits_eng_heavy >= 2")
    yield "spec_generic_swe", spec, 8, q("Generic SWE with some engineering content"), f"{g} AND hits_eng_heavy = 1"
    yield "spec_generic_swe_thin", spec, 2, q("Generic SWE (no strong engineering signals)"), f"{g} AND hits_eng_heavy = 0"
    yield "spec_fullstack_backend_leaning", spec, 4, q("Fullstack but backend-leaning"), f"{fs} AND {lean}"
    yield "spec_fullstack_neutral", spec, -12, q("Fullstack (less backend focus)"), f"{fs} AND NOT {lean}"
    for name, key, pts, why in [
        ("penalty_frontend_heavy", "frontend", -35, "Frontend specialization (out of scope)"),
        ("penalty_mobile", "mobile", -40, "Mobile (out of scope)"),
        ("penalty_ml", "ml", -35, "ML/AI (out of scope)"),
        ("penalty_data", "data", -35, "Data engineering (out of scope)"),
        ("penalty_devops", "devops", -25, "DevOps/SRE (adjacent)"),
        ("penalty_qa", "qa", -35, "QA/Testing (out of scope)"),
        ("penalty_security", "security", -30, "Security engineering (out of scope)"),
        ("penalty_embedded", "embedded", -25, "Embedded/Firmware (out of scope)"),
        ("penalty_game", "game", -30, "Game development (out of scope)"),
    ]:
        yield name, spec, pts, q(why), f"specialization = '{key}'"

    st = "stack"
    yield "stack_java_title", st, 14, q("Java in title"), _has("java", "skills_title")
    yield "stack_spring_title", st, 14, q("Spring in title"), _has("spring", "skills_title")
    yield "stack_microservices_title", st, 8, q("Microservices in title"), _has("microservices", "skills_title")
    for s, label in (("java", "Java"), ("spring", "Spring")):
        need = _has(s, "skills_required")
        yield (f"stack_{s}_desc", st, f"CASE WHEN {need} THEN 9 ELSE 5 END",
               f"'{label} in description (' || CASE WHEN {need} THEN 'required' ELSE 'preferred' END || ')'",
               f"{_has(s)} AND NOT {_has(s, 'skills_title')}")
    yield "stack_hibernate_jpa", st, 5, q("JPA / Hibernate mentioned"), f"({_has('hibernate')} OR {_has('jpa')})"
    yield "stack_kafka", st, 4, q("Kafka mentioned"), _has("kafka")
    yield ("stack_microservices_desc", st, 3, q("Microservices in description"),
           f"{_has('microservices')} AND NOT {_has('microservices', 'skills_title')}")
    yield "stack_redis", st, 2, q("Redis mentioned"), _has("redis")
    yield "stack_relational_db", st, 2, q("Postgres/MySQL mentioned"), f"({_has('postgres')} OR {_has('mysql')})"
    yield "stack_containerization", st, 3, q("Docker / Kubernetes mentioned"), f"({_has('docker')} OR {_has('kubernetes')})"
    yield "stack_rest_api", st, 2, q("REST APIs mentioned"), _has("rest")
    yield "stack_auth", st, 2, q("JWT/OAuth/Keycloak mentioned"), f"({_has('jwt')} OR {_has('oauth')} OR {_has('keycloak')})"
    java, modern = _shared(L.JAVA_CORE), _shared(L.MODERN_CORE)
    yield ("stack_java_backend_synergy", st, f"CASE {java} WHEN 3 THEN 5 WHEN 4 THEN 8 ELSE 11 END",
           f"'Coherent Java backend stack (' || {java} || '/5)'", f"{java} >= 3")
    yield ("stack_modern_backend_synergy", st, f"CASE {modern} WHEN 4 THEN 5 WHEN 5 THEN 8 ELSE 10 END",
           f"'Modern backend stack (' || {modern} || ' components)'", f"{modern} >= 4")
    both = sorted(set(L.JAVA_CORE + L.MODERN_CORE))
    yield ("penalty_frontend_heavy_stack", st, -18, q("Frontend-heavy stack with no backend balance"),
           f"{_shared(L.FRONTEND_SKILLS)} >= 2 AND {_shared(both)} < 2")
    langs = f"list_sort(list_filter(skills, lambda s: s IN ({', '.join(map(q, L.OTHER_BACKEND_LANGS))})))"
    yield ("penalty_non_java_backend", st, -8, f"'Backend role in ' || array_to_string({langs}, ', ') || ' (no Java)'",
           f"specialization = 'backend' AND len({langs}) > 0 AND NOT {_has('java')}")

    ex, y = "experience", "required_years"
    yield "exp_grad_friendly", ex, 10, q("Grad-friendly wording"), "grad_friendly"
    yield ("exp_range_0_2", ex, 6, "'Experience range ' || coalesce(range_min, 0) || '–' || range_max || ' years'",
           "range_max <= 2")
    yield "exp_required_low", ex, 6, f"'Required: ' || {y} || '+ years'", f"{y} <= 1"
    yield "exp_required_two", ex, 2, q("Required: 2+ years"), f"{y} = 2"
    yield "exp_required_three", ex, -8, q("Required: 3+ years"), f"{y} = 3"
    yield "exp_required_four", ex, -14, q("Required: 4+ years"), f"{y} = 4"
    yield "exp_required_high", ex, -25, f"'Required: ' || {y} || '+ years (out of range)'", f"{y} >= 5"

    lo, c = "location", "lower(coalesce(country, ''))"
    usa = f"(contains({c}, 'usa') OR contains({c}, 'united states') OR {c} = 'us')"
    europe = f"(contains({c}, 'europe') OR {c} = 'eu' OR {contains_any(c, L.EUROPE_COUNTRY_WORDS)})"
    yield "location_remote", lo, 7, q("Remote-friendly"), "remote"
    yield ("location_egypt", lo, 6, q("Located in Egypt"),
           f"region = 'EGYPT' AND {contains_any(c, ['egypt', *L.EGYPT_CITIES])}")
    yield "location_usa", lo, 3, q("USA location"), f"region <> 'EGYPT' AND {usa}"
    yield "location_europe", lo, 3, q("Europe location"), f"region <> 'EGYPT' AND NOT {usa} AND {europe}"

    co = "company"
    for t, pts, why in (("s", 15, "Tier-S iconic company"), ("a", 9, "Tier-A strong international company"),
                        ("b", 4, "Tier-B recognized company"), ("eg_t1", 7, "Recognized Egypt employer")):
        yield f"company_tier_{t}", co, pts, f"'{why} (' || company_name || ')'", f"company_tier = '{t}'"
    yield "penalty_company_spam", co, -18, q("Staffing / recruitment-agency posting"), "company_tier = 'spam'"
    yield "penalty_company_vague", co, -8, q("Vague employer (Confidential / Our Client)"), "company_tier = 'vague'"

    re_, age = "recency", _age(as_of)
    yield "recency_today", re_, 3, q("Posted within 24h"), f"{age} <= 1"
    yield "recency_three_days", re_, 2, q("Posted within 3 days"), f"{age} BETWEEN 2 AND 3"
    yield "recency_week", re_, 1, q("Posted within a week"), f"{age} BETWEEN 4 AND 7"
    yield "recency_stale", re_, -3, f"'Posted ' || {age} || ' days ago'", f"{age} > 60"

    def plural(h):
        return f"CASE WHEN {h} = 1 THEN '' ELSE 's' END"

    def hit(name, cat, bank, pts, why, lowest=1):
        return name, cat, pts.replace("h", f"hits_{bank}"), why.replace("#h", f"hits_{bank}").replace("#s", plural(f"hits_{bank}")), f"hits_{bank} >= {lowest}"

    yield hit("visa_relocation", "visa", "visa", "least(h * 6, 14)",
              "'Visa sponsorship / relocation language (' || #h || ' phrase' || #s || ')'")
    yield hit("modern_scale_signals", "modern_eng", "scale", "least(h * 4, 12)",
              "'Scale/distributed-systems language (' || #h || ' signals)'")
    yield hit("modern_platform_signals", "modern_eng", "platform", "least(h * 3, 9)",
              "'Platform/infrastructure language (' || #h || ' signals)'")
    yield hit("growth_signals", "growth", "growth", "least(h * 3, 9)",
              "'Career-growth language (' || #h || ' phrase' || #s || ')'")
    yield hit("penalty_support_role", "role_intent", "support", "-least(h * 8, 20)",
              "'Support/helpdesk language (' || #h || ' signals)'")
    yield hit("penalty_legacy_stack", "role_intent", "legacy", "-least(h * 5, 14)",
              "'Legacy maintenance language (' || #h || ' signals)'")
    yield hit("penalty_low_eng", "role_intent", "low_eng", "-least(h * 6, 14)",
              "'Low-eng / CMS / low-code (' || #h || ' signals)'")
    ql = "quality"
    yield "penalty_thin_description", ql, -6, q("Very short job description (<200 chars)"), "description_chars < 200"
    yield "quality_substantive_description", ql, 2, q("Detailed job description"), "description_chars > 1500"
    yield hit("penalty_spam_phrasing", ql, "spam", "-least(h * 6, 14)",
              "'Spammy phrasing (' || #h || ' phrase' || #s || ')'")
    yield hit("penalty_buzzword_stuffing", ql, "buzzword", "-least((h - 2) * 3, 9)",
              "'Buzzword-heavy (' || #h || ' buzzwords)'", 3)
    earlier = ""
    for w in L.STUFFING_KEYWORDS:
        yield (f"penalty_keyword_stuffing_{w}", ql, -4, f"'Keyword ''{w}'' repeated ' || n_{w} || ' times'",
               f"n_{w} >= 8{earlier}")
        earlier += f" AND n_{w} < 8"


def own_rule_rows():
    """The rules with those of query g02 laid over them."""
    wide = "len(skills)"
    for row in rule_rows():
        if row[0] == "stack_kafka":
            yield "stack_kafka", "stack", 6, q("Kafka wanted"), _has("kafka", "skills_required")
        elif row[0] != "stack_redis":
            yield row
        if row[0] == "seniority_intern":
            yield "seniority_open", "seniority", -1, q("Level not told"), "seniority = 'unknown'"
    yield "stack_wide", "stack", f"least({wide} - 5, 4)", f"'Wide stack (' || {wide} || ' skills)'", f"{wide} >= 6"
    yield "text_long", "quality", 3, "'Long text: ' || description_chars", "description_chars > 2500"
    yield "text_medium", "quality", 1, q("Some text"), "description_chars BETWEEN 1001 AND 2500"


def _weight(name: str) -> str:
    eg, intl = L.STRATEGIES["EGYPT"].get(name, 1.0), L.STRATEGIES["INTERNATIONAL"].get(name, 1.0)
    return f"CASE WHEN region = 'EGYPT' THEN CAST({eg} AS DOUBLE) ELSE CAST({intl} AS DOUBLE) END"


LABEL = case([(f"score >= {low}", q(label)) for low, label in L.QUALITY_LABELS[:-1]], q(L.QUALITY_LABELS[-1][1]))


def score_ctes(src: str, p: str = "", as_of: str = AS_OF, rules=None, given_tier: str | None = None) -> list[str]:
    """CTEs up to ``{p}scored`` (the features, raw_score, score, confidence, quality_label)."""
    rows = " UNION ALL ".join(
        f"SELECT k, {i} AS n, {q(name)} AS name, {q(cat)} AS category, CAST({pts} AS DOUBLE) AS base_points, "
        f"CAST({pts} AS DOUBLE) * {_weight(name)} AS final_points, {why} AS reason FROM {p}feat WHERE {cond}"
        for i, (name, cat, pts, why, cond) in enumerate(rules or rule_rows(as_of))
    )
    return feature_ctes(src, p, given_tier) + [
        f"{p}rules AS MATERIALIZED ({rows})",
        f"""{p}sums AS (SELECT k, sum(final_points ORDER BY n) AS raw,
 count(*) FILTER (final_points > 0) AS ups, count(*) FILTER (final_points < 0) AS downs FROM {p}rules GROUP BY k)""",
        f"""{p}s1 AS (SELECT f.*, coalesce(raw, 0.0) AS raw_score,
 CAST(greatest(0, least(100, round_even(coalesce(raw, 0.0), 0))) AS INTEGER) AS score,
 CAST(greatest(0, least(100, 30 + least(35, 4 * coalesce(ups, 0)) + least(10, 2 * coalesce(downs, 0))
  + CASE WHEN description_chars >= 500 THEN 12 ELSE 0 END + CASE WHEN seniority <> 'unknown' THEN 6 ELSE 0 END
  + CASE WHEN specialization <> 'unknown' THEN 6 ELSE 0 END
  - CASE WHEN seniority IN ('junior', 'graduate', 'intern') AND required_years >= 4 THEN 18 ELSE 0 END)) AS INTEGER)
  AS confidence FROM {p}feat f LEFT JOIN {p}sums USING (k))""",
        f"{p}scored AS MATERIALIZED (SELECT *, {LABEL} AS quality_label FROM {p}s1)",
    ]


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
