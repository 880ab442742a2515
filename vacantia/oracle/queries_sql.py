"""One DuckDB statement per registered query."""

from __future__ import annotations

from .. import lexicon as L
from ..operators.scoring import DEFAULT_REGION
from ..plans import payloads as P
from ..plans import runs
from ..plans.postings import AS_OF
from . import merge_sql as M
from . import scoring_sql as S

TS = "'%Y-%m-%d %H:%M:%S'"


def ts(column: str) -> str:
    return f"strftime({column}, {TS}) AS {column.split('.')[-1]}"


def plain(select: str) -> str:
    return S.with_(S.POSTINGS, select=select)


def collapsed(text: str) -> str:
    return f"nullif(trim(regexp_replace({text}, '\\s+', ' ', 'g')), '')"


_SRC = f"src AS (SELECT *, doc_id AS k, {S.country()} AS country FROM postings)"


def featured(select: str) -> str:
    return S.with_(S.POSTINGS, _SRC, *S.feature_ctes("src"), select=select)


def own_tiers(select: str) -> str:
    """Postings of the customers; employer tiers by parts of the suppliers' names."""
    tiers = "CASE s_nationkey % 4 " + " ".join(f"WHEN {i} THEN {S.q(t)}" for i, t in enumerate(L.COMPANY_TIERS)) + " END"
    ctes = [
        S.POSTINGS,
        f"""named AS (SELECT p.* REPLACE (CASE WHEN doc_id % 3 > 0 THEN c_name ELSE company_name END AS company_name)
 FROM postings p LEFT JOIN customer ON c_custkey = doc_id)""",
        f"""own AS (SELECT s_nationkey % 4 AS place, {tiers} AS tier,
 CASE WHEN s_suppkey % 3 = 0 THEN right(s_name, 2) ELSE right(s_name, 4) END AS term FROM supplier)""",
        f"names AS (SELECT DISTINCT {S.name_norm()} AS name FROM named WHERE company_name IS NOT NULL)",
        "met AS (SELECT name, arg_min(tier, place) AS own_tier FROM names JOIN own ON contains(name, term) GROUP BY name)",
        f"src AS (SELECT p.*, doc_id AS k, {S.country()} AS country, own_tier FROM named p LEFT JOIN met ON name = {S.name_norm()})",
    ]
    return S.with_(*ctes, *S.score_ctes("src", given_tier="own_tier"), select=select)


def scored(select: str, as_of: str = AS_OF) -> str:
    return S.with_(S.POSTINGS, _SRC, *S.score_ctes("src", as_of=as_of), select=select)


def merged(run: int, select: str, *ctes: str) -> str:
    return S.with_(*M.upto(run), *ctes, select=select)


_FOLDED = S.words("coalesce(description_text, '')")
_RULE_ROWS = "SELECT k AS doc_id, name, category, base_points, final_points, reason FROM rules"

# ------------------------------------------------------------------- actions, in SQL
_CLOCK = "to_timestamp(1706900000 + doc_id + 60 * {})::TIMESTAMP"
_DOC = f"docs AS (SELECT doc_id, title, source, external_id, {M.FP} AS fp FROM postings)"
_APPLIED = """CASE WHEN doc_id % 28 = 1 THEN 'APPLIED' WHEN doc_id % 14 = 1 THEN 'NOT_APPLIED'
 WHEN doc_id % 7 = 1 THEN 'APPLIED' WHEN doc_id % 7 = 2 THEN 'REJECTED' ELSE 'NOT_APPLIED' END"""
_SERVED = f"""served AS MATERIALIZED (SELECT j.* EXCLUDE (lifecycle), d.doc_id,
 {_APPLIED} AS application_status,
 CASE WHEN doc_id % 7 = 1 THEN {_CLOCK.format(1).replace("to_timestamp", "make_timestamp").replace("1706900000 + doc_id + 60 * 1", "(1706900060 + doc_id) * 1000000")} END AS applied_at,
 doc_id % 5 = 1 AND doc_id % 10 <> 1 AS favorite,
 CASE WHEN doc_id % 23 = 1 THEN 'ARCHIVED' ELSE lifecycle END AS lifecycle,
 CASE WHEN doc_id % 6 = 1 AND doc_id % 12 <> 1 THEN 'note ' || d.external_id END AS notes
 FROM jobs3 j JOIN docs d USING (fp) WHERE doc_id % 41 <> 1)"""


def served(select: str) -> str:
    return merged(3, select, _DOC, _SERVED)


_LINE = "SELECT fp AS fingerprint, title, company_slug, source, country, score FROM served"
_ORDERS = {
    "score": "score DESC NULLS LAST, first_seen_at DESC, fp",
    "newest": "first_seen_at DESC, fp",
    "company": "company_slug, first_seen_at DESC, fp",
}

_STATE = f"""SELECT fp AS fingerprint, company_slug, region, title, location, country, remote, department,
 description_text, apply_url, {ts("updated_at_source")}, {ts("posted_at")}, lifecycle, {ts("closed_at")}, score,
 confidence, {ts("first_seen_at")}, {ts("last_seen_at")} FROM jobs3"""
_SUM = ", ".join(f"CAST(sum(jobs_{c}) AS BIGINT) AS {c}" for c in ("new", "updated", "closed"))
_FAILED = "CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS failed"
_LOGS = "logs AS (" + " UNION ALL ".join(
    f"SELECT '{r}' AS run_id, TIMESTAMP '{runs.clock_of(r)}' AS started_at, * FROM ({M.counters(r)})" for r in runs.RUNS
) + ")"


def labelled(score: str) -> str:
    return S.LABEL.replace("score >=", f"{score} >=")


# ------------------------------------------------------------------- boards, in SQL
_OK = f"doc_id % {P.BROKEN_EVERY} <> 0"
_DESC = collapsed("description_text")


def listed(remote: str, country: str, *more: str, where: str = _OK, **given: str) -> str:
    cols = {
        "company_slug": "company_slug", "external_id": "external_id", "title": "title", "apply_url": "apply_url",
        "location": "location", "country": country, "remote": remote, "description_text": _DESC, **given,
    }
    picked = ", ".join(f"{v} AS {k}" for k, v in cols.items())
    return plain(f"SELECT {', '.join([picked, *more])} FROM postings WHERE {where}")


def _remote(*words: str) -> str:
    return "coalesce(" + " OR ".join(f"contains(lower(location), '{w}')" for w in words) + ", false)"


def _placed(words) -> str:
    return f"CASE WHEN {S.contains_any('lower(location)', words)} THEN location ELSE 'Egypt' END"


_LOC = "nullif(location, '')"
_CARD = S.title_matches("title")
_ID = f"CASE WHEN doc_id % {P.EMPTY_ID_EVERY} = 0 THEN '' ELSE external_id END"

# ------------------------------------------------------------------- pages
_TAGS = "<[/!?]?[A-Za-z?!](?:[^>\"'']|\"[^\"]*\"|''[^'']*'')*>"
_BODY = "regexp_replace(html, '(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', ' ', 'g')"
_PLAIN = f"regexp_replace({_BODY}, '(?s){_TAGS}', ' ', 'g')"
for _ref, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_ref}', '{_char}')"

_EPOCH = "CAST(epoch(date_trunc('second', ts)) AS BIGINT)"


def why() -> str:
    """Everything a breakdown says, from ``scored s`` and its rules."""
    said = "name || '|' || category || '|' || base_points::VARCHAR || '|' || round_even(final_points, 2)::VARCHAR || '|' || reason"
    regions = ", ".join(S.q(r) for r in L.STRATEGIES)

    def all_of(what: str, which: str) -> str:
        return f"coalesce((SELECT string_agg({what}, ' ; ' ORDER BY n) FROM rules r WHERE r.k = s.k AND {which}), '')"

    return f"""round_even(raw_score, 2) AS raw_score, quality_label,
 CASE WHEN region IN ({regions}) THEN region ELSE {S.q(DEFAULT_REGION)} END AS strategy,
 {all_of(said, 'final_points <> 0')} AS rules, {all_of('reason', 'final_points > 0')} AS positives,
 {all_of('reason', 'final_points < 0')} AS negatives"""



def streamed() -> str:
    """What the pages of one board come to, read, filtered and scored."""
    rows = f"""SELECT company_slug, {_ID} AS external_id, title, apply_url, location, description, posted_at,
 {_remote(*L.GREENHOUSE_REMOTE_WORDS)} AS remote, 'greenhouse' AS source
 FROM (SELECT *, {_DESC} AS description FROM postings) WHERE {_OK}"""
    named = f"""SELECT i.* EXCLUDE (description), description AS description_text, c.name AS company_name, c.target_region AS region
 FROM ({rows}) i JOIN companies c ON c.slug = i.company_slug"""
    return S.with_(
        S.POSTINGS, M.COMPANY_CTE, f"listed AS ({named})",
        f"src AS (SELECT *, {M.FP} AS k FROM ({S.filtered('listed')}))", *S.score_ctes("src"),
        select="SELECT k AS fingerprint, company_slug, title, country, score, confidence, quality_label FROM scored",
    )


ORACLES: dict[str, str] = {
    "f01_title_match": plain(f"SELECT doc_id, {S.title_matches('title')} AS matches FROM postings"),
    "f03_loc_international": plain(f"SELECT doc_id, {S.country_international()} AS country FROM postings"),
    "f04_loc_egypt": plain(f"SELECT doc_id, {S.country_egypt()} AS country FROM postings"),
    "f05_experience_excluded": plain(f"SELECT doc_id, {S.experience_excluded()} AS excluded FROM postings"),
    "f06_passes_region": plain(S.filtered("postings", columns="doc_id, region")),
    "f07_precheck": plain(f"SELECT source, count(*) AS n_details FROM postings WHERE {_CARD} GROUP BY source"),
    "f14_remote": plain(
        f"SELECT doc_id, {_remote('remote')} AS remote_plain, {_remote(*L.GREENHOUSE_REMOTE_WORDS)} AS remote_wide FROM postings"
    ),
    "x01_html_text": f"SELECT page_id, {collapsed(_PLAIN)} AS text FROM pages",
    "x02_fingerprint": plain(
        """SELECT doc_id, sha256(concat_ws(chr(31), source, CASE WHEN doc_id % 5 <> 0 THEN external_id
 ELSE lower(apply_url) END)) AS fingerprint FROM postings"""
    ),
    "x04_text_hash": "SELECT doc_id, sha256(text) AS text_hash FROM documents",
    "x05_parse_dt": f"""SELECT event_id, strftime(CASE event_id % 6 WHEN 3 THEN date_trunc('second', ts) - INTERVAL 2 HOUR
 WHEN 4 THEN date_trunc('day', ts) WHEN 5 THEN NULL ELSE date_trunc('second', ts) END, {TS}) AS parsed,
 strftime(make_timestamp({_EPOCH} * 1000000), {TS}) AS from_millis FROM events""",
    "x07_unescape": """SELECT doc_id, '<p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
 || '</p>' AS markup FROM documents""",
    "x08_normalize_title": plain(f"SELECT doc_id, {S.title_norm()} AS title_norm FROM postings"),
    "x13_section": plain(
        f"""SELECT doc_id, nullif({S.section("lower(coalesce(description_text, ''))", L.PREFERRED_HEADINGS)}, '') AS preferred,
 nullif({S.section("lower(coalesce(description_text, ''))", L.REQUIRED_HEADINGS)}, '') AS required FROM postings"""
    ),
    "x16_keyword_stuffing": plain(
        "SELECT doc_id, "
        + ", ".join(
            f"CAST({S.occurrences(chr(108) + 'ower(coalesce(description_text, {}))'.format(S.q('')), w)} AS INTEGER) AS n_{w}"
            for w in L.STUFFING_KEYWORDS
        )
        + " FROM postings"
    ),
    "x17_age_days": plain(f"SELECT doc_id, {S._age(AS_OF)} AS age_days FROM postings"),
    "x22_url_id": plain("SELECT doc_id, replace(apply_url, '?ref=x', '') AS link, external_id AS link_id FROM postings"),
    "x24_location_list": """SELECT concat_ws(', ', lang, source) AS places, count(*) AS n_rows
 FROM documents GROUP BY 1""",
    "x09_seniority": featured("SELECT doc_id, seniority FROM feat"),
    "x10_specialization": featured("SELECT doc_id, specialization FROM feat"),
    "x11_experience": featured(
        "SELECT doc_id, required_years, preferred_years, range_min, range_max, grad_friendly FROM feat"
    ),
    "x12_stack": featured(
        """SELECT doc_id, s AS skill, list_contains(skills_title, s) AS in_title,
 list_contains(skills_description, s) AS in_description, list_contains(skills_required, s) AS is_required,
 list_contains(skills_preferred, s) AS is_preferred FROM (SELECT *, unnest(skills) AS s FROM feat)"""
    ),
    "x14_signal_counts": featured(
        "SELECT doc_id, " + ", ".join(f"CAST(hits_{b} AS INTEGER) AS hits_{b}" for b in L.PHRASE_BANKS) + " FROM feat"
    ),
    "x15_company_tier": plain(f"SELECT doc_id, {S.tier()} AS tier FROM postings"),
    "p02_feature_view": featured(
        """SELECT doc_id, title_norm, seniority, specialization, required_years AS exp_required,
 grad_friendly AS exp_grad_friendly, array_to_string(list_sort(skills_title), ',') AS stack_title,
 array_to_string(list_sort(list_filter(skills, lambda s: NOT list_contains(skills_title, s))), ',') AS stack_desc,
 CAST(description_chars AS INTEGER) AS description_chars FROM feat"""
    ),
    "r_score": scored(
        "SELECT doc_id, score, raw_score, confidence, quality_label, region AS strategy FROM scored"
    ),
    "r_rules": scored(
        """SELECT k AS doc_id, name, category, base_points, final_points,
 round_even(final_points / base_points, 2) AS multiplier, reason FROM rules"""
    ),
    "g05_score_only": scored("SELECT doc_id, score FROM scored"),
    "g03_tuned_weights": scored(
        """SELECT name, count(*) AS n_rules, sum(base_points * CASE WHEN region = 'EGYPT' AND name = 'spec_backend' THEN 2.0
 WHEN region <> 'EGYPT' AND name = 'seniority_junior' THEN 0.5 ELSE 1.0 END) AS points
 FROM rules JOIN src USING (k) WHERE NOT (region = 'EGYPT' AND name = 'stack_java_title') GROUP BY name"""
    ),
    "g02_extra_rule": S.with_(
        S.POSTINGS, _SRC, *S.score_ctes("src", rules=list(S.own_rule_rows())),
        select="""SELECT doc_id, score, raw_score, coalesce((SELECT string_agg(name || '|' || final_points::VARCHAR || '|' || reason,
 ' ; ' ORDER BY n) FROM rules r WHERE r.k = s.k AND final_points <> 0), '') AS rules FROM scored s""",
    ),
    "g04_own_tiers": own_tiers("SELECT doc_id, company_tier AS tier, score, raw_score FROM scored"),
    "x18_quality_label": scored("SELECT quality_label, count(*) AS n_postings FROM scored GROUP BY 1"),
    "x20_breakdown_json": scored(f"SELECT doc_id, score, confidence, {why()} FROM scored s"),
    "p05_summary": scored(
        """SELECT doc_id,
 coalesce((SELECT array_to_string(list(reason ORDER BY n)[1:4], ' | ') FROM rules r WHERE r.k = s.k AND final_points > 0), '') AS top_positives,
 coalesce((SELECT array_to_string(list(reason ORDER BY n)[1:3], ' | ') FROM rules r WHERE r.k = s.k AND final_points < 0), '') AS top_negatives
 FROM scored s"""
    ),
    "t00_best_postings": S.with_(
        S.POSTINGS,
        f"src AS (SELECT *, doc_id AS k FROM ({S.filtered('postings')}) WHERE region = 'INTERNATIONAL')",
        *S.score_ctes("src"),
        select="""SELECT doc_id, title, company_name, country, score, confidence, quality_label,
 coalesce((SELECT array_to_string(list(reason ORDER BY n)[1:4], ' | ') FROM rules r WHERE r.k = s.k AND final_points > 0), '') AS top_positives
 FROM scored s ORDER BY score DESC, doc_id LIMIT 50""",
    ),
    **{
        f"m02_job_upsert_run{r}": merged(
            r, f"SELECT fp AS fingerprint, slug AS company_slug, seq, kind, outcome, CASE WHEN kind = 'sighting' THEN now_score END AS score FROM ev{r} WHERE kind <> 'base'"
        )
        for r in runs.RUNS
    },
    "m03_field_merge": merged(3, _STATE),
    "m04_rescore_on_update": merged(
        2, f"SELECT fp AS fingerprint, score, confidence, {labelled('score')} AS quality_label FROM jobs2"
    ),
    "m05_reactivate": merged(
        3, f"""SELECT fp AS fingerprint, title, {ts('closed_at')} FROM jobs3 WHERE lifecycle = 'ACTIVE'
 AND fp IN (SELECT fp FROM jobs2 WHERE lifecycle = 'CLOSED')"""
    ),
    "m06_close_unseen": merged(
        2, f"SELECT fp AS fingerprint, company_slug, {ts('closed_at')} FROM jobs2 WHERE lifecycle = 'CLOSED'"
    ),
    "m07_last_seen": merged(3, f"SELECT {ts('last_seen_at')}, count(*) AS n_jobs FROM jobs3 GROUP BY 1"),
    "m08_failed_company": merged(
        2, f"SELECT fp AS fingerprint, lifecycle, {ts('last_seen_at')} FROM jobs2 WHERE company_slug = 'asana'"
    ),
    "w02_ordered_sightings": merged(
        1, """SELECT fp AS fingerprint, min(slug) AS first_company, max(slug) AS last_company, count(*) AS n_sightings
 FROM ev1 WHERE kind = 'sighting' GROUP BY fp HAVING count(*) > 1"""
    ),
    "j02_tombstone_anti": merged(
        1, "SELECT company_slug, count(*) AS n_kept FROM seen1 WHERE fp NOT IN (SELECT fp FROM tombs) GROUP BY 1"
    ),
    "j03_tombstoned": merged(
        1, "SELECT fp AS fingerprint, company_slug FROM seen1 WHERE fp IN (SELECT fp FROM tombs)"
    ),
    "j04_unseen": merged(3, "SELECT fp AS fingerprint, company_slug FROM close3"),
    "j05_known_split": S.with_(
        *M.upto(1), f"snap2 AS ({runs.snapshot_sql(2)})", f"obs2 AS ({runs.repeated_sql('snap2')})",
        select=f"""SELECT o.company_slug, j.fp IS NOT NULL AS known, count(*) AS n_cards FROM (SELECT *, {M.FP} AS fp FROM obs2) o
 LEFT JOIN jobs1 j ON j.fp = o.fp AND j.company_slug = o.company_slug GROUP BY 1, 2""",
    ),
    "j09_rule_weights": scored(
        """SELECT region AS strategy, name, round(any_value(final_points / base_points), 4) AS weight, count(*) AS n_rules
 FROM rules JOIN src USING (k) GROUP BY 1, 2"""
    ),
    "w01_first_listing": S.with_(
        S.POSTINGS, f"snap1 AS ({runs.snapshot_sql(1)})", f"obs1 AS ({runs.repeated_sql('snap1')})",
        select="""SELECT source, external_id, company_slug, title FROM obs1
 QUALIFY row_number() OVER (PARTITION BY source, external_id ORDER BY company_slug, seq) = 1""",
    ),
    "a03_run_counters": merged(3, M.counters(3)),
    "a03_run_counters_failed": merged(2, M.counters(2)),
    "a04_run_totals": merged(2, f"SELECT count(*) AS companies, {_FAILED}, {_SUM} FROM ({M.counters(2)})"),
    "a04_run_report": merged(
        2, f"""SELECT CASE grouping(source, company_slug) WHEN 0 THEN 'company' WHEN 1 THEN 'source' ELSE 'run' END AS level,
 source, company_slug, count(*) AS companies, {_FAILED}, CAST(sum(jobs_seen) AS BIGINT) AS seen, {_SUM}
 FROM ({M.counters(2)}) GROUP BY ROLLUP (source, company_slug)"""
    ),
    "a05_source_tallies": merged(3, f"SELECT source, {_SUM}, {_FAILED} FROM ({M.counters(3)}) GROUP BY source"),
    "m13_rescore_all": merged(
        3, f"SELECT fp AS fingerprint, score, confidence, {why()} FROM scored s",
        "src AS (SELECT j.* EXCLUDE (score, confidence), fp AS k, c.name AS company_name FROM jobs3 j JOIN companies c ON c.slug = j.company_slug)",
        *S.score_ctes("src", as_of="2024-03-03 12:00:00"),
    ),
    "a09_rescore_summary": merged(
        1, "SELECT count(*) AS scanned, count(*) FILTER (fp IN (SELECT fp FROM ev1 WHERE kind = 'sighting' AND slug = 'zz-search' AND outcome = 'updated')) AS updated, "
        "count(*) FILTER (fp NOT IN (SELECT fp FROM ev1 WHERE kind = 'sighting' AND slug = 'zz-search' AND outcome = 'updated')) AS unchanged FROM jobs1"
    ),
    "m14_source_run": merged(1, f"SELECT * FROM ({M.counters(1)}) WHERE source = 'lever'"),
    "m09_set_status": served(f"SELECT fp AS fingerprint, application_status, {ts('applied_at')} FROM served"),
    "m10_toggle_favorite": served("SELECT fp AS fingerprint, favorite FROM served"),
    "m11_archive_notes": served("SELECT fp AS fingerprint, lifecycle, notes FROM served"),
    "m12_tombstone": merged(
        3, f"""SELECT fp AS fingerprint, NULL AS deleted_at, title, source FROM docs WHERE doc_id % {runs.TOMBSTONE_EVERY} = 0
 UNION ALL SELECT j.fp, strftime(make_timestamp((1706900540 + doc_id) * 1000000), {TS}), j.title, j.source
 FROM jobs3 j JOIN docs d USING (fp) WHERE doc_id % 41 = 1""", _DOC
    ),
    "f08_search": served(
        f"""{_LINE} WHERE region = 'INTERNATIONAL' AND lifecycle IN ('ACTIVE', 'CLOSED') AND application_status = 'NOT_APPLIED'
 AND source IN ('greenhouse', 'ashby', 'lever') AND country IN ('USA', 'Europe', 'Remote') AND score >= 20"""
    ),
    "f09_remote_favorites": served(f"{_LINE} WHERE remote AND favorite"),
    "f11_text_search": served(
        f"{_LINE} WHERE lower(title) LIKE '%visa sp_nsor%' OR lower(description_text) LIKE '%visa sp_nsor%'"
    ),
    "f12_filter_lists": served(
        "SELECT lifecycle, count(*) AS n_jobs FROM served WHERE lifecycle IN ('ACTIVE', 'CLOSED') GROUP BY 1"
    ),
    "f13_constraints": served(
        """SELECT "check", count(*) AS n_violations FROM (
 SELECT 'title longer than 500' AS "check" FROM twice WHERE notes IS NOT NULL
 UNION ALL SELECT 'lifecycle not in domain' FROM twice WHERE favorite
 UNION ALL SELECT 'job without company' FROM twice WHERE country = 'Europe'
 UNION ALL SELECT 'duplicate fingerprint' FROM served WHERE country = 'USA') GROUP BY 1"""
    ).replace("\nSELECT \"check\"", ",\ntwice AS (SELECT * FROM served UNION ALL SELECT * FROM served WHERE country = 'USA')\nSELECT \"check\""),
    "f13_other_tables": """WITH co AS (SELECT
 CASE s_suppkey % 11 WHEN 1 THEN NULL WHEN 2 THEN repeat('x', 121) ELSE s_name END AS slug,
 CASE s_suppkey % 11 WHEN 5 THEN NULL WHEN 6 THEN 'nowhere' ELSE 'lever' END AS source,
 CASE s_suppkey % 11 WHEN 7 THEN NULL WHEN 8 THEN repeat('y', 201) ELSE s_name END AS external_id,
 s_suppkey % 11 AS a, s_suppkey % 13 AS b FROM supplier),
lo AS (SELECT o_orderkey AS k, o_orderstatus AS st, o_orderpriority AS pr FROM orders),
tb AS (SELECT CASE WHEN p_partkey % 31 = 7 THEN repeat('x', 65) WHEN p_partkey % 37 <> 8 THEN sha256(p_name) END AS fp, p_size
 FROM part),
st AS (SELECT CASE WHEN c_custkey % 41 = 1 THEN repeat('x', 81) WHEN c_custkey % 43 <> 2 THEN c_mktsegment END AS k,
 c_custkey % 47 = 3 AS no_value FROM customer)
SELECT "check", CAST(n AS BIGINT) AS n_violations FROM (
 SELECT 'company slug is null' AS "check", count(*) AS n FROM co WHERE a = 1
 UNION ALL SELECT 'company slug longer than 120', count(*) FROM co WHERE a = 2
 UNION ALL SELECT 'company name is null', count(*) FROM co WHERE a = 3
 UNION ALL SELECT 'company name longer than 200', count(*) FROM co WHERE a = 4
 UNION ALL SELECT 'company source is null', count(*) FROM co WHERE a = 5
 UNION ALL SELECT 'company source not in domain', count(*) FROM co WHERE a = 6
 UNION ALL SELECT 'company external_id is null', count(*) FROM co WHERE a = 7
 UNION ALL SELECT 'company external_id longer than 200', count(*) FROM co WHERE a = 8
 UNION ALL SELECT 'company careers_url longer than 500', count(*) FROM co WHERE a = 9
 UNION ALL SELECT 'company active is null', count(*) FROM co WHERE a = 10
 UNION ALL SELECT 'company target_region is null', count(*) FROM co WHERE b = 1
 UNION ALL SELECT 'company target_region not in domain', count(*) FROM co WHERE b = 2
 UNION ALL SELECT 'duplicate slug', count(slug) - count(DISTINCT slug) FROM co
 UNION ALL SELECT 'duplicate source and id', count(*) - count(DISTINCT (source, external_id)) FROM co
  WHERE source IS NOT NULL AND external_id IS NOT NULL
 UNION ALL SELECT 'log started_at is null', count(*) FROM lo WHERE k % 17 = 3
 UNION ALL SELECT 'log source not in domain', count(*) FROM lo WHERE pr = '5-LOW'
 UNION ALL SELECT 'log company_slug longer than 120', count(*) FROM lo WHERE k % 19 = 4
 UNION ALL SELECT 'log status longer than 40', count(*) FROM lo WHERE k % 23 = 5
 UNION ALL SELECT 'log status is null', count(*) FROM lo WHERE k % 23 <> 5 AND st = 'P'
 UNION ALL SELECT 'log error_kind longer than 80', count(*) FROM lo WHERE k % 29 = 6
 UNION ALL SELECT 'tombstone fingerprint is null', count(*) FROM tb WHERE fp IS NULL
 UNION ALL SELECT 'tombstone fingerprint longer than 64', count(*) FROM tb WHERE length(fp) > 64
 UNION ALL SELECT 'tombstone title longer than 500', count(*) FROM tb WHERE p_size = 9
 UNION ALL SELECT 'tombstone source longer than 40', count(*) FROM tb WHERE p_size = 10
 UNION ALL SELECT 'duplicate tombstone', count(fp) - count(DISTINCT fp) FROM tb
 UNION ALL SELECT 'state key is null', count(*) FROM st WHERE k IS NULL
 UNION ALL SELECT 'state key longer than 80', count(*) FROM st WHERE length(k) > 80
 UNION ALL SELECT 'state value is null', count(*) FROM st WHERE no_value
 UNION ALL SELECT 'duplicate state key', count(k) - count(DISTINCT k) FROM st) WHERE n > 0""",
    "f15_saved_views": served(
        """SELECT 'Active' AS view, fp AS fingerprint FROM served WHERE lifecycle = 'ACTIVE' AND application_status = 'NOT_APPLIED'
 UNION ALL SELECT 'Applied', fp FROM served WHERE application_status = 'APPLIED'
 UNION ALL SELECT 'Favorites', fp FROM served WHERE lifecycle = 'ACTIVE' AND application_status = 'NOT_APPLIED' AND favorite
 UNION ALL SELECT 'Closed', fp FROM served WHERE lifecycle = 'CLOSED' AND application_status = 'NOT_APPLIED'
 UNION ALL SELECT 'Archived', fp FROM served WHERE lifecycle = 'ARCHIVED' AND application_status = 'NOT_APPLIED'"""
    ),
    "t01_top_by_score": served(f"{_LINE} ORDER BY {_ORDERS['score']} LIMIT 25"),
    "t02_newest": served(f"{_LINE} ORDER BY {_ORDERS['newest']} LIMIT 25"),
    "t03_by_company": served(f"{_LINE} ORDER BY {_ORDERS['company']} LIMIT 25"),
    "t04_page": served(f"{_LINE} ORDER BY {_ORDERS['score']} LIMIT 20 OFFSET 40"),
    "a01_count_by_status": served("SELECT application_status, count(*) AS n_jobs FROM served GROUP BY 1"),
    "a02_region_counts": served(
        """SELECT region, count(*) FILTER (lifecycle = 'ACTIVE' AND application_status = 'NOT_APPLIED') AS n_open
 FROM served GROUP BY 1"""
    ),
    "p03_serving_row": served(
        """SELECT fp AS fingerprint, score, c.name AS company, title, location, s.source,
 strftime(posted_at, '%Y-%m-%d') AS posted_date FROM served s JOIN companies c ON c.slug = s.company_slug"""
    ),
    "k05_list_export": served(
        f"""SELECT fp AS fingerprint, title, c.name AS company, location, country, remote, s.source, apply_url, {ts('posted_at')},
 score, confidence, {labelled('score')} AS quality_label, lifecycle, application_status, favorite
FROM served s JOIN companies c ON c.slug = s.company_slug"""
    ),
    "k06_detail_export": served(
        f"""SELECT fp AS fingerprint, title, c.name AS company, location, country, remote, CAST(NULL AS VARCHAR) AS employment_type,
 department, s.source, apply_url, {ts('posted_at')}, {ts('first_seen_at')}, score, confidence, {labelled('score')} AS quality_label,
 score AS score_breakdown, lifecycle, application_status, favorite, notes, description_text
FROM served s JOIN companies c ON c.slug = s.company_slug"""
    ),
    "k07_company_export": served(
        """SELECT slug, name, source, slug AS external_id, 'https://jobs.example.com/' || slug AS careers_url, true AS active
 FROM companies WHERE slug IN (SELECT company_slug FROM served)"""
    ),
    "s14_active_companies": served(
        """SELECT slug, name, (SELECT nullif(count(*), 0) FROM served s WHERE s.company_slug = slug) AS n_jobs
 FROM companies WHERE source = 'lever'"""
    ),
    "s15_point_lookup": served(
        """SELECT fp AS fingerprint, title, c.name AS company FROM served s JOIN companies c ON c.slug = s.company_slug
 WHERE fp = (SELECT min(fp) FROM served WHERE source = 'ashby')"""
    ),
    "t05_recent_logs": merged(
        3, """SELECT run_id, company_slug, status, jobs_seen, jobs_new, jobs_updated, jobs_closed FROM logs
 ORDER BY started_at DESC, company_slug LIMIT 20""", _LOGS
    ),
    "a10_last_success": merged(
        3, f"""SELECT 'stored' AS state, strftime(max(started_at), {TS}) AS last_success FROM logs WHERE status = 'ok'
 UNION ALL SELECT 'absent', NULL UNION ALL SELECT 'unreadable', NULL""", _LOGS
    ),
    "x23_stale": merged(
        3, f"""SELECT 'stored' AS state, strftime(t, {TS}) AS as_of, t - (SELECT max(started_at) FROM logs WHERE status = 'ok')
 >= INTERVAL {L.CATCHUP_THRESHOLD_HOURS} HOUR AS stale
 FROM (VALUES (TIMESTAMP '2024-02-04 07:59:59'), (TIMESTAMP '2024-02-04 08:00:00')) AS v(t)
 UNION ALL SELECT 'absent', '2024-02-04 07:59:59', true UNION ALL SELECT 'unreadable', '2024-02-04 07:59:59', true
 UNION ALL SELECT 'no company', '2024-02-04 08:00:00', false""", _LOGS
    ),
    "m01_company_upsert": """SELECT 's-' || s_suppkey AS slug, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 4 = 0 THEN s_name || ' Inc. & Co.'
  WHEN s_suppkey % 5 <> 0 THEN s_name || ' Inc.' ELSE s_name END AS name,
 CASE WHEN s_suppkey % 3 <> 0 THEN '2024-01-01 00:00:00' ELSE '2024-02-01 00:00:00' END AS created_at,
 'lever' AS source, 'EGYPT' AS target_region, s_suppkey % 5 <> 0 OR s_suppkey % 2 = 0 AS active,
 CASE WHEN s_suppkey % 5 <> 0 THEN 0 END AS n_config FROM supplier WHERE s_suppkey % 3 <> 0 OR s_suppkey % 5 <> 0""",
    "k01_commit": merged(2, _STATE.replace("jobs3", "jobs2").replace("SELECT", "SELECT 2 AS version,", 1)),
    "s15_stored_lookup": merged(
        2, """SELECT fp AS fingerprint, source, title, description_text, lifecycle FROM jobs2
 WHERE fp IN (SELECT min(fp) FROM jobs2 GROUP BY source)"""
    ),
    "k02_run_log": merged(
        2, f"SELECT '2' AS run_id, company_slug, source, status, jobs_seen, jobs_new, jobs_updated, jobs_closed FROM ({M.counters(2)})"
    ),
    "k03_state": f"SELECT '{L.LAST_SUCCESS_KEY}' AS key, '{runs.clock_of(2)}' AS value, '{runs.clock_of(2)}' AS updated_at",
    "s13_registry": plain(
        f"""SELECT board AS source, company_slug, count(*) AS n_items FROM postings,
 (VALUES ('greenhouse'), ('lever'), ('ashby'), ('workday'), ('wellfound'), ('linkedin'), ('wuzzuf'), ('bayt')) AS b(board)
 WHERE CASE WHEN board IN ('linkedin', 'wuzzuf', 'bayt') THEN {_CARD} ELSE {_OK} END GROUP BY 1, 2"""
    ),
    "s12_seed": """SELECT 's-' || s_suppkey AS slug, s_name AS name, CASE s_suppkey % 4 WHEN 1 THEN 'ashby' ELSE 'lever' END AS source,
 CASE s_suppkey % 3 WHEN 0 THEN 'EGYPT' ELSE 'INTERNATIONAL' END AS target_region, true AS active, 0 AS n_config
 FROM supplier WHERE s_suppkey % 4 <> 0""",
    "j06_active_keys": served(
        """SELECT company_slug, fp AS fingerprint FROM served WHERE lifecycle = 'ACTIVE' AND company_slug =
 (SELECT company_slug FROM served GROUP BY 1 ORDER BY count(*) DESC, company_slug LIMIT 1)"""
    ),
    "k07_log_export": merged(
        3, f"""SELECT run_id, source, company_slug, status, {ts('started_at')}, strftime(started_at, {TS}) AS finished_at, jobs_seen, jobs_new,
 jobs_updated, jobs_closed, CASE WHEN status = 'failed' THEN source || ': nothing captured for ' || company_slug END AS error_message,
 CASE WHEN status = 'failed' THEN 'ScraperError' END AS error_kind FROM logs""", _LOGS
    ),
    "f12_strict": served(
        "SELECT lifecycle, count(*) AS n_jobs, true AS refused FROM served WHERE lifecycle IN ('CLOSED', 'ARCHIVED') GROUP BY 1"
    ),
    "r01_score_stream": streamed(),
    "r02_merge_stream": streamed(),
    "s01_greenhouse": listed(
        _remote(*L.GREENHOUSE_REMOTE_WORDS), "'HQ'", "'Engineering' AS department", ts("posted_at"), external_id=_ID
    ),
    "s02_lever": listed(
        f"{_remote('remote')} OR doc_id % 8 = 0 OR doc_id % 9 = 0", "location", "'Full-time' AS employment_type",
        "'Core' AS team", ts("posted_at"), external_id=_ID,
        description_text=collapsed("coalesce(description_text, '') || ' About We hire'"),
    ),
    "s03_ashby": listed(
        f"{_remote('remote')} OR doc_id % 10 = 0 OR doc_id % 6 = 0",
        f"CASE WHEN doc_id % 2 = 0 THEN 'Egypt' ELSE {_LOC} END", ts("posted_at"), location=_LOC,
    ),
    "s04_workday": listed(
        _remote("remote"),
        f"coalesce({_LOC}, CASE WHEN doc_id % 3 <> 0 THEN 'Cairo' END)",
        "CASE WHEN doc_id % 3 <> 0 THEN 'Full time' END AS employment_type",
        external_id="company_slug || '_R-' || external_id",
        apply_url="'https://' || company_slug || '.jobs.example.com/en-US/Careers/job/City/' || company_slug || '_R-' || external_id",
        location=f"coalesce({_LOC}, CASE WHEN doc_id % 3 <> 0 THEN 'Cairo' END)",
        description_text=f"CASE WHEN doc_id % 3 <> 0 THEN {_DESC} END",
    ),
    "s05_linkedin": listed(
        _remote("remote"), _LOC, ts("posted_at"), where=_CARD, location=_LOC,
        apply_url="'https://www.linkedin.com/jobs/view/a-job-' || external_id",
        description_text=collapsed("coalesce(description_text, '') || ' tail'"),
    ),
    "j05_hydrate": listed(
        _remote("remote"), _LOC, ts("posted_at"), where=_CARD, location=_LOC,
        apply_url="'https://www.linkedin.com/jobs/view/a-job-' || external_id",
        description_text="CASE WHEN doc_id % 4 <> 0 THEN " + collapsed("coalesce(description_text, '') || ' tail'") + " END",
    ),
    "s07_wuzzuf": listed(
        _remote("remote"), _placed(L.WUZZUF_PLACES), where=_CARD, location=_placed(L.WUZZUF_PLACES),
        external_id="external_id || '-' || company_slug",
        apply_url="'https://wuzzuf.net/jobs/p/' || external_id || '-' || company_slug",
    ),
    "s09_bayt": listed(
        _remote("remote"), _placed(L.BAYT_PLACES), where=_CARD, location=_placed(L.BAYT_PLACES),
        external_id="'bayt-' || external_id",
        apply_url="'https://www.bayt.com/en/egypt/jobs/some-job-' || external_id || '/'",
    ),
    "s11_wellfound": listed(
        f"{_remote('remote')} OR doc_id % 5 = 0", _LOC, location=_LOC,
        apply_url="'https://wellfound.com/jobs/job-' || external_id",
    ),
    "s16_rejects": plain(
        f"""SELECT s.source, company_slug, 'item without id' AS reject, count(*) AS n_items
 FROM postings, (VALUES ('greenhouse'), ('lever'), ('ashby')) AS s(source) WHERE NOT ({_OK}) GROUP BY ALL"""
    ),
    "s17_bad_payload": plain(
        """SELECT DISTINCT company_slug, 'greenhouse: unexpected payload for ' || company_slug AS error_message
 FROM postings WHERE company_slug > 'local-shop'"""
    ),
    "s17_wrong_list": plain(
        """SELECT DISTINCT company_slug, board || ': unexpected payload for ' || company_slug AS error_message
 FROM postings, (VALUES ('greenhouse'), ('ashby')) AS b(board) WHERE length(company_slug) % 4 <> 0"""
    ),
    "s18_bad_config": plain(
        "SELECT DISTINCT company_slug, source || ': company ' || company_slug || ' missing ' || CASE source "
        + " ".join(f"WHEN '{s}' THEN '{w}'" for s, w in (
            ("workday", "host/tenant/site"), ("linkedin", "keywords/location"), ("wuzzuf", "keywords"), ("bayt", "keywords")))
        + " END || ' config' AS error_message FROM postings WHERE source IN ('workday', 'linkedin', 'wuzzuf', 'bayt')"
    ),
    "a11_fetch_tallies": plain(
        f"""SELECT company_slug, count(*) AS total_cards, count(*) FILTER ({_CARD}) AS accepted,
 count(*) FILTER (NOT {_CARD}) AS skipped_by_title,
 count(*) FILTER ({_CARD} AND doc_id % 4 = 0) AS skipped_known FROM postings GROUP BY 1"""
    ),
}
