"""The three derived runs merged in SQL."""

from __future__ import annotations

from ..plans import runs
from ..plans.postings import COMPANIES
from . import scoring_sql as S

VOLATILE = ["title", "location", "country", "remote", "department", "description_text", "apply_url", "updated_at_source"]
_TYPES = {"remote": "BOOLEAN", "updated_at_source": "TIMESTAMP"}

FP = "sha256(concat_ws(chr(31), lower(trim(source)), lower(trim(coalesce(nullif(external_id, ''), apply_url)))))"
COMPANY_CTE = "companies AS (SELECT * FROM (VALUES {}) AS c(slug, name, source, target_region))".format(
    ", ".join(
        "(" + ", ".join(map(S.q, row)) + ")"
        for row in COMPANIES + [(runs.REPEATER, "Everything Search", "linkedin", "INTERNATIONAL")]
    )
)
TOMB_CTE = f"tombs AS (SELECT {FP} AS fp FROM postings WHERE doc_id % {runs.TOMBSTONE_EVERY} = 0)"
_NONE = ", ".join(f"CAST(NULL AS {_TYPES.get(c, 'VARCHAR')}) AS {c}" for c in VOLATILE)
JOBS0 = f"""jobs0 AS (SELECT CAST(NULL AS VARCHAR) AS fp, CAST(NULL AS VARCHAR) AS company_slug,
 CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS external_id, CAST(NULL AS VARCHAR) AS region,
 CAST(NULL AS TIMESTAMP) AS posted_at, {_NONE}, CAST(NULL AS VARCHAR) AS lifecycle, CAST(NULL AS TIMESTAMP) AS closed_at,
 CAST(NULL AS INTEGER) AS score, CAST(NULL AS INTEGER) AS confidence, CAST(NULL AS TIMESTAMP) AS first_seen_at,
 CAST(NULL AS TIMESTAMP) AS last_seen_at WHERE false)"""


def run_ctes(run: int) -> list[str]:
    """``ev{run}`` (what each event did) and ``jobs{run}`` from ``jobs{run - 1}``."""
    n, failed, now = run, runs.FAILED.get(run, []), f"TIMESTAMP '{runs.clock_of(run)}'"
    ok = "true" if not failed else f"slug NOT IN ({', '.join(map(S.q, failed))})"
    vol, prior = ", ".join(VOLATILE), ", ".join(
        f"last_value({c} IGNORE NULLS) OVER w AS p_{c}" for c in VOLATILE
    )
    after = ", ".join(f"coalesce({c}, p_{c}) AS {c}" for c in VOLATILE)
    changed = " OR ".join(f"({c} IS NOT NULL AND {c} IS DISTINCT FROM p_{c})" for c in VOLATILE)
    late = ", ".join(f"arg_max({c}, pos) AS {c}" for c in VOLATILE if c != "company_slug")
    return [
        f"snap{n} AS ({runs.snapshot_sql(run)})",
        f"obs{n} AS MATERIALIZED ({runs.repeated_sql(f'snap{n}')})",
        f"ok{n} AS (SELECT * FROM companies WHERE {ok})",
        f"""seen{n} AS MATERIALIZED (SELECT o.*, c.name AS company_name, c.target_region AS region,
 {FP.replace("source", "o.source").replace("external_id", "o.external_id")} AS fp
 FROM obs{n} o JOIN ok{n} c ON c.slug = o.company_slug)""",
        f"acc{n} AS MATERIALIZED (SELECT * FROM ({S.filtered(f'seen{n}')}) WHERE fp NOT IN (SELECT fp FROM tombs))",
        f"""close{n} AS (SELECT j.fp, j.company_slug FROM jobs{n - 1} j JOIN ok{n} c ON c.slug = j.company_slug
 WHERE j.lifecycle <> 'ARCHIVED' AND NOT EXISTS
 (SELECT 1 FROM seen{n} s WHERE s.fp = j.fp AND s.company_slug = j.company_slug))""",
        f"""un{n} AS (
 SELECT fp, 'base' AS kind, '' AS slug, 0 AS phase, CAST(-1 AS BIGINT) AS seq, NULL AS company_name, {vol}, company_slug,
  source, external_id, region, posted_at, lifecycle, closed_at, score AS old_score, confidence AS old_confidence,
  first_seen_at, last_seen_at FROM jobs{n - 1}
 UNION ALL BY NAME SELECT fp, 'sighting' AS kind, company_slug AS slug, 0 AS phase, seq, company_name, {vol}, company_slug,
  source, external_id, region, posted_at FROM acc{n}
 UNION ALL BY NAME SELECT fp, 'close' AS kind, company_slug AS slug, 1 AS phase, 0 AS seq FROM close{n})""",
        f"""w{n} AS MATERIALIZED (SELECT *, row_number() OVER () AS k,
 slug || chr(1) || phase || lpad(CAST(seq + 1 AS VARCHAR), 12, '0') AS pos, {prior},
 last_value(CASE WHEN kind <> 'base' THEN kind END IGNORE NULLS) OVER w AS p_kind,
 first_value(kind) OVER a AS f_kind, first_value(lifecycle) OVER a AS f_lifecycle,
 first_value(closed_at) OVER a AS f_closed, first_value(first_seen_at) OVER a AS f_first,
 first_value(last_seen_at) OVER a AS f_last, first_value(company_slug) OVER a AS owner,
 first_value(source) OVER a AS f_source, first_value(external_id) OVER a AS f_external_id,
 first_value(region) OVER a AS f_region, first_value(posted_at) OVER a AS f_posted
 FROM un{n} WINDOW w AS (PARTITION BY fp ORDER BY slug, phase, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
 a AS (PARTITION BY fp ORDER BY slug, phase, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""",
        f"""img{n} AS MATERIALIZED (SELECT k, fp, kind, slug, phase, seq, pos, company_name, {after}, f_region AS region,
 f_posted AS posted_at, old_score, old_confidence, owner, f_source, f_external_id, f_closed, f_first, f_last, f_lifecycle,
 kind = 'sighting' AND f_kind = 'sighting' AND p_kind IS NULL AS is_new, ({changed}) AS field_changed,
 CASE WHEN f_lifecycle = 'ARCHIVED' THEN f_lifecycle WHEN p_kind = 'sighting' THEN 'ACTIVE'
  WHEN p_kind = 'close' THEN 'CLOSED' ELSE f_lifecycle END AS life_before FROM w{n})""",
        f"sight{n} AS (SELECT * FROM img{n} WHERE kind = 'sighting')",
        *S.score_ctes(f"sight{n}", f"r{n}_", runs.clock_of(run)),
        f"""sc{n} AS (SELECT i.*, coalesce(s.score, i.old_score) AS now_score, coalesce(s.confidence, i.old_confidence)
 AS now_confidence FROM img{n} i LEFT JOIN r{n}_scored s USING (k))""",
        f"""mv{n} AS (SELECT *, kind = 'sighting' AND now_score IS DISTINCT FROM
 last_value(now_score IGNORE NULLS) OVER (PARTITION BY fp ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
 AS moved FROM sc{n})""",
        f"""ev{n} AS MATERIALIZED (SELECT *, CASE WHEN is_new THEN 'new'
 WHEN kind = 'sighting' AND (field_changed OR moved OR life_before = 'CLOSED') THEN 'updated'
 WHEN kind = 'close' AND life_before = 'ACTIVE' THEN 'closed' ELSE 'noop' END AS outcome,
 CASE WHEN life_before = 'ARCHIVED' THEN 'ARCHIVED' WHEN kind = 'sighting' THEN 'ACTIVE'
  WHEN kind = 'close' THEN 'CLOSED' ELSE f_lifecycle END AS life_after FROM mv{n})""",
        f"""jobs{n} AS MATERIALIZED (SELECT fp, any_value(owner) AS company_slug, any_value(f_source) AS source,
 any_value(f_external_id) AS external_id, any_value(region) AS region, any_value(posted_at) AS posted_at, {late},
 arg_max(life_after, pos) AS lifecycle,
 CASE WHEN arg_max(life_after, pos) = 'CLOSED' THEN CASE WHEN bool_or(outcome = 'closed') THEN {now} ELSE any_value(f_closed) END
  WHEN arg_max(life_after, pos) = 'ARCHIVED' THEN any_value(f_closed) END AS closed_at,
 arg_max(now_score, pos) FILTER (moved OR kind = 'base') AS score,
 arg_max(now_confidence, pos) FILTER (moved OR kind = 'base') AS confidence,
 CASE WHEN bool_or(is_new) THEN {now} ELSE any_value(f_first) END AS first_seen_at,
 CASE WHEN bool_or(kind = 'sighting') THEN {now} ELSE any_value(f_last) END AS last_seen_at
 FROM ev{n} GROUP BY fp)""",
    ]


def upto(run: int) -> list[str]:
    """CTEs of all runs up to one."""
    ctes = [S.POSTINGS, COMPANY_CTE, TOMB_CTE, JOBS0]
    for r in range(1, run + 1):
        ctes += run_ctes(r)
    return ctes


def counters(run: int) -> str:
    failed = ", ".join(map(S.q, runs.FAILED.get(run, ["-"])))
    ok = f"slug NOT IN ({failed})"
    parts = ", ".join(
        f"CAST(coalesce(count(*) FILTER (outcome = '{o}'), 0) AS INTEGER) AS jobs_{o}" for o in ("new", "updated", "closed")
    )
    return f"""SELECT c.slug AS company_slug, c.source, CASE WHEN c.{ok} THEN 'ok' ELSE 'failed' END AS status,
 CAST(CASE WHEN c.{ok} THEN (SELECT count(*) FROM obs{run} o WHERE o.company_slug = c.slug) ELSE 0 END AS INTEGER) AS jobs_seen,
 coalesce(e.jobs_new, 0) AS jobs_new, coalesce(e.jobs_updated, 0) AS jobs_updated, coalesce(e.jobs_closed, 0) AS jobs_closed
 FROM companies c LEFT JOIN (SELECT slug, {parts} FROM ev{run} WHERE kind <> 'base' GROUP BY slug) e ON e.slug = c.slug"""
