"""Explicit schemas; nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _b, _i, _d, _ts = T.StringType(), T.BooleanType(), T.IntegerType(), T.DoubleType(), T.TimestampType()


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


RAW_JOB = _schema(
    source=_s, external_id=_s, title=_s, apply_url=_s, location=_s, country=_s, remote=_b,
    employment_type=_s, department=_s, team=_s, description_html=_s, description_text=_s,
    posted_at=_ts, updated_at_source=_ts, raw_payload=_s,
)

# One sighting of a posting in a run: what a company's board or search listed.
OBSERVATION = T.StructType(
    [T.StructField("run_id", _s), T.StructField("company_slug", _s), T.StructField("seq", T.LongType())]
    + RAW_JOB.fields
)

COMPANY = _schema(
    slug=_s, name=_s, source=_s, external_id=_s, careers_url=_s,
    config=T.MapType(_s, _s), active=_b, target_region=_s, created_at=_ts,
)

TRIGGERED_RULE = _schema(name=_s, category=_s, base_points=_d, final_points=_d, reason=_s)
BREAKDOWN = _schema(
    score=_i, raw_score=_d, confidence=_i, quality_label=_s, region=_s, strategy=_s,
    triggered_rules=T.ArrayType(TRIGGERED_RULE), positives=T.ArrayType(_s), negatives=T.ArrayType(_s),
)

JOB = _schema(
    fingerprint=_s, company_slug=_s, source=_s, external_id=_s, title=_s, location=_s, country=_s,
    remote=_b, employment_type=_s, department=_s, team=_s, description_html=_s, description_text=_s,
    apply_url=_s, region=_s, posted_at=_ts, updated_at_source=_ts, lifecycle=_s, closed_at=_ts,
    application_status=_s, applied_at=_ts, favorite=_b, notes=_s,
    heuristic_score=_d, heuristic_confidence=_d, score_breakdown=BREAKDOWN,
    first_seen_at=_ts, last_seen_at=_ts, raw_payload=_s,
)

RUN_LOG = _schema(
    run_id=_s, started_at=_ts, finished_at=_ts, source=_s, company_slug=_s, status=_s,
    jobs_seen=_i, jobs_new=_i, jobs_updated=_i, jobs_closed=_i, error_message=_s, error_kind=_s,
)
TOMBSTONE = _schema(fingerprint=_s, deleted_at=_ts, title=_s, source=_s)
STATE = _schema(key=_s, value=_s, updated_at=_ts)
ACTION = _schema(fingerprint=_s, action=_s, arg=_s, ts=_ts, seq=T.LongType())

# One captured response: a listing page, a detail page, or the end-of-run marker.
LANDING = _schema(
    run_id=_s, source=_s, company_slug=_s, kind=_s, ref=_s, page=_i, fetched_at=_ts, payload=_s,
)

# What columns may hold, as column metadata: longest value, not null, and the names of domains in the lexicon.
def ruled(schema: T.StructType, lengths: dict[str, int], required: str, domains: dict[str, str] | None = None) -> T.StructType:
    """The columns of a schema that a rule is about, with the rules as their metadata."""
    out = []
    for f in schema.fields:
        rules = {"length": lengths.get(f.name), "required": f.name in required.split() or None}
        rules = {k: v for k, v in (rules | {"domain": (domains or {}).get(f.name)}).items() if v is not None}
        if rules:
            out.append(T.StructField(f.name, f.dataType, True, rules))
    return T.StructType(out)


JOB_RULES = ruled(
    JOB,
    {
        "fingerprint": 64, "external_id": 255, "title": 500, "location": 500, "country": 120,
        "employment_type": 120, "department": 200, "team": 200, "apply_url": 1000,
    },
    "fingerprint company_slug source external_id title remote apply_url region lifecycle application_status favorite",
    {
        "source": "SOURCES", "region": "REGIONS", "lifecycle": "LIFECYCLES", "application_status": "APPLICATION_STATUSES",
    },
)
COMPANY_RULES = ruled(
    COMPANY, {"slug": 120, "name": 200, "external_id": 200, "careers_url": 500},
    "slug name source external_id active target_region", {"source": "SOURCES", "target_region": "REGIONS"},
)
RUN_LOG_RULES = ruled(
    RUN_LOG, {"company_slug": 120, "status": 40, "error_kind": 80}, "started_at status", {"source": "SOURCES"}
)
TOMBSTONE_RULES = ruled(TOMBSTONE, {"fingerprint": 64, "title": 500, "source": 40}, "fingerprint")
STATE_RULES = ruled(STATE, {"key": 80}, "key value")
