"""Posting keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import strip

# fixed value: separator of key parts
SEPARATOR = "\x1f"


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the trimmed, lower-cased parts; a null part counts as ''."""
    clean = [F.lower(strip(F.coalesce(p, F.lit("")))) for p in parts]
    return F.sha2(F.concat_ws(SEPARATOR, *clean), 256)


def job_fingerprint(source: Column, external_id: Column, apply_url: Column) -> Column:
    """Key of a posting: its source and id, or its link when the id is empty."""
    return fingerprint(source, F.coalesce(F.nullif(external_id, F.lit("")), apply_url))


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)
