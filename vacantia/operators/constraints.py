"""Keys, lengths, domains and references of all stored tables, as a table of violations.

The rules of single columns are metadata of the schemas; keys and references stand here.
Each table is read once: a row hands on the rules it breaks and its keys, and one
aggregate, combined before its shuffle, counts both.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lexicon, schemas
from ..session import small_side


def column_checks(rules: T.StructType, prefix: str = "") -> list[tuple[str, Column]]:
    """(name, broken) for every rule in the metadata of a schema's columns."""
    out = []
    for f in rules.fields:
        column, name = F.col(f.name), f"{prefix}{f.name}"
        if f.metadata.get("required"):
            out.append((f"{name} is null", column.isNull()))
        if "length" in f.metadata:
            out.append((f"{name} longer than {f.metadata['length']}", F.length(column) > f.metadata["length"]))
        if "domain" in f.metadata:
            out.append((f"{name} not in domain", ~column.isin(*getattr(lexicon, f.metadata["domain"]))))
    return out


def broken(df: DataFrame, checks: list[tuple[str, Column]], key: str, unique: dict[str, list[str]]) -> DataFrame:
    """(check, key, n) of one table: rows that break a check, and rows beyond the first of a key.

    ``unique`` names checks by the columns of a key; as in SQL, a key with a null is equal to none.
    """
    found = [(name, F.col(key).cast("string"), bad, F.lit(False)) for name, bad in checks]
    for name, columns in unique.items():
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
        found.append((name, F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]), whole, F.lit(True)))
    said = F.array(*[
        F.when(bad, F.struct(F.lit(name).alias("check"), at.alias("key"), once.alias("once")))
        for name, at, bad, once in found
    ])
    rows = df.select(F.explode(F.filter(said, lambda s: s.isNotNull())).alias("s")).select("s.*")
    counted = rows.groupBy("check", "key", "once").agg(F.count("*").alias("rows"))
    n = F.col("rows") - F.when(F.col("once"), 1).otherwise(0)
    return counted.select("check", "key", n.alias("n")).where("n > 0")


def violations(
    jobs: DataFrame, companies: DataFrame, logs: DataFrame | None = None, tombstones: DataFrame | None = None,
    state: DataFrame | None = None,
) -> DataFrame:
    """(check, key, n) for every broken rule of the tables given; empty when all is well.

    ``n`` is the number of rows that break it, for a repeated key the rows beyond its first.
    """
    slugs = companies.select(F.col("slug").alias("company_slug"), F.lit(True).alias("has_company")).distinct()
    known = jobs.join(small_side(slugs), "company_slug", "left")
    orphan = ("job without company", F.col("company_slug").isNotNull() & F.col("has_company").isNull())
    parts = [
        broken(
            known, [*column_checks(schemas.JOB_RULES), orphan], "fingerprint", {"duplicate fingerprint": ["fingerprint"]}
        ),
        broken(
            companies, column_checks(schemas.COMPANY_RULES, "company "), "slug",
            {"duplicate slug": ["slug"], "duplicate source and id": ["source", "external_id"]},
        ),
    ]
    if logs is not None:
        parts.append(broken(logs, column_checks(schemas.RUN_LOG_RULES, "log "), "run_id", {}))
    if tombstones is not None:
        keys = {"duplicate tombstone": ["fingerprint"]}
        parts.append(broken(tombstones, column_checks(schemas.TOMBSTONE_RULES, "tombstone "), "fingerprint", keys))
    if state is not None:
        parts.append(broken(state, column_checks(schemas.STATE_RULES, "state "), "key", {"duplicate state key": ["key"]}))
    return reduce(DataFrame.unionByName, parts)
