"""The ``postings`` view: job postings derived from the ``documents`` table.

The given corpus holds no job words, so titles, places, companies and phrases
are drawn from pools by document number.  The same text runs in Spark and, with
another timestamp name, in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed value: the clock of all derived queries
AS_OF = "2024-02-01 12:00:00"

_TITLES = [
    "Junior Java Developer", "Software Engineer", "Senior Software Engineer", "Backend Engineer",
    "Jr. Backend Developer", "SWE II", "New Grad Software Engineer", "Full Stack Developer",
    "Frontend React Engineer", "Data Engineer", "DevOps Engineer", "Software Engineer I",
    "Associate Software Engineer", "JavaScript Engineer", "Spring Boot Developer", "Staff Software Engineer",
    "Sr. Backend Engineer", "Entry-Level Backend Engineer", "Graduate Software Engineer",
    "QA Automation Engineer", "iOS Engineer", "Machine Learning Engineer", "Software Engineering Intern",
]
_PLACES = [
    "New York, NY", "Cairo, Egypt", "Berlin, Germany", "Remote - US", "Vienna, Austria", None, "London, UK",
    "Giza", "Tokyo, Japan", "Remote (MENA)", "Dublin, Ireland", "Anywhere", "Alexandria", "Toronto, Canada",
    "Paris, France", "Remote, Middle East", "Seattle", "Smart Village", "",
]
COMPANIES = [
    ("stripe", "Stripe", "greenhouse", "INTERNATIONAL"),
    ("asana", "Asana", "lever", "INTERNATIONAL"),
    ("okta", "Okta, Inc.", "ashby", "INTERNATIONAL"),
    ("instabug", "Instabug", "wuzzuf", "EGYPT"),
    ("abc-staffing", "ABC Staffing Agency", "linkedin", "EGYPT"),
    ("confidential", "Confidential", "bayt", "EGYPT"),
    ("local-shop", "Some Local Shop LLC", "greenhouse", "INTERNATIONAL"),
    ("citi", "Citi", "lever", "EGYPT"),
    ("twilio", "Twilio", "ashby", "INTERNATIONAL"),
    ("paymob", "Paymob", "linkedin", "EGYPT"),
    ("random-shop", "Random Shop LLC", "workday", "INTERNATIONAL"),
]
_SNIPPETS = [
    "", "Minimum 6 years of experience.", "0-2 years. New grads welcome.",
    "Requirements: Java, Spring Boot, Hibernate, JPA, REST.",
    "Docker, Kubernetes, Postgres, Redis, Kafka, REST, microservices.",
    "We provide visa sponsorship and relocation support.",
    "Distributed systems for millions of users with low-latency API.",
    "Developer platform, observability, CI/CD.", "Strong mentorship, ownership, career growth.",
    "L2 support, help desk.", "Maintain legacy COBOL mainframe, EJB.",
    "WordPress and Drupal, low-code tools.", "URGENT HIRING!!! Apply now!!!",
    "Passionate rockstar ninja guru self-starter with synergy.",
    "java java java java java java java java java", "React, Vue, Angular, TypeScript.",
    "Nice to have: Java and Spring.", "3+ years of experience with Python.",
    "10 years of experience in Go, Rust.", "Preferred: 4 years. Junior candidates ok.",
    "1-2 years, JWT, OAuth2, Keycloak.",
    "Event-driven architecture, cloud-native, data pipeline, streaming.",
    "5+ years required; entry level team.", "2-5 years of experience.", "At least 3 years. PostgreSQL.",
]


def _cell(value) -> str:
    if value is None:
        return "CAST(NULL AS VARCHAR(64))"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _pool(rows, names: str) -> str:
    rows = [row if isinstance(row, tuple) else (row,) for row in rows]
    body = ", ".join(f"({i}, {', '.join(map(_cell, row))})" for i, row in enumerate(rows))
    return f"(SELECT * FROM (VALUES {body}) AS v(i, {names}))"


def postings_sql(documents: str = "documents", timestamp: str = "TIMESTAMP") -> str:
    """SELECT statement of the view over a documents relation."""
    return f"""
SELECT d.doc_id, c.company_slug, c.company_name, c.source, c.region,
  CAST(d.doc_id AS VARCHAR(20)) AS external_id, t.title, l.location,
  COALESCE(lower(l.location) LIKE '%remote%' OR lower(l.location) LIKE '%anywhere%', false) AS remote,
  CONCAT('https://jobs.example.com/', c.company_slug, '/', CAST(d.doc_id AS VARCHAR(20)), '?ref=x') AS apply_url,
  CASE WHEN d.doc_id % 13 = 0 THEN NULL
       ELSE CONCAT(s.snippet, ' ', s2.snippet, ' ', d.text) END AS description_text,
  {timestamp} '2024-02-01 00:00:00' - (d.doc_id % 90) * INTERVAL '1' DAY AS posted_at
FROM {documents} d
JOIN {_pool(_TITLES, "title")} t ON t.i = d.doc_id % {len(_TITLES)}
JOIN {_pool(_PLACES, "location")} l ON l.i = d.doc_id % {len(_PLACES)}
JOIN {_pool(COMPANIES, "company_slug, company_name, source, region")} c ON c.i = d.doc_id % {len(COMPANIES)}
JOIN {_pool(_SNIPPETS, "snippet")} s ON s.i = d.doc_id % {len(_SNIPPETS)}
JOIN {_pool(_SNIPPETS, "snippet")} s2 ON s2.i = (d.doc_id * 7 + 3) % {len(_SNIPPETS)}"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view over a data folder; ``posted_at`` has no zone (it is UTC)."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spark.sql(postings_sql("{documents}", "TIMESTAMP_NTZ"), documents=documents)


def companies(spark: SparkSession) -> DataFrame:
    """The pool's companies and the search that repeats their postings, all active."""
    rows = COMPANIES + [("zz-search", "Everything Search", "linkedin", "INTERNATIONAL")]
    df = spark.createDataFrame(rows, "slug string, name string, source string, target_region string")
    return df.select(
        "slug", "name", "source", F.col("slug").alias("external_id"), "target_region",
        F.lit(True).alias("active"),
    )
