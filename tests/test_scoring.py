"""Scoring cases: which rules fire, and how scores compare.  All scored in one job."""

import pytest
from pyspark.sql import functions as F

from vacantia.operators import scoring

AS_OF = "2024-02-01 12:00:00"
RICH = "Our stack is Java and Spring over Postgres, with Redis and Kafka beside a REST layer of distributed systems; mentors for all, 0-2 years is fine."
NEW_GRAD = "This new grad program puts you on distributed systems for millions of requests at low latency. A learning budget, mentoring, and engineering excellence come with it."
IDEAL = ("What we run: microservices on Kubernetes and Docker, a Postgres store, Redis as cache, Kafka for events. What we write: "
         "Spring Boot with JPA and Hibernate behind REST APIs. Ask for 0-2 years, get mentorship and a career path.")
TOP = ("You own microservices on Kubernetes: distributed systems that answer billions of events, and API design for them. "
       "0-2 years. Relocation assistance and visa sponsorship are ours to give, so are ownership, mentors and career progression.")
AVERAGE = ("Three things matter: Java with Spring Boot, REST APIs over Postgres and Redis, and Docker on Kubernetes. "
           "3+ years of experience is a must; backend services are what the team ships, with an engineering culture.")
FULL = "Hibernate and JPA under Spring Boot in Java; REST APIs between microservices on Kubernetes and Docker; Kafka, Redis, Postgres."
PURE = ("Junior Java Developer", "You know Postgres, JPA with Hibernate and some Spring Boot, from 0-2 years of work.")
GENERIC = ("Software Engineer, New Grad", "A distributed system of microservices and its API, in a team with engineering practices.")
KNOWN_FIRM = "Ownership and career growth on microservices, an API and distributed systems."

# case: (region, title, text, more)
CASES = {
    "swe": ("INT", "SWE I", "first job"),
    "sde": ("INT", "SDE I (New Grad)", ""),
    "jr": ("EG", "Jr. Backend Engineer", ""),
    "senior": ("INT", "Senior Backend Engineer", "Spring in Java"),
    "staff": ("INT", "Staff Backend Engineer", ""),
    "principal": ("INT", "Principal Software Engineer", ""),
    "lead": ("INT", "Lead Engineer", ""),
    "new_grad": ("INT", "New Grad Software Engineer", NEW_GRAD),
    "intern": ("INT", "Backend Intern", ""),
    "years": ("EG", "Java Engineer", "You bring at least 6 years of experience."),
    "backend": ("EG", "Backend Developer", "An API in REST style"),
    "thin": ("INT", "Software Engineer", "A young firm with a kitchen."),
    "rich": ("INT", "Software Engineer", "A microservice per team, one API for millions of events, all of it a distributed system"),
    "frontend": ("EG", "Frontend React Developer", "Redux and React"),
    "mobile": ("EG", "iOS Developer", "All Swift"),
    "ml": ("INT", "Machine Learning Engineer II", ""),
    "data": ("INT", "Data Engineer II", ""),
    "qa": ("INT", "QA Engineer", ""),
    "security": ("INT", "Security Engineer II", ""),
    "devops": ("INT", "DevOps Engineer II", ""),
    "full_stack_text": ("EG", "Backend Developer", FULL),
    "java_preferred": ("INT", "Software Engineer", "We like Java"),
    "modern": ("INT", "Backend Developer", "REST microservices over Redis and Postgres, in Docker, on Kubernetes"),
    "grad": ("INT", "Software Engineer", "Meant for a recent graduate with 0-2 years experience."),
    "seven": ("EG", "Java Engineer", "At least 7 years of experience required."),
    "pure_eg": ("EG", *PURE),
    "pure_int": ("INT", *PURE),
    "generic_eg": ("EG", *GENERIC),
    "generic_int": ("INT", *GENERIC, {"remote": True, "country": "Remote - US"}),
    "stripe": ("INT", "Software Engineer", KNOWN_FIRM, {"remote": True, "company_name": "Stripe"}),
    "unknown": ("INT", "Software Engineer", KNOWN_FIRM, {"remote": True, "company_name": "Corner Bakery and Sons"}),
    "asana": ("INT", "Software Engineer", "One API, many callers", {"remote": True, "country": "Europe", "company_name": "Asana"}),
    "instabug": ("EG", "Junior Java Engineer", "Mostly Spring Boot", {"company_name": "Instabug"}),
    "staffing": ("INT", "Software Engineer", "An API to write", {"company_name": "Nile Staffing Agency"}),
    "vague": ("INT", "Software Engineer", "An API to write", {"company_name": "Confidential"}),
    "visa": ("INT", "Software Engineer", "A relocation package comes with the visa sponsorship."),
    "no_visa": ("INT", "Software Engineer", "Engineers wanted."),
    "visa_eg": ("EG", "Java Engineer", "International applicants get visa sponsorship."),
    "scale": ("INT", "Backend Developer", "High throughput at low latency: distributed systems for billions of records."),
    "platform": ("INT", "Backend Developer", "CI/CD and observability for the developer tools of a platform team."),
    "growth": ("INT", "Software Engineer", "Mentors, a learning stipend, ownership of your part and a career path."),
    "support": ("INT", "Software Engineer", "A help desk job: technical support, mostly tier 2 support calls."),
    "legacy": ("INT", "Java Engineer", "EJB and COBOL on a mainframe; the legacy code must live on."),
    "low_eng": ("INT", "Software Engineer", "Drupal, CMS admin work, some WordPress and no-code forms."),
    "spam": ("INT", "Software Engineer", "Urgently hiring!!! WhatsApp on +2012 and apply now !!!"),
    "buzz": ("INT", "Software Engineer", "A passionate guru, a ninja, a rockstar: the self-starter and visionary whose synergy will disrupt."),
    "stuffing": ("INT", "Software Engineer", " ".join(["java"] * 10)),
    "stripe_swe": ("INT", "Software Engineer", "With mentors and ownership: an API design for distributed systems. We sponsor visa papers.",
                   {"remote": True, "company_name": "Stripe"}),
    "random_backend": ("INT", "Backend Developer", "An API for forms", {"company_name": "Corner Bakery and Sons"}),
    "junior_java": ("EG", "Junior Java Engineer", "0-2 yrs of Spring Boot."),
    "senior_java": ("EG", "Senior Java Architect", "8+ yrs of Spring."),
    "java_backend": ("EG", "Junior Java Backend Developer", "Postgres through JPA and Spring Boot"),
    "react": ("EG", "Full Stack Engineer", "Node and React over MongoDB, the full stack"),
    "empty": ("INT", "Software Engineer", ""),
    "rich_text": ("INT", "Software Engineer", RICH),
    "javascript": ("EG", "JavaScript Developer", "Node and React"),
    "senior_spring": ("EG", "Senior Java Engineer", "Microservices in Spring"),
    "top": ("INT", "Software Engineer, New Grad", TOP, {"remote": True, "company_name": "Stripe"}),
    "poor": ("INT", "Senior Staff Architect", "No less than 10+ years of experience required"),
    "clamped": ("EG", "Junior Java Backend Developer", "Kubernetes, Docker, Postgres, Redis, Kafka, JPA, Hibernate, Spring Boot",
                {"company_name": "Instabug"}),
    "negatives": ("EG", "Senior Java Architect", "10+ years of Spring"),
    "ideal": ("EG", "Junior Java Backend Developer", IDEAL, {"company_name": "Instabug"}),
    "average": ("INT", "Backend Developer", AVERAGE),
    "null_text": ("INT", "Backend Developer", None),
}


@pytest.fixture(scope="module")
def got(spark):
    rows = []
    for case, (region, title, text, *more) in CASES.items():
        given = {"remote": False, "country": "Egypt" if region == "EG" else "USA", "company_name": None, **(more[0] if more else {})}
        rows.append((case, title, text, given["remote"], given["country"],
                     "EGYPT" if region == "EG" else "INTERNATIONAL", None, given["company_name"]))
    df = spark.createDataFrame(
        rows, "case string, title string, description_text string, remote boolean, country string, region string, "
              "posted_at timestamp, company_name string").repartition(8)
    scored = scoring.score(df, AS_OF).withColumn("json", F.to_json(scoring.breakdown()))
    return {r["case"]: r for r in scored.collect()}


def rules(row):
    return {r["name"]: r for r in row["triggered_rules"]}


PRESENT = {
    "swe": "seniority_junior", "jr": "seniority_junior", "senior": "seniority_senior", "staff": "seniority_staff",
    "principal": "seniority_staff", "lead": "seniority_lead", "new_grad": "seniority_graduate",
    "intern": "seniority_intern", "backend": "spec_backend", "rich": "spec_generic_swe_engineering_heavy",
    "frontend": "penalty_frontend_heavy", "mobile": "penalty_mobile", "ml": "penalty_ml", "data": "penalty_data",
    "qa": "penalty_qa", "security": "penalty_security", "devops": "penalty_devops",
    "full_stack_text": "stack_java_backend_synergy", "modern": "stack_modern_backend_synergy",
    "grad": "exp_grad_friendly", "seven": "exp_required_high", "stripe": "company_tier_s", "asana": "company_tier_a",
    "instabug": "company_tier_eg_t1", "staffing": "penalty_company_spam", "vague": "penalty_company_vague",
    "visa": "visa_relocation", "scale": "modern_scale_signals", "platform": "modern_platform_signals",
    "growth": "growth_signals", "support": "penalty_support_role", "legacy": "penalty_legacy_stack",
    "low_eng": "penalty_low_eng", "spam": "penalty_spam_phrasing", "buzz": "penalty_buzzword_stuffing",
    "stuffing": "penalty_keyword_stuffing_java",
}
ABSENT = [("thin", "spec_generic_swe_engineering_heavy"), ("java_preferred", "stack_java_backend_synergy"),
          ("javascript", "stack_java_title"), ("javascript", "stack_java_desc")]
BEATS = [("rich", "thin", 0), ("generic_int", "generic_eg", 0), ("stripe", "unknown", 10), ("visa", "no_visa", 0),
         ("stripe_swe", "random_backend", 0), ("junior_java", "senior_java", 25), ("java_backend", "react", 15)]
BELOW = [("senior", 30), ("staff", 20), ("principal", 20), ("poor", 35), ("senior_spring", 40)]


@pytest.mark.parametrize("case", PRESENT)
def test_rule_fires(got, case):
    assert PRESENT[case] in rules(got[case])


@pytest.mark.parametrize("case,name", ABSENT)
def test_rule_is_silent(got, case, name):
    assert name not in rules(got[case])


@pytest.mark.parametrize("case,other,margin", BEATS)
def test_beats(got, case, other, margin):
    assert got[case]["score"] > got[other]["score"] + margin


@pytest.mark.parametrize("case,limit", BELOW)
def test_below(got, case, limit):
    assert got[case]["score"] < limit


def test_either_rule(got):
    assert rules(got["sde"]).keys() & {"seniority_junior", "seniority_graduate"}
    assert rules(got["years"]).keys() & {"seniority_senior", "exp_required_high"}


def test_weights_by_region(got):
    assert rules(got["pure_eg"])["stack_java_title"]["final_points"] > rules(got["pure_int"])["stack_java_title"]["final_points"]
    visa = rules(got["visa_eg"])["visa_relocation"]
    assert visa["final_points"] < visa["base_points"]


def test_labels_and_ranges(got):
    assert got["new_grad"]["quality_label"] in ("Decent Fit", "Strong Fit", "Excellent Fit")
    assert got["top"]["quality_label"] in ("Strong Fit", "Excellent Fit") and got["top"]["score"] >= 65
    assert got["poor"]["quality_label"] == "Poor Fit"
    assert got["ideal"]["score"] >= 75 and got["ideal"]["confidence"] >= 75
    assert 30 <= got["average"]["score"] <= 75
    assert got["rich_text"]["confidence"] > got["empty"]["confidence"]


def test_every_row_adds_up(got):
    for row in got.values():
        total = 0.0
        for r in row["triggered_rules"]:
            total += r["final_points"]
        assert total == row["raw_score"] and 0 <= row["score"] <= 100
        assert row["score"] == max(0, min(100, round(total)))
        assert '"quality_label"' in row["json"] and '"triggered_rules"' in row["json"]


def test_negatives_listed(got):
    assert any(r["final_points"] < 0 for r in got["negatives"]["triggered_rules"])


def test_label_buckets(spark):
    df = spark.createDataFrame([(s,) for s in (85, 70, 55, 40, 20)], "s int")
    labels = [r[0] for r in df.select(scoring.quality_label(F.col("s"))).collect()]
    assert labels == ["Excellent Fit", "Strong Fit", "Decent Fit", "Weak Fit", "Poor Fit"]


def test_filter_on_a_score_does_not_copy_the_rules(spark):
    """The plan of a filter above the score stays as small as that of the score."""
    df = spark.createDataFrame([], "title string, description_text string, remote boolean, country string, region string, "
                                   "posted_at timestamp, company_name string")
    plain = scoring.score(df, AS_OF)
    size = lambda d: len(d._jdf.queryExecution().optimizedPlan().toString())
    assert size(plain.where("score >= 50")) < 1.2 * size(plain) + 10_000
