"""A posting parsed once, so that rules read columns and never text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon
from ..functions.patterns import any_of, first_match, fold, found, found_any, group, held, hits_any, quoted, to_int
from ..functions.text import company_name_norm, normalize_title, occurrences, section
from ..session import once_per_session, settled
from .tiers import with_tier

_CORE = [
    "title_norm", "seniority", "specialization", "required_years", "preferred_years",
    "range_min", "range_max", "grad_friendly", "description_chars",
    "skills_title", "skills_description", "skills", "skills_required", "skills_preferred",
    "company_tier", "keyword_counts",
]
FEATURE_COLUMNS = _CORE + [f"hits_{bank}" for bank in lexicon.PHRASE_BANKS]


def detect_seniority(title_norm: Column, folded: Column, required_years: Column, seen: Column | None = None) -> Column:
    """Title words first, then demanded years, then graduate-programme wording."""
    by_years = (
        F.when(required_years >= 7, "staff")
        .when(required_years >= 5, "senior")
        .when(required_years >= 3, "mid")
        .when(required_years <= 2, "junior")
        .when(found(folded, lexicon.GRADUATE_PROGRAMME, seen), "graduate")
        .otherwise("unknown")
    )
    return first_match(title_norm, lexicon.SENIORITY, otherwise=by_years)


def detect_specialization(title_norm: Column) -> Column:
    return first_match(title_norm, lexicon.SPECIALIZATION)


def experience(folded: Column, seen: Column | None = None) -> dict[str, Column]:
    """Years as written; the generic wording counts only where nothing else does."""
    hard = to_int(group(folded, lexicon.YEARS_HARD, seen=seen))
    soft = to_int(group(folded, lexicon.YEARS_SOFT, seen=seen))
    low = to_int(group(folded, lexicon.YEARS_RANGE, 1, seen))
    high = to_int(group(folded, lexicon.YEARS_RANGE, 2, seen))
    generic = to_int(group(folded, lexicon.YEARS_GENERIC, seen=seen))
    return {
        "required_years": F.when(hard.isNull() & soft.isNull() & low.isNull(), generic).otherwise(hard),
        "preferred_years": soft,
        "range_min": low,
        "range_max": high,
        "grad_friendly": found(folded, lexicon.GRAD_FRIENDLY, seen),
    }


def skills_in(folded: Column, vocabulary=None, seen: Column | None = None) -> Column:
    """Skills of the vocabulary that a text mentions, in vocabulary order."""
    vocabulary = vocabulary or lexicon.SKILLS
    named = [F.when(found_any(folded, p, seen), F.lit(skill)) for skill, p in vocabulary.items()]
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(folded, F.lit("")) == "", none).otherwise(
        F.filter(F.array(*named), lambda s: s.isNotNull())
    )


def company_tier(name: Column, given: Column | None = None) -> Column:
    """Tier of an employer by name: terms contained in it, then spam and vague wording.

    ``given`` is a tier found otherwise (see ``tiers``), to be taken instead of the terms.
    """
    tiers = {tier: quoted(terms) for tier, terms in lexicon.COMPANY_TIERS.items()} if given is None else {}
    norm = company_name_norm(name)
    found_by = first_match(norm, {**tiers, **lexicon.COMPANY_PATTERNS}.items(), test=lambda t, p: t.rlike("(?U)" + p))
    return found_by if given is None else F.coalesce(given, found_by)


def _layers(vocabulary, banks, tier: Column | None = None) -> list[dict[str, Column]]:
    """Columns to add, layer by layer.

    Each layer reads the columns of the one below more than once, so the
    optimizer keeps them apart and no text is scanned twice for one column.
    """
    text = F.coalesce("description_text", F.lit(""))
    folded, title, seen = F.col("_folded"), F.col("title_norm"), F.col("_held")
    with_title = F.concat(folded, F.lit(" "), title)
    years = [v for k, v in vars(lexicon).items() if k.startswith("YEARS_")]
    gated = [p for patterns in [*vocabulary.values(), *banks.values()] for p in patterns]
    gated += [*years, lexicon.GRAD_FRIENDLY, lexicon.GRADUATE_PROGRAMME]
    words = [*lexicon.PREFERRED_HEADINGS, *lexicon.REQUIRED_HEADINGS, *lexicon.STUFFING_KEYWORDS]
    parsed = {
        **experience(folded, seen),
        "_preferred": section(folded, lexicon.PREFERRED_HEADINGS, seen=seen),
        "_required": section(folded, lexicon.REQUIRED_HEADINGS, seen=seen),
        "specialization": detect_specialization(title),
        "description_chars": F.length(text),
        "skills_title": skills_in(title, vocabulary),
        "skills_description": skills_in(folded, vocabulary, seen),
        "company_tier": company_tier(F.col("company_name"), tier),
        "keyword_counts": F.array(*[occurrences(folded, k, seen) for k in lexicon.STUFFING_KEYWORDS]),
    }
    for bank, patterns in banks.items():
        read = with_title if bank in lexicon.BANKS_WITH_TITLE else folded
        parsed[f"hits_{bank}"] = hits_any(read, patterns, seen)
    # a cut-off section may show a word the whole text does not hold, hence the intersections
    preferred = F.array_except(F.array_intersect("skills", "_in_preferred"), "_in_required")
    required = F.array_union(F.array_intersect("skills", "_in_required"), "skills_title")
    return [
        {"title_norm": normalize_title(F.col("title")), "_folded": fold(text)},
        # of text and title: a gate that opens for a literal of the title alone costs a look, no result
        {"_held": held(with_title, gated, words)},
        parsed,
        {
            "seniority": settled(detect_seniority(title, folded, F.col("required_years"), seen)),
            "skills": settled(F.array_union("skills_title", "skills_description")),
            "_in_preferred": skills_in(F.col("_preferred"), vocabulary),
            "_in_required": skills_in(F.col("_required"), vocabulary),
        },
        {"skills_preferred": preferred},
        {"skills_required": settled(F.array_except(required, "skills_preferred"))},
    ]


@once_per_session
def _default_layers() -> list[dict[str, Column]]:
    return _layers(lexicon.SKILLS, lexicon.PHRASE_BANKS)


def features(df: DataFrame, vocabulary=None, banks=None, tiers: DataFrame | None = None) -> DataFrame:
    """Add FEATURE_COLUMNS to postings (title, description_text, company_name).

    ``tiers`` is a table of terms (see ``tiers``) to be taken for that of the word lists.
    """
    if vocabulary or banks or tiers is not None:
        tier = None if tiers is None else F.col("_tier")
        layers = _layers(vocabulary or lexicon.SKILLS, banks or lexicon.PHRASE_BANKS, tier)
    else:
        layers = _default_layers()
    if tiers is not None:
        df = with_tier(df, tiers, "_tier")
    for layer in layers:
        df = df.withColumns(layer)
    return df.drop("_folded", "_held", "_preferred", "_required", "_in_preferred", "_in_required", "_tier")


def skill_map(df: DataFrame) -> DataFrame:
    """Add ``stack``: skill to where it is mentioned and how."""

    def mention(skill: Column) -> Column:
        return F.struct(
            skill.alias("key"),
            F.struct(
                F.array_contains("skills_title", skill).alias("in_title"),
                F.array_contains("skills_description", skill).alias("in_description"),
                F.array_contains("skills_required", skill).alias("is_required"),
                F.array_contains("skills_preferred", skill).alias("is_preferred"),
            ).alias("value"),
        )

    return df.withColumn("stack", F.map_from_entries(F.transform("skills", mention)))


def feature_view(df: DataFrame, *ids: str) -> DataFrame:
    """What explains a score: level, kind, years, sorted skills of title and of text alone."""
    return features(df).select(
        *ids,
        "title_norm",
        "seniority",
        "specialization",
        F.col("required_years").alias("exp_required"),
        F.col("grad_friendly").alias("exp_grad_friendly"),
        F.array_sort("skills_title").alias("stack_title"),
        F.array_sort(F.array_except("skills", "skills_title")).alias("stack_desc"),
        "description_chars",
    )
