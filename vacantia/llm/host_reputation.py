"""URL filter by host reputation with empirical-Bayes shrinkage (operator 2).

Labelled pages give each host a count of pages and of bad ones.  Hosts that were seen
rarely lean on their registered domain, domains on their suffix, suffixes on the whole:
at each level the parent's rate and a strength make a beta prior, the level's own counts
update it.  A level's strength is the moment estimate of the beta-binomial spread of its
members' rates.  A host is blocked when the lower posterior bound of its bad rate
(mean minus ``z`` standard deviations) reaches ``block_from``.  Rules come first.

Only counts per host move; three strengths and one rate go through the driver.

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is
judged by the overall rate; a page with several labels counts once for each, null labels
and labels without a page not at all; without any label everything is allowed; repeated
rows are judged each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_side

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 10_000.0


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def registered_domain(host: Column) -> Column:
    """The last two labels of a host; a host of one label is its own domain."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _strength(members: DataFrame) -> float | None:
    """Beta-binomial strength from the spread of the members' rates; None without a label."""
    sums = members.where("n > 0").agg(
        F.count("*").alias("m"), F.sum("n").alias("n"), F.sum("bad").alias("bad"),
        F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("b2"),
    ).first()
    if not sums["n"]:
        return None
    m, n, p = sums["m"], float(sums["n"]), sums["bad"] / sums["n"]
    own = p * (1 - p)
    room = n - sums["n2"] / n - (m - 1)
    if own <= 0 or room <= 0:
        return MOST_STRENGTH
    between = (sums["b2"] - n * p * p - own * (m - 1)) / (own * room)
    if between <= 0:
        return MOST_STRENGTH
    return min(max(1 / between - 1, LEAST_STRENGTH), MOST_STRENGTH)


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Pages and bad pages among the labelled ones, by host, with the host's domain and suffix.

    ``labels`` has page_id and ``bad`` (0 or 1).
    """
    known = labels.where(F.col("page_id").isNotNull() & F.col("bad").isNotNull()).select("page_id", "bad")
    hosts = pages.select("page_id", host_of(F.col("url")).alias("host"))
    counted = hosts.join(known, "page_id").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    every = hosts.select("host").distinct().join(counted, "host", "left")
    return every.select(
        "host", registered_domain(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"),
        F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).cast("long").alias("bad"),
    )


def reputation(counts: DataFrame, z: float = 1.645) -> DataFrame:
    """Per host the posterior mean and lower bound of its bad rate."""
    domains = counts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    strengths = [_strength(level) for level in (counts, domains, suffixes)]
    if strengths[0] is None:
        return counts.select("host", F.lit(0.0).alias("bad_rate"), F.lit(0.0).alias("bad_bound"))
    of_host, of_domain, of_suffix = strengths
    total = suffixes.agg(F.sum("bad") / F.sum("n")).first()[0]

    suffix_rate = ((F.col("bad") + of_suffix * total) / (F.col("n") + of_suffix)).alias("suffix_rate")
    by_suffix = small_side(suffixes.select("suffix", suffix_rate))
    domain_rate = ((F.col("bad") + of_domain * F.col("suffix_rate")) / (F.col("n") + of_domain)).alias("domain_rate")
    by_domain = small_side(domains.join(by_suffix, "suffix").select("domain", domain_rate))
    size = F.col("n") + F.lit(of_host)
    mean = (F.col("bad") + of_host * F.col("domain_rate")) / size
    bound = F.col("bad_rate") - z * F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.col("size") + 1))
    return counts.join(by_domain, "domain").select("host", mean.alias("bad_rate"), size.alias("size")).select(
        "host", "bad_rate", bound.alias("bad_bound")
    )


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Name and verdict of the longest rule that fits; null where none does."""
    longest_first = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = [
        ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path) for r in longest_first
    ]
    named = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict")) for r in longest_first]
    return F.coalesce(*[F.when(fit, name) for fit, name in zip(fits, named, strict=True)])


def judge(pages: DataFrame, hosts: DataFrame, rules: list[Rule], block_from: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's bound for every page."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = small_side(hosts.select("host", "bad_bound"))
    ruled = parts.join(known, "host", "left").withColumn(
        "fits", fitting_rule(F.col("host"), F.col("path"), rules) if rules else F.lit(None).cast("struct<rule:string,verdict:string>")
    )
    own = F.when(F.col("bad_bound") >= block_from, "block").otherwise("allow")
    return ruled.select(
        "page_id", "host", "path", F.col("fits.rule").alias("rule"),
        F.coalesce("fits.verdict", own).alias("verdict"), "bad_bound",
    )
