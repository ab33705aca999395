"""Judge pages by URL rules and by the reputation of their host.

A rule blocks or allows a host with its subdomains under a path prefix; the
longest rule that fits decides. Other pages are judged by their host: labelled
outcomes of pages are counted per host, and each host's rate of good pages is
shrunk through a beta-binomial prior towards its registered domain, that towards
the public suffix, and that towards all pages. The strength of each prior is
estimated from the spread of the rates at that level (method of moments). A host
is blocked on evidence only: if the upper posterior bound of its rate is below the
threshold. One with few labels has a wide interval and stays.

Results in special cases: a null URL or one without ``://`` has an empty host and
path; a host without labelled pages has the reputation of its domain, suffix or
of all pages; without any outcome the prior is even and nothing but rules blocks. Rows that repeat a page_id
are judged one by one; outcomes of a page_id that repeats are counted once, as
the worst of them. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm.storage import written

#: Pages that the rate of all pages is worth as the prior of a public suffix.
ROOT_STRENGTH = 10.0

#: Up to this many hosts the table of reputations is broadcast; beyond, it is joined by shuffle.
BROADCAST_HOSTS = 100_000


class Rule(NamedTuple):
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


#: The rules of the task.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, lower-cased."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits as (text, action), or null. Ties go to the first."""
    fitting = F.lit(None).cast("struct<text:string,action:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        inside = (host == rule.host) | host.endswith("." + rule.host)
        fitting = F.when(
            inside & path.startswith(rule.path),
            F.struct(F.lit(rule.text).alias("text"), F.lit(rule.action).alias("action")),
        ).otherwise(fitting)
    return fitting


def registered_domain(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def public_suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _strength(rates: DataFrame, keys: Sequence[str], center: str) -> DataFrame:
    """Prior strength of each parent: how many pages its rate is worth.

    By moments: the weighted variance of the children's rates around the parent's
    rate, less what chance alone gives them, over all rows of ``rates``.
    """
    rate, n, mid = F.col("good") / F.col("n"), F.col("n"), F.col(center)
    return (
        rates.filter("n > 0")
        .groupBy(*keys).agg(
            F.sum(n * (rate - mid) * (rate - mid)).alias("squares"),
            F.sum(mid * (1 - mid)).alias("noise"),
            F.sum(n * mid * (1 - mid)).alias("most"),
            F.count("*").alias("children"))
        .withColumn("spread", F.greatest(F.col("squares") - F.col("noise"), F.lit(0.0)))
        .select(*keys, F.when(
            (F.col("children") > 1) & (F.col("spread") > 0),
            F.greatest(F.lit(1.0), F.least(F.lit(1e4), F.col("most") / F.col("spread"))),
        ).otherwise(F.lit(ROOT_STRENGTH)).alias("strength"))
    )


def host_reputation(outcomes: DataFrame, hosts: DataFrame, z: float = 1.645) -> DataFrame:
    """host, n, good, mean, bound, upper for each host of ``hosts(host)``.

    ``outcomes(host, n, good)``: labelled pages and good ones among them per host.
    ``bound`` and ``upper`` are the mean less and plus ``z`` posterior standard deviations,
    for which the prior is worth no more pages than are labelled at the domain's other hosts.
    """
    base = (
        hosts.select("host").distinct().join(outcomes, "host", "left").na.fill(0, ["n", "good"])
        .withColumn("domain", registered_domain(F.col("host")))
        .withColumn("suffix", public_suffix(F.col("host")))
    )
    by_domain = base.groupBy("domain").agg(
        F.first("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("good").alias("good"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    # Each level takes its parent's mean as the centre of its prior. The root's window
    # runs over one row per public suffix.
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    suffixes = by_suffix.withColumn("center", (
        (F.sum("good").over(everything) + 1) / (F.sum("n").over(everything) + 2))
    ).select("suffix", (
        (F.col("good") + ROOT_STRENGTH * F.col("center")) / (F.col("n") + ROOT_STRENGTH)
    ).alias("suffix_mean"))
    domains = by_domain.join(suffixes, "suffix")
    domains = domains.join(_strength(domains, ["suffix"], "suffix_mean"), "suffix", "left").select(
        "domain", F.col("n").alias("domain_n"), (
            (F.col("good") + F.coalesce("strength", F.lit(ROOT_STRENGTH)) * F.col("suffix_mean"))
            / (F.col("n") + F.coalesce("strength", F.lit(ROOT_STRENGTH)))).alias("domain_mean"))
    own = base.join(domains, "domain")
    own = own.join(_strength(own, ["domain"], "domain_mean"), "domain", "left")
    prior = F.coalesce("strength", F.lit(ROOT_STRENGTH))
    alpha = F.col("good") + prior * F.col("domain_mean")
    weight = F.col("n") + prior
    mean = alpha / weight
    evidence = F.col("n") + F.least(prior, F.col("domain_n") - F.col("n"))
    away = z * F.sqrt(mean * (1 - mean) / (evidence + 1))
    return own.select(
        "host", "n", "good", mean.alias("mean"),
        F.greatest(F.lit(0.0), mean - away).alias("bound"), F.least(F.lit(1.0), mean + away).alias("upper"))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = RULES,
    threshold: float = 0.7, z: float = 1.645,
) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's mean and bounds, for each page.

    ``outcomes(page_id, good)``: labelled pages, good 0 or 1 (null: not labelled).
    """
    parsed = pages.select(
        "page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    # The worst outcome of a page, then counts per host: a hot host is summed before the shuffle.
    labelled = (
        outcomes.filter("page_id is not null and good is not null")
        .groupBy("page_id").agg(F.min("good").cast("long").alias("good"))
    )
    counted = (
        parsed.select("page_id", "host").join(labelled, "page_id")
        .groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    )
    reputation = written(host_reputation(counted, parsed.select("host"), z), "url-hosts")
    few = reputation.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    judged = parsed.join(
        F.broadcast(reputation) if few else reputation, "host", "left")
    return (
        judged.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
        .select(
            "page_id", "host", "path", F.col("fit.text").alias("rule"),
            F.coalesce(
                F.col("fit.action"),
                F.when(F.col("upper") < threshold, "block").otherwise("allow")).alias("verdict"),
            "mean", "bound", "upper")
    )
