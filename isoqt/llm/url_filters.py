"""URL filter: exact host and path rules, and an empirical-Bayes reputation of hosts for all other pages.

Labelled page outcomes are counted per host. A beta-binomial prior is fitted at each level by the analysis-of-variance
estimate of the intraclass correlation; the corpus shrinks suffixes, a suffix its registered domains, a domain its
hosts. A host is blocked when the lower bound of its posterior share of bad pages passes the limit.

Defined cases: a null url or one without ``://`` has an empty host and path, meets no rule and is judged with the
other pages of the empty host; a host without labelled pages gets its domain's prior; with no labels at all every
page without a rule is allowed; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (action, host, path): fits the host and its subdomains when the path starts with ``path``; the longest rule wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Second-level labels that belong to the suffix when a country code follows (fixed values of common registries).
SECOND_LEVEL = ("co", "com", "net", "org", "ac", "gov", "edu")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    second = "|".join(SECOND_LEVEL)
    return F.regexp_extract(host, rf"((?:(?<=\.)(?:{second})\.[a-z]{{2}})|[^.]*)$", 1)


def domain_of(host: Column) -> Column:
    second = "|".join(SECOND_LEVEL)
    return F.regexp_extract(host, rf"([^.]+\.(?:{second})\.[a-z]{{2}}|[^.]+\.[^.]*|[^.]*)$", 1)


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (as ``hostpath``) and its action, both null when none fits."""
    rule = action = F.lit(None).cast("string")
    for act, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path).otherwise(rule)
        action = F.when(fits, act).otherwise(action)
    return rule, action


def concentration(groups: DataFrame, low: float, high: float) -> Column:
    """Prior strength of a level from its groups' ``n`` and ``bad``: (1 - rho) / rho within [low, high]."""
    n, bad = F.col("n"), F.col("bad")
    total, hits, count = F.sum(n), F.sum(bad), F.count(F.lit(1))
    mean = hits / total
    between = (F.sum(bad * bad / n) - total * mean * mean) / F.greatest(count - 1, F.lit(1))
    within = F.sum(bad - bad * bad / n) / F.greatest(total - count, F.lit(1))
    size = (total - F.sum(n * n) / total) / F.greatest(count - 1, F.lit(1))
    rho = (between - within) / F.nullif(between + (size - 1) * within, F.lit(0.0))
    return F.when(rho > 0, F.greatest(F.lit(low), F.least(F.lit(high), (1 - rho) / rho))).otherwise(F.lit(high))


def reputation(hosts: DataFrame, z: float = 1.645, low: float = 1.0, high: float = 1000.0) -> DataFrame:
    """Posterior of every host: ``hosts`` has host, n (labelled pages) and bad; adds mean and lower bound.

    The level sums are aggregates of the host table; priors are one row each, joined as such.
    """
    hosts = hosts.select("host", "n", "bad", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    priors = [level.where("n > 0").agg(concentration(level, low, high).alias("k"), (F.sum("bad") / F.sum("n")).alias("m")).first()
              for level in (suffixes, domains, hosts)]
    if priors[0]["m"] is None:
        return hosts.select("host", F.lit(0.0).alias("mean"), F.lit(0.0).alias("lower"))
    (ks, m), (kd, _), (kh, _) = priors
    shrink = lambda k, prior, n="n", bad="bad": (k * prior + F.col(bad)) / (k + F.col(n))
    top = suffixes.select("suffix", shrink(ks, m).alias("m_suffix"))
    mid = domains.join(top, "suffix").select("domain", "suffix", shrink(kd, F.col("m_suffix")).alias("m_domain"))
    a, b = F.col("a"), F.col("b")
    return (hosts.join(mid, ["domain", "suffix"])
            .select("host", (kh * F.col("m_domain") + F.col("bad")).alias("a"), (kh * (1 - F.col("m_domain")) + F.col("n") - F.col("bad")).alias("b"))
            .select("host", (a / (a + b)).alias("mean"), (a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("lower")))


def judge(pages: DataFrame, outcomes: DataFrame, key: Column, rules=RULES, limit: float = 0.5, z: float = 1.645) -> DataFrame:
    """Page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url).

    ``outcomes`` has ``key`` (unique, bigint) and ``bad`` (0 or 1); ``key`` is the column of pages it refers to. The
    hot host is counted map-side; the join that brings the verdict back is left to Spark, which splits a skewed host.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), key.alias("key"))
    labels = outcomes.where("key IS NOT NULL AND bad IS NOT NULL").groupBy("key").agg(F.max("bad").cast("double").alias("bad"))
    counts = rows.join(labels, "key", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"))
    blocked = reputation(counts, z).where(F.col("lower") > limit).select("host", F.lit("block").alias("reputation"))
    rule, action = match_rule(F.col("host"), F.col("path"), rules)
    return (rows.join(blocked, "host", "left")
            .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, F.col("reputation"), F.lit("allow")).alias("verdict")))
