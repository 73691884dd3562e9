"""URL filters: explicit rules first, then empirical-Bayes host reputation.

Labelled page outcomes (good or bad) are counted per host. The good rate of a host is
shrunk towards its registered domain, that one towards its public suffix, and that one
towards the whole corpus. Each level is a beta-binomial whose prior strength is fitted by
moments over all groups of the level. A page passes if the lower posterior bound of its
host's good rate reaches a threshold.

Only DataFrame functions are used. Counts are summed before they are shuffled; a host with
a third of all rows is one row in the reputation table, and the join that brings verdicts
back to pages is a plain shuffled join which adaptive execution splits.

Defined cases: a null url or one without `://` has an empty host and path, no rule, and the
reputation of the empty host. Columns of the pages that are called like those added (host,
path, rule, verdict, bound) are replaced. Outcomes that are null count as unlabelled. Repeated rows are
judged and counted each. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, written

#: Public suffixes of two labels, a parameter of what uses them; any other suffix is the
#: last label. Fixed values.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.uk", "ne.jp", "or.jp", "org.au", "org.uk")


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_suffix(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    last_two = F.substring_index(host, ".", -2)
    return F.when(last_two.isin(*suffixes), last_two).otherwise(F.substring_index(host, ".", -1))


def url_domain(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The suffix and one label more; a bare suffix is its own domain."""
    last_two = F.substring_index(host, ".", -2)
    return F.when(last_two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(last_two)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Of the rules ("host/path", verdict) that fit, the longest as a struct; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _shrunk(groups: DataFrame, mean: Column, floor: float) -> DataFrame:
    """Adds `mean` and `strength` after pooling: `groups` has n, good and the parent's `mean`.

    Moments of the beta-binomial: E(k - nm)^2 = nm(1 - m)(1 + (n - 1)r), r = 1/(strength + 1).
    """
    var = F.col("n") * mean * (1 - mean)
    fit = groups.agg(
        F.sum(F.pow(F.col("good") - F.col("n") * mean, 2) - var).alias("over"),
        F.sum((F.col("n") - 1) * var).alias("room"),
    ).select(F.least(F.lit(0.5), F.greatest(F.lit(floor), F.coalesce(F.when(F.col("room") > 0, F.col("over") / F.col("room")), F.lit(floor)))).alias("r"))
    k = 1 / F.col("r") - 1
    return groups.crossJoin(F.broadcast(fit)).withColumn("strength", k).withColumn("mean", (F.col("good") + F.col("strength") * mean) / (F.col("n") + F.col("strength"))).drop("r")


def host_reputation(outcomes: DataFrame, host: str = "host", good: str = "good", z: float = 1.645, floor: float = 0.002, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """One row per host: n, good, mean and bound (the lower posterior bound).

    `outcomes` has a row per page; `good` is 1, 0 or null for a page without a label.
    """
    hosts = outcomes.groupBy(F.col(host).alias("host")).agg(F.count(good).alias("n"), F.coalesce(F.sum(F.col(good).cast("long")), F.lit(0)).alias("good"))
    # Counts are written once: each level is an aggregate of few rows from then on.
    hosts = written(hosts.withColumn("domain", url_domain(F.col("host"), suffixes)).withColumn("suffix", url_suffix(F.col("host"), suffixes)), "url-hosts")
    sums = (F.sum("n").alias("n"), F.sum("good").alias("good"))
    domains = written(hosts.groupBy("domain", "suffix").agg(*sums), "url-domains")
    tops = written(domains.groupBy("suffix").agg(*sums), "url-suffixes")
    whole = tops.agg(((F.sum("good") + 1) / (F.sum("n") + 2)).alias("mean"))  # always one row
    tops = written(_shrunk(tops.crossJoin(F.broadcast(whole)), F.col("mean"), floor).select("suffix", "mean"), "url-suffixes")
    domains = written(_shrunk(domains.join(tops, "suffix"), F.col("mean"), floor).select("domain", "mean"), "url-domains")
    hosts = _shrunk(hosts.join(domains, "domain"), F.col("mean"), floor)
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("strength") + 1))
    return hosts.select("host", "n", "good", "mean", (F.col("mean") - F.lit(z) * sd).alias("bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], url: str = "url", least: float = 0.5, z: float = 1.645, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """`pages` with host, path, rule, verdict and bound. `outcomes`: host and good, a row per page."""
    clash = [c for c in pages.columns if c.lower() in ("host", "path", "rule", "verdict", "bound")]
    pages = pages.drop(*[c for c in clash if c != url])
    hit, key = free_name(pages, "hit"), free_name(pages, "key")
    pages = pages.withColumn("host", url_host(F.col(url))).withColumn("path", url_path(F.col(url)))
    pages = pages.withColumn(hit, matched_rule(F.col("host"), F.col("path"), rules))
    known = host_reputation(outcomes, z=z, suffixes=suffixes).select(F.col("host").alias(key), "bound")
    judged = pages.join(known, pages["host"] == known[key], "left").drop(key)
    verdict = F.coalesce(F.col(f"{hit}.verdict"), F.when(F.col("bound") >= least, "allow").otherwise("block"))
    return judged.withColumn("rule", F.col(f"{hit}.rule")).withColumn("verdict", verdict).drop(hit)


__all__ = ["filter_urls", "host_reputation", "matched_rule", "url_domain", "url_host", "url_path", "url_suffix"]
