"""URL filter: rules first, then the empirical-Bayes reputation of the host.

A labelled page is good or bad. Counts per host, registered domain and suffix form a chain of
beta-binomial models: the prior of a suffix is centred on the whole table's rate, that of a domain
on its suffix's posterior mean, that of a host on its domain's, so that a host with few labels keeps
close to its kin. Each level's concentration is fitted by moments over its groups. A host is blocked
when even the lower posterior bound of its bad rate is above the tolerated rate; one with too few
labels to be sure is allowed. A host without labels is judged by its prior alone, from the nearest of
domain, suffix and whole table that has labels; without any labels all hosts are allowed.

Only counts per host are shuffled, after partial aggregation, and only distinct hosts reach the
numerical step. A host with a third of all pages is a row there, and its pages stay where they are
when the verdicts are joined, by broadcast where small and with skewed partitions split otherwise.

Defined results: a null url, or one without `://`, has an empty host and path, no rule, and is
allowed without a reputation; repeated rows each get the verdict; labels that are null are no
labels; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut

# The rules of the contract, as (host and its subdomains, start of the path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
# Public suffixes of two labels, the common ones; the whole list can be passed instead.
SUFFIXES = tuple(
    f"{second}.{top}"
    for top, seconds in {
        "ar": "com edu gob net org", "au": "com edu gov id net org", "br": "com edu gov net org", "cn": "ac com edu gov net org", "hk": "com edu gov net org", "id": "ac co go or web",
        "il": "ac co gov net org", "in": "ac co edu gov net org", "jp": "ac co ed go gr lg ne or", "ke": "ac co go ne or", "kr": "ac co go ne or re", "mx": "com edu gob net org",
        "my": "com edu gov net org", "nz": "ac co geek govt iwi maori net org school", "ph": "com edu gov net org", "pl": "com edu gov net org", "sg": "com edu gov net org",
        "th": "ac co go in or", "tr": "com edu gov net org", "tw": "com edu gov net org", "ua": "com edu gov net org", "uk": "ac co gov ltd me net nhs org plc police sch", "za": "ac co gov net org web",
    }.items()
    for second in seconds.split()
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    found = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null without one."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _owner(host: Column) -> tuple[Column, Column]:
    """(host without its port, whether it is an IP address)."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    return name, name.rlike(r"^(\[.*\]|[0-9]{1,3}(\.[0-9]{1,3}){3})$")


def domain_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The registered domain: the public suffix and the label before it; an IP address is whole."""
    name, address = _owner(host)
    return F.when(address, name).when(F.substring_index(name, ".", -2).isin(*suffixes), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def suffix_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The public suffix: two labels if those are in `suffixes`, else one."""
    name, address = _owner(host)
    last = F.substring_index(name, ".", -2)
    return F.when(address, name).when(last.isin(*suffixes), last).otherwise(F.substring_index(name, ".", -1))


def concentration(level: DataFrame, mean: str, least: float = 2.0, most: float = 1000.0) -> Column:
    """Method of moments over groups with (bad, n) and prior mean: a window-free aggregate column."""
    # E[(b - n m)^2] = n m (1 - m) (1 + (n - 1) rho), rho = 1 / (1 + s)
    spread = F.sum(F.pow(F.col("bad") - F.col("n") * F.col(mean), 2) - F.col("n") * F.col(mean) * (1 - F.col(mean)))
    scale = F.sum(F.col("n") * (F.col("n") - 1) * F.col(mean) * (1 - F.col(mean)))
    rho = F.try_divide(spread, scale)
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(F.try_divide(1 - rho, F.greatest(rho, F.lit(1e-9))), F.lit(least))))


def _beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    logs = np.array([lgamma(u + v) - lgamma(u) - lgamma(v) for u, v in zip(p, q, strict=True)])
    with np.errstate(divide="ignore"):
        front = np.exp(logs + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 / np.maximum(tiny, np.abs(1 - (p + q) * z / (p + 1))) * np.sign(1 - (p + q) * z / (p + 1))
    f = d.copy()
    for m in range(1, 300):
        for top in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            d = 1 / d
            f = f * d * c
    out = front * f
    return np.where(flip, 1 - out, out)


def beta_quantile(level: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lo, hi = np.zeros(len(a)), np.ones(len(a))
    for _ in range(40):
        mid = (lo + hi) / 2
        below = _beta_cdf(mid, a, b) < level
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def reputations(labelled: DataFrame, confidence: float = 0.95, hosts: DataFrame | None = None, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """host, n, bad, reputation (posterior mean of the bad rate), bound (its lower posterior bound).

    `labelled` has host and bad (0 or 1, null: no label); `hosts` has distinct hosts to judge besides
    the labelled ones. Without labels nothing is judged.
    """
    host = labelled.where("bad is not null").groupBy("host").agg(F.sum("bad").cast("double").alias("bad"), F.count("*").cast("double").alias("n"))
    host = host.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes))
    host = cut(host)  # a row per labelled host, read at each level
    domain = host.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    suffix = domain.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    total = suffix.agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1)).alias("mean"))

    def posterior(level: DataFrame, prior: DataFrame, on: str | None, others: DataFrame | None = None) -> DataFrame:
        """Adds alpha, beta and mean, given the prior mean of each group's parent; `others` are groups without labels."""

        def under(groups: DataFrame) -> DataFrame:
            return groups.join(prior.withColumnRenamed("mean", "prior"), on) if on else groups.crossJoin(F.broadcast(prior.withColumnRenamed("mean", "prior")))  # one row

        joined = cut(under(level))  # a row per group, read for the strength and for the posterior
        weight = joined.agg(concentration(joined, "prior").alias("strength"))
        if others is not None:
            joined = joined.unionByName(under(others.withColumn("bad", F.lit(0.0)).withColumn("n", F.lit(0.0))))
        out = joined.crossJoin(F.broadcast(weight))  # one row
        out = out.withColumn("alpha", F.col("prior") * F.col("strength") + F.col("bad")).withColumn("beta", (1 - F.col("prior")) * F.col("strength") + F.col("n") - F.col("bad"))
        return out.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta"))).drop("prior", "strength")

    new = [None, None, None]
    if hosts is not None:
        # Groups without labels at each level: a fitted mean is the parent's, as their counts are 0.
        fresh = hosts.select("host").join(host.select("host"), "host", "left_anti").withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes))
        fresh = cut(fresh)
        domains = fresh.select("domain", "suffix").distinct().join(domain.select("domain"), "domain", "left_anti")
        new = [domains.select("suffix").distinct().join(suffix.select("suffix"), "suffix", "left_anti"), domains, fresh]
    total = total.where("mean is not null")
    suffix = cut(posterior(suffix, cut(total), None, new[0]))
    domain = cut(posterior(domain, suffix.select("suffix", "mean"), "suffix", new[1]))
    host = posterior(host, domain.select("domain", "mean"), "domain", new[2])

    def bounds(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(bound=beta_quantile(1 - confidence, part["alpha"].to_numpy(), part["beta"].to_numpy()))[["host", "n", "bad", "reputation", "bound"]]

    rows = host.select("host", "n", "bad", F.col("mean").alias("reputation"), "alpha", "beta")
    return rows.mapInPandas(bounds, "host string, n double, bad double, reputation double, bound double")


def filter_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules=RULES,
    tolerated: float = 0.5,
    confidence: float = 0.95,
    page_id: str = "page_id",
    url: str = "url",
    suffixes: tuple[str, ...] = SUFFIXES,
) -> DataFrame:
    """page_id, host, path, rule, verdict, reputation, bound for each page.

    `outcomes` has page_id and bad; a page may have several outcomes. Rows that repeat a page_id and a
    host are one page, so that its outcomes count once.
    """
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select(F.col(page_id).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    seen = judged.select("page_id", "host").distinct().join(outcomes.select(F.col("page_id"), F.col("bad").cast("long").alias("bad")), "page_id")
    hosts = judged.where("host <> ''").select("host").distinct()
    known = reputations(seen.where("host <> ''"), confidence, hosts, suffixes).select("host", "reputation", "bound")
    out = judged.withColumn("rule", rule).withColumn("ruled", verdict).join(known, "host", "left")
    own = F.when(F.col("bound") > tolerated, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "reputation", "bound")


def _bad() -> Column:
    return F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull(), 0)


def outcomes_from_labels(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Outcomes of pages whose path ends in the id of a labelled document: bad if of low quality or toxic."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), _bad().alias("bad")).distinct()
    named = pages.select(F.col(page_id).alias("page_id"), F.try_to_number(F.regexp_extract(path_of(url), r"/([0-9]{1,18})(?:/|\.html)?$", 1), F.lit("9" * 18)).cast("long").alias("doc_id"))
    return named.where("doc_id is not null").distinct().join(known.where("bad is not null"), "doc_id").select("page_id", "bad")
