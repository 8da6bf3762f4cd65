"""URL filter by empirical-Bayes host reputation, DataFrame functions only.

Labelled page outcomes are shrunk through beta-binomial priors: the suffix (last label) towards the whole
table, the registered domain (last two labels; no public-suffix list is at hand) towards its suffix, and the
host towards its domain. Each level's prior strength is its moment estimate of the spread between children.
A page without a rule is allowed if the lower posterior bound of its host's good share reaches a threshold.

Rules come first: a rule (host/path) fits its host and all subdomains if the path starts with the rule's;
the longest fitting rule decides, and of equally long ones the first by code point.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by
the reputation of the empty host; unlabelled hosts are judged by their domain's posterior; repeated pages are
judged one by one (each counts as an outcome); no labels at all leave the prior mean of one half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: One-sided 95 % bound.
Z = 1.645
THRESHOLD = 0.6
#: Bounds of the estimated prior strengths, in outcomes.
STRENGTH = (1.0, 1000.0)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring(coalesce(`{url}`, ''), instr(coalesce(`{url}`, ''), '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The fitting rule and its verdict, null if none fits. Rules are configuration: few, kept in the plan."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        at, tail = rule.split("/", 1)
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + tail)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def _level(rows: DataFrame, key: str, up: str) -> DataFrame:
    return rows.groupBy(key, up).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def _strength(level: DataFrame, name: str) -> DataFrame:
    """One row: moment estimate (Kleinman) of a level's prior strength."""
    tot = level.agg(F.count(F.lit(1)).cast("double").alias("m"), F.sum("n").cast("double").alias("t"), F.sum("k").cast("double").alias("g"), F.sum(F.col("n") * F.col("n")).cast("double").alias("q"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("r"))
    p = F.col("g") / F.col("t")
    var = p * (1 - p)
    rho = (F.col("r") - F.col("t") * p * p - var * (F.col("m") - 1)) / (var * (F.col("t") - F.col("q") / F.col("t") - (F.col("m") - 1)))
    s = F.when((F.col("t") > 0) & (var > 0) & (F.col("t") - F.col("q") / F.col("t") - (F.col("m") - 1) > 0) & (rho > 0), (1 - rho) / rho).otherwise(STRENGTH[1])
    return tot.select(F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), s)).alias(name))


def reputation(outcomes: DataFrame) -> DataFrame:
    """host and bound (lower posterior bound of the good share) from rows host, n (outcomes) and k (good).

    One row for each host of ``outcomes``, unlabelled ones (n = 0) too.
    """
    dotted = F.split("host", r"\.")
    hosts = outcomes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    hosts = hosts.withColumn("domain", F.when(F.size(dotted) > 1, F.concat_ws(".", F.slice(dotted, -2, 2))).otherwise(F.col("host"))).withColumn("suffix", F.element_at(dotted, -1))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"))
    whole = suffixes.agg(((F.coalesce(F.sum("sk"), F.lit(0)) + 1) / (F.coalesce(F.sum("sn"), F.lit(0)) + 2)).alias("mean"))
    ones = whole
    for level, n, k, name in ((suffixes, "sn", "sk", "s1"), (domains, "dn", "dk", "s2"), (hosts, "n", "k", "s3")):
        ones = ones.crossJoin(_strength(level.where(F.col(n) > 0).select(F.col(n).alias("n"), F.col(k).alias("k")), name))  # one row each
    up = suffixes.crossJoin(F.broadcast(ones)).select("suffix", "s2", "s3", ((F.col("sk") + F.col("s1") * F.col("mean")) / (F.col("sn") + F.col("s1"))).alias("sm"))
    up = domains.join(up, "suffix").select("domain", "s3", ((F.col("dk") + F.col("s2") * F.col("sm")) / (F.col("dn") + F.col("s2"))).alias("dm"))
    a, b = F.col("k") + F.col("s3") * F.col("dm"), F.col("n") - F.col("k") + F.col("s3") * (1 - F.col("dm"))
    both = hosts.join(up, "domain").select("host", a.alias("a"), b.alias("b"))
    mean = F.col("a") / (F.col("a") + F.col("b"))
    return both.select("host", F.greatest(F.lit(0.0), mean - Z * F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict and bound of every page.

    outcomes: rows page_url and good (0, 1 or null) that are labelled; pages are judged by all of them.
    """
    host, path = host_and_path()
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    o_host, _ = host_and_path("page_url")
    seen = outcomes.select(o_host.alias("host"), F.col("good").isNotNull().cast("long").alias("n"), F.coalesce(F.col("good"), F.lit(0)).cast("long").alias("k"))
    seen = seen.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    rep = reputation(seen.union(parsed.groupBy("host").agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k"))))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") >= threshold, "allow").otherwise("block")
    return parsed.join(rep.withColumnRenamed("host", "r_host"), F.col("host") == F.col("r_host")).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, own).alias("verdict"), "bound")


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_url and good: the quality label of the document that a page shows, by the number in its path."""
    _, path = host_and_path()
    number = F.regexp_extract(path, r"^.*/([0-9]{1,18})(\.[a-z]+)?/?$", 1)
    shown = pages.select(F.col("url").alias("page_url"), F.when(number != "", number.cast("long")).alias("shown"))
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("good"))
    return shown.join(known, F.col("shown") == F.col("doc_id")).select("page_url", "good")
