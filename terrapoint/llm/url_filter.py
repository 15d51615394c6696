"""Host reputation by empirical Bayes, under rules that override it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains, where the path starts with the rule's."""

    verdict: str
    text: str  # host, then path

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/"))

#: Numbers as IPv4 has them, or brackets as IPv6 has.
ADDRESS = "^([0-9]+([.][0-9]+){3}|\\[.*\\])$"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What lies between the first :// and the next /, ? or #, with A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without its port and trailing dots."""
    return F.regexp_replace(F.regexp_replace(host, ":[0-9]*$", ""), "\\.+$", "")


def suffix_of(host: Column, suffixes: Sequence[str]) -> Column:
    """The public suffix: the longest of `suffixes` that ends the host, or its last label. An address is its own."""
    out = F.substring_index(host, ".", -1)
    for s in sorted(suffixes, key=len):
        out = F.when((host == s) | host.endswith("." + s), F.lit(s)).otherwise(out)
    return F.when(host.rlike(ADDRESS), host).otherwise(out)


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and one label more, or the host if it has none more."""
    rest = F.substring(host, F.lit(1), F.length(host) - F.length(suffix) - 1)
    return F.when(F.length(host) > F.length(suffix), F.concat(F.substring_index(rest, ".", -1), F.lit("."), suffix)).otherwise(host)


def _strength(counts: DataFrame, rate: float) -> float:
    """Prior strength, in labelled pages, by the method of moments (Kleinman, 1973): the more rates differ between groups
    than chance makes them, the weaker the prior. From 1 to 1000, and no more than there are labels."""
    s = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias("nn"), F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.lit(rate), F.lit(2.0))), F.lit(0.0)).alias("spread"),
    ).first()
    noise = rate * (1 - rate)
    freedom = s["n"] - s["nn"] / s["n"] if s["n"] else 0
    between = (s["spread"] - noise * (s["groups"] - 1)) / freedom if freedom > 0 else 0.0
    most = float(min(max(s["n"], 1), 1000))
    return min(max(noise / between - 1, 1.0), most) if between > 0 else most


def judged(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = RULES, z: float = 1.0, worst: float = 0.5, suffixes: Sequence[str] = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in"), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, mean, bound) for each page.

    outcomes (id, bad): labels of some pages, 1 bad and 0 good, any number for a page. Beta-binomial posteriors shrink
    the bad share of a host to that of its registered domain, that to its public suffix, and that to all pages;
    each level's strength is fitted to the labels. bound: the host's mean less z standard deviations. A page is blocked
    if its host is bad beyond doubt, bound > worst. The longest rule that fits its host and path goes before. Null urls, and those
    without ://, have an empty host and path, which share a reputation like any host. Hosts without labels have their
    domain's mean. Without any label the overall mean is a half and nothing is blocked. Outcomes with a null id or
    null bad don't count. Ports and trailing dots make hosts of their own, but of one domain; addresses have no domain above them.
    suffixes: public suffixes of two labels or more, as from a published list. Very long urls are read whole. Rows with equal or null ids are judged one by one. An empty table gives an empty result. Other columns
    aren't read.
    """
    host = host_of(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).select("id", host.alias("host"), path_of(F.col("url")).alias("path"))
    labels = outcomes.filter("id is not null and bad is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    known = rows.select("id", "host").join(labels, "id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    known = known.withColumn("name", name_of(F.col("host")))
    hosts = written(known.withColumn("suffix", suffix_of(F.col("name"), suffixes)).withColumn("domain", domain_of(F.col("name"), F.col("suffix"))).drop("name"))
    domains = written(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    tops = written(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    whole = tops.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    rate = (whole["bad"] + 1) / (whole["n"] + 2)
    k = [_strength(x.filter("n > 0"), rate) for x in (tops, domains, hosts)]

    def shrunk(prior: Column, strength: float) -> Column:
        return (F.col("bad") + prior * F.lit(strength)) / (F.col("n") + F.lit(strength))

    tops = written(tops.select("suffix", shrunk(F.lit(rate), k[0]).alias("prior")))
    domains = written(domains.join(tops, "suffix").select("domain", shrunk(F.col("prior"), k[1]).alias("prior")))
    mean = shrunk(F.col("prior"), k[2])
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.lit(k[2]) + 1))
    reputation = written(hosts.join(domains, "domain").withColumn("mean", mean).select("host", "mean", (F.col("mean") - F.lit(z) * deviation).alias("bound")))
    fits = [F.when(((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path), F.struct(F.lit(len(r.text)).alias("length"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in rules]
    longest = F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    method = F.when(F.col("bound") > worst, F.lit("block")).otherwise(F.lit("allow"))
    judged_ = rows.join(reputation, "host").withColumn("fit", longest)
    return judged_.select("id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"), "mean", "bound")


def digest(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")
