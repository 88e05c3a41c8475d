"""URL filters: rules first, then empirical-Bayes reputation of hosts.

Each host's rate of bad pages is shrunk through beta-binomial priors: the posterior mean of all pages is the prior mean of a suffix, that of the suffix
the prior mean of its registered domains, that of the domain the prior mean of its hosts. How strongly each level holds to the one above is estimated by the
method of moments: with rho = 1 / (strength + 1), a group of n pages has variance n m (1 - m) (1 + (n - 1) rho) around its parent's mean m. A page is
blocked if the lower posterior bound of its host's bad rate, mean - Z * deviation, is over `LIMIT`. Hosts without labelled pages have their domain's prior.

Counts by host combine before the shuffle, and verdicts are joined back by host, so a host with a third of all pages is one row and a join that can be split.
Everything is DataFrame functions. Rules are a short fixed list, so they are an expression; the longest rule that fits wins.

Public suffixes are a parameter, the short list below unless a file is read with `suffix_lists`. Ports don't tell hosts of a domain apart, and an IP address is a domain of its own.

Defined cases: url null or without `://` gives empty host and path, which are judged like any other host; outcomes of pages that aren't there, and null
outcomes, count nowhere; several outcomes of a page are bad if one is; rows with one id are judged each; without any outcomes no page is blocked by reputation.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import stored

# Rules (verdict, host, path) and public suffixes of two labels.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
TWO_LABEL_SUFFIXES = ["ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.uk"]
LABELS, MOST_SUFFIXES = 4, 100_000
ADDRESS = r"^(?:\[.*|[0-9]{1,3}(?:\.[0-9]{1,3}){3})$"
Z, LIMIT = 1.645, 0.5
LEAST_RHO, MOST_RHO = 0.001, 0.25  # strengths from 999 down to 3 pages


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def suffix_lists(spark: SparkSession, path: str) -> list[str]:
    """The entries of a public suffix file: one a line, comments after `//`. Such files have some ten thousand lines."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "//.*", "")).alias("v")).filter("v <> ''")
    return sorted({r.v for r in lines.distinct().limit(MOST_SUFFIXES).collect()})


def domains(host: Column, suffixes: list[str] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host, its port aside; an address is both.

    Of a host's endings of up to `LABELS` labels the longest one counts that the list has, as `co.uk`, or as `*.ck` for any label before `ck`, unless the
    list has it as an exception, `!www.ck`. Without such an ending the last label is the suffix.
    """
    bare = F.regexp_replace(host, ":[0-9]*$", "")
    exact = [x for x in suffixes if x[0] not in "*!"]
    wild, never = [x[2:] for x in suffixes if x.startswith("*.")], [x[1:] for x in suffixes if x.startswith("!")]
    suffix, domain = F.substring_index(bare, ".", -1), F.substring_index(bare, ".", -2)
    for k in range(2, LABELS + 1):
        ending = F.substring_index(bare, ".", -k)
        long_enough = F.length(bare) - F.length(F.replace(bare, F.lit("."), F.lit(""))) >= k - 1
        listed = ending.isin(exact) if exact else F.lit(False)
        if wild:
            listed = listed | F.substring_index(bare, ".", -(k - 1)).isin(wild) & ~(ending.isin(never) if never else F.lit(False))
        suffix, domain = F.when(long_enough & listed, ending).otherwise(suffix), F.when(long_enough & listed, F.substring_index(bare, ".", -(k + 1))).otherwise(domain)
    address = bare.rlike(ADDRESS)
    return F.when(address, bare).otherwise(domain), F.when(address, bare).otherwise(suffix)


STRENGTH = f"""1 / GREATEST({LEAST_RHO}D, LEAST({MOST_RHO}D, COALESCE(
  (SUM((k - n * m) * (k - n * m)) - SUM(n * m * (1 - m))) / NULLIF(SUM(n * (n - 1) * m * (1 - m)), 0), {MOST_RHO}D))) - 1"""


def shrunk(groups: DataFrame) -> DataFrame:
    """Groups of n pages, k of them bad, around m, with the strength of their level, the posterior mean and its weight."""
    strength = groups.agg(F.expr(STRENGTH)).scalar()
    weighed = groups.withColumn("strength", strength)
    return weighed.withColumns({"mean": F.expr("(k + m * strength) / (n + strength)"), "total": F.expr("n + strength")})


def reputation(hosts: DataFrame) -> DataFrame:
    """(rated_host, mean, lower_bound) of hosts (host, domain, suffix, n, k). Each level is stored, so it is computed once."""
    hosts, counts = stored(hosts), [F.sum("n").alias("n"), F.sum("k").alias("k")]
    overall = hosts.agg(F.expr("(SUM(k) + 1.0D) / (SUM(n) + 2.0D)")).scalar()
    suffixes = stored(hosts.groupBy("suffix").agg(*counts).withColumn("m", overall))
    means = shrunk(suffixes).select("suffix", F.col("mean").alias("m"))
    domains = stored(hosts.groupBy("domain", "suffix").agg(*counts).join(means, "suffix"))
    means = shrunk(domains).select("domain", "suffix", F.col("mean").alias("m"))
    rated = shrunk(stored(hosts.join(means, ["domain", "suffix"])))
    bound = F.expr(f"mean - {Z}D * SQRT(mean * (1 - mean) / (total + 1))")
    return rated.select(F.col("host").alias("rated_host"), "mean", bound.alias("lower_bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, limit: float = LIMIT, suffixes: list[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, lower_bound) of each row. outcomes: (page_id, bad); suffixes: see `domains` and `suffix_lists`."""
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, ruled = rule_columns(F.col("host"), F.col("path"), rules)
    known = outcomes.filter("bad is not null and page_id is not null").groupBy(F.col("page_id").alias("labelled")).agg(F.max("bad").alias("bad"))
    domain, suffix = domains(F.col("host"), suffixes)
    counts = urls.join(known, F.col("page_id") == F.col("labelled"), "left").groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.sum(F.col("bad").cast("double")).alias("k"))
    hosts = counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", F.coalesce("k", F.lit(0.0)).alias("k"))
    rated = urls.join(reputation(hosts), F.col("host") == F.col("rated_host"))
    own = F.when(F.col("lower_bound") > limit, "block").otherwise("allow")
    return rated.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, own).alias("verdict"), F.col("mean").alias("bad_rate"), "lower_bound")
