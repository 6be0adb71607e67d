"""URL verdicts: fixed rules first, empirical-Bayes host reputation for the rest.

Labelled page outcomes are counted by host.  The rates are shrunk down a tree of
beta-binomial levels: all pages, suffix, registered domain, host.  Each level's prior is
centred on the posterior mean of the level above, and its strength comes from the spread of
the counts themselves (method of moments).  A host is blocked when even the upper posterior
bound of its good rate is below one half, so hosts with little evidence pass.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize

#: (host, path, verdict)
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Suffixes of two labels under which domains are registered.
SUFFIXES = ["co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in"]
Z = 1.6448536269514722  # one-sided 95 %
RHO = (0.001, 0.999)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://` or for null."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def rule_columns(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does.  For short rule lists:
    every rule is one condition of the plan."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def host_levels(host: Column, suffixes: Iterable[str] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; an address of digits is its own domain and has
    an empty suffix."""
    labels = F.split(host, r"\.")
    two = F.substring_index(host, ".", -2)
    long = two.isin(*suffixes)
    digits = host.rlike(r"^[0-9.]+(:[0-9]+)?$")
    suffix = F.when(digits, F.lit("")).when(long, two).otherwise(F.substring_index(host, ".", -1))
    domain = F.when(digits | (F.size(labels) < 2), host).when(long, F.substring_index(host, ".", -3)).otherwise(two)
    return domain, suffix


def _strength(df: DataFrame, n: str, good: str, mean: str) -> float:
    """How many pages the level's prior is worth: 1/rho - 1 for the intra-class correlation."""
    m, k = F.col(mean), F.col(n)
    x = F.pow(F.col(good) - k * m, 2) / (k * m * (1 - m))
    s, c, d = df.where(k > 0).agg(F.sum(x), F.count(F.lit(1)), F.sum(k - 1)).first()
    rho = (s - c) / d if d else RHO[1]
    return 1 / min(max(rho, RHO[0]), RHO[1]) - 1


def host_reputation(outcomes: DataFrame, suffixes: Iterable[str] = SUFFIXES) -> DataFrame:
    """`outcomes(host, good)`, good 0, 1 or null (not labelled) -> one row per host: host,
    n_labelled, n_good, good_rate, bound (upper posterior bound of the good rate)."""
    domain, suffix = host_levels(F.col("host"), suffixes)
    hosts = outcomes.groupBy("host").agg(
        F.count("good").alias("n_labelled"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("n_good")
    )
    hosts = materialize(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    n, good = hosts.agg(F.sum("n_labelled"), F.sum("n_good")).first()
    out = hosts.withColumn("_mean", F.lit(((good or 0) + 1) / ((n or 0) + 2)))
    for level in ("suffix", "domain", "host"):
        sums = out.groupBy(level).agg(
            F.sum("n_labelled").alias("_n"), F.sum("n_good").alias("_g"), F.first("_mean").alias("_prior")
        )
        k = _strength(sums, "_n", "_g", "_prior")
        a, b = F.col("_g") + k * F.col("_prior"), F.col("_n") - F.col("_g") + k * (1 - F.col("_prior"))
        rate = sums.select(level, (a / (a + b)).alias("_mean"), (a + b).alias("_size"))
        out = out.drop("_mean", "_size").join(rate, level)
    m, size = F.col("_mean"), F.col("_size")
    return out.select(
        "host", "n_labelled", "n_good", m.alias("good_rate"), F.least(F.lit(1.0), m + Z * F.sqrt(m * (1 - m) / (size + 1))).alias("bound")
    )


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = 0.5, suffixes=SUFFIXES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the evidence of its host.

    Pages that a rule covers are the labelled outcomes (allow: good, block: bad) from which
    the other pages of a host are judged.  A null url, or one without `://`, has an empty host
    and path and is judged like a host named ''.  Rows that repeat are judged alike and all
    returned; extra columns are ignored; an empty table gives an empty result.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    parts = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("_by_rule"))
    good = F.when(F.col("_by_rule") == "allow", 1).when(F.col("_by_rule") == "block", 0)
    hosts = host_reputation(parts.select("host", good.alias("good")), suffixes)
    by_host = F.when(F.col("bound") < threshold, F.lit("block")).otherwise(F.lit("allow"))
    return parts.join(hosts, "host").select(
        "page_id", "host", "path", "rule", F.coalesce("_by_rule", by_host).alias("verdict"), "n_labelled", "n_good"
    )


def _rule_sql() -> str:
    cases = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    test = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    one = " ".join(f"WHEN {test(h, p)} THEN '{h + p}'" for h, p, _ in cases)
    two = " ".join(f"WHEN {test(h, p)} THEN '{v}'" for h, p, v in cases)
    return f"CASE {one} END AS rule, CASE {two} END AS by_rule"


def _level_sql(name: str, level: str, above: str) -> str:
    lo, hi = RHO
    return f"""
{name}_g AS (SELECT {level}, sum(n) AS n, sum(g) AS g, any_value(mean) AS prior FROM {above} GROUP BY {level}),
{name}_k AS (
  SELECT 1 / least(greatest(coalesce(
    (sum(pow(g - n * prior, 2) / (n * prior * (1 - prior))) - count(*)) / nullif(sum(n - 1), 0), {hi}), {lo}), {hi}) - 1 AS k
  FROM {name}_g WHERE n > 0),
{name} AS (
  SELECT a.host, a.domain, a.suffix, a.n, a.g, (s.g + k * s.prior) / (s.n + k) AS mean, s.n + k AS size
  FROM {above} a JOIN {name}_g s USING ({level}), {name}_k)"""


ORACLE = f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, {_rule_sql()} FROM p),
h0 AS (
  SELECT host, count(by_rule) AS n, count(*) FILTER (by_rule = 'allow') AS g, string_split(host, '.') AS l FROM r GROUP BY host),
h1 AS (
  SELECT *, regexp_matches(host, '^[0-9.]+(:[0-9]+)?$') AS digits,
    array_to_string(l[-2:], '.') AS two, array_to_string(l[-2:], '.') IN ({", ".join(f"'{s}'" for s in SUFFIXES)}) AS long FROM h0),
h2 AS (
  SELECT host, n, g,
    CASE WHEN digits THEN '' WHEN long THEN two ELSE l[-1] END AS suffix,
    CASE WHEN digits OR len(l) < 2 THEN host WHEN long THEN array_to_string(l[-3:], '.') ELSE two END AS domain FROM h1),
top AS (SELECT *, (SELECT (sum(g) + 1) / (sum(n) + 2) FROM h2) AS mean FROM h2),
{_level_sql("by_suffix", "suffix", "top")},
{_level_sql("by_domain", "domain", "by_suffix")},
{_level_sql("by_host", "host", "by_domain")}
SELECT r.page_id, r.host, r.path, r.rule, CAST(b.n AS BIGINT) AS n_labelled, CAST(b.g AS BIGINT) AS n_good,
  coalesce(r.by_rule, CASE WHEN least(1.0, mean + {Z} * sqrt(mean * (1 - mean) / (size + 1))) < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM r JOIN by_host b ON r.host = b.host
"""
