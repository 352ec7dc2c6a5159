"""URL filter by empirical-Bayes host reputation, with explicit rules before it.

Labelled page outcomes (bad or not) are counted per host, registered domain and suffix. Each level's
bad rate is a beta-binomial whose prior mean is the posterior mean one level up and whose strength is
fitted to the data by moments. A host is blocked if the lower bound of its posterior exceeds
``THRESHOLD``. A rule, where one fits, overrides the reputation; the longest rule wins.

Defined cases: a null url or one without ``://`` has empty host and path and is judged with the other
urls of the empty host; pages without a label count for nothing; several labels of a page count as
bad if one is; without any label the prior mean is one half and nothing is blocked; an empty page
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.llm.words import ascii_lower

#: (verdict, host, path); a rule is written host + path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Suffixes of two labels under which names are registered; all others have one label.
SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "com.br", "com.mx", "com.cn", "co.in", "co.za", "co.kr"]
#: Block where the bad rate exceeds this with 95 % posterior probability (one-sided normal bound).
THRESHOLD, Z = 0.5, 1.645
#: Bounds of the fitted correlation; the strength of a prior is 1 / rho - 1.
RHO_MIN, RHO_MAX = 0.001, 0.5


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits; the list is a parameter and part of the plan."""
    out = None
    for verdict, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        value = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _strength(level: DataFrame) -> float:
    """Prior strength of a level (n, bad, prior) by the moments of its over-dispersion; four sums."""
    p = F.col("prior")
    excess, freedom = level.agg(
        F.sum(F.pow(F.col("bad") - F.col("n") * p, 2) / (p * (1 - p)) - F.col("n")),
        F.sum(F.col("n") * (F.col("n") - 1.0)),
    ).first()
    rho = RHO_MAX if not freedom else min(max((excess or 0.0) / freedom, RHO_MIN), RHO_MAX)
    return 1 / rho - 1


def reputations(hosts: DataFrame) -> DataFrame:
    """Per host of ``hosts`` (host, n, bad): the posterior's lower bound and mean.

    Only counts are shuffled; per level one number, the prior's strength, reaches the driver.
    """
    hosts = hosts.select("host", "n", "bad", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    total, bad = hosts.agg(F.sum("n"), F.sum("bad")).first()
    top = ((bad or 0) + 1.0) / ((total or 0) + 2.0)

    def posterior(level: DataFrame, key: str) -> DataFrame:
        k = F.lit(_strength(level))
        return level.select(key, ((k * F.col("prior") + F.col("bad")) / (k + F.col("n"))).alias("prior"))

    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    suffixes = hosts.groupBy("suffix").agg(*counts).withColumn("prior", F.lit(top))
    domains = hosts.groupBy("domain", "suffix").agg(*counts).join(posterior(suffixes, "suffix"), "suffix")
    leaves = hosts.join(posterior(domains, "domain"), "domain")
    k = F.lit(_strength(leaves))
    mean = (k * F.col("prior") + F.col("bad")) / (k + F.col("n"))
    scored = leaves.select("host", "n", mean.alias("mean"), (k + F.col("n")).alias("weight"))
    bound = F.col("mean") - Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return scored.select("host", "n", "mean", bound.alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Every page's own columns as ``row`` with host, path, rule, verdict and the host's labelled pages.

    ``outcomes`` has page_id and bad (boolean).
    """
    read = pages.select(F.struct("*").alias("row"), F.col("page_id").alias("page"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = outcomes.where("bad IS NOT NULL").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    counted = read.select("page", "host").join(known, F.col("page") == F.col("page_id"), "left")
    hosts = counted.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    table = reputations(hosts).select(F.col("host").alias("name"), F.col("n").alias("n_labelled"), (F.col("bound") > THRESHOLD).alias("blocked"))
    # a third of the pages may be of one host; the join's skewed partitions are split at run time
    out = read.join(table, F.col("host") == F.col("name"), "left").withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    return out.select(
        "row", "host", "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"),
        "n_labelled",
    )


def _level_sql(name: str, prior: str) -> str:
    """The prior's strength of a level as a DuckDB expression over the table ``name``."""
    return f"""(SELECT 1 / (CASE WHEN coalesce(sum(n * (n - 1.0)), 0) = 0 THEN {RHO_MAX}
        ELSE least(greatest(sum(pow(bad - n * {prior}, 2) / ({prior} * (1 - {prior})) - n) / sum(n * (n - 1.0)), {RHO_MIN}), {RHO_MAX}) END) - 1 FROM {name})"""


_LAST = "array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - {}, 1), len(string_split(host, '.'))), '.')"
_TWO, _THREE = _LAST.format(1), _LAST.format(2)
_LISTED = ", ".join(f"'{s}'" for s in SUFFIXES)
_CASES = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
_FITS = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in _CASES]

SQL = f"""
WITH read AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
known AS (SELECT doc_id, max(CAST(toxic = 1 OR quality = 0 AS INT)) AS bad FROM labels WHERE (toxic = 1 OR quality = 0) IS NOT NULL GROUP BY doc_id),
hosts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad,
    CASE WHEN {_TWO} IN ({_LISTED}) THEN {_THREE} ELSE {_TWO} END AS domain,
    CASE WHEN {_TWO} IN ({_LISTED}) THEN {_TWO} ELSE list_extract(string_split(host, '.'), -1) END AS suffix
  FROM read LEFT JOIN known ON doc_id = page_id GROUP BY host),
top AS (SELECT (coalesce(sum(bad), 0) + 1.0) / (coalesce(sum(n), 0) + 2.0) AS p FROM hosts),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT p FROM top) AS prior FROM hosts GROUP BY suffix),
suffix_post AS (SELECT suffix, (k * prior + bad) / (k + n) AS prior FROM (SELECT *, {_level_sql('suffixes', 'prior')} AS k FROM suffixes)),
domains AS (SELECT h.*, s.prior FROM (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL) h JOIN suffix_post s USING (suffix)),
domain_post AS (SELECT domain, (k * prior + bad) / (k + n) AS prior FROM (SELECT *, {_level_sql('domains', 'prior')} AS k FROM domains)),
leaves AS (SELECT h.host, h.n, h.bad, d.prior FROM hosts h JOIN domain_post d USING (domain)),
scored AS (SELECT host, n, (k * prior + bad) / (k + n) AS mean, k + n AS weight FROM (SELECT *, {_level_sql('leaves', 'prior')} AS k FROM leaves))
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in _FITS)} END AS rule,
  CASE {" ".join(f"WHEN {f} THEN '{v}'" for f, _, v in _FITS)}
    WHEN mean - {Z} * sqrt(mean * (1 - mean) / (weight + 1)) > {THRESHOLD} THEN 'block' ELSE 'allow' END AS verdict,
  n AS n_labelled
FROM read JOIN scored USING (host)
"""
