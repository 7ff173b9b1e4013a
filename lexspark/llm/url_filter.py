"""URL filters: fixed rules first, then empirical-Bayes host reputation.

Labelled page outcomes are summed by host, registered domain and suffix.  Each
level shrinks towards the one above it by a beta-binomial prior whose strength is
estimated from the level's own overdispersion.  A host is blocked if the lower bound
of its posterior share of bad pages exceeds a threshold, by default the share of all
labelled pages: the host is worse than the average by more than chance would have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, table

#: (host, path, verdict): fixed values of the task.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Standard deviations of the posterior between its mean and the bound.
Z = 1.0
#: Labels that under a country code make a suffix of two labels; a list of all registries isn't part of this package.
SECOND_LEVEL = ("co", "com", "org", "net", "ac", "gov", "edu", "gob", "gouv", "govt", "mil", "go", "or", "ne", "nom", "sch")
_SUFFIX = rf"((?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}|[^.]+)$"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does.  ``rules``: a short list, part of the plan."""
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block"))
    pick = lambda f: F.coalesce(*(F.when(fits(h, p), F.lit(f(h + p, v))) for h, p, v in ordered), F.lit(None).cast("string"))
    return pick(lambda r, _: r), pick(lambda _, v: v)


def _strength(groups: DataFrame) -> float:
    """groups: (n, bad, mean above) -> pseudo-count of the prior, by the method of moments."""
    m = F.col("above")
    v = m * (1 - m)
    x = groups.where("n > 0").agg(
        F.sum(F.col("n") * (F.col("bad") / F.col("n") - m) * (F.col("bad") / F.col("n") - m)).alias("s"), F.sum(v).alias("e"), F.sum(v * (F.col("n") - 1)).alias("d")
    ).first()
    rho = (x["s"] - x["e"]) / x["d"] if x["d"] else 1e-3
    rho = min(0.5, max(1e-3, rho))
    return (1 - rho) / rho


def reputation(hosts: DataFrame, threshold: float | None = None, z: float = Z) -> DataFrame:
    """hosts: (host, n, bad), a row a host -> (host, blocked).  Without a threshold it is the share of bad ones among all labelled pages."""
    h = hosts.withColumns({"domain": F.regexp_extract("host", r"([^.]+\.)?" + _SUFFIX, 0), "suffix": F.regexp_extract("host", _SUFFIX, 0)})
    total = h.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    if not total["n"]:
        return hosts.select("host", F.lit(False).alias("blocked"))
    m0 = total["bad"] / total["n"]
    suffixes = h.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = h.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    raw = lambda df, *by: df.select(*by, F.when(F.col("n") > 0, F.col("bad") / F.col("n")).alias("above"))
    k1 = _strength(suffixes.withColumn("above", F.lit(m0)))
    k2 = _strength(domains.join(raw(suffixes, "suffix"), "suffix"))
    k3 = _strength(h.join(raw(domains, "suffix", "domain"), ["suffix", "domain"]))
    shrunk = lambda k: (F.col("bad") + k * F.col("above")) / (F.col("n") + k)
    s = suffixes.withColumn("above", F.lit(m0)).select("suffix", shrunk(k1).alias("above"))
    d = domains.join(s, "suffix").select("suffix", "domain", shrunk(k2).alias("above"))
    p = h.join(d, ["suffix", "domain"]).select("host", shrunk(k3).alias("mean"), (F.col("n") + k3).alias("weight"))
    bound = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return p.select("host", (bound > (m0 if threshold is None else threshold)).alias("blocked"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, threshold: float | None = None, z: float = Z) -> DataFrame:
    """pages: (page_id, url); outcomes: (page_id, bad 0/1), labelled pages -> page_id, host, path, rule, verdict.

    Hosts without labels rest on the levels above them; with no labels at all, and
    for urls without a host, the method allows.  Several labels of a page all count;
    null labels don't.  Repeated pages are each judged, and count once each; null ids
    have no labels.  A very long url is cut like any other; empty tables give no rows
    or, as outcomes, no blocks; other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession)
    host, path = split_url(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    labelled = judged.join(outcomes.where("bad is not null"), "page_id").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").cast("long").alias("bad"))
    seen = judged.where("host <> ''").select("host").distinct().join(labelled, "host", "left").fillna(0, ["n", "bad"])
    blocked = scratch.table(reputation(scratch.table(seen, "hosts"), threshold, z).where("blocked"), "blocked")
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("blocked"), "block").otherwise("allow")
    return judged.join(blocked, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, by_method).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outcome is the label of the page's number: bad if of low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.greatest(1 - F.col("quality"), F.col("toxic")).alias("bad"))
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes)


SQL = r"""
WITH u AS (SELECT page_id, coalesce(CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END, '') AS rest FROM pages),
j AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
o AS (SELECT doc_id AS page_id, greatest(1 - quality, toxic) AS bad FROM labels),
lab AS (SELECT host, count(*) AS n, sum(bad) AS bad FROM j JOIN o USING (page_id) WHERE bad IS NOT NULL GROUP BY host),
h AS (SELECT host, coalesce(n, 0)::DOUBLE AS n, coalesce(bad, 0)::DOUBLE AS bad,
             regexp_extract(host, '([^.]+\.)?((?:co|com|org|net|ac|gov|edu|gob|gouv|govt|mil|go|or|ne|nom|sch)\.[a-z]{2}|[^.]+)$', 0) AS domain,
             regexp_extract(host, '((?:co|com|org|net|ac|gov|edu|gob|gouv|govt|mil|go|or|ne|nom|sch)\.[a-z]{2}|[^.]+)$', 0) AS suffix
      FROM (SELECT DISTINCT host FROM j WHERE host <> '') LEFT JOIN lab USING (host)),
g AS (SELECT sum(bad) / sum(n) AS m0 FROM h),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY suffix),
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY suffix, domain),
lv AS (SELECT 1 AS lvl, n, bad, m0 AS m FROM s, g UNION ALL SELECT 2, d.n, d.bad, s.bad / s.n FROM d JOIN s USING (suffix)
       UNION ALL SELECT 3, h.n, h.bad, d.bad / d.n FROM h JOIN d USING (suffix, domain)),
k AS (SELECT lvl, (1 - rho) / rho AS k FROM (SELECT lvl, least(0.5, greatest(0.001, CASE WHEN sum(m * (1 - m) * (n - 1)) <> 0
        THEN (sum(n * (bad / n - m) * (bad / n - m)) - sum(m * (1 - m))) / sum(m * (1 - m) * (n - 1)) ELSE 0.001 END)) AS rho FROM lv WHERE n > 0 GROUP BY lvl)),
s2 AS (SELECT suffix, (bad + k * m0) / (n + k) AS m FROM s, g, k WHERE lvl = 1),
d2 AS (SELECT d.suffix, domain, (bad + k * m) / (n + k) AS m FROM d JOIN s2 USING (suffix), k WHERE lvl = 2),
h2 AS (SELECT host, (bad + k * m) / (n + k) AS m, n + k AS w FROM h JOIN d2 USING (suffix, domain), k WHERE lvl = 3),
b AS (SELECT host FROM h2, g WHERE m - sqrt(m * (1 - m) / (w + 1)) > m0),
r AS (SELECT j.*, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
                WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
                WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
                WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM j)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN host IN (SELECT host FROM b) THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
