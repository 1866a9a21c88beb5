"""URL filters: explicit rules first, an empirical-Bayes host reputation for the rest.

A labelled page is one Bernoulli outcome of its host.  Outcomes are shrunk down
a chain of beta-binomial priors: suffix toward the whole, registered domain
toward its suffix, host toward its registered domain.  The prior's strength at
each level comes from the data (method of moments on the level's groups).  A
page without a rule is blocked if its host's share of good pages lies below a
multiple of the overall rate even at its upper posterior bound, a quantile of the
beta distribution.

Plan: outcomes are counted per host with map-side combining before anything is
shuffled, so a hot host costs one row a task.  Suffix and domain tables are
aggregates of the host table.  Rows meet them in ordinary joins on slim columns
(never html); AQE splits a skewed host's partition, since the other side has one
row a key.  The host table is written once.  The only values that reach the driver are three prior strengths and
the overall rate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import ascii_lower, fresh, table, written

#: The query's rules; the longest that fits wins.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Labels that form a public suffix with a two-letter country code after them.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


@dataclass(frozen=True)
class Reputation:
    """block: below this multiple of the overall rate.  z: normal quantile of the posterior bound.  low, high: limits of a prior's strength."""

    block: float = 1.0
    z: float = 0.8416
    low: float = 2.0
    high: float = 200.0


def beta_upper(mean: Column, weight: Column, z: float) -> Column:
    """The quantile of the beta distribution (mean, weight) that the normal quantile z names, by the closed approximation of Abramowitz and Stegun, 26.5.22; weight of 2 or more."""
    a, b = F.greatest(mean * weight, F.lit(1.0)), F.greatest((1 - mean) * weight, F.lit(1.0))
    ia, ib = 1 / (2 * a - 1), 1 / (2 * b - 1)
    h = 2 / (ia + ib)
    lam = (z * z - 3) / 6
    w = -z * F.sqrt(h + lam) / h - (ib - ia) * (lam + 5 / 6 - 2 / (3 * h))
    return a / (a + b * F.exp(2 * w))


def host(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.when(F.locate("://", url) > 0, F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)).otherwise("")


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null.  rules is configuration, compiled into one CASE: a few hundred at most."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        out = F.when(fits, rule).otherwise(out)
    return out


def suffix(host: Column) -> Column:
    two = F.regexp_extract(host, rf"(?:^|\.)((?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}})$", 1)
    return F.when(two != "", two).otherwise(F.substring_index(host, ".", -1))


def registered(host: Column, suffix: Column) -> Column:
    """One label more than the suffix; the host itself if it has none."""
    return F.when(F.length(host) > F.length(suffix) + 1, F.concat_ws(".", F.substring_index(F.substring(host, F.lit(1), F.length(host) - F.length(suffix) - 1), ".", -1), suffix)).otherwise(host)


def _strength(groups: DataFrame, prior: Column, p: Reputation) -> float:
    """Method of moments: how far the groups' rates scatter round their priors beyond binomial noise."""
    m = F.least(F.greatest(prior, F.lit(1e-6)), F.lit(1 - 1e-6))
    chi = (F.col("good") - F.col("n") * m) ** 2 / (m * (1 - m))
    r = groups.where("n > 1").agg(F.sum(chi - F.col("n")).alias("over"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs")).first()
    if not r["pairs"]:
        return p.high
    rho = min(max(float(r["over"]) / float(r["pairs"]), 1e-9), 1 - 1e-9)
    return round(min(max(1 / rho - 1, p.low), p.high), 3)


def reputation(outcomes: DataFrame, p: Reputation = Reputation()) -> tuple[DataFrame, DataFrame, DataFrame, tuple[float, float]]:
    """From outcomes (host, good 0/1): host, domain and suffix tables with posterior mean and weight; the root's mean and weight.

    Rows with a null or empty host, or a null outcome, teach nothing.
    """
    counts = outcomes.where("host != '' AND good IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    counts = written(counts.withColumn("suffix", suffix(F.col("host"))).withColumn("domain", registered(F.col("host"), F.col("suffix"))), "hosts")
    sums = (F.sum("n").alias("n"), F.sum("good").alias("good"))
    domains = counts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    total = suffixes.agg(*sums).first()
    root = (total["good"] + 1.0) / (total["n"] + 2.0) if total["n"] else 0.5

    def post(level: DataFrame, mean: Column, names: tuple[str, str]) -> DataFrame:
        k = _strength(level, mean, p)
        return level.withColumn(names[0], (F.col("good") + k * mean) / (F.col("n") + k)).withColumn(names[1], F.col("n") + k).drop("n", "good")

    s = post(suffixes, F.lit(root), ("m_suffix", "w_suffix")).select("suffix", "m_suffix", "w_suffix")
    d = post(domains.join(s, "suffix"), F.col("m_suffix"), ("m_domain", "w_domain")).select("domain", "m_domain", "w_domain")
    h = post(counts.join(d, "domain"), F.col("m_domain"), ("m_host", "w_host")).select("host", "m_host", "w_host")
    return h, d, s, (root, 2.0 + (total["n"] or 0))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, p: Reputation = Reputation(), url: str = "url") -> DataFrame:
    """Adds host, path, rule, good_share, good_upper and verdict to pages.

    Null urls and urls without :// have an empty host and path, fit no rule and
    are judged by the overall rate.  Hosts without a labelled page take their
    domain's posterior, then their suffix's, then the overall one.  Repeated
    rows are judged alike; an empty table gives an empty result; columns of pages
    that are named like a result are replaced, others stay whatever their names.
    outcomes: (host, good); without any, all is allowed.
    """
    h, d, s, (root, weight) = reputation(outcomes, p)
    results = ("host", "path", "rule", "good_share", "good_upper", "verdict")
    at = pages.drop(*(c for c in pages.columns if c.lower() in results))
    below, above, mh, wh, md, wd, ms, ws = fresh(at, "suffix", "domain", "m_host", "w_host", "m_domain", "w_domain", "m_suffix", "w_suffix")
    kept = at.columns
    at = at.withColumn("host", host(F.col(url))).withColumn("path", path(F.col(url)))
    at = at.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules)).withColumn(below, suffix(F.col("host"))).withColumn(above, registered(F.col("host"), F.col(below)))
    at = at.join(h.toDF("host", mh, wh), "host", "left").join(d.toDF(above, md, wd), above, "left").join(s.toDF(below, ms, ws), below, "left")
    mean, n = F.coalesce(mh, md, ms, F.lit(root)), F.coalesce(wh, wd, ws, F.lit(weight))
    said = F.lit(None).cast("string")
    for rule, what in rules:
        said = F.when(F.col("rule") == rule, what).otherwise(said)
    out = at.withColumn("good_share", F.round(mean, 6)).withColumn("good_upper", F.round(beta_upper(mean, n, p.z), 6))
    bad = F.col("good_upper") < round(p.block * root, 6)
    return out.withColumn("verdict", F.coalesce(said, F.when(bad, "block").otherwise("allow"))).select(*kept, *results)


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes of the pages that labels knows by id: good if of quality and not toxic."""
    good = (F.coalesce(F.col("quality"), F.lit(0)) * (1 - F.coalesce(F.col("toxic"), F.lit(0)))).cast("long")
    return pages.select(F.col("page_id").alias("doc_id"), host(F.col("url")).alias("host")).join(labels.select("doc_id", good.alias("good")), "doc_id").select("host", "good")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, labelled(pages, table(spark, sf_dir, "labels"))).select("page_id", "host", "path", "rule", "verdict", "good_share", "good_upper")


def _sql() -> str:
    two = "|".join(SECOND_LEVEL)
    p = Reputation()

    def strength(level: str, mean: str) -> str:
        m = f"least(greatest({mean}, 1e-6), 1 - 1e-6)"
        return f"""(SELECT coalesce(round(least(greatest(1 / least(greatest(
            sum(CASE WHEN n > 1 THEN pow(good - n * {m}, 2) / ({m} * (1 - {m})) - n END) / sum(CASE WHEN n > 1 THEN n * (n - 1) END),
            1e-9), 1 - 1e-9) - 1, {p.low}), {p.high}), 3), {p.high}) AS k FROM {level})"""

    cases = " ".join(f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for r, _ in sorted(RULES, key=lambda x: (-len(x[0]), x[0])))
    said = " ".join(f"WHEN rule = '{r}' THEN '{w}'" for r, w in RULES)
    return rf"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1) ELSE '' END AS raw,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
v AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
x AS (SELECT *, CASE WHEN regexp_matches(host, '(?:^|\.)(?:{two})\.[a-z]{{2}}$') THEN regexp_extract(host, '(?:^|\.)((?:{two})\.[a-z]{{2}})$', 1)
      ELSE list_extract(string_split(host, '.'), -1) END AS suffix FROM v),
y AS (SELECT *, CASE WHEN length(host) > length(suffix) + 1
      THEN list_extract(string_split(left(host, length(host) - length(suffix) - 1), '.'), -1) || '.' || suffix ELSE host END AS domain,
      CASE {cases} END AS rule FROM x),
o AS (SELECT host, domain, suffix, coalesce(quality, 0) * (1 - coalesce(toxic, 0)) AS good FROM y JOIN labels ON doc_id = page_id WHERE host != ''),
hc AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(good)::DOUBLE AS good FROM o GROUP BY ALL),
dc AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hc GROUP BY ALL),
sc AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM dc GROUP BY ALL),
root AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(good) + 1) / (sum(n) + 2) ELSE 0.5 END AS r, 2 + coalesce(sum(n), 0) AS w FROM sc),
s0 AS (SELECT sc.*, r FROM sc, root), ks AS {strength('s0', 'r')},
s AS (SELECT suffix, (good + k * r) / (n + k) AS m_s, n + k AS w_s FROM s0, ks),
d0 AS (SELECT dc.*, m_s FROM dc JOIN s USING (suffix)), kd AS {strength('d0', 'm_s')},
d AS (SELECT domain, (good + k * m_s) / (n + k) AS m_d, n + k AS w_d FROM d0, kd),
h0 AS (SELECT hc.*, m_d FROM hc JOIN d USING (domain)), kh AS {strength('h0', 'm_d')},
h AS (SELECT host, (good + k * m_d) / (n + k) AS m_h, n + k AS w_h FROM h0, kh),
z AS (SELECT page_id, host, path, rule, coalesce(m_h, m_d, m_s, r) AS m, coalesce(w_h, w_d, w_s, w) AS wt
      FROM y LEFT JOIN h USING (host) LEFT JOIN d USING (domain) LEFT JOIN s USING (suffix), root),
ab AS (SELECT *, greatest(m * wt, 1.0::DOUBLE) AS a, greatest((1 - m) * wt, 1.0::DOUBLE) AS b FROM z),
hh AS (SELECT *, 2 / (1 / (2 * a - 1) + 1 / (2 * b - 1)) AS h, 1 / (2 * b - 1) - 1 / (2 * a - 1) AS skew, {(p.z * p.z - 3) / 6!r}::DOUBLE AS lam FROM ab),
e AS (SELECT page_id, host, path, rule, round(m, 6) AS good_share,
      round(a / (a + b * exp(2 * (-{p.z}::DOUBLE * sqrt(h + lam) / h - skew * (lam + {5 / 6!r}::DOUBLE - 2 / (3 * h))))), 6) AS good_upper FROM hh)
SELECT page_id, host, path, rule, coalesce(CASE {said} END, CASE WHEN good_upper < round({p.block}::DOUBLE * r, 6) THEN 'block' ELSE 'allow' END) AS verdict, good_share, good_upper FROM e, root
"""


OP5_SQL = _sql()
