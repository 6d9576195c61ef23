"""Empirical-Bayes host reputation and URL rules, in DataFrame functions only.

Labelled outcomes of pages (1: bad) are counted per host, registered domain and suffix. Each
level's rate is shrunk through a beta prior centred on the level above: the suffix towards
all pages, the domain towards its suffix, the host towards its domain. The strength of each
prior is fitted by moments from how much rates differ between the members of that level. A
page without a rule is blocked if the lower posterior bound of its host's bad rate passes a
limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchscope.llm.common import attach
from patchscope.session import checkpointed

#: Second-level labels under which names are registered (fixed values).
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Lower bound: posterior mean minus BOUND_Z posterior deviations.
BOUND_Z = 1.645
LIMIT = 0.5
STRENGTH = (1.0, 10_000.0)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def domain(host_: Column) -> Column:
    """Registered domain: the last two labels, or three below a second-level suffix such as co.uk."""
    labels = F.split(host_, r"\.")
    deep = (F.size(labels) >= 3) & (F.length(F.get(labels, F.size(labels) - 1)) == 2) & F.get(labels, F.size(labels) - 2).isin(*SECOND_LEVEL)
    return F.when(deep, F.substring_index(host_, ".", -3)).otherwise(F.substring_index(host_, ".", -2))


def suffix(domain_: Column) -> Column:
    """The registered domain without its first label; a single label is its own suffix."""
    return F.when(F.instr(domain_, ".") > 0, F.regexp_extract(domain_, r"^[^.]*\.(.*)$", 1)).otherwise(domain_)


def strength(groups: DataFrame, mean: str) -> Column:
    """Prior strength by moments over rows (n, bad, prior mean): an aggregate to be used in ``agg``.

    The spread of rates beyond binomial noise gives p(1-p)/(1+k); no excess gives the upper limit.
    """
    n, p = F.col("n"), F.col(mean)
    excess = F.sum(F.pow(F.col("bad") - n * p, 2) - n * p * (1 - p))
    room = F.sum(n * (n - 1) * p * (1 - p))
    low, high = STRENGTH
    return F.when((room > 0) & (excess > 0), F.least(F.greatest(room / excess - 1, F.lit(low)), F.lit(high))).otherwise(F.lit(high))


def reputation(outcomes: DataFrame, z: float = BOUND_Z) -> DataFrame:
    """Posterior of the bad rate of each host: host, n, bad, mean, bound.

    ``outcomes``: host, bad (0/1; NULL is no outcome). A host without outcomes has the
    posterior that its domain hands down, that without outcomes its suffix's, and so on. An
    empty table gives no rows. Counts are summed per host first; the levels above work on those.
    """
    counts = checkpointed(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")))
    counts = counts.withColumn("domain", domain(F.col("host"))).withColumn("suffix", suffix(F.col("domain")))
    root = counts.agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1.0)).alias("prior"))

    def level(groups: DataFrame, above: DataFrame, on: list[str], key: str) -> DataFrame:
        """Posterior of each member of a level, stored; a one-row table of strengths is joined to all of them."""
        priors = groups.join(above, on) if on else groups.join(F.broadcast(above), F.lit(True))
        k = priors.agg(strength(priors, "prior").alias("k"))
        # k is one row, whatever the input
        fitted = priors.join(F.broadcast(k), F.lit(True))
        a, b = F.col("prior") * F.col("k") + F.col("bad"), (1 - F.col("prior")) * F.col("k") + F.col("n") - F.col("bad")
        return checkpointed(fitted.select(*groups.columns, a.alias("__a"), b.alias("__b"), (a / (a + b)).alias("mean")))

    by_suffix = level(counts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), root, [], "suffix")
    by_domain = level(
        counts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")),
        by_suffix.select("suffix", F.col("mean").alias("prior")), ["suffix"], "domain")
    by_host = level(counts, by_domain.select("domain", F.col("mean").alias("prior")), ["domain"], "host")
    a, b = F.col("__a"), F.col("__b")
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return by_host.select("host", "n", "bad", "mean", (F.col("mean") - z * deviation).alias("bound"))


def rule_of(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else NULLs. A rule fits its host and all subdomains if the path starts with the rule's."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for site, start, decision in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host_ == site) | F.endswith(host_, F.lit(f".{site}"))) & F.startswith(path_, F.lit(start))
        name, verdict = F.when(fits, F.lit(site + start)).otherwise(name), F.when(fits, F.lit(decision)).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, bad_rate, bound.

    ``outcomes``: page_id, bad. A url that is NULL or has no ``://`` has empty host and path
    and is judged as the empty host. A host without outcomes is judged by what its domain or
    suffix hands down. Several outcomes of a page count each; repeated pages count each. No
    pages give no rows; without any outcome no bound passes a limit of a half.
    """
    rows = checkpointed(pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")))
    known = rows.join(outcomes.select("page_id", "bad"), "page_id", "left")
    sizes = rows.groupBy("host").agg(F.count("*").alias("__rows"))
    stats = checkpointed(sizes.join(reputation(known.select("host", "bad")), "host", "left"))
    out = attach(rows, stats, ["host"], "__rows", "page_id")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("bound") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"),
        F.col("mean").alias("bad_rate"), "bound")


def _level_sql(key: str, above: str, on: str) -> str:
    low, high = STRENGTH
    p = f"SELECT g.*, a.prior FROM {key}_g g {'CROSS JOIN' if not on else 'JOIN'} {above} a {f'USING ({on})' if on else ''}"
    return f"""{key}_p AS ({p}),
{key}_k AS (SELECT CASE WHEN sum(n * (n - 1) * prior * (1 - prior)) > 0 AND sum((bad - n * prior) ** 2 - n * prior * (1 - prior)) > 0
  THEN least(greatest(sum(n * (n - 1) * prior * (1 - prior)) / sum((bad - n * prior) ** 2 - n * prior * (1 - prior)) - 1, {low}), {high}) ELSE {high} END AS k FROM {key}_p),
{key}_m AS (SELECT p.*, prior * k + bad AS a, (1 - prior) * k + n - bad AS b FROM {key}_p p, {key}_k)"""


SQL = rf"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
c AS (SELECT host, count(quality) AS n, coalesce(sum(1 - quality), 0)::DOUBLE AS bad FROM u LEFT JOIN labels ON page_id = doc_id GROUP BY host),
d AS (SELECT *, CASE WHEN regexp_matches(host, '\.({'|'.join(SECOND_LEVEL)})\.[^.][^.]$') THEN regexp_extract(host, '([^.]*\.[^.]*\.[^.]*)$', 1)
  WHEN contains(host, '.') THEN regexp_extract(host, '([^.]*\.[^.]*)$', 1) ELSE host END AS domain FROM c),
host_g AS (SELECT *, CASE WHEN contains(domain, '.') THEN regexp_extract(domain, '^[^.]*\.(.*)$', 1) ELSE domain END AS suffix FROM d),
domain_g AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM host_g GROUP BY ALL),
suffix_g AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM host_g GROUP BY ALL),
top AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) AS prior FROM host_g),
{_level_sql('suffix', 'top', '')},
{_level_sql('domain', '(SELECT suffix, a / (a + b) AS prior FROM suffix_m)', 'suffix')},
{_level_sql('host', '(SELECT domain, a / (a + b) AS prior FROM domain_m)', 'domain')},
s AS (SELECT host, a / (a + b) AS mean, a / (a + b) - {BOUND_Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM host_m),
r AS (SELECT u.*, mean, bound, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM u LEFT JOIN s USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN bound > {LIMIT} THEN 'block' ELSE 'allow' END AS verdict, round(mean, 6) AS bad_rate, round(bound, 6) AS bound FROM r"""
