"""URL filter: explicit host/path rules, and empirical-Bayes host reputation for the rest.

A host's labelled page outcomes are shrunk through beta-binomial priors: the suffix is drawn
towards all pages, the registered domain towards its suffix, the host towards its domain. The
strength of each prior comes from the spread of that level's rates (method of moments). A page is
blocked if the lower posterior bound of its host's rate of bad pages exceeds max_bad.

Only DataFrame functions run; three scalars for each level reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path); a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
LEVELS = ("suffix", "domain", "host")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, f"{h}{p}").otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _strength(children: DataFrame, level: str, least: float, most: float) -> float:
    """Pseudo-observations of the level's prior by moments: m (1 - m) / (variance between rates) - 1."""
    seen = children.where("n > 0").select("n", "bad", "prior")
    x = seen.agg(
        F.sum("n").alias("n"),
        F.count("*").alias("k"),
        F.sum(F.pow("n", F.lit(2.0))).alias("n2"),
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), F.lit(2.0))).alias("ss"),
        F.sum(F.col("n") * F.col("prior") * (1 - F.col("prior"))).alias("mv"),
    ).first()
    if not x["n"] or x["k"] < 2 or not x["mv"]:
        return most
    mv = x["mv"] / x["n"]
    free = x["n"] - x["n2"] / x["n"]
    between = (x["ss"] - (x["k"] - 1) * mv) / free if free > 0 else 0.0
    return min(most, max(least, mv / between - 1)) if between > 0 else most


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645, least: float = 2.0, most: float = 1000.0) -> DataFrame:
    """One row per host of pages (page_id, host): n and bad labelled pages, bad_mean and bad_bound of the posterior.

    outcomes (page_id, bad 0/1 or null) may repeat an id (any bad label counts) and may miss pages;
    null ids match nothing. A host without labels has its domain's rate, and so on up.
    """
    known = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    host = pages.join(known, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    bare = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":\d*$", "")
    host = host.withColumns({"domain": F.regexp_extract(bare, r"([^.]*\.)?[^.]*$", 0), "suffix": F.regexp_extract(bare, r"[^.]*$", 0)})
    total = host.agg(F.sum("n"), F.sum("bad")).first()
    prior = (total[1] + 0.5) / (total[0] + 1) if total[0] else 0.5
    at = None
    for level, above in zip(LEVELS, (None, *LEVELS)):
        own = host if level == "host" else host.groupBy(*LEVELS[: LEVELS.index(level) + 1]).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        own = own.withColumn("prior", F.lit(prior)) if at is None else own.join(at.select(*LEVELS[: LEVELS.index(above) + 1], F.col("bad_mean").alias("prior")), [*LEVELS[: LEVELS.index(above) + 1]])
        s = _strength(own, level, least, most)
        a, b = F.col("prior") * s + F.col("bad"), (1 - F.col("prior")) * s + F.col("n") - F.col("bad")
        at = own.withColumns({"bad_mean": a / (a + b), "bad_bound": a / (a + b) - z * F.sqrt(a * b / (F.pow(a + b, F.lit(2.0)) * (a + b + 1)))})
    return at.select("host", "n", "bad", "bad_mean", "bad_bound")


def filter_urls(pages: DataFrame, outcomes: DataFrame, max_bad: float = 0.5, rules=RULES) -> DataFrame:
    """pages (page_id, url, any more) with host, path, rule, verdict, n_labelled, n_bad and bad_bound.

    A null url or one without :// has an empty host and path; such pages share one reputation.
    Repeated pages are judged alike. Columns of pages named like the new ones are replaced.
    """
    new = ("host", "path", "rule", "verdict", "n_labelled", "n_bad", "bad_bound")
    pages = pages.drop(*new).withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    rep = host_reputation(pages.select("page_id", "host"), outcomes).select("host", F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), "bad_bound")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return pages.join(rep, "host", "left").withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow"))})


def op4_host_reputation(spark, sf_dir: str) -> DataFrame:
    """labels carries one id, so a page's outcome is the label with its id: bad if of low quality or toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull(), 0).alias("bad"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict", "n_labelled", "n_bad", F.round("bad_bound", 6).alias("bad_bound"))


def _oracle() -> str:
    level = """
{lv}0 as (select {keys}, sum(n) n, sum(bad) bad from hosts group by {keys}),
{lv}1 as (select a.*, {prior} as prior from {lv}0 a {join}),
{lv}2 as (select sum(n) n, count(*) k, sum(n * n::double) n2, sum(n * pow(bad / n - prior, 2.0)) ss, sum(n * prior * (1 - prior)) / sum(n) mv from {lv}1 where n > 0),
{lv}3 as (select case when n is null or k < 2 or mv = 0 then 1000.0 when n - n2 / n <= 0 or (ss - (k - 1) * mv) / (n - n2 / n) <= 0 then 1000.0
  else least(1000.0, greatest(2.0, mv / ((ss - (k - 1) * mv) / (n - n2 / n)) - 1)) end s from {lv}2),
{lv} as (select {keys}, n, bad, (prior * s + bad) / (s + n) as m, prior * s + bad as a, (1 - prior) * s + n - bad as b from {lv}1, {lv}3)"""
    parts = [
        level.format(lv="suf", keys="suffix", prior="(select (sum(bad) + 0.5) / (sum(n) + 1) from hosts)", join=""),
        level.format(lv="dom", keys="suffix, domain", prior="p.m", join="join suf p using (suffix)"),
        level.format(lv="hos", keys="suffix, domain, host", prior="p.m", join="join dom p using (suffix, domain)"),
    ]
    return (
        r"""with outcome as (select doc_id, max(case when quality = 0 or toxic = 1 then 1 when quality is not null then 0 end) bad from labels where doc_id is not null group by doc_id),
page as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path from pages),
hosts as (select host, regexp_extract(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '([^.]*\.)?[^.]*$', 0) domain,
  regexp_extract(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '[^.]*$', 0) suffix, count(bad) n, coalesce(sum(bad), 0) bad
  from page left join outcome on doc_id = page_id group by 1),"""
        + ",".join(parts)
        + """, ruled as (select *, case
  when (host = 'example.org' or host like '%.example.org') and path like '/en/1%' then 'example.org/en/1'
  when (host = 'example.org' or host like '%.example.org') and path like '/es/%' then 'example.org/es/'
  when (host = 'com' or host like '%.com') and path like '/fr/%' then 'com/fr/'
  when (host = 'com' or host like '%.com') and path like '/de/%' then 'com/de/'
  when (host = 'org' or host like '%.org') and path like '/%' then 'org/' end as rule from page)
select page_id, ruled.host, path, rule, case rule when 'example.org/en/1' then 'block' when 'example.org/es/' then 'block' when 'com/de/' then 'block' when 'com/fr/' then 'allow' when 'org/' then 'allow'
  else case when m - 1.645 * sqrt(a * b / (pow(a + b, 2.0) * (a + b + 1))) > 0.5 then 'block' else 'allow' end end as verdict,
  cast(n as bigint) as n_labelled, cast(bad as bigint) as n_bad, round(m - 1.645 * sqrt(a * b / (pow(a + b, 2.0) * (a + b + 1))), 6) as bad_bound
from ruled join hos on ruled.host = hos.host"""
    )


OP4_SQL = _oracle()
