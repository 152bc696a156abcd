"""URL filtering: host and path rules, then a blocked Bloom filter of listed canonical URLs in front of an exact join.

The list is stored as distinct canonical URLs; its blocked Bloom filter (bloom.py) is broadcast within a fixed bound.
URLs that the filter rejects never take part in the exact hash join, which removes the false positives.

Edge cases: a null URL, or one without "://", has an empty host and path and an empty canonical form, matches no rule,
is in no list and is allowed; repeated rows are judged one by one; an empty table or list gives no block verdicts by
list; extra columns stay (names made here are replaced, ``_url``, ``_at``, ``_block``, ``_listed`` and ``_salt`` dropped).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopdex.llm import bloom
from loopdex.llm.common import written

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
SALTS = 16
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without "://"."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), *_LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without a leading "www." and a default port, path without trailing slashes, and the query; neither scheme
    nor fragment. Empty without "://"."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r":(80|443)$", "")
    return F.when(host(url) == "", F.lit("")).otherwise(F.concat(bare, F.regexp_replace(path(url), "/+$", ""), query))


def rule_of(host_: Column, path_: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits the host or a parent domain and starts the path; null if none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        domain, slash, rest = rule.partition("/")
        fits = ((host_ == domain) | host_.endswith("." + domain)) & path_.startswith(slash + rest)
        out = F.when(fits, rule).otherwise(out)
    return out


def judge(df: DataFrame, listed: DataFrame, url: str = "url", rules: dict[str, str] | None = None) -> DataFrame:
    """df with host, path, rule, maybe_listed (the filter's answer), listed (the exact one) and verdict.

    listed: a DataFrame with one column canonical, distinct."""
    rules = RULES if rules is None else rules
    made = ["host", "path", "rule", "canonical", "maybe_listed", "listed", "verdict"]
    df = df.withColumn("_url", F.col(url)).drop(*made, "_at", "_block", "_listed", "_salt")
    u = F.col("_url")
    df = df.withColumns({"host": host(u), "path": path(u), "canonical": canonical(u)}).drop("_url")
    df = df.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    listed = written(listed.where("canonical <> ''"), "listed")
    df = bloom.with_answer(df, "canonical", bloom.build(listed, "canonical", listed.count()), "maybe_listed")
    df = df.withColumn("maybe_listed", F.col("maybe_listed") & (F.col("canonical") != ""))
    # Only possible hits meet the list, dealt out by salt, as one listed URL may hold many of them; the others pass by. Rows
    # that a rule decides keep their answer from the list, but not their verdict.
    keys = listed.select(F.col("canonical").alias("_listed"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    hits = df.where("maybe_listed").withColumn("_at", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    hits = hits.join(keys, (F.col("canonical") == F.col("_listed")) & (F.col("_at") == F.col("_salt")), "left")
    hits = hits.withColumn("listed", F.col("_listed").isNotNull()).drop("_listed", "_salt", "_at")
    exact = hits.unionByName(df.where("NOT maybe_listed").withColumn("listed", F.lit(False)))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        by_rule = F.when(F.col("rule") == rule, verdict).otherwise(by_rule)
    return exact.withColumn("verdict", F.coalesce(by_rule, F.when(F.col("listed"), "block").otherwise("allow")))


def repeated(pages: DataFrame, url: str = "url") -> DataFrame:
    """The list of the query: canonical URLs that more than one page has."""
    return pages.groupBy(canonical(F.col(url)).alias("canonical")).count().where("count > 1 AND canonical <> ''").select("canonical")


def sql() -> str:
    lower = f"translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), '{_LOWER[0]}', '{_LOWER[1]}')"
    fits = " ".join(
        f"WHEN (host = '{r.split('/')[0]}' OR ends_with(host, '.{r.split('/')[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}') THEN '{r}'"
        for r in sorted(RULES, key=len, reverse=True)
    )
    verdicts = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES.items())
    return f"""WITH p AS (SELECT page_id, {lower} AS host, regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '(?s)^.*?://[^?#]*(\\?[^#]*)', 1) AS query
 FROM (SELECT page_id, coalesce(url, '') AS u FROM pages)),
c AS (SELECT *, CASE WHEN host = '' THEN '' ELSE regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') || query END AS canonical, CASE {fits} END AS rule FROM p),
l AS (SELECT canonical FROM c WHERE canonical <> '' GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, host, path, rule, canonical IN (SELECT canonical FROM l) AS listed, CASE rule {verdicts} ELSE CASE WHEN canonical IN (SELECT canonical FROM l) THEN 'block' ELSE 'allow' END END AS verdict FROM c"""
