"""Host reputation from labelled page outcomes: beta-binomial shrinkage along host, domain, suffix and all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.operators.skew import skew_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bounds of the correlation within a group; the prior counts as ``1 / rho - 1`` pages.
RHO = (0.001, 0.5)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def levels(host: Column) -> dict[str, Column]:
    """Host without user and port, registered domain (its last two labels) and suffix (the last)."""
    bare = F.regexp_extract(host, "([^@:]*)(:[0-9]*)?$", 1)
    two = F.regexp_extract(bare, "([^.]+[.][^.]+)$", 1)
    return {"bare": bare, "domain": F.when(two == "", bare).otherwise(two), "suffix": F.regexp_extract(bare, "([^.]+)$", 1)}


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; rules of the same length go by their text.

    ``rules`` is an argument, so its size does not grow with the data.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def reputations(hosts: DataFrame) -> DataFrame:
    """``hosts`` (bare, domain, suffix, n, k: labelled pages and bad ones) with the posterior of each host.

    At every level a group's rate is shrunk towards its parent's. The strength of the prior is the
    moment estimate over all groups of the level: the excess of the Pearson statistic over what
    binomial counts would give, as a correlation within groups.
    """
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    top = whole.select(((F.coalesce("k", F.lit(0)) + 1) / (F.coalesce("n", F.lit(0)) + 2)).alias("p0"))
    current = hosts.withColumn("p0", top.scalar())
    keys = ["suffix", "domain", "bare"]
    for depth, key in enumerate(keys):
        parent, rate = f"p{depth}", f"p{depth + 1}"
        by = keys[: depth + 1]
        group = current.groupBy(*by, parent).agg(F.sum("n").alias("gn"), F.sum("k").alias("gk"))
        n, k, p = F.col("gn"), F.col("gk"), F.col(parent)
        rho = group.agg(
            F.when(
                F.sum(n * (n - 1)) > 0,
                F.greatest(F.lit(RHO[0]), F.least(F.lit(RHO[1]), (F.sum((k - n * p) * (k - n * p) / (p * (1 - p))) - F.sum(n)) / F.sum(n * (n - 1)))),
            ).otherwise(RHO[1])
        )
        strength = group.withColumn("rho", rho.scalar()).withColumn(f"m{depth + 1}", 1 / F.col("rho") - 1)
        strength = strength.select(*by, f"m{depth + 1}", ((k + F.col(f"m{depth + 1}") * p) / (n + F.col(f"m{depth + 1}"))).alias(rate))
        current = current.join(strength, by)
    mean, weight = F.col("p3"), F.col("n") + F.col("m3")
    return current.select("bare", "n", mean.alias("mean"), F.sqrt(mean * (1 - mean) / (weight + 1)).alias("deviation"))


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[tuple[str, str]],
    z: float = 1.645,
    block_above: float = 0.25,
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """(key, host, path, rule, verdict, labelled) of every page, one row per row of ``pages``.

    ``outcomes`` (key, bad boolean) labels some pages, each row counting once; rows with a null key or
    null ``bad`` count for nothing. A page without a rule is blocked if even the lower posterior bound
    of its host's bad rate, ``mean - z * deviation``, is above ``block_above``. Pages without host
    share the reputation of the empty host.
    """
    host, path = split_url(F.col("url"))
    base = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url")).select("key", host.alias("host"), path.alias("path"))
    base = base.withColumns(levels(F.col("host")))
    marks = outcomes.select(F.col(f"`{key}`").alias("key"), F.col("bad").cast("int").alias("bad")).filter("key is not null and bad is not null")
    marks = marks.groupBy("key").agg(F.count("*").alias("n"), F.sum("bad").alias("k"))
    found = base.join(marks, "key", "left").groupBy("suffix", "domain", "bare").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")
    )
    known = reputations(found).select("bare", F.col("n").alias("labelled"), (F.col("mean") - z * F.col("deviation") > block_above).alias("bad_host"))
    judged = skew_join(base.select("key", "host", "path", "bare"), known, ["bare"], "left")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return judged.select(
        F.col("key").alias(key), "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("bad_host"), "block").otherwise("allow")).alias("verdict"), "labelled",
    )


#: The rules that the registered query applies.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def rule_sql(rules: list[tuple[str, str]]) -> tuple[str, str]:
    parts = []
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0]), reverse=True):
        name, _, rest = text.partition("/")
        parts.append((f"(host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '/{rest}')", text, what))
    return tuple("case " + " ".join(f"when {c} then '{x[i]}'" for c, *x in parts) + " end" for i in (0, 1))


def oracle(rules: list[tuple[str, str]] = RULES, z: float = 1.645, block_above: float = 0.25) -> str:
    rule, verdict = rule_sql(rules)
    sql = f"""
with rest as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
base as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
         from (select page_id, coalesce(rest, '') as rest from rest)),
bare as (select *, regexp_extract(host, '([^@:]*)(:[0-9]*)?$', 1) as bare from base),
parts as (select *, case when regexp_matches(bare, '[^.]+[.][^.]+$') then regexp_extract(bare, '([^.]+[.][^.]+)$', 1) else bare end as domain,
          regexp_extract(bare, '([^.]+)$', 1) as suffix from bare),
marks as (select doc_id as page_id, count(*) as n, sum(case when quality = 0 or toxic = 1 then 1 else 0 end) as k from labels
          where doc_id is not null and (quality = 0 or toxic = 1) is not null group by 1),
l0 as materialized (select suffix, domain, bare, coalesce(sum(n), 0)::double as n, coalesce(sum(k), 0)::double as k from parts left join marks using (page_id) group by 1, 2, 3),
q0 as (select l0.*, (select (sum(k) + 1) / (sum(n) + 2) from l0) as p0 from l0)"""
    keys = ["suffix", "domain", "bare"]
    for d in range(3):
        by = ", ".join(keys[: d + 1])
        sql += f""",
g{d} as materialized (select {by}, p{d}, sum(n) as gn, sum(k) as gk from q{d} group by {by}, p{d}),
r{d} as materialized (select 1 / (case when sum(gn * (gn - 1)) > 0 then greatest({RHO[0]}, least({RHO[1]}, (sum((gk - gn * p{d}) * (gk - gn * p{d}) / (p{d} * (1 - p{d}))) - sum(gn)) / sum(gn * (gn - 1)))) else {RHO[1]} end) - 1 as m from g{d}),
q{d + 1} as materialized (select q{d}.*, m as m{d + 1}, (gk + m * g{d}.p{d}) / (gn + m) as p{d + 1} from q{d} join g{d} using ({by}), r{d})"""
    return sql + f""",
known as (select bare, n::bigint as labelled, p3 - {z} * sqrt(p3 * (1 - p3) / (n + m3 + 1)) > {block_above} as bad_host from q3)
select page_id, host, path, {rule} as rule, coalesce({verdict}, case when bad_host then 'block' else 'allow' end) as verdict, labelled
from parts left join known using (bare)"""
