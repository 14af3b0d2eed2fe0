"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a regular expression with the literal tokens that any URL it fits must
hold. Tokens of rules are counted over the URLs, each rule is filed under its
rarest one, and a URL's tokens fetch the rules to try: only those run. DataFrame
functions only; each distinct URL is judged once.

Defined results: a NULL URL or one without ``://`` has an empty host and path and
fits no rule; repeated rows get the same verdict each; further columns pass
through unless their name is one that the result defines. A tie between rules of
one length goes to the text that sorts first. Rules without a literal token are
filed under the empty token, which every URL has.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules that may be broadcast; a longer list joins by token as any table does.
BROADCAST_RULES = 20_000
TOKEN_BREAK = "[^A-Za-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is searched in host + path; ``named`` rules are reported and win
    over the method's own, which only decide what no named rule fits."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...] = field(default=())
    named: bool = True


def prefix_rule(verdict: str, host: str, path: str) -> UrlRule:
    """A host with all its subdomains, and the beginning of a path."""
    literal = re.sub(r"([^A-Za-z0-9])", r"\\\1", host + path)
    tokens = re.split(TOKEN_BREAK, host + path)
    whole = tokens[:-1]  # the path may go on after its last token
    return UrlRule(host + path, verdict, rf"\A(?:[^/]*\.)?{literal}", tuple(t for t in whole if t))


# The given rules.
RULES = (
    prefix_rule("allow", "org", "/"),
    prefix_rule("block", "example.org", "/es/"),
    prefix_rule("block", "example.org", "/en/1"),
    prefix_rule("allow", "com", "/fr/"),
    prefix_rule("block", "com", "/de/"),
)
# The method's own patterns, for URLs that no given rule fits.
OWN_RULES = tuple(
    UrlRule(w, "block", rf"\A[^/]*(?<![a-z0-9]){w}(?![a-z0-9])", (w,), named=False)
    for w in ("spam", "casino", "xxx", "porn", "malware", "phishing")
)


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.split(F.concat(host, path), TOKEN_BREAK))


def rule_table(spark: SparkSession, rules: Sequence[UrlRule]) -> DataFrame:
    return spark.createDataFrame(
        [(i, r.name, r.verdict, r.pattern, list(r.literals) or [""], r.named) for i, r in enumerate(rules)],
        "rule_no long, rule string, verdict string, pattern string, literals array<string>, named boolean",
    )


def rule_index(rules: DataFrame, urls: DataFrame, small: bool) -> DataFrame:
    """Rules with ``token``, the rarest of their literals among the URLs' tokens."""
    sent = F.broadcast if small else (lambda df: df)
    wanted = rules.select("rule_no", F.explode("literals").alias("token"))
    counts = (
        urls.select(F.explode("tokens").alias("token"))
        .join(sent(wanted.select("token").distinct()), "token", "left_semi")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    rarest = (
        wanted.join(counts, "token", "left")
        .groupBy("rule_no")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token")).getField("token").alias("token"))
    )
    return rules.join(rarest, "rule_no").drop("literals")


def judge_urls(
    pages: DataFrame, rules: Sequence[UrlRule] = RULES + OWN_RULES, url: str = "url", default: str = "allow"
) -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    small = len(rules) <= BROADCAST_RULES
    return judge_with(pages, rule_table(pages.sparkSession, rules), url, default, small)


def judge_with(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", small: bool = False
) -> DataFrame:
    """The same with a table of rules (as :func:`rule_table` makes it) of any size: only
    ``small`` ones, at most ``BROADCAST_RULES``, are broadcast; others are joined by
    token, a frequent token being a skewed join that adaptive execution splits."""
    host, path = split_url(F.col("__url"))
    urls = pages.select(F.col(f"`{url}`").alias("__url")).filter("__url is not null").distinct()
    urls = urls.select("__url", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("tokens", F.array_union(tokens(F.col("host"), F.col("path")), F.array(F.lit(""))))
    index = rule_index(F.broadcast(rules) if small else rules, urls, small)
    tried = urls.select("__url", F.concat("host", "path").alias("__at"), F.explode("tokens").alias("token")).join(
        F.broadcast(index) if small else index, "token"
    )
    fits = tried.filter(F.expr("__at rlike pattern and instr(__url, '://') > 0"))
    # longest first, named rules before the method's own
    best = fits.groupBy("__url").agg(
        F.min(F.struct((~F.col("named")).alias("own"), (-F.length("rule")).alias("short"), "rule", "verdict")).alias("__b")
    )
    new = ("host", "path", "rule", "verdict")
    kept = pages.select(*[c for c in pages.columns if c not in new or c == url])
    out = kept.withColumn("__url", F.col(f"`{url}`")).join(best, "__url", "left")
    host, path = split_url(F.col("__url"))
    return out.select(
        *[F.col(f"`{c}`") for c in kept.columns],
        host.alias("host"),
        path.alias("path"),
        F.when(~F.col("__b.own"), F.col("__b.rule")).alias("rule"),
        F.coalesce("__b.verdict", F.lit(default)).alias("verdict"),
    )


def judge_sql() -> str:
    """The same verdicts in SQL."""
    rules = ", ".join(
        f"('{r.name}', '{r.name.split('/')[0]}', '/{r.name.split('/', 1)[1]}', '{r.verdict}')" for r in RULES
    )
    own = "|".join(r.name for r in OWN_RULES)
    return f"""
    with p as (
      select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
      from pages),
    h as (
      select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), '{UPPER}', '{LOWER}') as host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path
      from p),
    r as (select * from (values {rules}) as t(rule, rhost, rpath, rverdict)),
    b as (
      select h.*, rule, rverdict
      from h left join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
      qualify row_number() over (partition by page_id order by length(rule) desc nulls last, rule) = 1)
    select page_id, host, path, rule,
           coalesce(rverdict, case when regexp_matches(host, '(^|[^a-z0-9])({own})($|[^a-z0-9])') then 'block' else 'allow' end) as verdict
    from b"""
