"""URL filter rules, found through their rarest literal token. DataFrame functions only.

Each rule is a regular expression on the address (host in ASCII lower case, then path) and the literal
tokens that every address it fits must hold. Over all URLs the tokens of rules are counted and each rule
is indexed under its rarest one. A URL's tokens fetch candidate rules by an equi-join with that index,
and only fetched rules run their expression.

Null urls and urls without "://" have an empty host and path, fit no rule and are allowed. Repeated rows
keep their multiplicity; an empty table gives an empty result; further columns of the input are kept
unless their name is one of the results', which then wins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this number are broadcast; a larger index is joined by shuffle.
BROADCAST_RULES = 20_000


@dataclass(frozen=True)
class Rule:
    """name: as reported, None for a pattern of the method's own. rank: listed rules outrank patterns."""

    action: str
    pattern: str
    tokens: tuple[str, ...]
    name: str | None = None

    @property
    def rank(self) -> int:
        return 0 if self.name is None else 1 + len(self.name)


def prefix_rule(action: str, name: str) -> Rule:
    """A rule "host/path": fits the host and all its subdomains where the path starts with the rule's."""
    host, slash, rest = name.partition("/")
    tokens = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", name.translate(str.maketrans(UPPER, LOWER)))
    if not tokens:
        raise ValueError(f"no whole literal token in rule {name!r}")
    return Rule(action, rf"^(?:[^/]*\.)?\Q{host}\E\Q{slash}{rest}\E", tuple(tokens), name)


#: (host, path) rules with their verdicts.
RULES = [prefix_rule(*x) for x in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))]
#: The method's own patterns, for addresses that no listed rule fits: advertising, tracking and account pages.
PATTERNS = [
    Rule("block", r"^(?:[^/]*\.)?ads-track\.", ("ads", "track")),
    Rule("block", r"^(?:[^/]*\.)?doubleclick\.", ("doubleclick",)),
    Rule("block", r"^[^/]*/(?:[^/]+/)*ads/", ("ads",)),
    Rule("block", r"^[^/]*/(?:[^/]+/)*wp-login\.php$", ("wp", "login", "php")),
    Rule("block", r"^[^/]*/(?:[^/]+/)*checkout/", ("checkout",)),
]


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path (never null)."""
    c = F.col(url)
    rest = F.when(F.instr(c, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    return df.withColumns({"host": _ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def _tokens(address: Column) -> Column:
    return F.array_distinct(F.filter(F.split(_ascii_lower(address), "[^a-z0-9]+"), lambda t: t != ""))


def judge(df: DataFrame, rules: list[Rule], patterns: list[Rule], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule (the longest listed rule that fits, or null) and verdict."""
    spark: SparkSession = df.sparkSession
    addressed = split_url(df.drop("host", "path", "rule", "verdict"), url)
    listed = spark.createDataFrame([(i, r.action, r.pattern, r.name, r.rank, list(r.tokens)) for i, r in enumerate([*rules, *patterns])], "rule_no int, action string, pattern string, name string, rule_rank int, tokens array<string>")
    small = len(rules) + len(patterns) <= BROADCAST_RULES
    near = F.broadcast if small else (lambda x: x)

    address = F.concat("host", "path")
    found = addressed.where(F.length("host") + F.length("path") > 0).select(F.col(key).alias("_key"), F.col(url).alias("_url"), address.alias("_address"), F.explode(_tokens(address)).alias("token"))
    literals = listed.select("rule_no", F.explode("tokens").alias("token"))
    counted = found.select("token").join(near(literals.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = literals.join(near(counted), "token", "left").groupBy("rule_no").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    index = rarest.join(near(listed.drop("tokens")), "rule_no")

    fits = found.join(near(index), "token").where(F.expr("_address rlike pattern"))
    best = fits.groupBy("_key", "_url").agg(F.max(F.struct("rule_rank", F.col("name"), F.col("action"))).alias("_best"))
    joined = addressed.join(best, F.col(key).eqNullSafe(F.col("_key")) & F.col(url).eqNullSafe(F.col("_url")), "left")
    return joined.withColumns({"rule": F.col("_best.name"), "verdict": F.coalesce("_best.action", F.lit(default))}).drop("_key", "_url", "_best")
