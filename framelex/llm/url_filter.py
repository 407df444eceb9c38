"""URL filter rules by hashed host-suffix and path-prefix expressions.

A rule is a host, a path prefix and a verdict; it fits its host and all
subdomains when the URL's path starts with the rule's. As in a hashed block
list, each distinct URL is expanded to the expressions ``host-suffix +
path-prefix`` it could match, expressions and rules meet in an equi-join on
short hash prefixes, and a hit counts only when the full digests agree. Among
the rules that fit, the longest (host plus path, in characters) wins, then the
one with the longer host; equal rules with both verdicts block.

Hosts are cut at the label counts and paths at the lengths that occur together
in a rule, so a URL of any length expands to at most as many expressions as the
rules have such pairs.

Defined cases: a null URL, or one without ``://``, has an empty host and path
and fits no rule; it is allowed. Rules with a null host, path or verdict are
left out, repeated rules count once, and an empty rule table allows all. Extra
columns stay, whatever their names; those named as a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.joins import broadcast_measured
from .common import hidden, shown

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the hash prefix that the join compares (32 bits).
PREFIX_DIGITS = 8


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL, empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def _digest(host: Column, path: Column) -> Column:
    # a line break cannot be part of a host suffix that meets a rule's host
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def labels(host: Column | str) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def compile_rules(rules: DataFrame) -> tuple[DataFrame, list[tuple[int, int]], int]:
    """(rule table with digests, the pairs of host labels and path length that
    occur, bytes). Only the distinct pairs and one size come to the driver."""
    t = (rules.select(F.translate("host", _UPPER, _LOWER).alias("r_host"), F.col("path").alias("r_path"),
                      F.col("verdict").alias("r_verdict"))
         .dropna().groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict")))  # block > allow
    t = t.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path")))
    t = t.withColumn("r_prefix", F.substring("r_digest", 1, PREFIX_DIGITS))
    found = t.groupBy(labels(F.col("r_host")).alias("k"), F.length("r_path").alias("n")).agg(
        F.sum(F.octet_length("r_host") + F.octet_length("r_path") + 120).alias("b")).collect()
    return t, sorted((r["k"], r["n"]) for r in found), sum(r["b"] for r in found)


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with host, path, rule (host + path of the rule that decides,
    else null) and verdict (``allow`` or ``block``)."""
    compiled, cuts, size = compile_rules(rules)
    rows, names = hidden(urls)
    host, path = host_path(F.col(names[url]))
    t = rows.withColumns({"host": host, "path": path})
    distinct = t.select(F.col("host").alias("u_host"), F.col("path").alias("u_path")).where("u_host != ''").distinct()
    # host suffixes and path prefixes, cut as in the rules
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in cuts]).cast("array<struct<k:int,n:int>>")
    e = distinct.withColumns({"_labels": labels(F.col("u_host")), "_length": F.length("u_path")})
    e = e.withColumn("_cut", F.explode(F.filter(wanted, lambda c: (c["k"] <= F.col("_labels")) & (c["n"] <= F.col("_length")))))
    e = e.withColumn("e_digest", _digest(F.expr("substring_index(u_host, '.', -_cut.k)"), F.expr("substring(u_path, 1, _cut.n)")))
    e = e.withColumn("e_prefix", F.substring("e_digest", 1, PREFIX_DIGITS))
    hits = e.join(broadcast_measured(compiled, size), F.col("e_prefix") == F.col("r_prefix")).where("e_digest = r_digest")
    rank = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), "r_host", "r_path")
    best = hits.groupBy("u_host", "u_path").agg(
        F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), rank).alias("_best"))
    out = t.join(best, (t["host"] == best["u_host"]) & (t["path"] == best["u_path"]), "left")
    return shown(out, names, "host", "path", F.col("_best.rule").alias("rule"),
                 F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"))
