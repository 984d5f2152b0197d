"""URL allow and block rules by host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(text: Column) -> Column:
    """A-Z lower-cased, and no other letter."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(fold(rest), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow", prefix_bytes: int = 4) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of pages; rules has columns ``host, path, verdict``.

    Each distinct (host, path) is expanded into its host suffixes times its path prefixes; these meet the rules in an
    equi-join on a short prefix of their SHA-256 digest, and the full digest confirms the match. A rule fits its host and all
    subdomains if the path starts with the rule's path; the longest host and path together win, then the longer host, then
    block. Path prefixes are taken at the lengths that rules have, whose number is bounded by the longest path.
    Null urls and urls without ``://`` have empty host and path and get the default; repeated pages stay; a null rule field
    makes the rule void; an empty rule table gives the default everywhere.
    """
    rules = rules.where("host is not null and path is not null and verdict is not null").select(fold(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).distinct()
    named = pages.select(F.col(f"`{page_id}`").alias("page_id"), host_of(F.col(f"`{url}`").cast("string")).alias("host"), path_of(F.col(f"`{url}`").cast("string")).alias("path"))
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path")).distinct().collect())
    if not lengths:
        return named.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    digest = lambda host, path: F.sha2(F.concat_ws("\n", host, path), 256)
    short = lambda d: F.substring(d, 1, 2 * prefix_bytes)
    rules = rules.withColumn("rule_digest", digest(F.col("rule_host"), F.col("rule_path"))).withColumn("short", short(F.col("rule_digest")))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    known = F.split(F.lit(",".join(map(str, lengths))), ",").cast("array<int>")
    prefixes = F.transform(F.filter(known, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    distinct = named.select("host", "path").distinct()
    spread = distinct.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
    spread = spread.withColumn("digest", digest(F.col("suffix"), F.col("prefix"))).withColumn("short", short(F.col("digest"))).select("host", "path", "digest", "short")
    hits = spread.join(rules, "short").where("digest = rule_digest")
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("a"), F.length("rule_host").alias("b"), (F.col("rule_verdict") == "block").alias("c"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")), rank).alias("best"))
    return named.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
