"""Allow and block rules for URLs, matched by hashed host-suffix and path-prefix expressions.

Each URL is expanded into every suffix of its host joined with every prefix of its path that has the
length of some rule's path. An expression meets the rules through an equi-join on the first 32 bits
of its digest; the full digest then confirms the hit. Of the rules that fit a URL the longest wins.
URLs are made distinct first, so a page table that repeats a URL is judged once for each URL.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_SCHEMA = "verdict string, host string, path string"


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased. Empty without `://`."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end. Empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rules as a table."""
    return spark.createDataFrame(list(rules), RULE_SCHEMA)


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _rules(rules: DataFrame) -> DataFrame:
    """Digest, rule and rank of each rule; of rules with one host and path, block outranks allow."""
    clean = rules.where("host is not null and path is not null and verdict is not null")
    host = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    text = F.concat(F.col("host"), F.col("path"))
    return (clean.withColumn("host", host).groupBy("host", "path").agg(F.max("verdict").alias("rule_verdict"))
            .select(_digest(F.concat_ws("\n", "host", "path")).alias("rule_digest"), text.alias("rule"), "rule_verdict",
                    # longer rules first, then the longer host, then by text: never a tie
                    F.struct(F.char_length(text).alias("size"), F.char_length("host").alias("host_size"),
                             text.alias("text")).alias("rank"))
            .withColumn("rule_short", _short(F.col("rule_digest"))))


def judge_urls(urls: DataFrame, rules: DataFrame, *, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """One row for each distinct URL: url, host, path, rule (host and path joined; null if none fits) and verdict.

    A rule fits its host and all subdomains if the URL's path starts with the rule's path (an empty path
    fits every path). Null URLs and URLs without `://` have an empty host and path, which only a rule with an
    empty host fits. Without a rule the verdict is `otherwise`. Rules with a null part are ignored; a rule
    given twice counts once, and if its verdicts differ, `block` holds.
    """
    ruled = _rules(rules)
    lengths = ruled_lengths(rules)
    judged = urls.select(F.col(url).alias("url")).distinct()
    judged = judged.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.char_length("path")),
                           lambda n: F.substring("path", F.lit(1), n))
    expressions = (judged.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
                   .withColumn("digest", _digest(F.concat_ws("\n", "suffix", "prefix"))))
    hits = expressions.join(ruled, (_short(F.col("digest")) == F.col("rule_short")) & (F.col("digest") == F.col("rule_digest")))
    best = hits.groupBy("url").agg(F.max_by(F.struct("rule", "rule_verdict"), "rank").alias("won"))
    return judged.join(best.withColumnRenamed("url", "won_url"), F.col("url") == F.col("won_url"), "left").select(
        "url", "host", "path", F.col("won.rule").alias("rule"),
        F.coalesce("won.rule_verdict", F.lit(otherwise)).alias("verdict"))


def ruled_lengths(rules: DataFrame) -> list[int]:
    """The distinct lengths of rule paths: at most as many as the longest path has characters."""
    return [r[0] for r in rules.where("path is not null").select(F.char_length("path").alias("n")).distinct().orderBy("n").collect()]


def judge_pages(pages: DataFrame, rules: DataFrame, *, id_: str = "page_id", url: str = "url", otherwise: str = "allow") -> DataFrame:
    """One row for each row of `pages`: its id, host, path, rule and verdict. Repeated ids and URLs stay as they are."""
    judged = judge_urls(pages, rules, url=url, otherwise=otherwise).withColumnRenamed("url", "judged_url")
    rows = pages.select(pages[id_].alias("id"), pages[url].alias("page_url"))
    return rows.join(judged, F.col("page_url").eqNullSafe(F.col("judged_url"))).select(
        F.col("id").alias(id_), "host", "path", "rule", "verdict")
