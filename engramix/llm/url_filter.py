"""URL filters (operator 2): host-suffix and path-prefix expressions, an equi-join on
short hash prefixes, then full digests and rule precedence.

A rule is ``host + path`` ("example.com/en/"). It fits its host and all
subdomains where the url's path starts with the rule's path; the longest rule
wins, then the longer host, then block before allow.

Every distinct (host, path) is expanded into host suffix x path prefix, of the numbers of
labels and of folders that occur among the rules: a url of any length gives no more
expressions than the rules have shapes. Path prefixes end at a slash (or are empty): a
rule whose path does not end with a slash is keyed by its path up to the last slash,
and the full digest of the rule's whole length confirms it. Only a fixed-width hash prefix is joined.

Null urls, and urls without ``://``, have an empty host and path and meet no
rule; they are spread over the tasks of the last join. An empty table gives an empty
result; repeated rows and rules are kept or judged as one; ties between rules go by the order
above, then by the rule's text; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Hex digits of the joined hash prefix: 32 bits.
PREFIX_HEX = 8
DEFAULT_VERDICT = "allow"
#: Groups of urls without a host, which meet nothing.
SALTS = 256


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, counts: list[int]) -> Column:
    """The last labels of a host, for each of ``counts`` that it has."""
    labels = F.size(F.split(host, r"\."))
    held = F.filter(F.array(*map(F.lit, counts)), lambda k: k <= labels)
    return F.transform(held, lambda k: F.call_function("substring_index", host, F.lit("."), -k))


def path_prefixes(path: Column, counts: list[int]) -> Column:
    """The path up to and with its k-th slash, for each k of ``counts`` that it has; 0 is the empty prefix."""
    slashes = F.size(F.split(path, "/")) - 1
    return F.transform(
        F.filter(F.array(*map(F.lit, counts)), lambda k: k <= slashes),
        lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.call_function("substring_index", path, F.lit("/"), k), F.lit("/"))),
    )


def _short(expression: Column) -> Column:
    return F.substring(F.sha2(expression, 256), 1, PREFIX_HEX)


def expand_rules(rules: DataFrame) -> DataFrame:
    """``rules`` (rule, verdict) with the join key and the full digest."""
    host = lower_ascii(F.substring_index("rule", "/", 1))
    path = F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)")
    folder = F.regexp_extract(F.col("rule_path"), "^(.*/)?", 1)
    return (
        rules.filter(F.col("rule").isNotNull())
        .select("rule", "verdict", host.alias("rule_host"), path.alias("rule_path"))
        .select(
            "*",
            F.size(F.split("rule_host", r"\.")).alias("labels"),
            (F.size(F.split(folder, "/")) - 1).alias("folders"),
            _short(F.concat("rule_host", folder)).alias("short"),
            F.sha2(F.concat("rule_host", "rule_path"), 256).alias("digest"),
        )
    )


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule (null where none fits), verdict."""
    named = pages.select(
        F.col(id_col).alias(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")
    )
    expanded = expand_rules(rules)
    shapes = expanded.agg(F.collect_set("labels").alias("labels"), F.collect_set("folders").alias("folders")).first()
    if not shapes.labels:
        return named.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(DEFAULT_VERDICT).alias("verdict"))
    expressions = (
        named.filter(F.col("host") != "")
        .select("host", "path")
        .distinct()
        .select("host", "path", F.explode(host_suffixes(F.col("host"), sorted(shapes.labels))).alias("suffix"))
        .select("host", "path", "suffix", F.explode(path_prefixes(F.col("path"), sorted(shapes.folders))).alias("prefix"))
        .select("host", "path", "suffix", _short(F.concat("suffix", "prefix")).alias("short"))
    )
    confirmed = F.sha2(F.concat("suffix", F.expr("substring(path, 1, length(rule_path))")), 256) == F.col("digest")
    best = (
        expressions.join(expanded, "short")
        .filter(confirmed & (F.col("suffix") == F.col("rule_host")))
        .groupBy("host", "path")
        .agg(
            F.max(
                F.struct(
                    F.length("rule").alias("len"),
                    F.length("rule_host").alias("host_len"),
                    (F.col("verdict") == "block").alias("blocks"),
                    "rule",
                    "verdict",
                )
            ).alias("best")
        )
    )
    salt = F.when(F.col("host") == "", 1 + F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0)
    return named.withColumn("salt", salt).join(best.withColumn("salt", F.lit(0).cast("bigint")), ["host", "path", "salt"], "left").select(
        id_col,
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(DEFAULT_VERDICT)).alias("verdict"),
    )
