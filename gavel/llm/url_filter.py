"""URL rules matched through hash prefixes of host-suffix and path-prefix expressions.

Each URL is expanded into expressions, one for each suffix of its host (cut at dots)
and each folder of its path. A rule has one expression, its host and the folder part
of its path. Both sides are joined on the first eight hex digits of the expression's
SHA-256; a pair counts only if the full digests are equal and the URL's path starts
with the rule's path. The longest rule that fits gives the verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.llm.common import is_small, once

#: Verdict of a URL that no rule fits.
DEFAULT_VERDICT = "allow"
PREFIX_DIGITS = 8
#: Copies of a rule when the rules are too many to broadcast: rows of one very
#: common expression are then spread over so many tasks.
SALTS = 32

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAKEN = ["_url", "_key", "_n", "_host", "_path"]


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*/)?", 0)


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules given as (host and path, verdict); the verdict is block or allow."""
    return spark.createDataFrame(rules, "rule string, verdict string")


def _keyed_rules(rules: DataFrame) -> DataFrame:
    cut = F.instr("rule", "/")
    host = F.when(cut > 0, F.substr("rule", F.lit(1), cut - 1)).otherwise(F.col("rule"))
    path = F.when(cut > 0, F.substr("rule", cut)).otherwise("")
    parts = (rules.where("rule is not null and verdict is not null")
             .select("rule", F.col("verdict").alias("rule_verdict"),
                     F.translate(host, _UPPER, _LOWER).alias("rule_host"), path.alias("rule_path")))
    digest = F.sha2(F.concat("rule_host", _folder(F.col("rule_path"))), 256)
    return parts.select(
        "rule", "rule_verdict", "rule_path", digest.alias("rule_digest"),
        F.substr(digest, F.lit(1), F.lit(PREFIX_DIGITS)).alias("prefix"),
        F.size(F.split("rule_host", "\\.")).alias("labels"),
        F.size(F.split("rule_path", "/")).alias("folders"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_column: str = "page_id",
               url_column: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Per row: the id, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``.

    A rule fits its host and all subdomains of it if the URL's path starts with the
    rule's path; the longest rule text wins, and of two equal rules the blocking one.
    A URL that is null or holds no ``://`` has an empty host and path and gets the
    default verdict, as does every URL without a fitting rule. Repeated rows are all
    returned. Other columns of the input are left out. An empty table gives an empty
    one; without rules every row gets the default.

    URLs are expanded no further than the deepest rule reaches, as longer expressions
    can't match. Rules up to ``BROADCAST_ROWS`` are broadcast, more of them are
    joined by shuffle, with the rows of each expression salted.
    """
    keyed = _keyed_rules(rules)
    deepest = keyed.agg(F.max("labels"), F.max("folders")).first()
    labels, folders = deepest[0] or 0, deepest[1] or 0

    url = F.col("_url")
    rows = (pages.select(F.col(id_column).alias("_key"), F.col(url_column).alias("_url"))
            .groupBy("_key", "_url").agg(F.count(F.lit(1)).alias("_n"))
            .withColumns({"_host": host_of(url), "_path": path_of(url)}))
    parts = once(rows, _labels=F.split("_host", "\\."), _folders=F.split("_path", "/"))
    n, m = F.size("_labels"), F.size("_folders")
    hosts = F.transform(
        F.sequence(F.lit(1), F.least(n, F.lit(max(labels, 1)))),
        lambda k: F.array_join(F.slice("_labels", n - k + 1, k), "."))
    prefixes = F.concat(F.array(F.lit("")), F.when(m > 1, F.transform(
        F.sequence(F.lit(1), F.least(m - 1, F.lit(max(folders, 1)))),
        lambda k: F.concat(F.array_join(F.slice("_folders", F.lit(1), k), "/"), F.lit("/"))))
        .otherwise(F.array().cast("array<string>")))
    expressions = (parts.select(*_TAKEN, F.explode(hosts).alias("_suffix"),
                                prefixes.alias("_prefixes"))
                   .select(*_TAKEN, "_suffix", F.explode("_prefixes").alias("_prefix"))
                   .select(*_TAKEN, F.concat("_suffix", "_prefix").alias("_text")))
    expressions = once(expressions, _digest=F.sha2("_text", 256)).withColumn(
        "prefix", F.substr("_digest", F.lit(1), F.lit(PREFIX_DIGITS)))
    fits = ((F.col("rule_digest") == F.col("_digest"))
            & F.startswith(F.col("_path"), F.col("rule_path")))
    keyed = keyed.drop("labels", "folders")
    if is_small(keyed):
        keyed = F.broadcast(keyed)
        on = expressions["prefix"] == keyed["prefix"]
    else:
        expressions = expressions.withColumn(
            "_salt", F.pmod(F.xxhash64("_key", "_url"), F.lit(SALTS)))
        keyed = keyed.withColumn("rule_salt", F.explode(
            F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        on = ((expressions["prefix"] == keyed["prefix"])
              & (F.col("_salt") == F.col("rule_salt")))
    found = expressions.join(keyed, on & fits, "left")
    rank = F.struct(F.length("rule"), "rule", F.col("rule_verdict") == "block")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(
        rank.alias("rank"), F.col("rule"), F.col("rule_verdict")))).alias("_best")
    return (found.groupBy(*_TAKEN).agg(best)
            .select(F.col("_key").alias(id_column), F.col("_host").alias("host"),
                    F.col("_path").alias("path"), F.col("_best.rule").alias("rule"),
                    F.coalesce("_best.rule_verdict", F.lit(default)).alias("verdict"),
                    F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int"))).alias("_copy"))
            .drop("_copy"))
