"""URL filter: host-suffix and path-prefix expressions against a rule list.

Every URL is expanded into ``host suffix + path prefix`` expressions. They meet the rules by an
equi-join on the first characters of a SHA-256 digest; the full digest then confirms the match, and
the longest fitting rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.skew import fits_broadcast

PREFIX_DIGITS = 8  # hexadecimal digits of the digest that the join runs on
SALTS = 32  # copies of each rule where the rules are too many to broadcast
DEFAULT_VERDICT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_SCHEMA = "host string, path string, verdict string"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffixes(host: Column, labels: Column) -> Column:
    """The suffixes of a host that have one of the given label counts; the empty host has itself only."""
    parts = F.split(host, r"\.", -1)
    return F.transform(
        F.filter(labels, lambda n: n <= F.size(parts)),
        lambda n: F.concat_ws(".", F.slice(parts, F.size(parts) - n + 1, n)),
    )


def _prefixes(path: Column, lengths: Column) -> Column:
    """The prefixes of a path that have one of the given lengths."""
    return F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))


def _keyed(df: DataFrame, host: Column, path: Column) -> DataFrame:
    digest = F.sha2(F.concat(host, F.lit("\x00"), path), 256)
    return df.withColumn("_digest", digest).withColumn("_short", F.substring("_digest", 1, PREFIX_DIGITS))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """Verdict of every row of ``pages`` (``page_id, url``) under ``rules`` (``host, path, verdict``).

    Returns ``page_id, host, path, rule, verdict`` with one row per input row. A rule fits its host and all
    subdomains when the path of the URL starts with the rule's path, character by character. The longest
    rule (host and path together) wins; among equally long ones the longer host, then ``block``
    before ``allow``. Without a fitting rule ``rule`` is null and the verdict is ``default``.

    Null URLs and URLs without ``://`` have an empty host and path. Rows are never merged: equal
    ``page_id`` or equal URLs give one row each. Rules with a null host, path or verdict are left out, repeated
    rules count once. Other columns of either table are not read, so their names cannot clash. An empty
    table gives no rows; no rules give the default everywhere.

    The expressions stay next to their page, so only the best rule per page is shuffled. The label counts and
    path lengths worth expanding come from the rules: their number depends on the rules alone.
    """
    spark = pages.sparkSession
    lower = F.translate(F.col("host"), UPPER, LOWER)
    rules = rules.select(lower.alias("_rhost"), F.col("path").alias("_rpath"), F.col("verdict").alias("_verdict"))
    rules = rules.dropna().groupBy("_rhost", "_rpath").agg(F.max("_verdict").alias("_verdict"))  # "block" > "allow"
    rules = _keyed(rules, F.col("_rhost"), F.col("_rpath")).withColumnRenamed("_digest", "_rdigest")
    shapes = rules.agg(
        F.sort_array(F.collect_set(F.size(F.split("_rhost", r"\.", -1)))).alias("labels"),
        F.sort_array(F.collect_set(F.length("_rpath"))).alias("lengths"),
    ).first()
    numbers = lambda values: F.lit(values) if values else F.array().cast("array<int>")

    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    pairs = rows.withColumn("_h", F.explode_outer(_suffixes(F.col("host"), numbers(shapes["labels"]))))
    pairs = pairs.withColumn("_p", F.explode_outer(_prefixes(F.col("path"), numbers(shapes["lengths"]))))
    pairs = _keyed(pairs, F.col("_h"), F.col("_p"))
    on = ["_short"]
    if fits_broadcast(rules):
        rules = F.broadcast(rules)
    else:  # an expression as common as "com/" is dealt over the copies of its rule
        salt = F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")
        pairs, on = pairs.withColumn("_salt", salt), [*on, "_salt"]
        rules = rules.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = pairs.join(rules, on, "left")
    sure = F.col("_rdigest").eqNullSafe(F.col("_digest"))
    best = F.max(F.when(sure & F.col("_digest").isNotNull(), F.struct(
        (F.length("_rhost") + F.length("_rpath")).alias("size"), F.length("_rhost").alias("host_size"),
        F.col("_verdict").alias("verdict"), F.concat("_rhost", "_rpath").alias("rule"),
    ))).alias("_best")
    judged = met.groupBy("_row", "page_id", "host", "path").agg(best)
    return judged.select(
        "page_id", "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules ``(verdict, host, path)`` as a table."""
    return spark.createDataFrame([(host, path, verdict) for verdict, host, path in rules], RULE_SCHEMA)
