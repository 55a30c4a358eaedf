"""Verdicts on the addresses of source files by pattern rules that are found by their rarest token.

The project fetches day files of positions, port outlines, storm tracks and station reports by address. A record is a
download: a `url` and whatever else is known of the file. Rules say what may be fetched:

* a rule begins with `||` if it is tied to a host: the host itself and all its subdomains;
* `*` stands for any run of characters, `^` for a separator or the end, a last `|` for the end;
* everything else stands for itself. Hosts are compared in lower case (A-Z), the rest as written.

A rule is filed once, under that of its whole tokens which fewest addresses hold. The tokens of an address fetch the
rules filed under them, and only those are run as regular expressions. All of it is DataFrame expressions and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewake.operators.sizing import checkpointed

from .columns import put_columns

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of tokens, as the inside of a character class.
TOKEN = r"0-9A-Za-z\x80-\x{10FFFF}"
#: Addresses with one token, such as a top-level domain, are dealt over so many parts.
PARTS = 64
RULE_FIELDS = "rule string, pattern string, verdict string"


def site_rules(spark: SparkSession, listed: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (rule, pattern, verdict) from (verdict, host, path): the host and its subdomains, paths that begin so.
    Characters with a meaning in patterns (`*`, `^`, `|`) are not for such lists."""
    return spark.createDataFrame([(host + path, f"||{host}{path}", verdict) for verdict, host, path in listed], RULE_FIELDS)


def pattern_rules(spark: SparkSession, listed: list[tuple[str, str]]) -> DataFrame:
    """Rules without a name from (verdict, pattern). They speak only where no named rule fits."""
    return spark.createDataFrame([(None, pattern, verdict) for verdict, pattern in listed], RULE_FIELDS)


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without `://` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://` or for null."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _subject(url: Column) -> Column:
    """What regular expressions see: `://`, the host, and the rest as written; null without `://`."""
    rest = F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*((?s:.*))$", 1)
    return F.when(url.contains("://"), F.concat(F.lit("://"), host_of(url), rest))


def _expression(pattern: Column) -> Column:
    """Regular expression of a pattern."""
    tied = pattern.startswith("||")
    body = F.regexp_replace(F.regexp_replace(pattern, r"^\|\|", ""), r"\|$", "")
    escaped = F.regexp_replace(body, r"([\\.+?${}()|\[\]])", r"\\$1")
    open_ended = F.regexp_replace(F.regexp_replace(escaped, r"\^", r"(?:[^0-9A-Za-z_.%\\-]|\\z)"), r"\*", ".*")
    return F.concat(F.lit("(?s)"), F.when(tied, r"^://(?:[^/?#]*\.)?").otherwise(""), open_ended,
                    F.when(pattern.endswith("|"), r"\z").otherwise(""))


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def compiled(rules: DataFrame) -> DataFrame:
    """Distinct rules with their regular expression and whole tokens: those between two characters that are no part of
    a token and no `*`. Rules without a pattern or a verdict are left out."""
    whole = F.regexp_extract_all(_lower(F.col("pattern")), F.lit(rf"(?<=[^*{TOKEN}])([{TOKEN}]+)(?=[^*{TOKEN}])"), F.lit(1))
    return (rules.select("rule", "pattern", "verdict").where("pattern IS NOT NULL AND verdict IS NOT NULL").distinct()
            .select("*", _expression(F.col("pattern")).alias("expression"), F.array_distinct(whole).alias("tokens")))


def judge(downloads: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """Append host, path, rule, pattern and verdict to each download.

    downloads: any table with a column of addresses; it is written once, so select what is needed first. rules: columns
    rule (a name, or null), pattern and verdict, of any number. Of the rules that fit, named ones go first, then the
    longest pattern, then the verdict and the name that sort last (`block` after `allow`). rule and pattern are those of the
    winner. Where none fits, and for a null address or one without `://`, both are null and the verdict is `otherwise`.

    Every row comes back, repeated ones as often as they occur. Columns of downloads with the names of new ones are
    replaced. Empty tables of downloads give no rows, empty rules give `otherwise` everywhere.
    """
    source = F.col(url).cast("string")
    rows = checkpointed(downloads.withColumn("__at", F.monotonically_increasing_id()).withColumn("__subject", _subject(source)))
    named = F.concat(F.array_distinct(F.split(_lower(F.col("__subject")), rf"[^{TOKEN}]+")), F.array(F.lit("")))
    held = rows.where("__subject IS NOT NULL").select("__at", "__subject", F.explode(F.array_distinct(named)).alias("__token"))
    counts = held.groupBy("__token").agg(F.count(F.lit(1)).alias("__held"))

    ready = compiled(rules)
    tokens = ready.select("rule", "pattern", "verdict", "expression", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("__token"))
    rarest = (tokens.join(counts, "__token", "left").groupBy("rule", "pattern", "verdict", "expression")
              .agg(F.min(F.struct(F.coalesce("__held", F.lit(0)).alias("held"), F.col("__token").alias("token"))).alias("__least")))
    filed = rarest.select("rule", "pattern", "verdict", "expression", F.col("__least.token").alias("__token"),
                          F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("__part"))
    fetched = held.withColumn("__part", F.pmod(F.xxhash64("__at"), F.lit(PARTS)).cast("int")).join(filed, ["__token", "__part"])
    order = F.struct(F.col("rule").isNotNull().alias("named"), F.length("pattern").alias("size"), "verdict", "rule", "pattern")
    best = fetched.where(F.regexp_like("__subject", F.col("expression"))).groupBy("__at").agg(F.max(order).alias("__best"))
    judged = rows.join(best.withColumnRenamed("__at", "__found"), F.col("__at") == F.col("__found"), "left")
    new = put_columns(judged, host=host_of(source), path=path_of(source), rule=F.col("__best.rule"), pattern=F.col("__best.pattern"),
                      verdict=F.coalesce("__best.verdict", F.lit(otherwise)))
    return new.drop("__at", "__subject", "__found", "__best")
