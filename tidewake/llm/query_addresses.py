"""op13_addresses: verdicts on the addresses of all pages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import address_rules

SITES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
         ("block", "net", "/fr/")]
#: What no site rule covers: junk hosts, sessions, forms and binaries.
PATTERNS = [("block", p) for p in [
    "||spam-farm.", "||link-farm.", "-pills.", "||pills.", "||casino.", "-casino.", "/casino/", "/login^", "/signup^", "/wp-admin/", "/cgi-bin/",
    "^sessionid=", "^phpsessid=", "/captcha^", "||adserver.", "||doubleclick.", ".exe|", ".apk|", "/search?*q="]] + [("allow", "/search?q=about|")]


def op13_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = address_rules.site_rules(spark, SITES).unionByName(address_rules.pattern_rules(spark, PATTERNS))
    return address_rules.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict", "pattern")


def _plain(pattern: str) -> str:
    """The same pattern for another regular expression engine."""
    text = "".join({"*": ".*", "^": "(?:[^0-9A-Za-z_.%-]|$)"}.get(c, re.escape(c)) for c in pattern.removeprefix("||").removesuffix("|"))
    return "(?s)" + ("^://(?:[^/?#]*[.])?" if pattern.startswith("||") else "") + text + ("$" if pattern.endswith("|") else "")


_RULES = ", ".join([f"('{h}{p}', '||{h}{p}', '{_plain('||' + h + p)}', '{v}', 1)" for v, h, p in SITES]
                   + [f"(NULL, '{p}', '{_plain(p)}', '{v}', 0)" for v, p in PATTERNS])
Q = {"op13_addresses": op13_addresses}
SQL = {"op13_addresses": f"""
WITH cut AS (
  SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages),
parts AS (
  SELECT row_number() OVER () AS row_no, page_id, contains(url, '://') AS fine,
    translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path, substr(tail, length(regexp_extract(tail, '^[^/?#]*')) + 1) AS rest FROM cut),
rules AS (SELECT * FROM (VALUES {_RULES}) AS r(rule, pattern, expression, verdict, named)),
best AS (
  SELECT row_no, rule, pattern, verdict FROM parts JOIN rules ON fine AND regexp_matches('://' || host || rest, expression)
  QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY named DESC, length(pattern) DESC, verdict DESC, rule DESC, pattern DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict, pattern FROM parts LEFT JOIN best USING (row_no)"""}
