"""Address rules against running every rule on every address."""

import re

import pytest

from tidewake.llm import address_rules

SITES = [("allow", "noaa.gov", "/"), ("block", "coast.noaa.gov", "/htdata/CMSP/"), ("allow", "coast.noaa.gov", "/htdata/CMSP/AISDataHandler/2020/"),
         ("block", "gov", "/data/"), ("allow", "iastate.edu", "/")]
PATTERNS = [("block", "_2020_*.zip|"), ("block", "^token="), ("allow", "||opendata.arcgis.com^"), ("block", "||opendata.arcgis.com^"), ("block", "zst"),
            ("block", "/a.b(c)/")]
URLS = ["https://coast.noaa.gov/htdata/CMSP/AISDataHandler/2020/AIS_2020_01_01.zip", "https://coast.noaa.gov/htdata/CMSP/AISDataHandler/2021/AIS_2021_01_01.zip",
        "https://COAST.NOAA.GOV/htdata/CMSP/x", "https://coast.noaa.gov/HTDATA/cmsp/x", "https://xnoaa.gov/data/1", "https://gov/data/", "https://gov/data",
        "https://api.tidesandcurrents.noaa.gov", "https://api.tidesandcurrents.noaa.gov?station=1", "https://mesonet.agron.iastate.edu/cgi-bin/asos.py#top",
        "https://geospatial-usace.opendata.arcgis.com/api", "https://opendata.arcgis.com", "https://opendata.arcgis.com.example.org/", "https://mirror.org/AIS_2020_01_02.zip",
        "https://mirror.org/AIS_2020_01_02.zip?x=1", "https://mirror.org/get?token=5", "https://mirror.org/get?xtoken=5", "ais-2025-01-01.csv.zst",
        "s3://bucket/ais-2025-01-01.csv.zst", "https://m.org/a.b(c)/", "https://m.org/aXb(c)/", "a://b://noaa.gov/x", "://noaa.gov/", "https:///noaa.gov/", "", None,
        "https://é.noaa.gov/ü", "https://noaa.gov:80/x", "https://user@noaa.gov/x", "https://mirror.org/" + "part/" * 20000 + "zst", "https://noaa.gov/\nx"]


def slow(url):
    if url is None or "://" not in url:
        return "", "", None, None, "allow"
    tail = url[url.index("://") + 3:]
    host = re.match(r"[^/?#]*", tail)[0]
    path, rest = re.match(r"[^?#]*", tail[len(host):])[0], tail[len(host):]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [((True, len(h + p) + 2, v, h + p), h + p, f"||{h}{p}", v) for v, h, p in SITES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    for v, p in PATTERNS:
        body = "".join({"*": ".*", "^": r"(?:[^0-9A-Za-z_.%-]|\Z)"}.get(c, re.escape(c)) for c in p.removeprefix("||").removesuffix("|"))
        full = (r"^://(?:[^/?#]*\.)?" if p.startswith("||") else "") + body + (r"\Z" if p.endswith("|") else "")
        if re.search(full, "://" + host + rest, re.S):
            fits.append(((False, len(p), v, ""), None, p, v))
    return (host, path, *(max(fits)[1:] if fits else (None, None, "allow")))


@pytest.fixture
def rules(spark):
    return address_rules.site_rules(spark, SITES).unionByName(address_rules.pattern_rules(spark, PATTERNS))


def test_downloads(spark, rules):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] * 2
    got = address_rules.judge(spark.createDataFrame(rows, "day int, url string, HOST string"), rules)
    assert got.columns == ["day", "url", "host", "path", "rule", "pattern", "verdict"]
    want = sorted([(i, *slow(u)) for i, u, _ in rows], key=str)
    assert sorted([(r.day, r.host, r.path, r.rule, r.pattern, r.verdict) for r in got.collect()], key=str) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_filed_under_whole_tokens(spark, rules):
    tokens = {r.pattern: r.tokens for r in address_rules.compiled(rules).collect()}
    assert tokens["_2020_*.zip|"] == ["2020", "zip"] and tokens["zst"] == [] and tokens["||noaa.gov/"] == ["noaa", "gov"] and tokens["^token="] == ["token"]


def test_empty(spark, rules):
    some = spark.createDataFrame([("https://coast.noaa.gov/htdata/CMSP/x",)], "url string")
    assert address_rules.judge(some.limit(0), rules).count() == 0
    assert address_rules.judge(some, rules.limit(0), otherwise="block").first().verdict == "block"
    broken = spark.createDataFrame([("a", None, "block"), ("b", "||noaa.gov/", None)], address_rules.RULE_FIELDS)
    assert address_rules.judge(some, broken).first().verdict == "allow"
