import re

import pytest
from conftest_llm import rows_of
from pyspark.sql import functions as F

from haulframe.llm.url_filter import RULES, judge_urls

COLUMNS = ("page_id", "host", "path", "rule", "verdict")
URLS = [None, "", "nope", "http://", "a://B.NET?x", "http://x.net/", "//no", "http://É.Org/fr/ü#x",
        "a://b://c/d", "http://net/a\nb?c", "http://example.net/en/", "http://EXAMPLE.net/EN/",
        "https://a.example.com/de", "https://a.example.com/de/1", "http://badexample.net/en/",
        "http://net", "http://x.net:80/", "u://org/fr/" + "y/" * 20_000, "http://😀.net/😀"]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in RULES:
        name, slash, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + start) and (
                best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, "?", "?") for i, u in enumerate(URLS)] + [(3, "http://x.net/", None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")


def test_hosts_paths_and_rules(pages):
    given = dict(rows_of(pages.filter("host IS NOT NULL"), "page_id", "url"))
    out = rows_of(judge_urls(pages, steps=3), *COLUMNS)
    assert len(out) == len(URLS) + 1
    for i, host, path, rule, verdict in out:
        want = brute(given[i]) if (i, host) != (3, "x.net") else brute("http://x.net/")
        assert (host, path) == want[:2]
        assert rule == (want[2] and want[2][0])
        assert verdict == (want[2][1] if want[2] else verdict) and verdict in ("allow", "block")


def test_empty(pages):
    assert judge_urls(pages.limit(0), steps=2).count() == 0


def test_held_out_accuracy(spark):
    """Labels follow the host; half of the pages train, the verdict on the others is measured."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    blocked = F.col("url").contains("example.net")
    trained = pages.filter("page_id % 2 = 0").select("url", blocked.alias("blocked"))
    out = judge_urls(pages.filter("page_id % 2 = 1"), trained, rules=(), steps=12)
    wrong = out.filter((F.col("verdict") == "block") != F.col("host").contains("example.net"))
    assert wrong.count() <= 0.03 * out.count()
