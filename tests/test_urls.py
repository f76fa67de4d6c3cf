from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from pageloom.functions import urls
from pageloom.operators import sites

FOLLOWED = [
    ("https://example.com/docs/a", True),
    ("https://www.example.com/docs", True),
    ("https://example.com.evil.net/docs", True),
    ("https://example.com/docs/login", False),
    ("https://example.com/DOCS", False),
    ("mailto:docs@example.com", False),
    ("https://other.org/docs", False),
]


def test_should_follow(spark):
    df = spark.createDataFrame(FOLLOWED, "url string, keep boolean")
    rules = dict(
        site="example.com", include_keywords=["docs"], exclude_keywords=["login"]
    )
    got = df.withColumn("got", urls.should_follow(F.col("url"), **rules)).collect()
    assert [r["got"] for r in got] == [r["keep"] for r in got]


def test_suffix_mode_is_stricter(spark):
    df = spark.createDataFrame([(u,) for u, _ in FOLLOWED], "url string")
    keep = urls.filter_same_site(F.col("url"), "example.com", "suffix")
    got = {r["url"] for r in df.filter(keep).collect()}
    assert "https://www.example.com/docs" in got
    assert "https://example.com.evil.net/docs" not in got


def test_empty_filters_are_off(spark):
    df = spark.createDataFrame([("mailto:a@b",)], "url string")
    on = urls.should_follow(
        F.col("url"), include_keywords=[], exclude_keywords=None, excluded_protocols=[]
    )
    assert df.filter(on).count() == 1


BASES = [
    "http://a.b", "http://a.b/", "http://a.b/c", "http://a.b/c/", "http://a.b/c/d?q=1#f",
    "https://u:p@a.b:80/x//y/../z", "http://a.b/c;p/d;q", "HTTP://A.b/c", "http://a.b?x#",
    "http://a.b/c/./d", "http://é.b/c", "",
]
HREFS = [
    "", "../x", "?z", "?", "#", "#t", "//o.com/x", "x", "x/y.html", "./x", "x/..", "HTTP://X.com/",
    "http:x", "https:x", "mailto:x@y", "http://[x", "/r", "/r?q#f", "/r//s", "/r/./s", "/r?", "/r#",
    "http://o.com/a/../b", "http://o.com?", "http://o.com/#", "a:b", "x;y", "..", ".", "...", "x y",
    "javascript:void(0)", "tel:+1", "?a=/../b", "#a//b", "x?a=b&c=../d", "//", "///x", "%2e%2e/x",
    "é", "x#y?z", "/x?y?z#", "http://o.com:80", "https://a.b/c", "\\x", "x:", ":x", "a/b:c",
]


def _join(base, href):
    try:
        return urljoin(base, href)
    except ValueError:
        return None


def test_resolution_equals_urljoin(spark):
    pairs = [(b, h) for b in BASES for h in HREFS]
    df = spark.createDataFrame(pairs, "base string, href string")
    out = df.withColumn("url", urls.resolve_url(F.col("base"), F.col("href")))
    out = out.withColumn("near", urls.resolve_native(F.col("base"), F.col("href")))
    rows = out.collect()
    wrong = [
        (r["base"], r["href"], r["url"])
        for r in rows
        if r["url"] != _join(r["base"], r["href"])
    ]
    assert not wrong
    assert sum(r["near"] is not None for r in rows) > len(rows) / 4


@pytest.mark.parametrize(
    "url",
    [
        "http://a.b/c", "HTTPS://U:P@Host.Example:8080/x?y#z", "http://[::1]:80/x", "//h/x", "/x",
        "mailto:a@b.c", "http://a b/c", "http://", "http://u@/x", "ftp://h?x", "http://h#f@g", "",
        "http://a@b@c:1/x", "http://:80/",
    ],
)
def test_parts_equal_urlparse(spark, url):
    df = spark.createDataFrame([(url,)], "url string")
    got = df.select(urls.url_parts(F.col("url")).alias("p")).first()["p"]
    want = urlparse(url)
    assert (got["scheme"], got["netloc"], got["hostname"]) == (
        want.scheme, want.netloc, want.hostname,
    )


def test_gateway_url(spark):
    df = spark.createDataFrame([("http://a.b/c d?x=1&y=~*-_.é",)], "url string")
    made = urls.gateway_url(F.col("url"), "http://g", "K", True, "us", True)
    assert df.select(made).first()[0] == (
        "http://g?api_key=K&url=http%3A%2F%2Fa.b%2Fc%20d%3Fx%3D1%26y%3D~%2A-_.%C3%A9"
        "&render=true&country_code=us&premium=true"
    )


def test_safe_dir_name(spark):
    names = ["a.b:80", "..x", "é_-.", "", "...", "u@h"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(urls.safe_dir_name(F.col("n"))).collect()]
    assert got == ["a.b_80", "x", "é_-.", "scraped_data", "scraped_data", "u_h"]


@pytest.mark.parametrize("mode", urls.SITE_MATCHES)
def test_assign_site_equals_pairwise_filter(spark, mode):
    found = [u for u, _ in FOLLOWED] + ["http://a.example.com:80/", "http://example.com/x"]
    places = ["example.com", "example", "a.example.com:80", "com", "e", "nowhere"]
    urls_df = spark.createDataFrame([(u,) for u in found], "url string")
    sites_df = spark.createDataFrame([(s,) for s in places], "site string")
    got = sites.assign_site(urls_df, sites_df, mode)
    want = {
        (r["url"], s)
        for s in places
        for r in urls_df.filter(urls.filter_same_site(F.col("url"), s, mode)).collect()
    }
    assert {(r["url"], r["site"]) for r in got.collect()} == want


def test_rotation_is_the_same_when_hosts_are_split(spark):
    rows = [("big", f"u{i:04d}") for i in range(300)] + [(f"h{i % 7}", f"v{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "host string, url string")
    whole = {tuple(r) for r in sites.rotate_assign(df, ["a", "b", "c"]).collect()}
    split = {tuple(r) for r in sites.rotate_assign(df, ["a", "b", "c"], 40).collect()}
    assert whole == split and len(whole) == 360
    big = sorted(r for r in whole if r[0] == "big")
    assert [r[2] for r in big] == ["a", "b", "c"] * 100
