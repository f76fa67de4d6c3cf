import random
import ipaddress
import random

from pyspark.sql import functions as F

from pageloom.functions import nets
from pageloom.operators import hosts, sites

DROP = ["localhost", "127.9.9.9", "10.0.0.1", "169.254.169.254", "192.0.2.1", "240.0.0.1"]
DROP_V6 = ["::1", "fe80::1", "64:ff9b::1"]
KEEP = ["8.8.8.8", "100.64.0.1", "192.0.0.9", "224.0.0.1", "name.example", "010.0.0.1", "10.1"]


def urls_of(spark, names):
    rows = [(f"http://[{n}]/x" if ":" in n else f"http://u:p@{n}:80/x",) for n in names]
    return spark.createDataFrame(rows, "url string")


def test_public_hosts(spark):
    df = urls_of(spark, DROP + DROP_V6 + KEEP)
    got = {r["url"] for r in hosts.filter_public_host(df).collect()}
    assert got == {r["url"] for r in urls_of(spark, KEEP).collect()}


def edge_addresses():
    rng = random.Random(1)
    numbers = {rng.randrange(2**32) for _ in range(500)}
    for block in nets.RESERVED_V4 + nets.PUBLIC_V4:
        net = ipaddress.ip_network(block)
        for end in (int(net.network_address), int(net.broadcast_address)):
            numbers |= {n for n in (end - 1, end, end + 1) if 0 <= n < 2**32}
    return [str(ipaddress.ip_address(n)) for n in sorted(numbers)]


def test_ranges_equal_ipaddress(spark):
    texts = edge_addresses()
    df = spark.createDataFrame([(t,) for t in texts], "host string")
    matched = hosts.cidr_match(df, hosts.cidr_blocks(spark))
    out = matched.select("host", "kind", nets.is_public_host(F.col("host")).alias("public"))
    rows = out.collect()
    assert len(rows) == len(texts)
    for row in rows:
        ip = ipaddress.ip_address(row["host"])
        public = not (ip.is_private or ip.is_loopback or ip.is_reserved)
        assert row["public"] == public, row
        assert (row["kind"] in (None, "public")) == public, row


def test_match_prefers_the_narrowest_block(spark):
    blocks = hosts.cidr_blocks(spark, [("10.0.0.0/8", "a"), ("10.1.0.0/16", "b"), ("10.1.2.3/32", "c")])
    names = ["10.9.9.9", "10.1.9.9", "10.1.2.3", "11.0.0.0", "name", None]
    df = spark.createDataFrame([(n,) for n in names], "host string")
    got = {r["host"]: r["kind"] for r in hosts.cidr_match(df, blocks).collect()}
    assert got == dict(zip(names, ["a", "b", "c", None, None, None]))
    none = hosts.cidr_match(df, blocks.limit(0))
    assert none.columns == ["host", "cidr", "kind"] and none.count() == len(names)


def test_resolved_hosts(spark):
    dns = spark.createDataFrame(
        [("h.example", "10.1.1.1"), ("ok.example", "8.8.8.8"), ("six.example", "fe80::1")],
        "host string, ip string",
    )
    df = urls_of(spark, ["h.example", "ok.example", "six.example", "none.example", "10.0.0.1"])
    got = {r["url"].split("@")[1] for r in hosts.resolved_host_check(df, dns).collect()}
    assert got == {"ok.example:80/x", "none.example:80/x"}


def test_contained_sites_are_found_by_rare_pieces(spark):
    rng = random.Random(11)
    hosts = [f"shop{i}.example{i % 7}.com" for i in range(200)] + ["a.io", "io", "xn--e1a.test:8080", "é.de"]
    names = [f"shop{i}.example{i % 7}.com" for i in range(0, 200, 3)] + [f"missing{i}.com" for i in range(300)]
    names += ["example3", ".com", "io", "a", "é", "8080", "", "nowhere.test", "shop1", "mple5.c"]
    urls = spark.createDataFrame([(f"http://{h}/p{rng.randrange(3)}",) for h in hosts for _ in range(2)], "url string")
    table = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "site string, plan int")
    got = sorted(tuple(r) for r in sites.assign_site(urls, table).select("url", "site", "plan").collect())
    where = [r.url for r in urls.collect()]
    want = sorted((u, n, i) for u in where for i, n in enumerate(names) if n and n in u.split("/")[2])
    assert got == want
    places = spark.createDataFrame([(h,) for h in hosts], "_netloc string")
    filed = table.select("site").filter("site <> ''").distinct()
    rows = sites.contained_candidates(places, filed).count()
    true = sum(n in h for h in hosts for n in set(names) if n)
    # A site per substring would be looked up some 40,000 times, ".com" alone match 200.
    assert true <= rows <= 1.3 * true
    assert sites.assign_site(urls, table.limit(0)).count() == 0
    assert sites.assign_site(urls.limit(0), table).count() == 0
    twice = sites.assign_site(urls.limit(1), table.filter("site = '.com'").union(table.filter("site = '.com'")))
    assert twice.count() == 2
