import random

import pytest

from pageloom.catalog.queries import QUERIES
from pageloom.operators import graph
from pageloom.plans.corpus import crawl_run, crawl_to_chunks

EDGES = [("s", "a"), ("s", "b"), ("a", "c"), ("b", "a"), ("c", "d"), ("d", "a")]


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def seeds_of(spark, *urls):
    return spark.createDataFrame([(u,) for u in urls], "url string")


def found(df):
    rows = df.collect()
    assert len(rows) == len({r["url"] for r in rows})
    return {r["url"]: r["depth"] for r in rows}


@pytest.mark.parametrize(
    "max_depth, want",
    [
        (0, {"a": 1, "b": 1}),
        (1, {"a": 1, "b": 1, "c": 2}),
        (2, {"a": 1, "b": 1, "c": 2, "d": 3}),
        (None, {"a": 1, "b": 1, "c": 2, "d": 3}),
    ],
)
def test_reach(spark, max_depth, want):
    assert found(graph.reach(frame(spark, EDGES), seeds_of(spark, "s"), max_depth)) == want


def test_seed_rules(spark):
    edges = frame(spark, EDGES)
    with_seed = graph.reach(edges, seeds_of(spark, "s"), 0, include_seed=True)
    assert found(with_seed) == {"s": 0, "a": 1, "b": 1}
    assert found(graph.reach(edges, seeds_of(spark, "a"), None)) == {"c": 1, "d": 2, "a": 3}
    assert found(graph.reach(edges, seeds_of(spark, "nowhere"), None)) == {}


def test_level_limit_is_an_error_not_a_cut(spark):
    with pytest.raises(RuntimeError):
        graph.reach(frame(spark, EDGES), seeds_of(spark, "s"), None, max_levels=2)


def test_level_limit_lets_finished_crawls_end(spark):
    chain = frame(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    want = {"b": 1, "c": 2, "d": 3}
    assert found(graph.reach(chain, seeds_of(spark, "a"), None, max_levels=4)) == want
    assert found(graph.reach(chain, seeds_of(spark, "a"), 10, max_levels=2)) == want


def test_random_graphs_equal_plain_search(spark):
    for seed in range(3):
        rng = random.Random(seed)
        edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(60)]
        edges += [("n0", f"n{rng.randrange(40)}") for _ in range(30)]
        out = {}
        for s, d in edges:
            out.setdefault(s, set()).add(d)
        want, visited, level = {}, {"n0"}, {"n0"}
        depth = 0
        while level:
            depth += 1
            linked = set().union(*(out.get(u, set()) for u in level))
            for u in linked:
                want.setdefault(u, depth)
            level = linked - visited
            visited |= level
        assert found(graph.reach(frame(spark, edges), seeds_of(spark, "n0"), None)) == want


def link(*urls):
    return "".join(f'<a href="{u}">x</a>' for u in urls)


PAGES = [
    ("http://s.t/", "<p>home</p>" + link("/a", "b?x=1&amp;y=2", "http://o.t/", "mailto:m@s.t")),
    ("http://s.t/a", "<p>=page a</p><nav>menu</nav>" + link("/", "/skip/1", "/gone")),
    ("http://s.t/b?x=1&y=2", "<p>home</p>" + link("../c")),
    ("http://s.t/c", "<p>page c</p>" + link("/d")),
    ("http://s.t/d", "<p>page d</p>"),
    ("http://s.t/skip/1", "<p>skipped</p>"),
    ("http://o.t/", "<p>other</p>"),
]


def pages_of(spark):
    return spark.createDataFrame(PAGES, "url string, html string")


def test_crawl_snapshot_and_callable(spark):
    pages = pages_of(spark)
    seeds = seeds_of(spark, "http://s.t/")
    rules = dict(max_depth=1, site="s.t", exclude_keywords=["skip"])
    want = {
        "http://s.t/a": 1, "http://s.t/b?x=1&y=2": 1,
        "http://s.t/": 2, "http://s.t/gone": 2, "http://s.t/c": 2,
    }
    assert found(graph.crawl(seeds, pages, **rules)) == want
    asked = []

    def fetch(urls):
        asked.append(sorted(r[0] for r in urls.collect()))
        return pages.join(urls, "url", "left_semi")

    assert found(graph.crawl(seeds, fetch=fetch, **rules)) == want
    assert asked == [["http://s.t/"], ["http://s.t/a", "http://s.t/b?x=1&y=2"]]


def test_deeper_crawls_find_no_less(spark):
    seeds = seeds_of(spark, "http://s.t/")
    sizes = [set(found(graph.crawl(seeds, pages_of(spark), max_depth=d))) for d in range(4)]
    assert all(a <= b for a, b in zip(sizes, sizes[1:]))


@pytest.mark.parametrize("parsed", [False, True])
def test_crawl_to_chunks(spark, parsed):
    out = crawl_to_chunks(
        spark, "http://s.t/", pages_of(spark), max_depth=1,
        exclude_keywords=["skip"], split_length=16, parsed=parsed,
    )
    assert out.columns == ["URL", "Content", "Chunk Number"]
    got = {tuple(r) for r in out.collect()}
    assert got == {
        ("http://s.t/", "home x x x x", 1),
        ("http://s.t/a", "'=page a x x x", 1),
        ("http://s.t/b?x=1&y=2", "home x", 1),
        ("http://s.t/c", "page c x", 1),
    }


def test_crawl_to_chunks_fetches_each_url_once(spark):
    asked = []

    def fetch(urls):
        asked.extend(r[0] for r in urls.collect())
        return pages_of(spark).join(urls, "url", "left_semi")

    rules = dict(max_depth=1, exclude_keywords=["skip"], split_length=16)
    out = crawl_to_chunks(spark, "http://s.t/", fetch=fetch, **rules)
    want = crawl_to_chunks(spark, "http://s.t/", pages_of(spark), **rules)
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in want.collect()}
    assert sorted(asked) == [
        "http://s.t/", "http://s.t/a", "http://s.t/b?x=1&y=2", "http://s.t/c", "http://s.t/gone",
    ]


def test_bad_domains(spark):
    for domain in ("ftp://s.t/", "s.t", "http:///x", "http://127.0.0.1/", "http://[::1]/", "http://localhost"):
        with pytest.raises(ValueError):
            crawl_to_chunks(spark, domain, pages_of(spark))


def test_set_operations(spark):
    a, b = seeds_of(spark, "x", "x", "y"), seeds_of(spark, "y", "z")
    assert sorted(r[0] for r in graph.urls_union(a, b).collect()) == ["x", "y", "z"]
    assert [r[0] for r in graph.urls_except(a, b).collect()] == ["x"]
    assert [r[0] for r in graph.drop_visited(a.distinct(), b).collect()] == ["x"]


def test_small_frontier_is_broadcast_and_edges_stay_put(spark, folder):
    edges = graph.materialize(frame(spark, EDGES * 50), "edges")
    frontier = graph.materialize(seeds_of(spark, "s"), "frontier")
    plan = graph.expand_frontier(frontier, edges)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_frontier_query_expands_pages_and_parts(spark, tmp_path):
    pages = [("http://s.t/a", '<a href="/b">b</a><a href="/c">c</a>'), ("http://s.t/b", '<a href="/c">c</a>')]
    spark.createDataFrame(pages, "url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    items = spark.createDataFrame([(1, 7), (1, 8), (2, 7)], "l_partkey bigint, l_suppkey bigint")
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(r["url"] for r in QUERIES["expand_frontier"](spark, str(tmp_path)).collect())
    assert got == ["http://s.t/b", "http://s.t/c", "s7", "s8"]


def test_pages_a_crawl_can_come_to(spark):
    seeds = seeds_of(spark, "http://o.t/", "http://s.t/", "http://none/")
    near = graph.visitable(pages_of(spark), seeds, site="s.t", exclude_keywords=["skip"])
    assert sorted(r["url"] for r in near.collect()) == [
        "http://o.t/", "http://s.t/", "http://s.t/a", "http://s.t/b?x=1&y=2", "http://s.t/c",
        "http://s.t/d",
    ]


def scans_under_exchange(plan, name):
    """Table scans of ``name`` in a plan's text, and how many of them an exchange stands above."""
    stack, scans, dealt = [], 0, 0
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-|"))
        while stack and stack[-1][0] >= depth:
            stack.pop()
        text = line.strip(" :+-|*()0123456789")
        if "Scan parquet" in line and name in line:
            scans += 1
            # Only what lies between the scan and the join above it counts.
            above = [t for _, t in reversed(stack)]
            joins = next((i for i, t in enumerate(above) if "Join" in t), len(above))
            dealt += any("Exchange" in t for t in above[:joins])
        stack.append((depth, text))
    return scans, dealt


def test_levels_shuffle_neither_edges_nor_visited(spark, monkeypatch):
    rng = random.Random(6)
    edges = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(600)]
    plans = []
    original = graph.Bucketed.append

    def append(self, df, part=None):
        if self.part:
            plans.append((self.name, df._jdf.queryExecution().executedPlan().toString()))
        original(self, df, part)

    monkeypatch.setattr(graph.Bucketed, "append", append)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = found(graph.reach(frame(spark, edges), seeds_of(spark, "n0"), None))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(got) > 100 and len(plans) > 3
    for level, (name, plan) in enumerate(plans):
        assert scans_under_exchange(plan, "pageloom_edges") == (1, 0)
        scans, dealt = scans_under_exchange(plan, name)
        assert dealt == 0 and scans == (2 if level else 0)  # frontier and visited
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("pageloom_")]


def test_hubs_are_kept_out_of_the_buckets(spark):
    edges = [("s", f"n{i}") for i in range(60)] + [("n1", "x"), ("n2", "x"), ("x", "y"), ("y", "s")]
    want = found(graph.reach(frame(spark, edges), seeds_of(spark, "s"), None))
    assert found(graph.reach(frame(spark, edges), seeds_of(spark, "s"), None, hub_links=10)) == want
    assert want["y"] == 3 and len(want) == 63
    clustered = graph.Edges(frame(spark, edges), 10)
    assert clustered.kept.table().count() == 4 and clustered.hubs.count() == 60
    clustered.drop()


def plain_health_crawl(pages, outcomes, seed, rules):
    """pages: url -> linked urls; outcomes: url -> [(ts, failed)]."""
    total = failures = streak = 0
    depth_of, level, depth = {}, [seed], 0
    while level:
        tried = sorted((ts, url, failed) for url in level for ts, failed in outcomes.get(url, ()))
        linked, tripped = set(), False
        for ts, url, failed in tried:
            total += 1
            if failed:
                failures, streak = failures + 1, streak + 1
            else:
                streak = 0
                linked |= set(pages[url])
            if failed and (streak >= rules.failure_threshold or (total >= rules.min_requests and failures / total >= rules.failure_rate)):
                tripped = True
                break
        depth += 1
        fresh = linked - set(depth_of)
        depth_of.update(dict.fromkeys(fresh, depth))
        if tripped:
            return depth_of, depth
        level = fresh - {seed}
    return depth_of, depth


@pytest.mark.parametrize("seed", range(4))
def test_crawl_ends_by_health(spark, seed):
    from pageloom.operators.health import BreakerRules

    rng = random.Random(seed)
    names = [f"http://s.t/{i}" for i in range(60)]
    pages = {u: rng.sample(names, 3) for u in names}
    outcomes = {u: [(rng.randrange(9), rng.random() < (0.1, 0.3, 0.5, 0.0)[seed]) for _ in range(rng.randrange(3))] for u in names}
    outcomes[names[0]] = [(1, False)]
    outcomes = {u: list(dict(o).items()) for u, o in outcomes.items()}
    rules = BreakerRules(failure_threshold=3, failure_rate=0.4, min_requests=6)
    rows = [(u, link(*pages[u]), f, ts) for u, o in outcomes.items() for ts, f in o]
    table = spark.createDataFrame(rows, "url string, html string, failed boolean, ts int")
    want, levels = plain_health_crawl(pages, outcomes, names[0], rules)
    assert found(graph.crawl(seeds_of(spark, names[0]), table, max_depth=None, breaker=rules)) == want
    asked = []

    def fetch(urls):
        asked.append(urls.count())
        return table.join(urls, "url", "left_semi")

    assert found(graph.crawl(seeds_of(spark, names[0]), fetch=fetch, max_depth=None, breaker=rules)) == want
    # A level that holds the seed alone may be asked for, as nothing.
    assert levels <= len(asked) <= levels + 1 and sum(asked[levels:]) == 0


def test_trips_are_counted_on_from_log_to_log(spark):
    from pyspark.sql import functions as F

    from pageloom.operators.health import BreakerRules, Totals, next_trip

    rules = BreakerRules(failure_threshold=4, failure_rate=1.0, min_requests=100)

    def log(text):
        return spark.createDataFrame([(i, c == "x") for i, c in enumerate(text)], "n int, bad boolean")

    for size in (100, 2):
        trip, totals = next_trip(log("ox.xx".replace(".", "o")), F.col("bad"), ["n"], Totals(), rules, size)
        assert trip is None and totals == Totals(5, 3, 2)
        trip, totals = next_trip(log("x"), F.col("bad"), ["n"], totals, rules, size)
        assert trip is None and totals == Totals(6, 4, 3)
        trip, after = next_trip(log("xoxx"), F.col("bad"), ["n"], totals, rules, size)
        assert (trip["n"], trip["streak"], trip["reason"]) == (0, 4, "consecutive failures")
        trip, after = next_trip(log("oxxx"), F.col("bad"), ["n"], totals, rules, size)
        assert trip is None and after == Totals(10, 7, 3)
        assert next_trip(log(""), F.col("bad"), ["n"], totals, rules, size) == (None, totals)


@pytest.mark.parametrize("fetched", [False, True])
def test_crawl_totals_and_dns(spark, fetched):
    rows = [
        ("http://s.t/", "<p>home</p>" + link("/a", "http://in.s.t/x", "http://out.s.t/y", "/gone")),
        ("http://s.t/a", "<p>page x x</p>"),
        ("http://in.s.t/x", "<p>inside</p>" + link("http://s.t/hidden")),
        ("http://out.s.t/y", "<p>page</p>" + link("/z", "/empty")),
        ("http://out.s.t/z", "<p>last</p>"),
        ("http://out.s.t/empty", ""),
        ("http://s.t/hidden", "<p>hidden</p>"),
    ]
    pages = spark.createDataFrame(rows, "url string, html string")
    dns = spark.createDataFrame(
        [("in.s.t", "10.1.2.3"), ("out.s.t", "8.8.8.8"), ("s.t", "8.8.4.4"), ("bad.t", "::1")], "host string, ip string"
    )
    source = {"fetch": lambda urls: pages.join(urls, "url", "left_semi")} if fetched else {"pages": pages}
    run = crawl_run(spark, "http://s.t/", max_depth=None, dns=dns, **source)
    assert found(run.found) == {
        "http://s.t/a": 1, "http://out.s.t/y": 1, "http://s.t/gone": 1, "http://out.s.t/z": 2, "http://out.s.t/empty": 2,
    }
    totals = {r.site: tuple(r)[1:] for r in run.totals().collect()}
    assert totals == {"s.t": (2, 1, 1, 0, 1, 1), "out.s.t": (3, 2, 1, 2, 0, 2), None: (5, 3, 2, 2, 1, 2)}
    assert sorted((r.URL, r.Content) for r in run.records().collect()) == [
        ("http://out.s.t/y", "page x x"), ("http://out.s.t/z", "last"),
    ]
    free = crawl_run(spark, "http://s.t/", max_depth=None, **source)
    assert {"http://in.s.t/x", "http://s.t/hidden"} <= set(found(free.found))
    for name in ("http://bad.t/", "http://BAD.t/"):
        with pytest.raises(ValueError):
            crawl_run(spark, name, pages, dns=dns)
    assert crawl_run(spark, "http://bad.t/", pages, dns=dns, check_host=False).found.count() == 0
