"""Breadth-first traversal, one join per level on tables bucketed alike.

Edges are written once in buckets of ``src``, visited URLs level by level in as many buckets
of ``url``. A level then joins its frontier with the edges, and what it found with all that
was visited, bucket by bucket: neither the edges nor the visited URLs are shuffled, at any
level; only new targets are. The planner may broadcast a frontier instead, by its file size.

A page with very many links would make one bucket too large. The edges of such pages are kept
in a table of their own, which is joined with the few of them that a frontier holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.urls import should_follow
from pageloom.operators.health import BreakerRules, Totals, next_trip
from pageloom.operators.links import build_edges
from pageloom.session import materialize, scratch_path

# Links of one page that a bucket takes.
HUB_LINKS = 1_000_000


def expand_frontier(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct targets of the links that leave the frontier's URLs."""
    return (
        frontier.join(edges, frontier["url"] == edges["src"])
        .select(F.col("dst").alias("url"))
        .distinct()
    )


def drop_visited(urls: DataFrame, visited: DataFrame) -> DataFrame:
    return urls.join(visited, "url", "left_anti")


def urls_union(*tables: DataFrame) -> DataFrame:
    """Distinct URLs of all tables."""
    return reduce(DataFrame.union, [t.select("url") for t in tables]).distinct()


def urls_except(links: DataFrame, visited: DataFrame) -> DataFrame:
    """Distinct links that were not visited yet."""
    return links.select("url").subtract(visited.select("url"))


class Bucketed:
    """A table bucketed by ``key`` in the shared folder, known to the session's catalog while
    a traversal runs. It grows part by part, each a value of the column ``part``."""

    def __init__(self, spark: SparkSession, label: str, key: str, part: str | None = None):
        self.spark, self.key, self.part = spark, key, part
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = scratch_path(spark, label)
        self.name = f"pageloom_{label}_{uuid.uuid4().hex}"

    def append(self, df: DataFrame, part: int | None = None) -> None:
        """Add rows, which should come dealt out by ``key``, so that a bucket is one file."""
        if self.part:
            df = df.withColumn(self.part, F.lit(part))
        writer = df.write.mode("append").bucketBy(self.buckets, self.key)
        if self.part:
            writer = writer.partitionBy(self.part)
        writer.format("parquet").option("path", self.path).saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Make the catalog forget the table; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


class Edges:
    """(src, dst) ready to be joined level by level."""

    def __init__(self, edges: DataFrame, hub_links: int = HUB_LINKS):
        spark = edges.sparkSession
        counts = edges.groupBy("src").agg(F.count("*").alias("n"))
        large = counts.filter(F.col("n") > hub_links).select("src")
        self.hubs = None
        if not large.isEmpty():
            hubs = materialize(large, "hubs")
            self.hubs = materialize(edges.join(hubs, "src", "left_semi"), "hub-edges")
            edges = edges.join(hubs, "src", "left_anti")
        self.kept = Bucketed(spark, "edges", "src")
        self.kept.append(edges.select("src", "dst").repartition(self.kept.buckets, "src"))

    def targets(self, frontier: DataFrame) -> DataFrame:
        """Distinct targets of the links that leave the frontier's URLs."""
        found = expand_frontier(frontier, self.kept.table())
        if self.hubs is None:
            return found
        return urls_union(found, expand_frontier(frontier, self.hubs))

    def drop(self) -> None:
        self.kept.drop()


def _walk(
    seeds: DataFrame,
    expand: Callable[[DataFrame], DataFrame],
    max_depth: int | None,
    max_levels: int | None,
    include_seed: bool,
    skip_seeds: bool = False,
    ended: Callable[[], bool] = lambda: False,
) -> DataFrame:
    """(url, depth) level by level, until nothing new is found or ``ended`` says so after
    a level."""
    if max_depth is not None and max_depth < 0:
        raise ValueError("a depth below 0 reaches nothing")
    spark = seeds.sparkSession
    frontier = seeds = materialize(seeds.select("url").distinct(), "seeds")
    levels = Bucketed(spark, "levels", "url", "depth")
    depth = 0
    try:
        while max_depth is None or depth <= max_depth:
            if max_levels is not None and max_depth is None and depth >= max_levels:
                if frontier.isEmpty():
                    break
                raise RuntimeError(f"links still unvisited after {max_levels} levels")
            fresh = expand(frontier)
            if depth:
                fresh = drop_visited(fresh, levels.table().select("url"))
            # Each level is written as one more part of the result: the plan of the next
            # level starts there, and a lost executor does not bring back earlier levels.
            rows = Observation()
            levels.append(fresh.observe(rows, F.count("*").alias("n")), depth + 1)
            depth += 1
            if rows.get["n"] == 0 or ended():
                break
            # A seed that turns up again may stay: all it links to is found already.
            # Only a fetcher should not be asked for it twice.
            frontier = levels.table().filter(F.col("depth") == depth).select("url")
            if skip_seeds:
                frontier = drop_visited(frontier, seeds)
    finally:
        levels.drop()
    found = spark.read.schema("url string, depth int").parquet(levels.path)
    if not include_seed:
        return found
    unlinked = drop_visited(seeds, found.select("url"))
    return found.union(unlinked.withColumn("depth", F.lit(0)))


def reach(
    edges: DataFrame,
    seeds: DataFrame,
    max_depth: int | None = 3,
    max_levels: int | None = None,
    include_seed: bool = False,
    hub_links: int = HUB_LINKS,
) -> DataFrame:
    """(url, depth) of all link targets on pages up to ``max_depth`` steps away.

    ``edges`` holds (src, dst), ``seeds`` holds (url). ``depth`` is the level a
    URL is first found on, from 1 to ``max_depth + 1``. A seed is in the result
    only if something links to it, unless ``include_seed`` asks for it (depth 0).
    ``max_depth=None`` runs until nothing new is found; ``max_levels`` then raises an
    error if links are left after so many levels.

    ``edges`` is evaluated twice, to count and to bucket. Sources with more than
    ``hub_links`` links are kept out of the buckets.
    """
    clustered = Edges(edges, hub_links)
    try:
        return _walk(seeds, clustered.targets, max_depth, max_levels, include_seed)
    finally:
        clustered.drop()


def visitable(pages: DataFrame, seeds: DataFrame, **filters) -> DataFrame:
    """The pages a crawl can come to: those that pass the filters, and the seeds.

    A condition on the URL alone, worked out before any HTML is parsed. Seeds are marked
    by a join, whatever their number; the planner broadcasts a short list.
    """
    if filters.get("site") == "own":
        filters = {**filters, "site": None}
    passes = F.coalesce(should_follow(F.col("url"), **filters), F.lit(False))
    marks = seeds.select(F.col("url").alias("_seed")).distinct()
    marked = pages.join(marks, pages["url"] == marks["_seed"], "left")
    return marked.filter(passes | F.col("_seed").isNotNull()).drop("_seed")


class _Watched:
    """A fetch callable whose outcomes count against breaker rules, level by level.

    ``log`` holds one table of (url, failed, ts) for each level; ``trip`` is the event that
    opened the breaker.
    """

    def __init__(self, fetch: Callable[[DataFrame], DataFrame], rules: BreakerRules):
        self.fetch, self.rules = fetch, rules
        self.so_far, self.trip = Totals(), None
        self.log: list[DataFrame] = []

    def __call__(self, frontier: DataFrame) -> DataFrame:
        got = materialize(self.fetch(frontier).select("url", "html", "failed", "ts"), "outcomes")
        self.trip, self.so_far = next_trip(got, F.col("failed"), ["ts", "url"], self.so_far, self.rules)
        if self.trip is not None:
            # The events up to the trip are those that took place.
            at = F.struct("ts", "url")
            last = F.struct(F.lit(self.trip["ts"]).alias("ts"), F.lit(self.trip["url"]).alias("url"))
            got = got.filter(at <= last)
        self.log.append(got.select("url", "failed", "ts"))
        return got.filter(~F.coalesce("failed", F.lit(False))).select("url", "html")

    def ended(self) -> bool:
        return self.trip is not None


def crawl(
    seeds: DataFrame,
    pages: DataFrame | None = None,
    fetch: Callable[[DataFrame], DataFrame] | None = None,
    max_depth: int | None = 3,
    max_levels: int | None = None,
    include_seed: bool = False,
    parsed: bool = True,
    breaker: BreakerRules | None = None,
    keep: Callable[[DataFrame], DataFrame] | None = None,
    **filters,
) -> DataFrame:
    """(url, depth) found by following links from the seeds.

    Content comes from a ``pages`` snapshot (url, html), or from ``fetch``, which
    gets a level's (url) rows and returns (url, html). The snapshot is parsed
    once into an edge table. Seeds are not filtered, and found URLs without a
    page stay in the result. ``filters`` go to ``should_follow``; of the links that pass,
    ``keep`` may take (src, dst) rows away, by a join with a table, say.

    With ``breaker`` the crawl ends by health. ``pages`` or ``fetch`` then give outcomes:
    (url, html, failed, ts), one row for each attempt. A level's attempts are ordered by
    (ts, url), nulls first, and their failures counted on from level to level. At the first
    attempt that trips the breaker the crawl ends: attempts behind it are as if they had not
    been made, and no further level is asked for. What was found till then is the result.
    """
    if (pages is None) == (fetch is None):
        raise ValueError("give either pages or fetch")
    keep = keep or (lambda edges: edges)
    if fetch is None and breaker is None:
        near = visitable(pages, seeds, **filters)
        edges = materialize(keep(build_edges(near, parsed, **filters)), "edges")
        return reach(edges, seeds, max_depth, max_levels, include_seed)
    if fetch is None:
        near = visitable(pages, seeds, **filters)

        def fetch(asked: DataFrame) -> DataFrame:
            return near.join(asked, "url", "left_semi")

    watched = _Watched(fetch, breaker) if breaker else None
    read = watched or fetch

    def expand(frontier: DataFrame) -> DataFrame:
        edges = keep(build_edges(read(frontier), parsed, **filters))
        return edges.select(F.col("dst").alias("url")).distinct()

    ended = watched.ended if watched else (lambda: False)
    return _walk(seeds, expand, max_depth, max_levels, include_seed, skip_seeds=True, ended=ended)
