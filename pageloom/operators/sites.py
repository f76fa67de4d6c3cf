"""Joins and assignments by site and host."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.urls import SITE_MATCHES, netloc, should_follow
from pageloom.operators.running import ROWS_PER_SLICE, running, spread_keys
from pageloom.session import materialize


def fetch_lookup(
    urls: DataFrame, pages: DataFrame, keep: Sequence[str] = ("html",)
) -> DataFrame:
    """(url, *keep, outcome): what the snapshot holds for every URL, ``processed``
    or ``failed``. The outcome is worked out before the join, so that with
    ``keep=()`` no page content is shuffled."""
    had = pages.select("url", *keep, (F.col("html") != "").alias("_body"))
    outcome = F.when(F.col("_body"), F.lit("processed")).otherwise(F.lit("failed"))
    return (
        urls.join(had, "url", "left").withColumn("outcome", outcome).drop("_body")
    )


# Characters of the pieces by which sites are looked up.
GRAM = 4


def _site_forms(where: Column, site_match: str) -> Column:
    """Every string a site may be written as to match this authority."""
    if site_match == "exact":
        return F.array(where)
    labels = F.split(where, r"\.")
    starts = F.sequence(F.lit(1), F.size(labels))
    return F.transform(
        starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )


def _grams(text: Column, size: int) -> Column:
    """The distinct pieces of ``size`` characters."""
    last = F.length(text) - size + 1
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, size))
    return F.when(last >= 1, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def contained_candidates(places: DataFrame, names: DataFrame, size: int = GRAM) -> DataFrame:
    """(_netloc, site): authorities with the sites they may contain, from distinct
    ``_netloc`` and distinct, non-empty ``site``.

    Every site is filed under one of its pieces of ``size`` characters, or under itself if
    it is shorter; an authority looks up each of its own pieces. A site's piece is the one
    that costs least: held by few authorities, and by few sites. So neither ``.com`` nor a
    piece that most sites have becomes a key unless a site holds nothing else. A site with
    a piece that no authority holds is contained in none.
    """
    sizes = names.select(F.least(F.length("site"), F.lit(size)).alias("n")).distinct().collect()
    of_place = F.array_distinct(F.flatten(F.array(*[_grams(F.col("_netloc"), r["n"]) for r in sizes])))
    if not sizes:
        return places.select("_netloc", F.lit(None).cast("string").alias("site")).limit(0)
    held = materialize(places.select("_netloc", F.explode(of_place).alias("gram")), "grams")
    own = F.when(F.length("site") < size, F.array("site")).otherwise(_grams(F.col("site"), size))
    filed = materialize(names.select("site", F.size(own).alias("grams"), F.explode(own).alias("gram")), "site-grams")
    cost = held.groupBy("gram").agg(F.count("*").alias("places")).join(
        filed.groupBy("gram").agg(F.count("*").alias("sites")), "gram"
    )
    best = (
        filed.join(cost, "gram")
        .groupBy("site", "grams")
        .agg(
            F.min(F.struct((F.col("places") * F.col("sites")).alias("cost"), "gram")).alias("best"),
            F.count("*").alias("known"),
        )
        .filter("known = grams")
        .select("site", F.col("best.gram").alias("gram"))
    )
    return held.join(best, "gram").select("_netloc", "site")


def assign_site(
    urls: DataFrame, sites: DataFrame, site_match: str = "contains"
) -> DataFrame:
    """Each URL with every site that covers it.

    Suffixes of the authority, or itself, are looked up by equality; in ``contains`` mode
    each site is looked up by one of its pieces and the containment verified. Only distinct
    authorities are looked up, and no pairwise comparison of URLs and sites takes place
    however many sites there are.
    """
    if site_match not in SITE_MATCHES:
        raise ValueError(f"site_match must be one of {SITE_MATCHES}")
    placed = urls.withColumn("_netloc", netloc(F.col("url")))
    places = placed.select("_netloc").filter("_netloc <> ''").distinct()
    if site_match == "contains":
        names = sites.select("site").filter("site <> ''").distinct()
        found = contained_candidates(places, names)
        found = found.filter(F.contains(F.col("_netloc"), F.col("site")))
    else:
        found = places.select("_netloc", F.explode(_site_forms(F.col("_netloc"), site_match)).alias("site"))
    return placed.join(found.join(sites, "site"), "_netloc").drop("_netloc")


def follow_by_site(
    urls: DataFrame, sites: DataFrame, site_match: str = "contains"
) -> DataFrame:
    """Run many site configurations at once: (url, site) that pass the filters of
    that site's row (start_with, include, exclude, excluded_protocols)."""
    url = F.col("url")

    def any_hit(words: str, test) -> Column:
        return F.exists(F.col(words), test)

    def off(words: str) -> Column:
        return F.coalesce(F.size(words), F.lit(0)) <= 0

    kept = assign_site(urls, sites, site_match).filter(
        (F.coalesce(F.col("start_with"), F.lit("")) == "")
        | url.startswith(F.col("start_with"))
    )
    return kept.filter(
        (off("exclude") | ~any_hit("exclude", lambda k: url.contains(k)))
        & (off("include") | any_hit("include", lambda k: url.contains(k)))
        & (
            off("excluded_protocols")
            | ~any_hit("excluded_protocols", lambda p: url.startswith(p))
        )
    ).select("url", "site")


def rotate_assign(
    requests: DataFrame,
    pool: list[str],
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Requests (host, url) with a ``proxy`` taken from ``pool`` in turn, per host
    in URL order."""
    if not pool:
        raise ValueError("pool cannot be empty")
    rows = spread_keys(requests, ["host"], ["url"], rows_per_slice)
    turns = running(rows, turn=("sum", F.lit(1).cast("bigint"))).result()
    choice = F.array(*map(F.lit, pool))
    at = ((F.col("turn") - 1) % len(pool)).cast("int")
    return turns.withColumn("proxy", choice[at]).drop("turn")


def hash_assign(requests: DataFrame, pool: list[str]) -> DataFrame:
    """A ``proxy`` per URL by its hash: evenly shared over all hosts, the same for
    the same URL in every run, and without ordering anything."""
    if not pool:
        raise ValueError("pool cannot be empty")
    at = F.pmod(F.xxhash64("url"), F.lit(len(pool))).cast("int")
    return requests.withColumn("proxy", F.array(*map(F.lit, pool))[at])


def follow(urls: DataFrame, **filters) -> DataFrame:
    return urls.filter(should_follow(F.col("url"), **filters))
