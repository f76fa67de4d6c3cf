"""Links of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.html import link_values, link_values_parsed
from pageloom.functions.urls import netloc, resolve_native, should_follow, url_join
from pageloom.session import once


def extract_links(pages: DataFrame, parsed: bool = True) -> DataFrame:
    """(url, href): every distinct link value of each page, as written."""
    values = link_values_parsed if parsed else link_values
    return pages.select("url", F.explode(values("html")).alias("href"))


def resolve_links(
    links: DataFrame, exact: bool = True, keep_failed: bool = False
) -> DataFrame:
    """(src, dst) of absolute URLs. Links that are no URL are dropped, or kept with
    a NULL ``dst`` to be counted."""
    page, href = F.col("url"), F.col("href")
    links = once(links, "_near", resolve_native(page, href))
    dst = F.col("_near")
    if exact:
        far = dst.isNull()
        dst = F.coalesce(dst, url_join(F.when(far, page), F.when(far, href)))
    resolved = once(links, "dst", dst).select(page.alias("src"), "dst")
    return resolved if keep_failed else resolved.filter("dst IS NOT NULL")


def build_edges(
    pages: DataFrame,
    parsed: bool = True,
    exact: bool = True,
    strip_fragment: bool = False,
    **filters,
) -> DataFrame:
    """Distinct (src, dst) of followed links of (url, html). Each page is parsed once."""
    return followed(extract_links(pages, parsed), exact, strip_fragment, **filters)


def followed(
    links: DataFrame, exact: bool = True, strip_fragment: bool = False, **filters
) -> DataFrame:
    """Distinct (src, dst) of those of the (url, href) links that are followed.

    URLs that differ in query or fragment are different pages, unless
    ``strip_fragment`` cuts the fragment off.

    ``filters`` are those of ``should_follow``; a ``site`` may also be the string
    ``"own"``, which keeps links into the page's own authority.
    """
    own = filters.get("site") == "own"
    if own:
        filters = {**filters, "site": None}
    edges = resolve_links(links, exact)
    if strip_fragment:
        edges = edges.withColumn("dst", F.regexp_replace("dst", "#.*$", ""))
    edges = edges.filter(should_follow(F.col("dst"), **filters))
    if own:
        edges = edges.filter(netloc(F.col("dst")).contains(netloc(F.col("src"))))
    return edges.distinct()


def distinct_links(edges: DataFrame) -> DataFrame:
    """Every linked URL once."""
    return edges.select(F.col("dst").alias("url")).distinct()
