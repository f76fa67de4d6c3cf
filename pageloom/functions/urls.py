"""URL parts, resolution, filters and derived names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Link schemes that lead to no page.
EXCLUDED_PROTOCOLS = ("mailto:", "tel:", "whatsapp:")
WEB_SCHEMES = ("http", "https")
SITE_MATCHES = ("contains", "suffix", "exact")

SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
# After user and password: up to the closing bracket if there is an opening one,
# else up to the port.
HOST = (
    r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?"
    r"(?:[^/?#@\[]*\[)?((?<=\[)[^\]/?#@]*|[^/?#:@\[]*)"
)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def netloc(url: Column) -> Column:
    """Authority with user and port, case kept; ``''`` if there is none."""
    return F.regexp_extract(url, NETLOC, 1)


def hostname(url: Column) -> Column:
    """Host in lower case without user, port or brackets; NULL if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def url_parts(url: Column) -> Column:
    return F.struct(
        scheme(url).alias("scheme"),
        netloc(url).alias("netloc"),
        hostname(url).alias("hostname"),
    )


# --- resolution ------------------------------------------------------------

# A base the native forms can build on: plain authority, no parameters, no
# whitespace, no empty query.
_BASE = r"^https?://[A-Za-z0-9._~:@%-]+(/[^?#\s;]*)?(\?[^#\s]+)?(#\S*)?$"
_ABSOLUTE = r"^https?://[A-Za-z0-9._~:@%-]+([/?#]\S*)?$"
_RELATIVE_HOST = r"^//[A-Za-z0-9._~:@%-]+([/?#]\S*)?$"
_ROOTED = r"^/(?!/)[^\s;]*$"
_OTHER_SCHEME = r"^(?:mailto|tel|whatsapp|javascript|data|sms):[^\s\[\]]*$"
_FRAGMENT = r"^#\S+$"
_QUERY = r"^\?[^#\s]+(#\S+)?$"
_PLAIN_RELATIVE = r"^[A-Za-z0-9_~%-][^\s:;]*$"
# Left to the UDF: dot segments, empty segments, and empty queries or fragments,
# which the join drops.
UNSAFE_END = r"[?#;]$|\?#|\\|;[?#]"
_NEEDS_JOIN = r"(?:^|/)\.|//|[?#]$|\?#|\\"


@F.pandas_udf(StringType())
def url_join(base: pd.Series, href: pd.Series) -> pd.Series:
    """RFC 3986 join by the standard library; NULL where it refuses the input."""

    def join(b, h):
        if b is None or h is None:
            return None
        try:
            return urljoin(b, h)
        except ValueError:
            return None

    return pd.Series([join(b, h) for b, h in zip(base, href)], dtype=object)


def resolve_native(base: Column, href: Column) -> Column:
    """The frequent link forms inside the JVM; NULL for the others."""
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    path = F.regexp_extract(base, r"^https?://[^/?#]+([^?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, "^.*/", 0), F.lit("")), F.lit("/"))
    usable = base.rlike(_BASE)
    tail = F.regexp_replace(href, "^https?:", "")
    clean = ~F.regexp_replace(tail, "^//", "").rlike(_NEEDS_JOIN)
    # An absolute link keeps its path as written, dots and all.
    # An empty last parameter is cut by the join.
    whole = ~href.rlike(UNSAFE_END)
    return (
        F.when(~usable, F.lit(None).cast("string"))
        .when(href == "", base)
        .when(href.rlike(_OTHER_SCHEME), href)
        .when(href.rlike(_ABSOLUTE) & whole, href)
        .when(
            href.rlike(_RELATIVE_HOST) & whole,
            F.concat(F.regexp_extract(base, "^https?:", 0), href),
        )
        .when(href == "#", F.regexp_replace(base, "#.*$", ""))
        .when(
            href.rlike(_FRAGMENT), F.concat(F.regexp_replace(base, "#.*$", ""), href)
        )
        .when(
            href.rlike(_QUERY),
            F.concat(F.regexp_replace(base, "[?#].*$", ""), href),
        )
        .when(href.rlike(_ROOTED) & clean, F.concat(origin, href))
        .when(
            href.rlike(_PLAIN_RELATIVE) & clean & ~path.rlike(r"//|/\."),
            F.concat(origin, folder, href),
        )
    )


def resolve_url(base: Column, href: Column, exact: bool = True) -> Column:
    """Absolute URL of a link found on page ``base``; ``href`` has no blanks around it.

    Frequent forms are built natively. With ``exact`` the rest (dot segments,
    empty segments, odd characters) goes to ``url_join``, and rows already solved
    send only NULLs there; without it they become NULL.
    """
    native = resolve_native(base, href)
    if not exact:
        return native
    open_ = native.isNull()
    return F.coalesce(native, url_join(F.when(open_, base), F.when(open_, href)))


# --- filters ---------------------------------------------------------------


def filter_prefix(url: Column, start_with: str | None) -> Column:
    return url.startswith(start_with) if start_with else F.lit(True)


def _any_of(tests: list[Column]) -> Column:
    return reduce(or_, tests)


def filter_exclude(url: Column, keywords: Sequence[str] | None) -> Column:
    """No keyword occurs in the URL."""
    return ~_any_of([url.contains(k) for k in keywords]) if keywords else F.lit(True)


def filter_include(url: Column, keywords: Sequence[str] | None) -> Column:
    """At least one keyword occurs in the URL."""
    return _any_of([url.contains(k) for k in keywords]) if keywords else F.lit(True)


def filter_protocol(
    url: Column, protocols: Sequence[str] | None = EXCLUDED_PROTOCOLS
) -> Column:
    return ~_any_of([url.startswith(p) for p in protocols]) if protocols else F.lit(True)


def filter_same_site(url: Column, site: str, site_match: str = "contains") -> Column:
    """The URL's authority holds ``site`` (default), ends with it at a dot
    (``suffix``) or equals it (``exact``)."""
    if site_match not in SITE_MATCHES:
        raise ValueError(f"site_match must be one of {SITE_MATCHES}")
    where = netloc(url)
    if site_match == "contains":
        return where.contains(site)
    if site_match == "suffix":
        return (where == site) | where.endswith("." + site)
    return where == site


def should_follow(
    url: Column,
    site: str | None = None,
    start_with: str | None = None,
    include_keywords: Sequence[str] | None = None,
    exclude_keywords: Sequence[str] | None = None,
    excluded_protocols: Sequence[str] | None = EXCLUDED_PROTOCOLS,
    site_match: str = "contains",
) -> Column:
    """All URL filters in one condition."""
    tests = [
        filter_prefix(url, start_with),
        filter_exclude(url, exclude_keywords),
        filter_include(url, include_keywords),
        filter_protocol(url, excluded_protocols),
    ]
    if site:
        tests.append(filter_same_site(url, site, site_match))
    return reduce(and_, tests)


def filter_valid_target(url: Column) -> Column:
    return scheme(url).isin(*WEB_SCHEMES) & (netloc(url) != "")


# --- derived names ---------------------------------------------------------


def safe_dir_name(site: Column, fallback: str = "scraped_data") -> Column:
    """A directory name: other characters become ``_``, leading dots go."""
    name = F.regexp_replace(F.regexp_replace(site, r"(?U)[^\w\-.]", "_"), r"^\.+", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(fallback))


def percent_encode(c: Column) -> Column:
    """RFC 3986 encoding with no safe reserved characters."""
    form = F.url_encode(c)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        form = F.replace(form, F.lit(old), F.lit(new))
    return form


def gateway_url(
    target: Column,
    base_url: str,
    api_key: str = "{api_key}",
    render_js: bool = False,
    country: str | None = None,
    premium: bool = False,
) -> Column:
    """Request URL of a fetch service. The default key is a placeholder, so that
    no secret lands in a table."""
    flags = ""
    if render_js:
        flags += "&render=true"
    if country:
        flags += f"&country_code={country}"
    if premium:
        flags += "&premium=true"
    return F.concat(
        F.lit(f"{base_url}?api_key={api_key}&url="), percent_encode(target), F.lit(flags)
    )
