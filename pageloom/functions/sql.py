"""The text functions under SQL names, with the arguments and the paths of the Column forms.

Each name is a temporary SQL function, so Catalyst sees through it. What the JVM can't
decide goes to the Arrow UDFs of the Column forms, which are registered under names that
start with an underscore; rows that are solved already send NULL there.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from pageloom.functions import charset, html, nets, text, urls


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _listed(values) -> str:
    return ", ".join(map(_quoted, values))


def _resolve_native() -> str:
    q = _quoted
    bare = "regexp_replace(regexp_replace(href, '^https?:', ''), '^//', '')"
    clean = f"NOT {bare} RLIKE {q(urls._NEEDS_JOIN)}"
    whole = f"NOT href RLIKE {q(urls.UNSAFE_END)}"
    origin = "regexp_extract(base, '^(https?://[^/?#]+)', 1)"
    path = "regexp_extract(base, '^https?://[^/?#]+([^?#]*)', 1)"
    folder = f"coalesce(nullif(regexp_extract({path}, '^.*/', 0), ''), '/')"
    return f"""CASE WHEN NOT base RLIKE {q(urls._BASE)} THEN NULL
      WHEN href = '' THEN base
      WHEN href RLIKE {q(urls._OTHER_SCHEME)} THEN href
      WHEN href RLIKE {q(urls._ABSOLUTE)} AND {whole} THEN href
      WHEN href RLIKE {q(urls._RELATIVE_HOST)} AND {whole}
        THEN concat(regexp_extract(base, '^https?:', 0), href)
      WHEN href = '#' THEN regexp_replace(base, '#.*$', '')
      WHEN href RLIKE {q(urls._FRAGMENT)} THEN concat(regexp_replace(base, '#.*$', ''), href)
      WHEN href RLIKE {q(urls._QUERY)} THEN concat(regexp_replace(base, '[?#].*$', ''), href)
      WHEN href RLIKE {q(urls._ROOTED)} AND {clean} THEN concat({origin}, href)
      WHEN href RLIKE {q(urls._PLAIN_RELATIVE)} AND {clean} AND NOT {path} RLIKE '//|/[.]'
        THEN concat({origin}, {folder}, href) END"""


def _reference(part: str) -> str:
    """What follows an ampersand, with the reference it starts with decoded."""
    names = "str_to_map({}, '\\n', '\\t')".format(
        _quoted("\n".join(f"{n}\t{c}" for n, c in html.ENTITIES.items()))
    )
    every = "str_to_map({}, '\x01', '\x02')".format(
        _quoted("\x01".join(f"{n}\x02{c}" for n, c in html.ALL_ENTITIES.items()))
    )
    name = f"regexp_extract({part}, {_quoted(html.NAMED)}, 1)"
    digits = f"regexp_extract({part}, {_quoted(html.NUMBERED)}, 1)"
    code = (
        f"try_cast(CASE WHEN lower({digits}) LIKE 'x%' THEN conv(substr({digits}, 2), 16, 10) "
        f"ELSE {digits} END AS INT)"
    )
    char = f"""transform(array({code}), c -> CASE
      WHEN c BETWEEN 128 AND 159 THEN substring({_quoted(html.CONTROLS)}, c - 127, 1)
      WHEN c BETWEEN 1 AND 55295 OR c BETWEEN 57344 AND 1114111
        THEN decode(unhex(lpad(hex(c), 8, '0')), 'UTF-32')
      ELSE '�' END)[0]"""
    return f"""CASE WHEN startswith({part}, 'amp;') THEN concat('&', substr({part}, 5))
      WHEN startswith({part}, '#') AND {part} RLIKE {_quoted(html.NUMBERED)}
        THEN concat({char}, regexp_replace({part}, {_quoted(html.NUMBERED)}, ''))
      ELSE concat(
        coalesce(try_element_at({names}, {name}), try_element_at({every}, {name}), concat('&', {name})),
        regexp_replace({part}, {_quoted(html.NAMED)}, '')) END"""


def _html_to_text() -> str:
    parts = f"split(regexp_replace(html, {_quoted(html.markup(html.DROPPED))}, ' '), '&')"
    decoded = (
        f"transform(array({parts}), ps -> array_join(concat(slice(ps, 1, 1), "
        f"transform(slice(ps, 2, size(ps)), p -> {_reference('p')})), ''))[0]"
    )
    return f"trim(regexp_replace({decoded}, {_quoted(text.WHITESPACE + '+')}, ' '))"


def _known_charset() -> str:
    marks = " ".join(
        f"WHEN startswith(hex(substring(body, 1, 4)), {_quoted(mark)}) THEN {_quoted(name)}"
        for mark, name in charset.BYTE_ORDER_MARKS.items()
    )
    meta = f"lower(regexp_extract(make_valid_utf8(CAST(body AS STRING)), {_quoted(charset.META)}, 1))"
    return f"""CASE {marks} WHEN {meta} <> '' THEN {meta}
      WHEN is_valid_utf8(CAST(body AS STRING)) THEN 'utf-8' END"""


def _is_utf8() -> str:
    return f"""coalesce(nullif(lower(declared), ''), detect_charset(body)) IN ({_listed(charset.UTF8_NAMES)})
      AND is_valid_utf8(CAST(body AS STRING))"""


def _is_public_ip() -> str:
    """Reserved ranges are constants; a public range inside a reserved one wins."""
    number = "aggregate(split(ip, '[.]'), 0L, (n, octet) -> n * 256 + CAST(octet AS BIGINT))"

    def within(blocks) -> str:
        return " OR ".join(f"n BETWEEN {lo} AND {hi}" for lo, hi in nets.bounds(blocks))

    return f"""CASE WHEN contains(ip, ':') THEN _is_public_ip(CASE WHEN contains(ip, ':') THEN ip END)
      WHEN ip RLIKE {_quoted(nets.DOTTED)} THEN NOT exists(array({number}),
        n -> ({within(nets.RESERVED_V4)}) AND NOT ({within(nets.PUBLIC_V4)}))
      WHEN ip IS NOT NULL THEN true END"""


# (name, arguments, result, body); later ones use earlier ones.
def functions() -> list[tuple[str, str, str, str]]:
    utf8 = "_is_utf8(body, declared)"
    return [
        ("_resolve_native", "base STRING, href STRING", "STRING", _resolve_native()),
        (
            "resolve_url", "base STRING, href STRING", "STRING",
            "coalesce(_resolve_native(base, href), "
            "_url_join(base, CASE WHEN _resolve_native(base, href) IS NULL THEN href END))",
        ),
        ("html_to_text", "html STRING", "STRING", _html_to_text()),
        ("_known_charset", "body BINARY", "STRING", _known_charset()),
        (
            "detect_charset", "body BINARY", "STRING",
            "coalesce(_known_charset(body), _guess_charset(CASE WHEN _known_charset(body) IS NULL THEN body END))",
        ),
        ("_is_utf8", "body BINARY, declared STRING", "BOOLEAN", _is_utf8()),
        (
            "decode_body", "body BINARY, declared STRING", "STRING",
            f"CASE WHEN {utf8} THEN CAST(body AS STRING) ELSE _decode_body(CASE WHEN NOT {utf8} THEN body END, "
            f"CASE WHEN NOT {utf8} THEN declared END, detect_charset(body)) END",
        ),
        ("is_public_ip", "ip STRING", "BOOLEAN", _is_public_ip()),
        (
            "is_public_host", "host STRING", "BOOLEAN",
            f"CASE WHEN host IS NULL THEN true WHEN host IN ({_listed(nets.LOCAL_NAMES)}) THEN false "
            "ELSE is_public_ip(host) END",
        ),
    ]


def register(spark: SparkSession) -> None:
    """Make ``resolve_url(base, href)``, ``html_to_text(html)``, ``html_to_text_parsed(html)``,
    ``detect_charset(body)``, ``decode_body(body, declared)``, ``is_public_ip(ip)``,
    ``is_public_host(host)`` and the table function ``html_links(html)`` callable from SQL."""
    spark.udf.register("_url_join", urls.url_join)
    spark.udf.register("_guess_charset", charset.guess_charset)
    spark.udf.register("_decode_body", charset.decode_bytes)
    spark.udf.register("_is_public_ip", nets.is_public_ip)
    spark.udf.register("html_to_text_parsed", html.html_to_text_parsed)
    spark.udtf.register("html_links", html.HtmlLinks)
    for name, arguments, result, body in functions():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
