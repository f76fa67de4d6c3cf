"""HTML to text and links.

Two paths. The default is a Python UDF over the standard library's tokenizer with an
open-element stack: right on real markup. The native one, for the asking, is regular
expressions inside the JVM; it reads well-formed pages alike and differs on unclosed or
nested dropped elements and on ``>`` inside attribute values.

The UDFs take pages a hundred at a time, as rows: an Arrow batch holds thousands of pages
(up to 64 MB), which a worker would have as columns, as strings and as results at once.
"""

from __future__ import annotations

from html import unescape
from html.entities import html5
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from pageloom.functions.text import normalize_ws, strip_ws

# Elements whose text is not content, elements whose body is not
# markup, elements without an end tag, elements whose text a tree's plain text
# leaves out, and frequent references, which the native path looks up first.
DROPPED = ("script", "style", "noscript", "header", "footer", "nav")
RAW_TEXT = ("script", "style")
VOID = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
UNPRINTED = frozenset(("template", "rt", "rp"))
ENTITIES = {
    "amp": "&",
    "nbsp": "\u00a0",
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "copy": "©",
    "reg": "®",
    "trade": "™",
    "middot": "·",
    "bull": "•",
    "ndash": "–",
    "mdash": "—",
    "hellip": "…",
    "lsquo": "‘",
    "rsquo": "’",
    "ldquo": "“",
    "rdquo": "”",
    "laquo": "«",
    "raquo": "»",
    "euro": "€",
    "pound": "£",
    "sect": "§",
    "deg": "°",
    "times": "×",
    "rarr": "→",
    "larr": "←",
}
# All other references; of those that need no semicolon the name counts as well.
ALL_ENTITIES = {name.rstrip(";"): char for name, char in html5.items() if name.endswith(";")}
# The signs that numeric references from 128 to 159 mean.
CONTROLS = bytes(range(128, 160)).decode("windows-1252", "replace")
# Attributes are passed over one by one, so that an href inside another one's value does
# not count; possessive, so that a page without an end of the tag costs no retries.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
HREF = (
    rf"""(?i)<a(?:[\s/]++(?!href[\s=/>])[^\s/>=<"']++(?:\s*+=\s*+{_VALUE})?+)*+[\s/]++href"""
    r"""(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)|(?=[\s/>]))"""
)
NAMED = "^([A-Za-z][-.A-Za-z0-9]*);?"
NUMBERED = "^#([0-9]+|[xX][0-9A-Fa-f]+);?"
QUOTES = r"""^["']|["']$"""


def _elements(tags: tuple[str, ...]) -> str:
    """Comments, and the named elements with all they hold, after their ``<``. What is not
    closed reaches to the end of the text, so no part of the text is searched twice."""
    return rf"!--.*?(?:-->|\z)|({'|'.join(tags)})(?=[\s/>])[^>]*+(?:>.*?(?:</\1\s*+>|\z)|\z)"


def markup(tags: tuple[str, ...]) -> str:
    """Comments, the named elements and all tags."""
    return rf"(?is)<(?:{_elements(tags)}|[/!?a-z][^>]*+(?:>|\z))"


def strip_elements(c: Column, tags: tuple[str, ...] = DROPPED) -> Column:
    """Blank out comments and the named elements with all they hold.

    One alternation meets comments and elements in document order. An element
    without an end tag reaches to the end of the text.
    """
    return F.regexp_replace(c, f"(?is)<(?:{_elements(tags)})", " ")


def _decode_one(part: Column) -> Column:
    """What follows an ampersand, with the reference it starts with decoded."""
    listed = "\n".join(f"{name}\t{char}" for name, char in ENTITIES.items())
    names = F.str_to_map(F.lit(listed), F.lit("\n"), F.lit("\t"))
    name = F.regexp_extract(part, NAMED, 1)
    every = "\x01".join(f"{n}\x02{char}" for n, char in ALL_ENTITIES.items())
    rare = F.str_to_map(F.lit(every), F.lit("\x01"), F.lit("\x02"))
    known = F.coalesce(
        F.try_element_at(names, name), F.try_element_at(rare, name), F.concat(F.lit("&"), name)
    )
    digits = F.regexp_extract(part, NUMBERED, 1)
    code = F.when(
        F.lower(digits).startswith("x"), F.conv(F.substr(digits, F.lit(2)), 16, 10)
    ).otherwise(digits)
    code = code.try_cast("int")
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    char = F.when(
        # Numbers of control characters mean the windows-1252 sign there.
        code.between(128, 159), F.substring(F.lit(CONTROLS), code - 127, F.lit(1))
    ).when(
        valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    ).otherwise("\ufffd")
    return (
        F.when(part.startswith("amp;"), F.concat(F.lit("&"), F.substr(part, F.lit(5))))
        .when(part.startswith("#") & part.rlike(NUMBERED), F.concat(char, F.regexp_replace(part, NUMBERED, "")))
        .otherwise(F.concat(known, F.regexp_replace(part, NAMED, "")))
    )


def decode_entities(c: Column) -> Column:
    """Decode numeric and named references.

    The text is split at ampersands, so each piece is looked at once and nothing
    is decoded twice. A reference may lack its semicolon; an unknown name keeps
    its ampersand and loses the semicolon.
    """
    parts = F.split(c, "&")
    rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), _decode_one)
    return F.array_join(F.concat(F.slice(parts, 1, 1), rest), "")


def html_to_text(c: Column, tags: tuple[str, ...] = DROPPED) -> Column:
    """Visible text with single blanks, inside the JVM. Comments, dropped elements
    and tags go in one pass."""
    bare = F.regexp_replace(c, markup(tags), " ")
    return normalize_ws(decode_entities(bare))


def link_values(c: Column) -> Column:
    """Array of distinct decoded and trimmed ``href`` values of the page's anchors.

    Links in navigation and footers count; those in comments, scripts and
    styles do not.
    """
    found = F.regexp_extract_all(strip_elements(c, RAW_TEXT), F.lit(HREF), F.lit(1))
    unquoted = F.transform(
        found,
        lambda v: strip_ws(decode_entities(F.regexp_replace(v, QUOTES, ""))),
    )
    return F.array_distinct(unquoted)


def _charref(digits: str) -> str:
    try:
        code = int(digits[1:], 16) if digits[:1] in "xX" else int(digits)
        if 127 < code < 160:
            return bytes([code]).decode("windows-1252")
        return "�" if code == 0 or 0xD800 <= code < 0xE000 else chr(code)
    except (ValueError, OverflowError):
        return "�"


class _Page(HTMLParser):
    """Collects text nodes outside dropped elements, and anchor targets."""

    def __init__(self, dropped):
        super().__init__(convert_charrefs=False)
        self.hidden = frozenset(dropped) | UNPRINTED
        self.stack, self.node, self.texts, self.hrefs = [], [], [], []
        self.depth = 0

    def end_node(self):
        text = " ".join("".join(self.node).split())
        if text:
            self.texts.append(text)
        self.node.clear()

    def handle_starttag(self, tag, attrs):
        self.end_node()
        if tag == "a":
            values = [v for k, v in attrs if k == "href"]
            if values:
                self.hrefs.append((values[-1] or "").strip())
        if tag not in VOID:
            self.stack.append(tag)
            self.depth += tag in self.hidden

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.end_node()
        if tag in self.stack:
            while True:
                top = self.stack.pop()
                self.depth -= top in self.hidden
                if top == tag:
                    break

    def keep(self, data):
        if not self.depth:
            self.node.append(data)

    def handle_data(self, data):
        self.keep(data)

    def handle_charref(self, name):
        self.keep(_charref(name))

    def handle_entityref(self, name):
        self.keep(html5.get(name + ";", "&" + name))

    def handle_comment(self, data):
        self.end_node()

    handle_decl = handle_pi = unknown_decl = handle_comment


def _closable(html: str) -> tuple[str, str]:
    """The part in which tags and comments can end, and the rest.

    The tokenizer looks to the end of the page for each opened tag or comment; where no
    end can come this is decided once for all of them instead.
    """
    last = html.rfind(">") + 1
    body, rest = html[:last], html[last:]
    closed = body.rfind("-->") + 3 if "-->" in body else 0
    return body[:closed] + body[closed:].replace("<!--", "&lt;!--"), rest


def _parse(html: str, dropped=DROPPED) -> _Page:
    page = _Page(dropped)
    body, rest = _closable(html)
    page.feed(body)
    page.close()
    page.keep(unescape(rest))
    page.end_node()
    return page


@F.udf(StringType(), useArrow=False)
def html_to_text_parsed(html: str | None) -> str | None:
    """Visible text by tokenizing the page; slower, and exact on broken markup."""
    return None if html is None else " ".join(_parse(html).texts)


@F.udf(ArrayType(StringType()), useArrow=False)
def link_values_parsed(html: str | None) -> list[str] | None:
    """Anchor targets by tokenizing the page, distinct, in page order."""
    return None if html is None else list(dict.fromkeys(_parse(html).hrefs))


@F.udf(
    StructType([StructField("text", StringType()), StructField("hrefs", ArrayType(StringType()))]),
    useArrow=False,
)
def page_parsed(html: str | None) -> tuple[str | None, list[str] | None]:
    """Visible text and anchor targets from one pass over the page."""
    if html is None:
        return None, None
    page = _parse(html)
    return " ".join(page.texts), list(dict.fromkeys(page.hrefs))


def page_native(c: Column) -> Column:
    """The same by the native path."""
    return F.struct(html_to_text(c).alias("text"), link_values(c).alias("hrefs"))


@F.udtf(returnType=StructType([StructField("href", StringType())]), useArrow=True)
class HtmlLinks:
    """``SELECT href FROM pages, LATERAL html_links(html)``"""

    def eval(self, html: str):
        if html is not None:
            for href in dict.fromkeys(_parse(html).hrefs):
                yield (href,)
