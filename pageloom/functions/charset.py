"""Page bytes to text.

The UDFs take bodies a hundred at a time, as rows, not in Arrow batches of thousands.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Byte order marks by hex prefix, longest first, and the names
# under which a header may mean UTF-8.
BYTE_ORDER_MARKS = {
    "FFFE0000": "utf-32",
    "0000FEFF": "utf-32",
    "EFBBBF": "utf-8-sig",
    "FFFE": "utf-16",
    "FEFF": "utf-16",
}
UTF8_NAMES = ("utf-8", "utf8", "utf_8")
SURROGATE = re.compile("[\ud800-\udfff]")
META = r"""(?i)<meta[^>]*?charset\s*=\s*["']?\s*([A-Za-z0-9._:-]+)"""


# Character sets that undeclared pages are tried in, the likelier first, and
# the lead bytes of the everyday characters of the double-byte ones.
SINGLE_BYTE = ("windows-1252", "windows-1251", "koi8-r", "windows-1250", "iso-8859-2")
EVERYDAY = {
    "shift_jis": ((0x82, 0x83), (0x88, 0x97)),
    "euc-jp": ((0xA4, 0xA5), (0xB0, 0xCF)),
    "euc-kr": ((0xB0, 0xC8),),
    "gbk": ((0xB0, 0xD7),),
    "big5": ((0xA4, 0xC6),),
}
# Letters that stand for commoner ones of another set, if they are many.
SELDOM = "\u013a\u013e\u0155\u0139\u013d\u0154"
# Signs that stand beside words like any punctuation.
QUOTED = "\u00a0\u00a1\u00a7\u00ab\u00ad\u00b0\u00b7\u00bb\u00bf\u2013\u2014\u2018\u2019\u201a\u201c\u201d\u201e\u2022\u2026\u20ac\u2116\u2122\u00a9\u00ae"

_NONE, _BREAK, _ASCII_LOWER, _ASCII_UPPER, _LOWER, _UPPER, _CYRILLIC_LOWER, _CYRILLIC_UPPER, _SIGN = range(9)


def _kind(char: str, high: bool) -> int:
    if char == "\ufffd" or unicodedata.category(char) == "Cc" and high:
        return _NONE
    if not char.isalpha():
        return _SIGN if high and char not in QUOTED else _BREAK
    upper = char.isupper()
    if "CYRILLIC" in unicodedata.name(char, ""):
        return _CYRILLIC_UPPER if upper else _CYRILLIC_LOWER
    if high:
        return _UPPER if upper else _LOWER
    return _ASCII_UPPER if upper else _ASCII_LOWER


def _pair(a: int, b: int) -> float:
    """How well one kind of character follows another, from -4 to 1."""
    if _NONE in (a, b):
        return -4.0
    if _SIGN in (a, b):
        return -0.3 if _BREAK in (a, b) else -1.0
    if _BREAK in (a, b):
        return 0.3
    cyrillic = (_CYRILLIC_LOWER, _CYRILLIC_UPPER)
    if (a in cyrillic) != (b in cyrillic):
        return -2.0  # two scripts in a word
    lower = (_ASCII_LOWER, _LOWER, _CYRILLIC_LOWER)
    if a in lower and b not in lower:
        return -2.0
    case = 0.3 if a not in lower and b not in lower else 1.0
    # Letters beyond ASCII seldom meet in Latin scripts.
    return case - (1.2 if a in (_LOWER, _UPPER) and b in (_LOWER, _UPPER) else 0.0)


@lru_cache
def _pair_scores() -> np.ndarray:
    """For each single-byte set a score of every pair of bytes, zero for two of ASCII."""
    table = np.array([[_pair(a, b) for b in range(9)] for a in range(9)])
    out = []
    for name in SINGLE_BYTE:
        chars = bytes(range(256)).decode(name, "replace")
        kinds = np.array([_kind(c, i > 127) for i, c in enumerate(chars)])
        seldom = np.array([c in SELDOM for c in chars])
        scores = table[kinds[:, None], kinds[None, :]] - 0.2 * (seldom[:, None] | seldom[None, :])
        scores[:128, :128] = 0
        out.append(scores.ravel())
    return np.array(out)


@lru_cache
def _everyday(name: str) -> np.ndarray:
    """Whether a character of the basic plane is an everyday one of the double-byte set."""
    out = np.zeros(1 << 16, bool)
    for first, last in EVERYDAY[name]:
        for lead in range(first, last + 1):
            for char in b"".join(bytes((lead, trail)) for trail in range(0x40, 0xFF)).decode(name, "ignore"):
                out[ord(char) & 0xFFFF] |= ord(char) > 127
    return out


def _likeliest(body: bytes) -> str:
    """The set in which the whole body reads best. Pairs of bytes are counted once and
    scored for each single-byte set; a double-byte set has to fit without an error, but for
    a cut last character, and is judged by its share of everyday characters."""
    data = np.frombuffer(body, np.uint8).astype(np.int64)
    pairs = np.bincount(np.append(data[:-1], data[-1:]) * 256 + np.append(data[1:], 32), minlength=1 << 16)
    weight = pairs.reshape(256, 256)
    seen = max(1, weight.sum() - weight[:128, :128].sum())
    scores = {name: s for name, s in zip(SINGLE_BYTE, _pair_scores() @ pairs / seen)}
    for name in EVERYDAY:
        try:
            text = body.decode(name)
        except UnicodeDecodeError as error:
            if error.start < len(body) - 2:
                continue
            text = body[: error.start].decode(name)
        codes = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
        codes = codes[codes > 127]
        # Marks and wide forms are shared by all of them.
        codes = codes[~(((codes >= 0x3000) & (codes < 0x3040)) | (codes >= 0xFF00) & (codes < 0xFF60))]
        if len(codes):
            good = _everyday(name)[codes].mean()
            scores[name] = good - (2 if name == "euc-kr" else 1) * (1 - good)
    return max(scores, key=lambda name: (round(scores[name], 6), -list(scores).index(name)))


@F.udf(StringType(), useArrow=False)
def guess_charset(body: bytes | None) -> str | None:
    """The likeliest character set of a body that declares none and is no UTF-8."""
    return None if body is None else _likeliest(bytes(body))


def detect_charset(body: Column) -> Column:
    """Byte order mark, else the first ``<meta charset>`` wherever it is, else utf-8 when
    the bytes are valid, else the likeliest of the sets in ``SINGLE_BYTE`` and ``EVERYDAY``
    by all bytes. Only bodies that need a guess reach the Python worker."""
    start = F.hex(F.substring(body, 1, 4))
    name = F.when(F.lit(False), F.lit(""))
    for mark, charset in BYTE_ORDER_MARKS.items():
        name = name.when(start.startswith(mark), charset)
    page = F.make_valid_utf8(body.cast("string"))
    meta = F.lower(F.regexp_extract(page, META, 1))
    known = name.when(meta != "", meta).when(F.is_valid_utf8(body.cast("string")), "utf-8")
    return F.coalesce(known, guess_charset(F.when(known.isNull(), body)))


def _decode(body: bytes, *names: str | None) -> str:
    for name in names:
        try:
            if name:
                # Some codecs yield half of a surrogate pair, which is no text.
                return SURROGATE.sub("\ufffd", body.decode(name, errors="replace"))
        except (LookupError, ValueError):
            continue
    return body.decode("utf-8", errors="replace")


@F.udf(StringType(), useArrow=False)
def decode_bytes(body: bytes | None, declared: str | None, detected: str | None) -> str | None:
    """Decode by the declared name, or by the detected one if Python does not
    know the former. Bytes that do not fit become U+FFFD."""
    return None if body is None else _decode(body, declared, detected)


def decode_body(body: Column, declared: Column) -> Column:
    """Text of a page body. Valid UTF-8 stays in the JVM and sends only NULLs to
    the Python worker."""
    detected = detect_charset(body)
    chosen = F.coalesce(F.nullif(F.lower(declared), F.lit("")), detected)
    native = chosen.isin(*UTF8_NAMES) & F.is_valid_utf8(body.cast("string"))
    rest = decode_bytes(F.when(~native, body), F.when(~native, declared), detected)
    return F.when(native, body.cast("string")).otherwise(rest)
