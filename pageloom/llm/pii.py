"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Native expressions only. A validated value is permuted, under a key, within the set
of valid values of its format: equal values get equal pseudonyms wherever they occur,
different values different ones, and the text keeps its layout. The permutation is a
Feistel network over a pair (a, b) with 0 <= a < m, 0 <= b < n: in turn a gets
a + h(b) mod m and b gets b + h(a) mod n, h from SHA-256 with the key. Each round is
undone by subtraction, so it is a permutation for any m and n; the formats below are
cut into pairs that cover exactly their valid values, so nothing has to be retried.

========== ============================================= ===========================
kind       valid if                                      permuted
========== ============================================= ===========================
card       13 to 19 digits, bare or in groups joined     all but the last digit,
           by single blanks or hyphens, Luhn sum 0       which is set by the Luhn sum
iban       country, check digits and 11 to 30 signs,     signs after the check digits
           remainder 1 modulo 97                         by kind, check digits anew
ssn        3-2-4 digits, area not 000, 666 or 9xx, no    within such numbers
           zero group or serial
date       YYYY-MM-DD, YYYY/MM/DD, DD.MM.YYYY,           day within its 400-year
           DD/MM/YYYY that exist                         cycle of 146,097 days
phone      international + or (ddd) ddd-dddd forms of    digits after the country
           8 to 15 digits                                code
ipv4       four numbers up to 255                        all 32 bits
email      local part, @, domain with a dot              letters, digits of all but
                                                         the last label, by kind
========== ============================================= ===========================

Other digits and all other text stay as they are. A null text stays null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import free_name

KEY = "pageloom-demo-key"
ROUNDS = 8

# No value starts or ends inside a word or a longer number.
EMAIL = r"[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]++\.)+[A-Za-z]{2,24}"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}"
IPV4 = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
PHONE = r"\+[0-9]{1,3}[ .\-]?\(?[0-9]{1,4}\)?(?:[ .\-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}"
CARD = r"[0-9](?:[ \-]?[0-9]){12,18}"
EDGE = r"A-Za-z0-9_"
# Lengths of the countries' IBANs without blanks; others are tried as they stand.
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}
IBAN_FIXED = "|".join(
    rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_SIZES.items()
)
EMAILS = rf"(?<![{EDGE}.@%+\-])(?:{EMAIL})(?![{EDGE}])"
# Places where a value other than an address may start. Readings of one place are tried
# in turn, so what stands beside a value can't hide it.
START = (
    rf"(?<![{EDGE}])(?=[+(][0-9]|[A-Z]{{2}}[0-9]{{2}}|[0-9]{{1,3}}\.[0-9]|[0-9]{{3}}-|[0-9]{{2}}[/.]|[0-9]{{4}}[/-]"
    rf"|{CARD.split(',')[0]}}})"
)
CARD_LIKE = r"[0-9]{13,19}|[0-9]{4}(?:([ \-])[0-9]{4})(?:\1[0-9]{4}){2}|[0-9]{4}([ \-])[0-9]{6}\2[0-9]{5}"
_CARD_END = rf"(?![{EDGE}]|\.[0-9])"
# (pattern with the sign before, its end): the first reading that is valid counts.
READINGS = [
    rf"^[^{EDGE}]({IBAN_FIXED})(?![{EDGE}])",
    rf"^[^{EDGE}]({IBAN})(?![{EDGE}])",
    rf"^[^{EDGE}.]({IPV4})(?![{EDGE}]|\.[0-9])",
    rf"^[^{EDGE}/.\-]({DATE})(?![{EDGE}]|[/.\-][0-9])",
    rf"^[^{EDGE}\-]({SSN})(?![{EDGE}]|-[0-9])",
    *[rf"^[^{EDGE}+]({p})(?![{EDGE}]|[.\-][0-9])" for p in (PHONE, PHONE.replace("{2,4}|", "{3}|"), PHONE.replace("{2,4}|", "{2}|"))],
    rf"^[^{EDGE}]({CARD_LIKE}){_CARD_END}",
    *[rf"^[^{EDGE}]([0-9](?:[ \-]?[0-9]){{{n - 1}}}){_CARD_END}" for n in range(19, 12, -1)],
]
WINDOW = 80  # signs that hold any reading and its end; an IBAN has up to 67


def _hash(key: Column, *parts: Column) -> Column:
    """60 bits of SHA-256 as a long."""
    text = F.concat_ws("|", key, *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, m: Column, n: Column, key: Column, label: Column) -> Column:
    """Struct (a, b): the keyed permutation of the pairs below (m, n). m, n < 2**31."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def two(acc: Column, i: Column) -> Column:
        # b is needed in its old form only; each half round is one struct.
        left = F.struct(
            F.pmod(acc["a"] + F.pmod(_hash(key, label, F.lit("a"), i, acc["b"]), m), m).alias("a"),
            acc["b"].alias("b"),
        )
        return F.transform(
            F.array(left),
            lambda s: F.struct(
                s["a"].alias("a"),
                F.pmod(s["b"] + F.pmod(_hash(key, label, F.lit("b"), i, s["a"]), n), n).alias("b"),
            ),
        )[0]

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, two)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Work ``value`` out once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def permute_digits(digits: Column, key: Column, label: Column) -> Column:
    """A string of 2 to 18 digits, permuted among those of its length; one digit is
    permuted alone, longer strings in pieces of 18 from the left, chained by label."""

    def power(k: Column) -> Column:
        return F.rpad(F.lit("1"), (k + 1).cast("int"), "0").cast("long")

    def piece(d: Column, tag: Column) -> Column:
        size = F.length(d)
        left = (size / 2).cast("int")
        right = size - left
        mixed = feistel(
            F.when(left > 0, F.substring(d, F.lit(1), left).cast("long")).otherwise(F.lit(0)),
            F.substring(d, left + 1, right).cast("long"),
            power(left),
            power(right),
            key,
            F.concat_ws(":", tag, size),
        )
        return _let(
            mixed,
            lambda s: F.concat(
                F.when(left > 0, F.lpad(s["a"].cast("string"), left, "0")).otherwise(""),
                F.lpad(s["b"].cast("string"), right, "0"),
            ),
        )

    def joined(whole: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), (F.length(whole) / 18).cast("int")), lambda i: i * 18 < F.length(whole))
        return F.array_join(
            F.transform(
                starts,
                lambda i: _let(
                    F.substring(whole, i * 18 + 1, F.lit(18)), lambda d: piece(d, F.concat_ws("/", label, i))
                ),
            ),
            "",
        )

    return _let(digits, joined)


def permute_letters(letters: Column, key: Column, label: Column) -> Column:
    """A string of a-z, permuted among those of its length, in pieces of up to 10."""

    def value(part: Column) -> Column:
        return F.aggregate(
            F.split(part, ""), F.lit(0).cast("long"), lambda v, c: v * 26 + (F.ascii(c) - 97)
        )

    def text(number: Column, size: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), size),
            F.struct(number.alias("v"), F.lit("").alias("t")),
            lambda acc, _: F.struct(
                F.floor(acc["v"] / 26).cast("long").alias("v"),
                F.concat(F.chr(acc["v"] % 26 + 97), acc["t"]).alias("t"),
            ),
        )["t"]

    def power(k: Column) -> Column:
        return F.aggregate(F.array_repeat(F.lit(26).cast("long"), k), F.lit(1).cast("long"), lambda a, b: a * b)

    def piece(d: Column, tag: Column) -> Column:
        size = F.length(d)
        left = (size / 2).cast("int")
        right = size - left
        mixed = feistel(
            F.when(left > 0, value(F.substring(d, F.lit(1), left))).otherwise(F.lit(0)),
            value(F.substring(d, left + 1, right)),
            power(left),
            power(right),
            key,
            F.concat_ws(":", tag, size),
        )
        return _let(
            mixed,
            lambda s: F.concat(
                F.when(left > 0, text(s["a"], left)).otherwise(""), text(s["b"], right)
            ),
        )

    def joined(whole: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), (F.length(whole) / 10).cast("int")), lambda i: i * 10 < F.length(whole))
        return F.array_join(
            F.transform(
                starts,
                lambda i: _let(
                    F.substring(whole, i * 10 + 1, F.lit(10)), lambda d: piece(d, F.concat_ws("/", label, i))
                ),
            ),
            "",
        )

    return _let(letters, joined)


def _refill(shape: Column, signs: str, values: Column) -> Column:
    """``shape`` with its characters of the class ``signs`` replaced by those of
    ``values`` in turn; letters keep the case they had."""
    def fill(given: Column) -> Column:
        return F.aggregate(
            F.split(shape, ""),
            F.struct(F.lit("").alias("t"), F.lit(0).alias("k")),
            lambda acc, c: F.when(
                c.rlike(f"^{signs}$"),
                _let(
                    F.substring(given, acc["k"] + 1, F.lit(1)),
                    lambda v: F.struct(
                        F.concat(acc["t"], F.when(c.rlike("^[A-Z]$"), F.upper(v)).otherwise(v)).alias("t"),
                        (acc["k"] + 1).alias("k"),
                    ),
                ),
            ).otherwise(F.struct(F.concat(acc["t"], c).alias("t"), acc["k"].alias("k"))),
        )["t"]

    # Bound once: inside the loop it would be worked out for every character.
    return _let(values, fill)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn test over a digit string, its last digit counted once."""
    return F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc
        + _let(
            F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
            lambda d: F.when(d > 9, d - 9).otherwise(d),
        ),
    )


def mod97(signs: Column) -> Column:
    """An upper-case letter and digit string, letters read as 10 to 35, modulo 97."""
    return F.aggregate(
        F.split(signs, ""),
        F.lit(0),
        lambda acc, c: F.when(
            c.rlike("^[0-9]$"), (acc * 10 + F.ascii(c) - 48) % 97
        ).otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )


def _valid_ip(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda o: o.cast("int") <= 255)


def _date(value: Column) -> Column:
    """The date, or null if there is no such day. Years before 1600 do not count."""
    iso = F.when(
        value.rlike("^[0-9]{4}"), F.concat_ws("-", F.substring(value, 1, 4), F.substring(value, 6, 2), F.substring(value, 9, 2))
    ).otherwise(
        F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 4, 2), F.substring(value, 1, 2))
    )
    found = F.try_to_date(iso, "yyyy-MM-dd")
    return F.when(F.substring(iso, 1, 4) >= "1600", found)


def kind_of(value: Column) -> Column:
    """The kind of a reading, or null if it is not a valid value."""
    compact = F.regexp_replace(value, "[ ]", "")
    card = _digits(value)
    return (
        F.when(value.contains("@"), "email")
        .when(
            value.rlike("^[A-Z]{2}"),
            F.when(
                mod97(F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))) == 1,
                "iban",
            ),
        )
        .when(value.rlike(f"^(?:{DATE})$"), F.when(_date(value).isNotNull(), "date"))
        .when(value.rlike(f"^(?:{IPV4})$"), F.when(_valid_ip(value), "ipv4"))
        .when(
            value.rlike(f"^(?:{SSN})$"),
            F.when(value.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), "ssn"),
        )
        .when(
            value.rlike(f"^(?:{PHONE})$"), F.when(F.length(card).between(8, 15), "phone")
        )
        .when(
            F.length(card).between(13, 19) & value.rlike(f"^(?:{CARD})$"),
            F.when((luhn_sum(card) % 10 == 0) & (~card.rlike("^0+$")), "card"),
        )
    )


def _card(value: Column, key: Column) -> Column:
    digits = _digits(value)
    body = permute_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, F.lit("card"))
    checked = _let(
        body,
        lambda d: F.concat(
            d, F.pmod(-luhn_sum(F.concat(d, F.lit("0"))), F.lit(10)).cast("string")
        ),
    )
    return _let(checked, lambda d: _refill(value, "[0-9]", d))


def _phone(value: Column, key: Column) -> Column:
    country = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(\-])", 0)
    rest = F.substring(value, F.length(country) + 1, F.length(value))
    return F.concat(
        country, _refill(rest, "[0-9]", permute_digits(_digits(rest), key, F.lit("phone")))
    )


def _ipv4(value: Column, key: Column) -> Column:
    o = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    mixed = feistel(
        o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, F.lit("ipv4")
    )
    return _let(
        mixed,
        lambda s: F.concat_ws(
            ".", F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256
        ),
    )


def _ssn(value: Column, key: Column) -> Column:
    p = F.split(value, "-")
    area = p[0].cast("long")
    # 898 areas: 1 to 899 without 666. 99 groups times 9,999 serials.
    a = F.when(area > 666, area - 2).otherwise(area - 1)
    b = (p[1].cast("long") - 1) * 9999 + p[2].cast("long") - 1
    mixed = feistel(a, b, F.lit(898), F.lit(99 * 9999), key, F.lit("ssn"))
    return _let(
        mixed,
        lambda s: F.concat_ws(
            "-",
            F.lpad(F.when(s["a"] >= 665, s["a"] + 2).otherwise(s["a"] + 1).cast("string"), 3, "0"),
            F.lpad((F.floor(s["b"] / 9999) + 1).cast("string"), 2, "0"),
            F.lpad((s["b"] % 9999 + 1).cast("string"), 4, "0"),
        ),
    )


def _shifted_date(value: Column, key: Column) -> Column:
    # 146,097 days = 189 * 773, counted from 1600-01-01.
    day = F.datediff(_date(value), F.lit("1600-01-01").cast("date"))
    cycle = F.floor(day / 146097)
    inner = day % 146097
    mixed = feistel(
        F.floor(inner / 773), inner % 773, F.lit(189), F.lit(773), key, F.concat_ws(":", F.lit("date"), cycle)
    )
    moved = _let(
        mixed,
        lambda s: F.date_add(
            F.lit("1600-01-01").cast("date"),
            (cycle * 146097 + s["a"] * 773 + s["b"]).cast("int"),
        ),
    )
    return _let(
        moved,
        lambda d: F.when(value.rlike("^[0-9]{4}-"), F.date_format(d, "yyyy-MM-dd"))
        .when(value.rlike("^[0-9]{4}/"), F.date_format(d, "yyyy/MM/dd"))
        .when(value.contains("."), F.date_format(d, "dd.MM.yyyy"))
        .otherwise(F.date_format(d, "dd/MM/yyyy")),
    )


def _by_kind(shape: Column, key: Column, label: str) -> Column:
    """Digits permuted among digits, letters among letters."""
    digits = permute_digits(_digits(shape), key, F.lit(label))
    letters = permute_letters(F.lower(F.regexp_replace(shape, "[^A-Za-z]", "")), key, F.lit(label))
    return _refill(_refill(shape, "[0-9]", digits), "[A-Za-z]", letters)


def _email(value: Column, key: Column) -> Column:
    last = F.regexp_extract(value, r"\.[A-Za-z]+$", 0)
    # Case does not tell addresses apart.
    return F.concat(
        _by_kind(F.substring(value, F.lit(1), F.length(value) - F.length(last)), key, "email"), last
    )


def _iban(value: Column, key: Column) -> Column:
    country = F.substring(value, 1, 2)
    rest = F.regexp_replace(F.substring(value, F.lit(5), F.length(value)), " ", "")
    body = _by_kind(rest, key, "iban")
    return _let(
        body,
        lambda b: _refill(
            F.concat(F.lit("##"), F.substring(value, F.lit(3), F.length(value))),
            "[#A-Z0-9]",
            F.concat(
                country,
                F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"),
                b,
            ),
        ),
    )


def pseudonym(value: Column, kind: Column, key: Column) -> Column:
    """The pseudonym of a value of the kind; the value itself if the kind is null."""
    return (
        F.when(kind == "card", _card(value, key))
        .when(kind == "iban", _iban(value, key))
        .when(kind == "ssn", _ssn(value, key))
        .when(kind == "date", _shifted_date(value, key))
        .when(kind == "phone", _phone(value, key))
        .when(kind == "ipv4", _ipv4(value, key))
        .when(kind == "email", _email(value, key))
        .otherwise(value)
    )


def _readings(text: Column) -> Column:
    """Valid values of a text without addresses, in order of place, overlaps included:
    structs (at, stop, value, kind, weak)."""
    places = F.split(text, START, -1)

    def first(pieces: Column) -> Column:
        ends = F.aggregate(
            pieces,
            F.array(F.lit(0)),
            lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))),
        )
        return _let(ends, lambda at: F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: F.get(at, i)))

    def read(at: Column) -> Column:
        # One sign before the place, a blank at the beginning.
        part = F.when(at > 0, F.substring(text, at, F.lit(WINDOW + 1))).otherwise(
            F.concat(F.lit(" "), F.substring(text, F.lit(1), F.lit(WINDOW)))
        )
        return _let(
            part,
            lambda w: F.get(
                F.filter(
                    F.transform(
                        F.filter(
                            F.array(*[F.regexp_extract(w, p, 1) for p in READINGS]), lambda v: v != ""
                        ),
                        lambda v: F.struct(
                            at.alias("at"), (at + F.length(v)).alias("stop"), v.alias("value"), kind_of(v).alias("kind")
                        ),
                    ),
                    lambda r: r["kind"].isNotNull(),
                ),
                F.lit(0),
            ),
        )

    return F.filter(F.transform(_let(places, first), read), lambda r: r.isNotNull())


def _chosen(readings: Column) -> Column:
    """Readings without overlaps, from the left; a card in unusual groups, which may be
    one by chance, gives way to any other value."""

    def weak(r: Column) -> Column:
        return (r["kind"] == "card") & ~r["value"].rlike(f"^(?:{CARD_LIKE})$")

    def walk(every: Column) -> Column:
        good = F.filter(
            every,
            lambda r: ~weak(r)
            | ~F.exists(every, lambda o: ~weak(o) & (o["at"] < r["stop"]) & (r["at"] < o["stop"])),
        )
        kind = "array<struct<at: int, stop: int, value: string, kind: string>>"
        return F.aggregate(
            good,
            F.array().cast(kind),
            lambda acc, r: F.when(
                (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1))["stop"], F.lit(0)) > r["at"]), acc
            ).otherwise(F.concat(acc, F.array(r))),
        )

    return _let(readings, walk)


def _cut(text: Column) -> Column:
    """The text as structs (between, value, kind): each value with what precedes it, and
    the rest with an empty value."""

    def parts(values: Column) -> Column:
        n = F.size(values)
        return F.transform(
            F.sequence(F.lit(0), n),
            lambda i: _let(
                F.coalesce(F.when(i > 0, F.get(values, i - 1)["stop"]), F.lit(0)),
                lambda start: F.struct(
                    F.substring(
                        text, start + 1, F.coalesce(F.get(values, i)["at"], F.length(text)) - start
                    ).alias("between"),
                    F.coalesce(F.get(values, i)["value"], F.lit("")).alias("value"),
                    F.get(values, i)["kind"].alias("kind"),
                ),
            ),
        )

    return _let(_chosen(_readings(text)), parts)


def found(text: Column) -> Column:
    """The text in order as structs (between, value, kind); kind is null where there is
    no value."""
    return F.flatten(
        F.transform(
            F.arrays_zip(
                F.split(text, EMAILS, -1).alias("b"), F.regexp_extract_all(text, F.lit(EMAILS), F.lit(0)).alias("v")
            ),
            lambda p: F.concat(
                _let(p["b"], _cut),
                F.when(
                    p["v"].isNotNull(),
                    F.array(F.struct(F.lit("").alias("between"), p["v"].alias("value"), F.lit("email").alias("kind"))),
                ).otherwise(F.array().cast("array<struct<between: string, value: string, kind: string>>")),
            ),
        )
    )


def pseudonymise(
    docs: DataFrame, key: str = KEY, text: str = "text", found_name: str = "pii_found"
) -> DataFrame:
    """``docs`` with ``text`` rewritten, and the kinds replaced, in order of place, in
    ``found_name`` (array; empty for clean and null texts; with a leading underscore if
    ``docs`` has that name already)."""
    found_name = free_name(docs, found_name)
    secret = F.lit(key)
    parts, hits = free_name(docs, "pii_parts"), free_name(docs, "pii_hits")
    # Texts without a possible start need no search; most have none.
    likely = F.col(text).rlike(f"@|{START}")
    marked = docs.withColumn(hits, F.when(likely, found(F.col(text))))
    some = F.exists(hits, lambda h: h["kind"].isNotNull())
    marked = marked.withColumn(
        parts,
        F.when(
            some,
            F.transform(hits, lambda h: F.concat(h["between"], pseudonym(h["value"], h["kind"], secret))),
        ),
    )
    joined = F.array_join(parts, "")
    kinds = F.when(
        some, F.transform(F.filter(hits, lambda h: h["kind"].isNotNull()), lambda h: h["kind"])
    ).otherwise(F.array().cast("array<string>"))
    return marked.select(
        *[
            F.when(F.col(parts).isNotNull(), joined).otherwise(F.col(text)).alias(text)
            if c == text
            else F.col(c)
            for c in docs.columns
        ],
        kinds.alias(found_name),
    )
