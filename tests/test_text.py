import random
import time

import pytest
from pyspark.sql import functions as F

from pageloom.functions import charset, html, retry, sql, text
from pageloom.operators import chunks, links
from pageloom.plans.corpus import pages_to_chunks


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]


def test_chunks(spark):
    def cut(values, n):
        return column(spark, values, lambda c: text.chunk_array(c, n))

    assert cut(["abcde", "", "ab\ncd", "h😀llo"], 2) == [
        ["ab", "cd", "e"], [], ["ab", "\nc", "d"], ["h😀", "ll", "o"],
    ]
    assert cut(["abc", ""], None) == [["abc"], []]
    assert cut(["ab cd"], 3) == [["ab ", "cd"]]


def test_chunk_properties(spark):
    rng = random.Random(7)
    values = [
        "".join(rng.choice("ab \n\té😀 ") for _ in range(rng.randrange(400)))
        for _ in range(60)
    ]
    for width in (1, 7, 64):
        for value, parts in zip(
            values, column(spark, values, lambda c: text.chunk_array(c, width))
        ):
            assert parts == [value[i : i + width] for i in range(0, len(value), width)]


def test_normalize_ws_equals_split_join(spark):
    blanks = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    values = ["x".join(blanks), "".join(blanks), " a  b ", ""]
    assert column(spark, values, text.normalize_ws) == [" ".join(v.split()) for v in values]
    assert column(spark, values, text.strip_ws) == [v.strip() for v in values]


def test_sanitize_cell(spark):
    values = ["=1", "+1", "-1", "@x", "\tx", "\rx", "a=1", "", None, " =1"]
    assert column(spark, values, text.sanitize_cell) == [
        "'=1", "'+1", "'-1", "'@x", "'\tx", "'\rx", "a=1", "", None, " =1",
    ]


HTML = [
    # page, parsed text, native text
    ("<title>T</title><nav>n</nav><p>a<b>b</b></p>", "T a b", "T a b"),
    ("<p>a&amp;b</p>", "a&b", "a&b"),
    ("<p>a<!-- x -->b</p>", "a b", "a b"),
    ('<script>var t="</p>";</script>x', "x", "x"),
    ("<div><nav>a</div>b", "b", ""),
    ("<nav>a<nav>b</nav>c</nav>d", "d", "c d"),
    ("<p>a&nbsp;&nbsp;b</p>", "a b", "a b"),
    ("", "", ""),
    ("<p title='a>b'>c</p>", "c", "b'>c"),
    ("<!DOCTYPE html><p>x<br>y</p>", "x y", "x y"),
    ("<p>&#65;&#x42;&#128512;&#xD800;&copy 1&unknown;&amp;lt;& &</p>",) + ("AB😀\ufffd© 1&unknown&lt;& &",) * 2,
    ("<p>&thorn;</p>", "þ", "þ"),
    ("<p>caf&eacute; &uuml;ber it&#146;s 1&#150;2 &#x94;</p>",) + ("café über it’s 1–2 ”",) * 2,
    ("<p>a</p><nav-bar>menu</nav-bar><p>body text</p>",) + ("a menu body text",) * 2,
    ("<header-x>h</header-x><style-guide></style-guide><p>kept</p>",) + ("h kept",) * 2,
    ("<title>a <nav> tutorial</title><p>whole body</p>", "a whole body", "a"),
    ("<p>1 < 2 <!-- c --> x</p>", "1 < 2 x", "1 < 2 x"),
    ("<STYLE>p{}</STYLE><Header>h</hEADER>t", "t", "t"),
]


def test_html_to_text_both_ways(spark):
    pages = [h for h, _, _ in HTML]
    assert column(spark, pages, html.html_to_text_parsed) == [p for _, p, _ in HTML]
    assert column(spark, pages, html.html_to_text) == [n for _, _, n in HTML]


def test_paths_agree_on_all_pages(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    h = F.col("html")
    differ = pages.filter(
        (html.html_to_text(h) != html.html_to_text_parsed(h))
        | (html.link_values(h) != html.link_values_parsed(h))
    )
    assert pages.count() > 0 and differ.count() == 0


LINKS = [
    ('<nav><a href=" /n ">x</a></nav>', ["/n"]),
    ("<a>x</a><a name=y>", []),
    ('<a href="">x</a>', [""]),
    ("<a href>x</a>", [""]),
    ("<a href='/a'>x</a><A HREF=\"/a\">y</A>", ["/a"]),
    ('<a data-href="x" href="y">z</a>', ["y"]),
    ('<a title="my href=/bad" href="/good">z</a>', ["/good"]),
    ("<style-guide></style-guide><a href='/caf&eacute;'>", ["/café"]),
    ('<!-- <a href="c"> --><script>"<a href=\'s\'>"</script><a href="k">', ["k"]),
    ("<a class=q href=/u>x</a>", ["/u"]),
    ('<a href="?a=1&amp;b=2">x</a><abbr href="no">', ["?a=1&b=2"]),
    ('<footer><a\nclass="c"\nhref = "f">x</a></footer>', ["f"]),
]


def test_text_and_links_are_read_in_one_pass(spark):
    pages = [h for h, _, _ in HTML] + [h for h, _ in LINKS]
    both = column(spark, pages, html.page_parsed)
    assert [b["text"] for b in both[: len(HTML)]] == [p for _, p, _ in HTML]
    assert [b["hrefs"] for b in both[len(HTML) :]] == [v for _, v in LINKS]


@pytest.mark.parametrize("unit", ["<!-- ", "<a ", "<a x='", "</", "<nav ", "<?", "<nav>", "&", '<a x="1" '])
def test_hostile_pages_take_linear_time(unit):
    start = time.process_time()
    html._parse("<p>x</p>" + unit * (1_000_000 // len(unit)))
    assert time.process_time() - start < 5


def test_links_both_ways(spark):
    pages = [h for h, _ in LINKS]
    assert column(spark, pages, html.link_values) == [v for _, v in LINKS]
    assert column(spark, pages, html.link_values_parsed) == [v for _, v in LINKS]


def test_edges_of_a_page(spark):
    page = '<a href="">1</a><a href="/x">2</a><a href="/x">3</a><a href="http://[x">4</a><a href="../y">5</a>'
    df = spark.createDataFrame([("http://s.t/a/b", page), ("http://s.t/e", ""), ("http://s.t/n", None)], "url string, html string")
    got = {tuple(r) for r in links.build_edges(df).collect()}
    assert got == {
        ("http://s.t/a/b", "http://s.t/a/b"),
        ("http://s.t/a/b", "http://s.t/x"),
        ("http://s.t/a/b", "http://s.t/y"),
    }


def test_edge_options(spark):
    df = spark.createDataFrame(
        [("http://s.t/a", '<a href="#x">1</a><a href="/b#y">2</a><a href="http://[x">3</a>')],
        "url string, html string",
    )
    got = {r["dst"] for r in links.build_edges(df, strip_fragment=True).collect()}
    assert got == {"http://s.t/a", "http://s.t/b"}
    kept = links.resolve_links(links.extract_links(df), keep_failed=True)
    assert kept.count() == 3 and kept.filter("dst IS NULL").count() == 1


def test_links_are_joined_once_and_filtered_on_the_value(spark):
    df = spark.createDataFrame([("http://s.t/", "<a href=x>")], "url string, html string")
    plan = links.build_edges(df, parsed=False, site="s.t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def _python_nodes(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("BatchEvalPython"), plan.count("ArrowEvalPython")


@pytest.mark.parametrize("read", [html.link_values_parsed, html.html_to_text_parsed, html.page_parsed])
def test_pages_go_to_python_in_short_batches(spark, read):
    """As rows, a hundred at a time, and not in Arrow batches of thousands of pages."""
    df = spark.createDataFrame([("<a href=x>y</a>",), (None,)], "html string")
    assert _python_nodes(df.select(read("html"))) == (1, 0)


def test_bodies_go_to_python_in_short_batches(spark):
    sql.register(spark)
    df = spark.createDataFrame([(b"\xe9t\xe9", None), (None, "utf-16")], "body binary, declared string")
    for text_of in (charset.decode_body(F.col("body"), F.col("declared")), F.expr("decode_body(body, declared)")):
        rows, columns = _python_nodes(df.select(text_of))
        assert rows and not columns


def test_late_declaration_is_found(spark):
    long = b"<head><script>" + b"x" * 200_000 + b"</script>"
    rows = [
        (long + b'<meta charset="iso-8859-5">\xd0', "iso-8859-5", "\u0430"),
        (b"<!--" + b" " * 1020 + b'--><meta http-equiv="x" content="text/html; charset=shift_jis">'
         + "日本".encode("shift_jis"), "shift_jis", "日本"),
        (b" " * 1015 + b'<meta charset="koi8-r">\xc1', "koi8-r", "\u0430"),
    ]
    df = spark.createDataFrame([(i, b) for i, (b, _, _) in enumerate(rows)], "i int, body binary")
    text_of = charset.decode_body(F.col("body"), F.lit(None).cast("string"))
    got = df.select("i", charset.detect_charset(F.col("body")).alias("name"), text_of.alias("text"))
    for r, (_, name, end) in zip(got.orderBy("i").collect(), rows):
        assert r["name"] == name and r["text"].endswith(end)


def test_decode_body(spark):
    rows = [
        ("é".encode(), "utf-8", "é"),
        ("é".encode(), None, "é"),
        (b"a\xffb", "UTF-8", "a�b"),
        (b"\xe9\x80", "windows-1252", "é€"),
        (b"caf\xe9", None, "café"),
        (b"\xef\xbb\xbfx", None, "x"),
        ("añ".encode("utf-16"), None, "añ"),
        ('<meta charset="iso-8859-5">'.encode() + b"\xd0", None, '<meta charset="iso-8859-5">а'),
        ("é".encode(), "no-such-charset", "é"),
        ("日本".encode("shift_jis"), "shift_jis", "日本"),
        (b"a\\ud800", "unicode_escape", "a\ufffd"),
        (b"", None, ""),
        (None, None, None),
    ]
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "i int, body binary, charset string, want string"
    )
    out = df.withColumn("got", charset.decode_body(F.col("body"), F.col("charset")))
    assert [r["got"] for r in out.orderBy("i").collect()] == [r[2] for r in rows]


def test_delays(spark):
    assert column(spark, [0, 1, 4], lambda c: retry.backoff_delay(c, 1.5, False), "int") == [
        1.5, 3.0, 24.0,
    ]
    got = column(spark, [2] * 50, lambda c: retry.backoff_delay(c, 1.0, True, 1), "int")
    assert all(4.0 <= v < 5.0 for v in got) and len(set(got)) > 1
    headers = [None, "7", " 7 ", "1.5", "Wed, 21 Oct 2015 07:28:00 GMT", ""]
    assert column(spark, headers, lambda c: retry.retry_after_delay(c, 2.9)) == [
        2, 7, 7, None, None, None,
    ]


def test_dedup_keeps_first_and_gaps(spark):
    pages = spark.createDataFrame([("u1", "aabbaa"), ("u2", "bbcc")], "url string, html string")
    kept = chunks.dedup_chunks(chunks.chunk_pages(pages, 2))
    got = {tuple(r) for r in kept.select("url", "chunk_number", "content").collect()}
    assert got == {("u1", 1, "aa"), ("u1", 2, "bb"), ("u2", 2, "cc")}
    again = chunks.dedup_chunks(kept)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in kept.collect()}


def test_hash_is_taken_before_sanitising(spark):
    pages = spark.createDataFrame([("u1", "=1"), ("u2", "=1"), ("u3", "")], "url string, html string")
    assert [tuple(r) for r in pages_to_chunks(pages).collect()] == [("u1", "'=1", 1)]


def test_dedup_keeps_first_and_sorts_no_content(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        text = rng.choice(["hot"] * 20 + [f"t{rng.randrange(80)}"] * 20 + [None])
        rows.append((f"u{rng.randrange(60)}", rng.randrange(3), text, text and f"h{text}", rng.randrange(2)))
    rows += rows[:20]
    df = spark.createDataFrame(rows, "url string, chunk_number int, content string, content_hash string, extra int")
    found = chunks.dedup_chunks(df)
    got = [tuple(r) for r in found.collect()]
    best = {}
    for r in rows:
        best.setdefault(r[3], []).append(r[:2])
    assert sorted((r[3] or "", *r[:2]) for r in got) == sorted((h or "", *min(v)) for h, v in best.items())
    assert found.columns == df.columns and set(got) <= set(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "content#" in plan
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(repr, chunks.dedup_chunks(df).collect())) == sorted(map(repr, found.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert chunks.dedup_chunks(df.limit(0)).count() == 0


@pytest.mark.parametrize("piece", ["<a ", "<!-- ", "<nav>", "<a href='x", "<script>", "</nav ", "<nav x='", "< a<b", "&#"])
def test_native_text_is_linear_in_broken_markup(spark, piece):
    """A megabyte of what is never closed; with passes over the rest for each it would take
    hours."""
    page = "<p>kept</p>" + piece * (1_000_000 // len(piece))
    df = spark.createDataFrame([(page,)], "html string").repartition(1).cache()
    df.count()
    for read in (html.html_to_text, html.strip_elements):
        start = time.perf_counter()
        got = df.select(read(F.col("html")).alias("t")).first()[0]
        assert "kept" in got and time.perf_counter() - start < 5
    df.unpersist()


def test_unclosed_markup_reaches_to_the_end(spark):
    rows = ["a<!-- b", "a<nav>b", "a<nav b", "a<b c", "a</b", "a<!-- b -->c<nav>d</nav>e<i f", "a < b", "a<nav/>b</nav>c"]
    df = spark.createDataFrame([(r,) for r in rows], "html string")
    got = [r[0] for r in df.select(html.html_to_text(F.col("html"))).collect()]
    assert got == ["a", "a", "a", "a", "a", "a c e", "a < b", "a c"]


# Everyday words of a few languages.
WORDS = {
    "ru": "и в не он на я что тот быть с весь это как она по но они к у ты из мы за вы так же от сказать этот который мочь человек о один ещё бы такой только себя своё какой когда уже для вот кто да говорить год знать мой до или если время рука нет самый ни стать большой даже другой наш под где дело есть сам раз чтобы два там чем глаз жизнь первый день тут ничто потом очень со хотеть ли при голова надо без видеть идти теперь тоже стоять друг дом сейчас можно после слово здесь думать место спросить через лицо тогда",
    "pl": "być w i z na że do nie się o jak ale po co który mieć to od za przez dla jest już tylko może czy więc jeszcze bardzo gdzie kiedy wszystko dobrze człowiek życie dzień świat książka miłość pieniądze źródło żółty ciężki święto ręka głowa noc księżyc słońce wiedzieć chcieć mówić każdy pierwszy drugi wielki mały nowy stary też sobie został między później właśnie można trzeba zawsze nigdy często długo",
    "cs": "být ten v na a se že s z mít do o který on k i jeho ale po když já od pro muset za moci rok svůj všechen jen jít už dva člověk další jak u první říci také velký před jeden než protože nebo žena čas vědět nový chtít dítě život věc místo ruka oko dům ještě práce slovo více malý dobrý země město strana svět přijít škola děkuji řeka žlutý šest čtyři",
    "fr": "le de un à être et en avoir que pour dans ce il qui ne sur se pas plus pouvoir par je avec tout faire son mettre autre on mais nous comme ou si leur y dire elle devoir avant deux même prendre aussi celui donner bien où fois vous encore nouveau aller cela entre premier vouloir déjà grand mon me moins aucun lui temps très savoir falloir voir quelque sans raison notre dont non an monde jour monsieur demander alors après trouver personne rendre part dernier venir pendant passer peu lequel suite bon comprendre depuis point ainsi heure rester français été élève hôtel",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei schön größer können müssen möchte früh Straße Übung Äpfel Öl fünf zwölf Mädchen Tür",
    "ja": "これは日本語の文章です 今日はとても良い天気ですね 私は毎日学校へ行きます 東京の人口は多い 新しい本を読みたいと思います カメラとテレビを買いました 電車で会社に通っています 友達と映画を見るのが好きです 明日の会議は午後三時から始まります ありがとうございました 子供たちは公園で遊んでいる 料理を作ることは楽しい",
    "zh": "今天天气很好 我们一起去学校学习 中国的历史非常悠久 他是一个很好的老师 这本书的内容很有意思 请问你叫什么名字 我喜欢看电影和听音乐 北京是中国的首都 经济发展带来了很多变化 大家都应该保护环境 昨天晚上我在家里吃饭 明年我想去国外旅行 工作和生活都很重要 科学技术不断进步",
}


@pytest.mark.parametrize(
    "language, name",
    [("ru", "windows-1251"), ("ru", "koi8-r"), ("pl", "iso-8859-2"), ("pl", "windows-1250"), ("cs", "iso-8859-2"),
     ("fr", "windows-1252"), ("de", "windows-1252"), ("ja", "shift_jis"), ("ja", "euc-jp"), ("zh", "gbk"), ("zh", "big5")],
)
def test_undeclared_pages_are_decoded_by_likelihood(spark, language, name):
    rng = random.Random(1)
    words = WORDS[language].split()
    pages = []
    for i in range(60):
        some = [rng.choice(words) for _ in range(rng.randrange(15, 80))]
        some = [w.capitalize() if rng.random() < 0.15 else w.upper() if rng.random() < 0.03 else w for w in some]
        text = f"<html><title>Page {i}</title><p class='x'>" + " ".join(some) + ". © 2024 </p></html>"
        text = text.encode(name, "ignore").decode(name)
        if not text.isascii():
            pages.append((i, text, bytearray(text.encode(name))))
    assert len(pages) > 50
    df = spark.createDataFrame(pages, "id int, text string, body binary")
    got = df.select("text", charset.decode_body(F.col("body"), F.lit(None).cast("string")).alias("t")).collect()
    assert sum(r.text == r.t for r in got) >= 0.95 * len(got)


def test_guess_needs_no_declaration_only_where_there_is_none(spark):
    text = "Привет, как дела"
    rows = [
        (text.encode("koi8-r"), "koi8-r"), (text.encode(), "utf-8"), (b"plain", "utf-8"), (b"", "utf-8"),
        (b"<meta charset=iso-8859-5>" + text.encode("koi8-r"), "iso-8859-5"), (b"caf\xe9", "windows-1252"),
        (b"\xe9", "windows-1252"), (None, None), ("日本語の文章です".encode("shift_jis") + b"\x93", "shift_jis"),
    ]
    df = spark.createDataFrame([(b and bytearray(b), w) for b, w in rows], "body binary, want string")
    got = df.select("want", charset.detect_charset(F.col("body")).alias("got")).collect()
    assert [(r.want, r.got) for r in got if r.want] == [(w, w) for _, w in rows if w]
