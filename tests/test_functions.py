import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.functions import html, reasons, urls
from webloom.functions.text import build_snippet, search_terms, seed_list, terms_of


def test_terms_of_sentences_and_spellings():
    assert terms_of("Our crawler's queue, once drained, re-reads nothing!") == ["crawler", "queue", "once", "drained", "re", "reads", "nothing"]
    spelt = "c++ rules; C#, F# (or .NET): asp.net/node.js next.js, VUE.JS! http / 2 sha -256 xc++ c++x"
    assert terms_of(spelt) == "cpp rules csharp fsharp dotnet aspnet nodejs nextjs vuejs http2 sha256 xc".split()
    assert terms_of("7 wells and 31 x9 pumps") == ["wells", "x9", "pumps"]
    assert terms_of("7 wells and 31 x9 pumps", keep_numbers=True) == ["wells", "31", "x9", "pumps"]


def test_terms_column_agrees_with_the_function(spark):
    texts = ["Straße C++ ﬁne ½ cup", None, "", "HTTP / 2 and sha - 256", "ÉTÉ node.js x", "a b the"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", search_terms(F.col("t")).alias("x")).collect()
    assert [r.x for r in sorted(rows)] == [terms_of(t) for t in texts]


@pytest.mark.parametrize(
    ("url", "base", "want"),
    [
        ("https://shop.example/list?z=9&utm_campaign=may&b=1&UTM_term=q", None, "https://shop.example/list?b=1&z=9"),
        ("part2", "https://shop.example/guide/", "https://shop.example/guide/part2"),
        ("part2", "https://shop.example/guide", "https://shop.example/part2"),
        ("HTTPS://Shop.EXAMPLE:443/Big/#end", None, "https://shop.example/Big"),
        ("http://shop.example:80", None, "http://shop.example/"),
        ("http://shop.example:9000/y/", None, "http://shop.example:9000/y"),
        ("//img.example/p", "https://shop.example/", "https://img.example/p"),
        ("../top?k=2&j=%20w", "https://shop.example/m/n/o", "https://shop.example/m/top?j=+w&k=2"),
        ("https://me:key@shop.example/?utm_content=3", None, "https://me:key@shop.example/"),
    ],
)
def test_canonical_url(url, base, want):
    assert urls.canonical_url(url, base) == want


@pytest.mark.parametrize(("url", "base"), [("", None), (" \t", None), ("no/base", None), ("gopher://shop.example/a", None), ("a", "mailto:shop.example"), ("http:///a", None)])
def test_no_canonical_url(url, base):
    with pytest.raises(ValueError):
        urls.canonical_url(url, base)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcXYZ019/._-?&=%", max_size=24))
def test_canonical_url_is_stable(tail):
    once = urls.canonical_url("https://h.example/" + tail)
    assert urls.canonical_url(once) == once


def test_url_columns(spark):
    given_urls = ["https://a.example/x/y?q=1", "https://a.example/", "http://A.example:80/x", "bad", None, "https://a.example/p/Q%20r"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(given_urls)], "i int, u string")
    got = {r.i: r for r in rows.select("i", urls.normalize_url(F.col("u")).alias("n"), urls.parent_url(F.col("u")).alias("p"), urls.host_of(F.col("u")).alias("h")).collect()}
    assert got[0].n == "https://a.example/x/y?q=1" and got[0].p == "https://a.example/x" and got[0].h == "a.example"
    assert got[1].p is None and got[2].p == "http://a.example/" and got[2].n == "http://a.example/x"
    assert got[3].n is None and got[4].n is None


def test_parse_page():
    page = """<html><head><title>T &amp; U</title></head><body><nav>menu</nav><div class="main-nav">x</div><div class="navbar">kept</div>
    <script>var a</script><p>One<br>two</p><a href="/b/?utm_source=1">b</a><a href="#x">x</a><a href="mailto:a@b">m</a><a href="/b">again</a></body></html>"""
    title, text, length, links = html.parse_page(page, "https://e.example/a")
    assert title == "T & U" and text == "T & U kept One two b x m again" and length == len(text)
    assert links == ["https://e.example/b"]
    assert html.parse_page('<meta property="og:title" content=" O "><title>T</title>')[0] == "O"
    assert html.parse_page("<h1>H</h1>")[0] == "H"
    assert html.parse_page("")[:3] == ("", "", 0)


def test_snippet():
    body = "x" * 300 + " cache and index " + "y" * 300
    got = build_snippet("t", body, {"cache", "index"})
    assert got.startswith("…") and got.endswith("…") and "cache and index" in got
    assert build_snippet("Title only", "  ", {"title"}) == "Title only"
    assert build_snippet(None, "z" * 250, {"q"}) == "z" * 200 + "…"
    assert build_snippet(None, None, {"q"}) == "" and build_snippet("t", None, ()) == "t"


def test_edge_reasons(spark):
    rows = [
        ("link", None, 1.0),
        ("content_similarity", '{"similarity": 0.81234, "shared_terms": ["b", "a", "b"]}', 0.8),
        ("near_duplicate", '{"kind": "content_hash_match"}', 1.0),
        ("near_duplicate", "[1]", 0.5),
        ("manual", None, None),
        ("url_hierarchy", '{"parent_path": "/a", "child_path": "/a/b"}', 0.9),
        ("co_ranked", None, 0.123456),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, e string, w double").select(reasons.edge_reason(F.col("t"), F.col("e"), F.col("w"))).collect()]
    assert got[0] == "Direct link between these pages."
    assert got[1] == "Similar page content (similarity 0.812). Shared terms: a, b."
    assert got[2].startswith("Near duplicate. These pages") and got[3] == "Related by near_duplicate with strength 0.5."
    assert got[4] == "Related by manual with strength unknown." and got[5].endswith("Paths: parent /a → child /a/b.")
    assert got[6] == "Related by co_ranked with strength 0.1235."


def test_seed_list(spark):
    assert spark.sql("select ' a, b;c  a' as s").select(seed_list(F.col("s"))).first()[0] == ["a", "b", "c"]
