"""Main texts: markup, classes of tokens, and templates against pages made by hand."""

import re
from html import unescape

import pytest
from conftest import SMALL

from reelmill.llm.common import table
from reelmill.llm.markup import parse
from reelmill.llm.queries import QUERIES
from reelmill.llm.templates import (
    equivalence_classes,
    extract_main_text,
    host_of,
    main_text,
    occurrence_vectors,
    valid_classes,
)

SCHEMA = "page_id long, url string, html string, host string, text string, id long, classes string"


@pytest.fixture
def pages(spark):
    def make(given):
        return spark.createDataFrame([(*r, "h", "t", 1, "c") for r in given], SCHEMA).repartition(3)

    return make


def texts(df):
    return {r["page_id"]: r["text"] for r in df.collect()}


def test_given_pages_equal_their_articles(spark):
    got = {r["page_id"]: r for r in QUERIES["op11_html_extraction"](spark, SMALL).collect()}
    for r in table(spark, SMALL, "pages").collect():
        article = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        article = re.sub("<[^>]*>", "", re.sub("</?(?:p|h1)>|<br>", " ", article))
        assert got[r["page_id"]]["text"] == " ".join(unescape(article).split())
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
        assert got[r["page_id"]]["url"] == r["url"]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a<p>b</p>c", "a b c"),
        ("x <b>y</b>z&amp;&lt;&#233;&nbsp; q", "x yz&<é q"),
        ("<p><b>open<br><p>next</b> more", "open next more"),
        ("one<script>if (a<b) '</p>'</script>two", "one two"),
        ("one<!-- <p>no</p> -->two<!-->three", "onetwothree"),
        ("<article>in<aside>no</aside>side</article>out", "in side"),
        ("<main>m<article>a</article></main>", "a"),
        ("<main><header><h1>t</h1></header>m</main><header>no</header>", "t m"),
        ("<form id=f><article>kept</article>no</form>", "kept"),
        ('<div class="cookie-notice">no</div><p>yes</p>', "yes"),
        ('<p>yes<span class="ad">no</span> it is</p>', "yes it is"),
        ('<article>a<section id="comments"><article>no</article></section></article>', "a"),
        ('<div class="has-sidebar">yes</div><div class="content-sidebar-wrap">too</div>', "yes too"),
        ("<div hidden>no</div><div style='display: none'>no</div><div aria-hidden=true>no</div>y", "y"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
        ("<ul><li>a<li>b</ul>", "a b"),
        ("a < b and <3 <img alt='x > y'> c", "a < b and <3 c"),
        ("cut off <a href='x", "cut off"),
        ("<noscript>no</noscript><textarea>no</textarea><button>no</button>yes", "yes"),
        ("<html><head><title>no</title><meta x><p>head is over", "head is over"),
        ("<head><style>no</style>text ends it", "text ends it"),
        ("<svg class=x/>yes<svg><path d=1/><text>no</text></svg> too", "yes too"),
        ('<div class="ad-free">yes</div><div class="entry-header">title</div><div class="site-header">no</div>', "yes title"),
        ('<article class="post tag-social">yes</article><article class="comment">no</article>', "yes"),
        ("<DIV>Upper</DIV><NAV>no</NAV>", "Upper"),
        ("&lt;p&gt; stays &am", "<p> stays &am"),
        ("", ""),
        (None, ""),
    ],
)
def test_markup(html, text):
    assert main_text(parse(html), None) == text


def test_deep_and_broken_markup_is_read_in_linear_time():
    assert main_text(parse("<div>" * 50_000 + "x" + "</p>" * 50_000), None) == "x"
    assert main_text(parse("<a href='" * 3000 + "y"), None) == ""
    assert len(main_text(parse("<p>" + "word " * 400_000), None)) == 1_999_999


def soup(k, body, host="h.example"):
    """A page without telling names: its template shows only over several pages."""
    return (
        k,
        f"https://{host}/{k}",
        f"<div><ul><li>Start</li><li>Contact us</li></ul></div><div><h1>Title {k}</h1>{body}</div>"
        f"<div>All rights reserved by nobody</div>",
    )


def test_template_without_telling_names(pages):
    given = [soup(k, f"<p>text {k} of its own</p>" * (1 + k % 3)) for k in range(6)]
    got = texts(extract_main_text(pages(given)))
    assert got == {k: " ".join([f"Title {k}"] + [f"text {k} of its own"] * (1 + k % 3)) for k in range(6)}
    # Two pages, or copies of one, show no template: nothing is dropped.
    alone = texts(extract_main_text(pages([given[0], (9, "https://h.example/9", given[0][2])] * 3)))
    assert alone[0] == "Start Contact us Title 0 text 0 of its own All rights reserved by nobody"


def test_notice_without_a_name_in_all_articles(pages):
    def page(k):
        shared = "<p>a passage that a third of the pages share</p>" if k % 3 == 0 else ""
        own = f"<article><h1>t{k}</h1><p>words {k}</p>{shared}<div>Read our new book today</div></article>"
        return (k, f"http://n.example/{k}", own)

    got = texts(extract_main_text(pages([page(k) for k in range(12)])))
    shared = " a passage that a third of the pages share"
    assert got == {k: f"t{k} words {k}{shared if k % 3 == 0 else ''}" for k in range(12)}


def test_lists_of_links_go_from_pages_without_an_article(pages):
    def page(k):
        links = "".join(f"<li><a href=x>link {k} {j}</a></li>" for j in range(5))
        return (k, f"http://l.example/{k}", f"<div><ul>{links}</ul></div><div><p>see <a>this</a> text {k}</p></div>")

    got = texts(extract_main_text(pages([page(k) for k in range(5)])))
    assert got == {k: f"see this text {k}" for k in range(5)}


def test_vectors_classes_and_order(spark, pages):
    given = [soup(k, f"<p>text {k}</p>" * (1 + k % 2)) for k in range(8)]
    df = pages(given).select("html").withColumn("host", host_of(spark_lit("https://h.example/")))
    vectors = {r["token"]: r for r in occurrence_vectors(df).collect()}
    brute = {}
    for _, _, html in given:
        page = parse(html)
        for t in set(page.tokens):
            t_signed = t - (1 << 64) if t >> 63 else t
            brute.setdefault(t_signed, {})[html] = page.tokens.count(t)
    assert set(vectors) == set(brute) | {0}
    groups, same = {}, {}
    for t, counts in brute.items():
        assert vectors[t]["pages"] == len(counts)
        groups.setdefault(tuple(sorted(counts.items())), set()).add(t)
        same.setdefault(vectors[t]["vector"], set()).add(t)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, same.values()))
    classes = equivalence_classes(occurrence_vectors(df), 3, 0.25)
    assert {frozenset(r["tokens"]) for r in classes.collect()} == {
        frozenset(g) for v, g in groups.items() if len(v) >= 3 and len(g) >= 3
    }
    assert valid_classes(df, classes).count() == classes.count()


def spark_lit(value):
    from pyspark.sql import functions as F

    return F.lit(value)


def test_a_class_without_an_order_is_not_valid(spark):
    one, two, three = "<u1>one</u1>", "<u2>two</u2>", "<u3>three</u3>"
    orders = [one + two + three, two + three + one, three + one + two, one + three + two]
    df = spark.createDataFrame([("h", f"{o}<p>{k}") for k, o in enumerate(orders * 2)], "host string, html string")
    classes = equivalence_classes(occurrence_vectors(df), 3, 0.25)
    assert classes.count() == 1 and valid_classes(df, classes).count() == 0


def test_strange_rows(pages):
    given = [(1, None, None), (1, None, None), (None, "no host", "<p>x"), (2, "http://h/", ""), (3, None, "<p>y")]
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in extract_main_text(pages(given[3:])).collect())
    assert got == [(2, "", 0), (3, "y", 1)]
    assert extract_main_text(pages(given)).count() == 5
    assert extract_main_text(pages([])).collect() == []
    assert extract_main_text(pages([])).columns == ["page_id", "url", "text", "n_chars"]


def test_hosts(spark):
    cases = {"HTTPS://User@A.b:80/x": "a.b", "http://c?x": "c", "//d/": "", "mailto:x": "", None: ""}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r["u"]: r["h"] for r in df.select("u", host_of(df["u"]).alias("h")).collect()} == cases
