"""Archives, extraction and URL rules."""

import time

import pytest

from casedesk.llm import dom, html_text, url_rules, warc
from tests.llm import brute
from tests.llm.conftest import rows_of

HEADER = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: {}\r\n\r\nabc"


@pytest.fixture(scope="module")
def page_rows():
    rows = [(1, "u1", "x" * 200), (2, "u2", "x" * 200), (2, "u2", "x" * 200), (3, None, None),
            (4, "", ""), (None, "u\r\nz", HEADER.format(5) * 30), (5, "u", "WARC/1.0\r\n"),
            (6, "u", "é" * 99), (7, "u", "é" * 99), (8, "u", "short"), (9, "u", "short"),
            (10, "u", "y" * 300_000)]
    return rows + [(100 + i, "w", HEADER.format(i * 17) + "z" * i * 31 + "WARC/1.0\r\n")
                   for i in range(40)]


@pytest.mark.parametrize("compression,split", [("gzip", "128m"), (None, "9000b")])
def test_round_trip(spark, page_rows, compression, split):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes",
                                             "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        pages = spark.createDataFrame(page_rows, "page_id long, url string, html string")
        found = warc.round_trip(pages.coalesce(2), compression=compression)
        got = rows_of(found, "record_id", "payload_bytes", "digest", "record_type", "refers_to")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute.archives([(r[0], r[2]) for r in page_rows])


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none).count() == 0
    assert html_text.extract(none).count() == 0
    assert url_rules.judged(none).count() == 0


@pytest.fixture(scope="module")
def field():
    return html_text.trained(["Some words of prose, as they come. And more of them follow here."],
                             n_pages=900)


def test_viterbi_is_the_best_path(field):
    from itertools import product

    maker, top = html_text.Maker(["few words, here"], 3), dom.root()
    page = ""
    while not 2 <= len(dom.leaves(page, top)) <= 9:
        page = maker.page()
    found, _ = html_text.labelled(page, top)
    flags = html_text.siblings(found)
    scores = [sum(field.weights.get(f, 0.0) for f in [*own, "bias"])
              for own in html_text.features(found)]

    def value(labels):
        return sum(s for s, y in zip(scores, labels, strict=True) if y) + sum(
            field.steps[k][a][b] for k, a, b in zip(flags, labels, labels[1:], strict=False))

    best = max(product((0, 1), repeat=len(found)), key=value)
    assert list(best) == field.labels(found)


def test_held_out_pages(field):
    maker, top, right, blocks = html_text.Maker(["Other prose, with stops. It goes on."], 77), \
        dom.root(), 0, 0
    for _ in range(150):
        found, labels = html_text.labelled(maker.page(), top)
        right += sum(a == b for a, b in zip(field.labels(found), labels, strict=True))
        blocks += len(labels)
    assert right / blocks > 0.95


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body>
<nav><ul><li><a href="/a">Menu</a></li><li><a href="/b">Other</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><article><h1>A &amp; B</h1>
<p>First   text &eacute;,\n with <b>bold</b>ness.<p>Second one<br>goes on. <script>x="</p>"</script></p>
<div class="ad">Buy this now.</div><p>Last words of it.</p></article>
<section class="comments"><p>I like it a lot, thank you.</p></section>
<form><label>Mail</label><input><button>Send</button></form><footer>&copy; x</footer></body></html>"""


def test_article_text(spark, field):
    rows = [(1, "u", PAGE), (None, None, None), (2, "u", ""), (1, "u", PAGE), (3, "u", "<p"),
            (4, "u", "<article><p>" + "Long text. " * 50_000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.extract(pages, field).collect()}
    want = "A & B First text é, with boldness. Second one goes on. Last words of it."
    assert got[1].text == want and got[1].n_chars == len(want)
    assert got[None].text == "" and got[2].text == "" and got[2].n_chars == 0
    assert got[4].n_chars == 50_000 * 11 - 1


def texts_of(page):
    return [leaf.text for leaf in dom.leaves(page, dom.root())]


@pytest.mark.parametrize("quote", "\"'")
def test_long_attribute_values(quote):
    value = f"{quote}data:image/png;base64,{'A>b/' * 25_000}{quote}"
    page = (f"<p>First.</p><img alt={quote}x{quote} src={value}><p class={quote}a{quote}>Second."
            f"</p><div data-x = {value} id={quote}b{quote}>Third.</div><p>Last.</p>")
    assert texts_of(page) == ["First.", "Second.", "Third.", "Last."]


def test_stray_quotes():
    assert texts_of("""<p title="a"" id=x>One.</p><p class=it's>Don't.</p><p lang=en'>Two's.</p>""") \
        == ["One.", "Don't.", "Two's."]
    assert texts_of('<p title="a>One.</p><p>Two.</p>') == ["One.", "Two."]
    assert texts_of("<p>One.</p><!-- no end") == ["One."]
    assert texts_of("<p>Two.</p><!---->3 < 4 <b") == ["Two.", "3 < 4 <b"]
    for part in ("<a ", "<a x='", '<a x="', "<a x=\"y' ", "<a x = ", "='"):
        dom.leaves("<p>" + part * 200_000, dom.root())
        dom.leaves("<p>" + part * 200_000 + ">", dom.root())


def test_formulas_and_drawings():
    page = ("<p>So <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow>"
            "<annotation encoding=tex>x = 2</annotation></semantics></math> holds.</p>"
            "<svg><title>No</title><desc>No</desc><text>Jan</text><text>Feb</text></svg>"
            "<p>In <annotation>full</annotation>.</p>")
    assert texts_of(page) == ["So x=2 holds.", "Jan Feb", "In full."]


URLS = [("http://Sub.Example.NET/en/1?q=1", "sub.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://example.net/de/1", "example.net", "/de/1", "net/", "block"),
        ("http://badexample.com/de/", "badexample.com", "/de/", None, "allow"),
        ("https://a.example.com/de/x#y", "a.example.com", "/de/x", "example.com/de/", "block"),
        ("x://net", "net", "", None, "allow"), ("x://a.net?b/", "a.net", "", None, "allow"),
        ("http://fr.org/fr/", "fr.org", "/fr/", "org/fr/", "allow"),
        ("http://my-casino.org/x", "my-casino.org", "/x", None, "block"),
        ("http://casinos.org/x", "casinos.org", "/x", None, "allow"),
        ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow")]


@pytest.mark.parametrize("limit", [url_rules.BROADCAST_RULES, 0])
def test_url_rules(spark, monkeypatch, limit):
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", limit)
    rows = [(i, u[0], "old") for i, u in enumerate(URLS)] + [(None, URLS[0][0], "old")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = url_rules.judged(pages)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    found = {r.page_id: (r.url, r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert [found[i] for i in range(len(URLS))] == URLS and found[None] == URLS[0]


def test_rules_without_a_word(spark):
    rules = (url_rules.Rule("digits", r"\d{4}", "block", 1, ()),)
    pages = spark.createDataFrame([(1, "http://a/1234"), (2, "http://a/12")],
                                  "page_id long, url string")
    assert rows_of(url_rules.judged(pages, rules), "page_id", "verdict") == [
        (1, "block"), (2, "allow")]


@pytest.mark.parametrize("page,want", [
    ("<b>" * 200_000 + "deep", 1),
    ("<div>" * 200_000 + "deep" + "</i></p></div>" * 200_000, 1),
    ("<ul><li><p>one" * 20_000 + "</span>" * 200_000, 20_000)])
def test_depth_costs_no_more_than_length(page, want):
    start = time.process_time()
    assert len(dom.leaves(page, dom.root())) == want
    assert time.process_time() - start < 30


def test_elements_that_close_others():
    page = ("<ul><li>a<li>b<ul><li>c</ul>d<li><p>e<p>f</ul>g<p>h<b>i<div>j</div>k</b>"
            "<table><tr><td>l<td>m<tr><td>n</table><dl><dt>o<dd>p</dl><i/>q<br>r</p>s")
    found = [leaf.text for leaf in dom.leaves(page, dom.root())]
    assert found == ["a", "b", "c", "d", "e", "f", "g", "hi", "j", "k", "l", "m", "n", "o", "p",
                     "q r", "s"]
