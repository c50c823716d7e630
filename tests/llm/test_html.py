"""Page reading on made pages of known text, host consensus, broken markup and odd rows."""

import duckdb
import pytest

from tidewatch.llm import html_extract as he

SCHEMA = "page_id long, url string, html string, text int"


def read(html):
    return he.read_page(html, None)


def test_article_without_what_is_around_it():
    html = """<!DOCTYPE html><html><head><title>No &amp; title</title><style>p{}</style><script>var t="</p><article>";</script></head>
      <body class="has-sidebar"><header><h1>Site</h1></header><div id="main-nav"><a href="/">Home</a></div><div class="cookie-notice">We use cookies</div>
      <div class="wrap"><article class="post-12 post"><h1>A&nbsp;title &lt;b&gt;</h1><p>First\n <b>bold</b> text<br>goes&#32;on &eacute;.<p>Second <span class="ad-slot">buy</span>one.
      <ul><li>item one<li>item <a href="x">two</a></ul><div class="ad">Advert text that is really very long, longer than all the rest of this page put together, so long</div>
      <form><label>Mail</label><input></form><!-- no <p>comment</p> --></article><section id="comments"><p>A reader's comment which is very much longer than the article itself, on and on and on.</p></section></div>
      <aside>side</aside><footer>&copy; foot</footer></body></html>"""
    assert read(html) == "A title <b>\nFirst bold text goes on é.\nSecond one.\nitem one\nitem two"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""), (None, ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b", "a\nb"), ("<div>a <!-- open <p>b", "a"), ("<p>a <b class='x>b", "a b"), ("a < b <3", "a < b <3"), ("<script>x", ""),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ("<form><article><p>in a form</article></form>", "in a form"), ("<div class='content-sidebar-wrap'><p>kept</div>", "kept"),
        ("<div class=sidebar><main><p>main</main></div>", "main"), ("<p data-x='a>b'>c", "c"), ("</p></div>x", "x"), ("<nav>only</nav>", ""), ("<p>a<span class=ad>b</p><p>c", "a\nc"), ("a<!-->b", "ab"),
        ("<div>" * 5000 + "deep", "deep"), ("<p>" + "x " * 500_000, ("x " * 500_000).strip()), ("<a href=1>only</a> links", "only links"), ("<p>a<hr>b", "a\nb"), ("<P CLASS=Notice>no<P>yes", "yes"),
    ],
)
def test_markup(html, text):
    assert read(html) == text


def test_pages_follow_their_host(spark):
    usual = "<body><div class='story s{i}'><p>{words}</p></div><div class='extra'><p>short</p></div></body>"
    odd = "<body><div class='story s9'><p>the article</p></div><div class='extra'><p>a box that for once is much longer than the article of its page</p></div></body>"
    rows = [(i, "http://h.com/1", usual.format(i=i, words="words " * 20), 1) for i in range(9)] + [(99, "http://H.com/2", odd, 1), (100, "http://alone.com", odd, 1), (101, "http://h.com/3", "<body><section><p>of another form</p></section>", 1)]
    got = {r.page_id: r.text for r in he.extract_pages(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got[99] == "the article" and got[100].startswith("a box") and got[101] == "of another form" and got[3] == ("words " * 20).strip()


def test_odd_rows(spark):
    rows = [(None, None, None, 1), (1, "", "<p>a", 2), (1, "", "<p>a", 2), (2, "x://h", "", 3), (3, None, "<p>\u00e9\U0001f600</p>", 4)]
    df = he.extract_pages(spark.createDataFrame(rows, SCHEMA))
    assert df.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in df.collect()) == [(0, "", "", 0), (1, "", "a", 1), (1, "", "a", 1), (2, "x://h", "", 0), (3, "", "\u00e9\U0001f600", 2)]
    assert he.extract_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_given_pages(spark):
    """The given pages have one form, whose text SQL can cut out: the article's blocks."""
    sf = "/root/testdata/sf0.01"
    from html import unescape

    want = {}
    for i, body in duckdb.sql(f"SELECT page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) FROM '{sf}/pages.parquet'").fetchall():
        blocks = body.replace("<br>", " ").replace("<b>", "").replace("</h1>", "<p>").replace("<h1>", "<p>").replace("</p>", "<p>").split("<p>")
        want[i] = "\n".join(" ".join(unescape(b).split()) for b in blocks if b.strip())
    assert {r.page_id: r.text for r in he.extract_pages(spark.read.parquet(f"{sf}/pages.parquet")).collect()} == want
