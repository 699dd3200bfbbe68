"""op4: main text of made pages, votes of a host, the article of the given pages."""

import html
import re

from crease.llm import op04_html as op

PAGE = """<html><body class="home"><header class="site-header"><h1>Site</h1></header><div id="cookie-notice">We use cookies</div>
<div class="wrap"><aside>side</aside><main><article class="post-12 post"><header><h1>Title &amp; more</h1></header>
<p>First <b>par</b>a<a href=x>graph</a>.<p>Second&nbsp;one, long  enough.<ul><li>one<li>two</ul><form><input> Sub</form>
<div class="ad-slot">Buy</div></article><section class="comments"><p>Great post!</p></section></main></div>
<footer>foo</footer><script>if(a<b){"</p>"}</script></body>"""


def test_leaves_out_what_is_not_main_text():
    assert op.Page(PAGE).text([]) == "Title & more First paragraph. Second one, long enough. one two"


def test_odd_markup():
    for x in ("", "<", "<<p>", "plain text", "<p", "<!--", "<script>", "</p></p>", "<p>a<br>b</p", "&#x110000; &unknown;", "a" * 300_000):
        op.Page(x).text([])
    assert op.Page("plain  text").text([]) == "plain text"
    assert op.Page("<div><p>a<br>b<p>c").text([]) == "a b c"
    for step in ("<div>", "<div><section>", "<b>", "<p>", "<ul><li>"):
        deep = (step + "x ") * 30_000
        assert len(op.Page(deep).text([]).replace(" ", "")) > 29_900


def test_embedded_elements():
    for x, text in (("One <svg class='i'/> two</p><p>Three", "One two Three"), ("One <svg/> two <svg><text>no</text></svg>three", "One two three"),
                    ("One <svg class=i> two</p><p>Three", "One two Three"), ("One <object data=x> two", "One two"), ("One <select> two", "One two"),
                    ("Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be", "Let x=1 be"), ("One <math/> two", "One two"),
                    ("One <object><p>no</p></object> two", "One two"), ("One <template><p>no</template> two", "One two")):
        assert op.Page(f"<article><p>{x}</p></article>").text([]) == text


def test_names_of_wrappers_and_of_parts():
    text = "<p>One two three.</p><p>Four five six.</p>"
    for x in ('<div class="layout no-sidebar"><article>%s</article></div>', '<div class="has-navbar"><main>%s</main></div>', '<div class="content share-enabled">%s</div>',
              '<div class="with-footer js-menu">%s</div>', '<div id="search"><article>%s</article></div>', '<div class="sidebar">%s</div>',
              '<div class="page modal-open"><div class="main-content newsletter">%s</div></div><div class="ads">x</div>'):
        assert op.page_of(x % text).text([]) == "One two three. Four five six.", x
    for x in ('<div class="comments">%s</div>', '<div id="cookie-consent">%s</div>', '<div class="sidebar"><div class="comment">%s</div></div>'):
        assert op.page_of(x % text).text([]) == "", x
    for x in ('<section class="related-work">%s</section>', '<section id="search">%s</section>', '<div class="table-widget"><table><tr><td>%s</table></div>',
              '<h2 id="reply">%s</h2>', '<div class="search-results-of-the-study">%s</div>'):
        assert op.page_of("<article><h1>Head</h1><p>intro</p>" + x % "inner words" + "</article><aside>no</aside>").text([]) == "Head intro inner words", x
    for x in ('<div class="ad-slot">no</div>', '<div class="left-sidebar">no</div>', '<div class="social share">no</div>', '<div class="related">no</div>',
              '<ul class="breadcrumbs"><li>no</ul>', '<div id="newsletter-signup">no</div>', '<div class="cookie_notice">no</div>', '<div class="site-header">no</div>'):
        for whole in ("<article>%s</article>", "<div class='post'>%s</div>"):
            assert op.page_of(whole % (text + x)).text([]) == "One two three. Four five six.", x


def test_whole_article():
    long = "long text of a section, " * 40
    for x in ("<h1>Head</h1><p>intro<section><p>%s</section><section><p>end</section>", "<header><h1>Head</h1></header>intro<div class='entry-content'>%s</div>end",
              "<h1>Head</h1><p>intro<ul class='a>b'><li>%s</ul>end", "<h1>Head</h1><p>intro<table><tr><td>%s</table>end"):
        for outer in ("article", "main"):
            page = op.Page(f"<div>top <a href=x>link</a></div><{outer}>{x % long}</{outer}><div>other</div>")
            assert page.text([]) == page.text(sorted(page.score, key=page.score.get)[::-1]) == f"Head intro {long}end"


def test_paths_of_a_host_are_bounded(spark):
    slug = lambda i: "".join(chr(97 + i // 26 ** k % 26) for k in range(3))
    page = "<div id='page-%s'><div class='body'><p>%s</p></div></div><div class='x-%s'><p>extra %s</div>"
    data = [("http://h.org/%d" % i, page % (slug(i), "main words " * 20, slug(i), "a long extra " * 30 * (i == 7))) for i in range(200)]
    pages = spark.createDataFrame(data, "url string, html string")
    paths = {r.host: r.paths for r in op.host_paths(pages).collect()}
    assert paths["h.org"] == [">div>div.body", ">div"]
    assert [r.paths for r in op.host_paths(pages, most=1).collect()] == [[">div>div.body"]]
    assert all(r.text == ("main words " * 20).strip() for r in op.extract(pages).collect())


def test_host_outvotes_one_page(spark):
    usual = '<div class="body"><p>%s</p></div><div class="extra"><p>%s</p></div>'
    data = [(i, "http://h.org/%d" % i, usual % ("main words here %d " % i * 20, "extra " * 3)) for i in range(9)]
    data += [(9, "http://h.org/9", usual % ("short main", "a long extra text, " * 30)), (10, None, None), (11, "http://other/", "<p>alone")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 AS _host")
    got = {r.page_id: r for r in op.extract(pages).collect()}
    assert got[9].text == "short main" and got[10].text == "" and got[11].text == "alone" and got[3]._host == 1


def test_given_pages(spark):
    got = op.op4_host_consensus(spark, "/root/testdata/sf0.001").collect()
    whole = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert len(got) == len(whole)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", whole[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]+>", " ", article)).split()) and r.n_chars == len(r.text)


def test_empty_table(spark):
    assert op.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
