"""Main text of hand-written pages, and repeats on a host against a brute-force search."""

from trailmark.llm import pages

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{x:1}</style></head><body><header>Site</header>
<nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy <b>now</b></div><!-- <p>no</p> -->
<article class="post"><h1>Head &amp; line</h1><p><b>Fir<i>st</i> &lt;p&gt; it
  is<br>next<p>two<script>var t="</p><p>evil";</script> more</p><aside>side</aside><div class="cookie-notice">ok?</div>
<ul><li>x<li>y</ul><form><input value="q"><p>name</p></form><section id="comments"><p>first!</p></section><p>end</p></article>
<footer>&copy; me</footer>"""


def test_blocks_of_a_page():
    main = [t for t, m, c in pages.blocks_of(PAGE) if m and not c]
    assert " ".join(main) == "Head & line First <p> it is next two more x y end"
    assert pages.blocks_of("") == []
    assert [b[0] for b in pages.blocks_of("a < b &am &amp c<p>x")] == ["a < b &am & c", "x"]


def test_repeats_of_a_host_go(spark):
    menu = "home about products support contact imprint privacy terms of use and much more"
    own = [f"n{i} begins the text that only page {i} has " + " ".join(f"w{i}x{j}" for j in range(30)) for i in range(6)]
    rows = [(i, f"http://a.example/{i}", f"<div>{menu}</div><p>{t}</p><div>{menu}</div>", 0) for i, t in enumerate(own)]
    rows += [(10, "http://b.example/", f"<div>{menu}</div>", 0), (11, None, None, 0), (12, "odd", "", 0), (13, "http://c.example/", PAGE, 0)]
    rows += [(14, "http://a.example/9", f"<p>{own[0]}</p>", 0), rows[1]]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(3)
    got = {}
    for r in pages.main_text(table).collect():
        got.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert got[1] == [own[1], own[1]] and [got[i] for i in (2, 3, 4, 5)] == [[t] for t in own[2:]]
    assert got[0] == [""] and got[14] == [""]
    assert got[10] == [menu] and got[11] == got[12] == [""]
    assert got[13][0].startswith("Head & line First")


def test_empty(spark):
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_given_pages_keep_the_article(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in table.collect()}
    for r in pages.main_text(table).collect():
        inside = html[r.page_id].split("<article>")[1].split("</article>")[0]
        plain = pages.re.sub(r"<[^>]*>", " ", inside)
        assert r.text == " ".join(pages.html.unescape(plain).split())


def kept(page):
    return " ".join(t for t, _, c in pages.blocks_of(page) if not c)


def test_names_that_only_look_like_chrome():
    for name in ("header-image full-width", "sidebar-right", "nav-open", "ad", "search"):
        assert kept(f'<html class="{name}"><body class="{name}"><article><p>text</p></article></body></html>') == "text"
        page = f'<nav>no</nav><div class="{name}"><p>a</p><div class="ad">no</div><main><p>text</p><nav>no</nav></main></div>'
        assert kept(page) == "a text"
    inside = ('<section id="share-prices">{}</section>', '<h2 id="social-impact">{}</h2>', '<section id="search">{}</section>',
              '<div class="search-results-discussion">{}</div>', '<p data-id="share-1" title=" class=ad ">{}</p>')
    for element in inside:
        assert kept(f"<article><p>one</p>{element.format('two')}<p>three</p></article>") == "one two three"
    related = '<article><p>the whole long article</p></article><div class="related"><article><p>teaser</p></article></div><p>end</p>'
    assert kept(related) == "the whole long article end"
    assert kept('<p>a</p><div class="share-buttons">no</div><div role="navigation">no</div><p hidden>no</p><p>b</p>') == "a b"


def test_repeats_decide_with_and_without_articles(spark):
    body = [f"b{i} " + " ".join(f"w{i}x{j}" for j in range(40)) for i in range(8)]
    teaser = "<article><h3>read next</h3><p>a teaser of some other story that the site shows</p></article>"
    passage = "a passage that two of the articles quote from one source word by word"
    note = "all rights reserved by the site"
    html = [f"<div><p>{b}</p></div>{teaser}" for b in body[:3]]
    html += [f"<main><nav><p>menu</p></nav></main><div><p>{body[3]}</p></div>"]
    rows = [(i, f"http://a.example/{i}", h) for i, h in enumerate(html)]
    quotes = [f"<p>{passage}</p>" if i in (2, 5) else "" for i in range(8)]
    rows += [(10 + i, f"http://m.example/{i}", f"<main><p>{note}</p><p>{b}</p>{quotes[i]}</main>") for i, b in enumerate(body)]
    links = '<div class="share-these-links">send this story to your friends by mail or by any other way</div>'
    only = '<div class="share-prices">the price of the share rose on monday as the firm said</div>'
    rows += [(20 + i, f"http://d.example/{i}", f"<article><p>{b}</p>{links}{only if i == 4 else ''}</article>") for i, b in enumerate(body)]
    rows += [(30 + i, f"http://e.example/{i}", f"<article><p>{body[0]}</p><p>by author {i}</p></article>") for i in range(8)]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(4)] == body[:4]
    assert [got[10 + i] for i in range(8)] == [f"{b} {passage}" if i in (2, 5) else b for i, b in enumerate(body)]
    assert [got[20 + i] for i in range(8) if i != 4] == [b for i, b in enumerate(body) if i != 4]
    assert got[24].startswith(body[4]) and got[24].endswith("the price of the share rose on monday as the firm said")
    assert all(got[30 + i] == f"{body[0]} by author {i}" for i in range(8))


def test_common_runs_of_articles_go_from_every_page(spark):
    body = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(8)]
    plea = "this site lives of what its readers give so please think of a gift to the people who write here"
    passage = "a passage of more than sixteen words that three of the articles quote from one and the same old source word by word"
    quotes = [f"<p>{passage}</p>" if i in (2, 5, 6) else "" for i in range(8)]
    rows = [(i, f"http://a.example/{i}", f"<article><p>{b}</p>{quotes[i]}<p>by {i} {plea} e{i}</p></article>") for i, b in enumerate(body)]
    rows += [(10 + i, f"http://b.example/{i}", f"<article><p>{body[0]} {i}</p></article>") for i in range(8)]
    rows += [(20 + i, f"http://c.example/{i}", f"<article><p>{b} {plea}</p></article>") for i, b in enumerate(body[:4])]
    rows += [(30 + i, f"http://d.example/{i}", f"<article><p>{body[0]} {plea} {i // 7}</p></article>") for i in range(8)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in pages.main_text(table).collect()}
    for i, b in enumerate(body):
        assert got[i] == " ".join(x for x in (b, passage if quotes[i] else "", f"by {i}", f"e{i}") if x)
        assert got[10 + i] == f"{body[0]} {i}"
        assert got[30 + i] == f"{body[0]} {plea} {i // 7}"
    assert all(got[20 + i] == f"{body[i]} {plea}" for i in range(4))
