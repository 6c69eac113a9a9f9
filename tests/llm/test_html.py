"""Main text of pages; templates by recurrence."""

import pytest

from callsight.llm import html

PAGE = '''<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- c <p>no</p> --><div class="ad">Buy</div>
<article><h1>Title &amp; more</h1><p><b>One</b> two<br>three
 four<p>Five&nbsp;six <i>se</i>ven<ul><li>a<li>b</ul><div class="share-buttons">Share</div><aside>Box</aside></article>
<section id="comments"><article class="comment"><p>A reader says a lot, really a lot, more than the article does and more.</p></article></section>
<form>Sign <input> up</form><footer>&copy; x</footer></body></html>'''


def test_article():
    assert html.extract(PAGE) == "Title & more\n\nOne two three four\n\nFive six seven\n\na\n\nb"


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain &lt; text", "plain < text"), ("<p>a<p>b", "a\n\nb"), ("a < b <3 c", "a < b <3 c"),
    ("<div><p>one</div>two</p>", "one\n\ntwo"), ("<article><p>x</article", "x</article"), ("<script>never closed <p>x", ""),
    ("<body><div hidden>h</div><div style='display: none'>i</div><main>m <b>n</main></body>", "m n"),
    ("<body><header>Site</header><article><header><h1>T</h1></header><p>b</p></article>", "T\n\nb"),
    ("<ul><li><a>one</a><li><a>two</a><li><a>three</a></ul><p>text</p>", "text"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"), ("<P CLASS='AD'>x</P><P>y</P>", "y"), ("&am &amp &#233; &eacute;", "&am & é é"),
    ("<p>" * 3000 + "deep" + "<div>" * 3000, "deep"),
])
def test_cases(page, text):
    assert html.extract(page) == text


@pytest.mark.parametrize("page,text", [
    ("<body><div class='site no-sidebar'><article><p>a</p></article></div>", "a"),
    ("<body><div class='content-with-sidebar'><p>a</p></div>", "a"),
    ("<body><div id=sidebar><article><p>a</p></article></div>", "a"), ("<body><div class=widget><p>most of it</p></div><p>b</p>", "most of it\n\nb"),
    ("<article><h2 id='related-work'>Related</h2><section id='comments-on-x'><p>c</p></section><p class=notice>n</p>", "Related\n\nc\n\nn"),
    ("<article>" + "".join(f"<h2 id='{w}'>{w}</h2>" for w in ("share", "header", "social-banner", "promotion", "ad")), "share\n\nheader\n\nsocial-banner\n\npromotion\n\nad"),
    ("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds", "So x=2 holds"),
    ("<div class='left-sidebar'>s</div><div class='cookie-banner'>c</div><section id=comments>d</section><p>The text</p>", "The text"),
    ("<article><p>The long text</p><ul class='share-links'><li>s</ul></article>", "The long text"),
])
def test_names_hide_no_text(page, text):
    assert html.extract(page) == text


def site(spark):
    rows = []
    for k in range(12):
        rows.append((k, f"http://Site.example/p{k}", f"<body><div class=x1><p>All about us</p><p>Since 1999</p></div><div><h2>Story {k}</h2>"
                     f"<p>Text number {k}.</p><p>Shared line.</p></div><div>Read also: story</div></body>"))
    for k in range(12, 30):  # copies of one page count once; its text is no template
        rows.append((k, f"http://copies.example/{k}", "<body><div><p>The same page</p></div></body>"))
    for k in range(30, 40):
        rows.append((k, f"http://art.example/{k}", f"<body><div>Top line</div><article><p>Common passage</p><p>Own {k}</p></article></body>"))
    rows += [(50, None, "<p>x</p>"), (51, "nothing", None), (52, "http://few.example/", "<body><div>Only</div></body>"), (None, "http://few.example/", ""), (52, "http://few.example/", "<body><div>Only</div></body>")]
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")


def test_templates_go(spark):
    got = html.main_text(site(spark))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert len(rows) == 45 and all(r["n_chars"] == len(r["text"]) for r in rows)
    by = {r["page_id"]: r["text"] for r in rows}
    for k in range(12):
        assert by[k] == f"Story {k}\n\nText number {k}."  # outside of an article, a line on every page is template too
    assert all(by[k] == "The same page" for k in range(12, 30))
    assert all(by[k] == f"Common passage\n\nOwn {k}" for k in range(30, 40))
    assert (by[50], by[51], by[52], by[None]) == ("x", "", "Only", "")


def test_no_pages(spark):
    assert html.main_text(site(spark).limit(0)).count() == 0


MENU = "<div class=a7><div>{0}</div><div><a href='/1'>First</a> <a href='/2'>Second</a></div></div>"


def plain_site():
    """Menus, boxes and closing lines without a telling tag or name, in and around articles; every page has its own menu title."""
    rows = []
    for k in range(40):
        box = "<div><b>Join us</b><div>Every week by post</div></div>" if k % 4 == 0 else ""
        rows.append((k, f"https://plain.example/{k}", f"<body>{MENU.format(f'On {k}')}<div class=q><h1>Story {k}</h1><p>Own words {k}.</p>{box}</div><div>All rights kept</div>"))
        rows.append((100 + k, f"https://art.example/{k}", f"<body><article><h1>A {k}</h1><p>Own text of {k}, long enough to matter.</p>{box}<p>Shared passage.</p></article>"))
    rows += [(200 + k, f"https://copy.example/{k}", f"<body><article><div><p>One text on many pages</p></div><p>{k}</p></article>") for k in range(30)]
    return rows


def test_recurrence_decides_without_telling_markup(spark):
    rows = plain_site()
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.main_text(frame).collect()}
    for k in range(40):
        assert got[k] == f"On {k}\n\nStory {k}\n\nOwn words {k}."  # the title is the page's own
        assert got[100 + k] == f"A {k}\n\nOwn text of {k}, long enough to matter.\n\nShared passage."
    for k in range(30):  # most of an article is no template
        assert got[200 + k] == f"One text on many pages\n\n{k}"
    assert {r["page_id"]: r["text"] for r in html.main_text(frame, min_pages=10**6).collect()}[0].startswith("On 0\n\nFirst Second\n\nStory 0")


def test_templates_against_a_recount(spark):
    rows = plain_site() + [(300 + k, "https://plain.example/copy", plain_site()[0][2]) for k in range(5)]
    frame = spark.createDataFrame([(u.split("/")[2], i, h) for i, u, h in rows], "host string, page long, html string")
    found = html.templates(frame.mapInArrow(html._hash_rows, "host string, page long, body long, hash long, shown boolean"), 4, 0.1)
    pages, total = {}, {}
    for _, u, h in rows:
        host = u.split("/")[2]
        total.setdefault(host, set()).add(h)
        for x, _ in html.subtree_hashes(html.parse(h)).values():
            pages.setdefault((host, x), set()).add(h)
    want = {k for k, v in pages.items() if len(v) >= 4 and len(v) >= 0.1 * len(total[k[0]])}
    assert {(r["host"], r["hash"]) for r in found.collect()} == want and len(want) >= 5


def test_hashes_see_content_and_structure_only():
    def top(page):
        root = html.parse(page)
        return html.digests(root)[id(root)]
    assert top("<div class=a><p>x  Y</p></div>") == top("<DIV id='b'><p>X y\n</p></DIV>")
    assert len({top(p) for p in ("<div><p>x</p></div>", "<p><div>x</div></p>", "<div><p>x</p>y</div>", "<div>x<p></p></div>", "<div><p>xy</p></div>")}) == 5


def test_deep_and_large_pages_take_linear_time(spark):
    import time
    deep = "<div>" * 20000 + "text" + "</div>" * 20000
    pages = [deep, deep + "<p>x" * 20000, "<div>" * 20000 + "</b><li>y" * 20000, "<div><a>l</a><a>m</a><a>n</a>" * 8000, "<p>" + "word " * 200000]
    began = time.process_time()
    for page in pages:
        html.extract(page, frozenset([1]))
    assert time.process_time() - began < 10
    assert html.extract(deep) == "text"
