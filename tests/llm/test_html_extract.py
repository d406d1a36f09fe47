"""Main text against hand-made pages, a plain reading of the supplied ones, and odd markup."""

import html as markup
import os
import re
import time

import pytest

from voxquarry.llm import html_extract as hx

SCHEMA = "page_id bigint, url string, html string, text string, path string, host string, votes int"
BODY = ["The first paragraph runs on for quite a while.", "So does the second one, with a comma or two, and an end."]


def extracted(spark, rows, **more):
    df = spark.createDataFrame([(i, u, h, "c", "c", "c", 1) for i, u, h in rows], SCHEMA).repartition(3)
    out = hx.main_text(df, **more)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return sorted(((r.page_id, r.url, r.text) for r in got), key=str)


def paragraphs(texts=BODY):
    return "".join(f"<p>{t}</p>" for t in texts)


LAYOUTS = {
    "article": "<body><nav><a href=x>Home</a></nav><article><h1>Head</h1>%s</article><footer>by us</footer>",
    "div": "<body><div id=top-menu>Home</div><div class='wrap has-sidebar'><h1>Head</h1><div class='entry-content'>%s</div>"
    "<div class=sidebar-1><p>Latest news of the day and more of it.</p></div></div><div class='cookie-notice'>We use cookies</div>",
    "main": "<header><a href=/>Site</a></header><main role=main><header><h1>Head</h1></header>%s<div class=share-buttons>Share</div>"
    "<section id=comments><h2>Comments</h2><article class=comment><p>I do not agree at all with what is written above, not at all.</p></article></section></main>",
    "form": "<form id=aspnetForm><div class=mainMenu><ul><li>One<li>Two</ul></div><div class=story><h1>Head</h1>%s</div><input value=x></form>",
    "table": "<table><tr><td class=leftnav>One<td class=text><h1>Head</h1>%s<tr><td colspan=2 class=copyright>2020</table>",
    "site": "<body class='single has-sidebar'><div id=page><header id=masthead><h1>The site</h1><nav>x</nav></header><div id=content>"
    "<div class=breadcrumb>Home &gt; News</div><article class='post type-post'><header class=entry-header><h1>Head</h1></header>"
    "<div class=entry-content>%s</div><footer>tags</footer></article><div id=comments class=comments-area><ol class=commentlist>"
    "<li><p>I do not agree at all with what is written above, not at all.</p></li></ol></div></div><aside id=secondary>More</aside></div>",
    "numbers": "<div class=c1><a href=1>Home</a><a href=2>News</a></div><div class=c2><h1>Head</h1>%s</div><div class=c3><p>Imprint.</p></div>",
    "ad": "<article><h1>Head</h1><div class=ad>Buy <b>this</b></div>%s<aside>More</aside><script>var a='</p>';</script><style>p{}</style>"
    "<form><label>Your mail</label><input></form></article>",
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layouts(name):
    page = hx.Page("<!DOCTYPE html><html><head><title>Head</title></head>" + LAYOUTS[name] % paragraphs() + "</html>")
    assert page.main_text(None) == "\n".join(["Head", *BODY])
    assert page.main_text(page.path(page.container())) == "\n".join(["Head", *BODY])


def test_blocks_and_references():
    text = "<article><p>a&nbsp;&amp;&lt;b&gt;\n\t c<br>d <i>e</i>f<p>&eacute;&#233;&#x1F600; &unknown; &amp<div>g<ul><li>h<li>i</ul>j</div></p>k<table><tr><td>l<td>m</table></article>"
    assert hx.Page(text).main_text(None) == "a &<b> c d ef\néé\U0001f600 &unknown; &\ng\nh\ni\nj\nk\nl\nm"


def test_consensus(spark):
    """Pages of a host follow the container that most of their text is in; numbers in class names don't matter."""
    page = '<body><div class="post-%d text">%s</div><div class="box"><p>%s</p></div></body>'
    long, short = paragraphs(BODY * 8), "<p>Only a line.</p>"
    rows = [(i, f"https://user@Example.org:80/{i}", page % (i, long, "Other matter.")) for i in range(6)]
    rows += [(10, "http://example.org/a", page % (10, short, "Somebody wrote a lot here. " * 20)), (11, None, page % (11, short, "Somebody wrote a lot here. " * 20))]
    rows += [(12, "http://example.org/b", "<body><p>Another layout.</p></body>"), (13, "http://else.org", page % (1, long, "x"))]
    article = "\n".join(BODY * 8)
    want = [(i, u, article) for i, u, _ in rows[:6]] + [(10, "http://example.org/a", "Only a line.")]
    want += [(11, None, ("Somebody wrote a lot here. " * 20).strip()), (12, "http://example.org/b", "Another layout."), (13, "http://else.org", article)]
    assert extracted(spark, rows) == sorted(want, key=str)


def test_large_table_of_paths(spark, monkeypatch):
    """Paths beyond a broadcast: pages are dealt out under several keys, with the same result."""
    monkeypatch.setattr(hx, "light", lambda df: df)
    rows = [(i, "https://one.org/x", LAYOUTS["div"] % paragraphs()) for i in range(40)] + [(40, None, None), (None, "https://one.org", "<p>a")]
    want = [(i, u, "\n".join(["Head", *BODY])) for i, u, _ in rows[:40]] + [(40, None, ""), (None, "https://one.org", "a")]
    assert extracted(spark, rows, salts=4) == sorted(want, key=str)


def test_odd_pages(spark):
    rows = [(1, "no url", None), (2, "", ""), (None, None, "<"), (4, "http://a.b", "plain text <b>only"), (4, "http://a.b", "plain text <b>only")]
    rows += [(5, "http://a.b/c", "<!-- never closed <p>x"), (6, "http://c", "<p>a<!-->b<!-- c -->d</p></p></div>e"), (7, "http://d", "<script>alert('<p>")]
    rows += [(8, "http://e", "<p title='never closed>x</p><p>y"), (9, "http://f", "1 < 2 <3 & 4"), (10, "http://g", "<![CDATA[x]]><?php y ?></ z>w\x00&#0;&#xD800;")]
    got = extracted(spark, rows)
    assert len(got) == len(rows)
    texts = {(i, t) for i, _, t in got}
    assert {(1, ""), (2, ""), (None, "<"), (4, "plain text only"), (5, ""), (6, "abd\ne"), (7, ""), (9, "1 < 2 <3 & 4")} <= texts
    assert extracted(spark, []) == []


def test_long_and_deep_pages():
    start = time.process_time()
    deep = "<div>" * 20_000 + "text" + "</div>" * 20_000
    assert hx.Page(deep).main_text(None) == "text"
    long = "<article>" + "<p>word " * 100_000 + "</article>"
    assert hx.Page(long).main_text(None).count("\n") == 99_999
    assert hx.Page("<a b='" * 50_000).main_text(None) == "" and hx.Page("<!--" * 100_000).main_text(None) == ""
    assert time.process_time() - start < 20


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="supplied tables are not here")
def test_supplied_pages(spark):
    """All supplied pages keep their text in one article element."""
    from voxquarry.llm import queries

    pages = {r.page_id: r.html for r in queries.table(spark, "/root/testdata/sf0.01", "pages").collect()}
    for r in queries.op11_html_extract(spark, "/root/testdata/sf0.01").collect():
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(markup.unescape(re.sub("<(b|br)>", " ", x)).split()) for x in re.split("</?(?:h1|p)>", body)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)
