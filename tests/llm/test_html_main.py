import html
import re
import time

import pytest

from tracelode.llm import html_main


def truth(page):
    """The text of the article element of the test pages, by plain string work."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|br)\b[^>]*>", body)
    return " ".join(t for p in parts if (t := " ".join(html.unescape(re.sub(r"<[^>]+>", "", p)).split())))


def test_pages_give_their_article(spark, data):
    pages = {r.page_id: r for r in spark.read.parquet(f"{data}/sf0.01/pages.parquet").collect()}
    rows = html_main.op3_html_extraction(spark, f"{data}/sf0.01").collect()
    assert len(rows) == len(pages)
    wrong = [r.page_id for r in rows if r.text != truth(pages[r.page_id].html)]
    assert not wrong, (wrong[:5], [(r.text, truth(pages[r.page_id].html)) for r in rows if r.page_id in wrong[:1]])
    assert all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in rows)


LONG = "A sentence, with commas, that goes on for a while. Another one follows it; then a third!"


def test_structures():
    page = f"""<html><head><title>t</title></head><body><header><a href=x>Home</a></header>
    <div id="cookie-notice">We use cookies, please accept. It is good, really.</div>
    <div class='content'><h1>Head</h1><p>{LONG}<p>{LONG} <b>bo</b>ld &amp; x&nbsp;y<form>Name: <input value=">"></form>
    <ul><li>point one<li>point two</ul><!-- <p>no</p> --><section class="comments"><p>{LONG} I say.</p></section></div>
    <aside><p>{LONG}</p></aside><footer>{LONG}</footer></body></html>"""
    assert html_main.main_text(page) == f"Head {LONG} {LONG} bold & x y point one point two"
    assert html_main.main_text(f"<body><nav><ul><li><a>one</a><li><a>two</a></ul></nav><p>{LONG}</p><p>{LONG}</p><div>x</div></body>") == f"{LONG} {LONG}"
    assert html_main.main_text("just text &lt;b&gt;") == "just text <b>"
    for odd in (None, "", "<", "<p", "<p>", "</p></p>", "<script>x", "<!-- ", "<a href='>", "<nav>only</nav>"):
        assert html_main.main_text(odd) in ("", "<", "<p", "<a href='>")


def test_edge_rows(spark):
    rows = [(1, "u", None, "x"), (2, "u", "", "x"), (3, "u", f"<p>{LONG * 5000}</p>", None), (3, "u", f"<p>{LONG * 5000}</p>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.n_chars) for r in html_main.extract(pages).collect()) == [(1, 0), (2, 0), (3, len(LONG) * 5000), (3, len(LONG) * 5000)]
    assert html_main.extract(pages.limit(0)).count() == 0


def test_title_and_lead_beside_the_body_stay_at_any_length():
    for n in (1, 3, 10, 100):
        body = "".join(f"<p>{LONG}</p>" for _ in range(n))
        text = " ".join([LONG] * n)
        nav = "<nav><a href=x>Home</a></nav>"
        assert html_main.main_text(f"<body>{nav}<article><h1>Title</h1><div>{body}</div></article></body>") == f"Title {text}"
        assert html_main.main_text(f"<body>{nav}<article><header><h1>Title</h1><p>Lead.</p></header><div>{body}</div></article></body>") == f"Title Lead. {text}"
        assert html_main.main_text(f"<body>{nav}<main><h1>Title</h1><section><div>{body}</div></section><p>End.</p></main></body>") == f"Title {text} End."
        assert html_main.main_text(f"<body>{nav}<h1>Title</h1><div>{body}</div></body>") == f"Title {text}"


def test_parts_of_other_kinds_inside_an_article_go():
    for name in ("post-comments", "article-sidebar", "main-newsletter", "entry-footer", "content-ads", "story_share"):
        other = f'<div class="{name}"><p>Nice post, bob says hello! {LONG}</p></div>'
        page = f"<body><article><h1>Title</h1><p>{LONG}</p>{other}<p>{LONG}</p></article></body>"
        assert html_main.main_text(page) == f"Title {LONG} {LONG}", name
    links = "".join(f"<li><a href=x>Another story {i}</a></li>" for i in range(8))
    assert html_main.main_text(f"<body><article><h1>Title</h1><p>{LONG}</p><ul>{links}</ul><p>{LONG}</p></article></body>") == f"Title {LONG} {LONG}"
    for name in ("post-header", "content-sidebar-wrap", "has-sidebar"):
        assert html_main.main_text(f'<body><div class="{name}"><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div></body>') == f"Title {LONG} {LONG}", name


def test_pages_without_an_article_element():
    menu = "".join(f"<li><a href=/{i}>Section {i}</a></li>" for i in range(12))
    for wrap in ("<div id=page><div class=text>{}</div></div>", "<table><tr><td>{}</td></tr></table>", "<div><div><section>{}</section></div></div>"):
        body = "".join(f"<p>{LONG} Part {i} ends here.</p>" for i in range(6))
        page = f"<html><body><ul>{menu}</ul><div class=ad>Buy now!</div>{wrap.format('<h2>Head</h2>' + body)}<div class=legal>All rights.</div></body></html>"
        assert html_main.main_text(page) == "Head " + " ".join(f"{LONG} Part {i} ends here." for i in range(6)), wrap


@pytest.mark.parametrize("unit, n", [("<div>x", 5000), ("<x>y", 5000), ("<a href=\"", 20_000), ("<p title='", 20_000), ("</y>", 20_000), ("<!x", 20_000), ("<p>x</b>", 5000), ("<script</script", 5000), ("<td><p>x", 5000)])
def test_odd_pages_are_read_in_linear_time(unit, n):
    took = []
    for k in (n // 4, n):
        began = time.perf_counter()
        html_main.main_text("<div>" * (2000 if unit == "</y>" else 1) + unit * k)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_unclosed_quotes_and_quotes_in_values():
    assert html_main.main_text(f"<p class=it's>{LONG}</p><p title='a > b'>{LONG}</p>") == f"{LONG} {LONG}"
    assert html_main.main_text(f'<p title="open>{LONG}</p>') == LONG
    assert html_main.main_text("<p>" + LONG + " 1 < 2 and a <b") == LONG + " 1 < 2 and a <b"


def test_marked_parts_inside_an_article_go_whatever_layout_words_they_have():
    for name in ("comments-container", "comments-wrap", "sidebar-wrapper", "with-sidebar", "ad-container", "cookie-wrapper", "nav-container", "related", "share login"):
        other = f'<div class="{name}"><p>{LONG}</p></div>'
        for body in (f"<article><h1>Title</h1><p>{LONG}</p>{other}<p>{LONG}</p></article>", f"<div><h1>Title</h1><p>{LONG}</p>{other}<p>{LONG}</p></div>"):
            assert html_main.main_text(f"<body><nav><a href=x>Home</a></nav>{body}</body>") == f"Title {LONG} {LONG}", name


def test_articles_stay_whatever_their_class_says():
    text = " ".join([LONG] * 4)
    body = f"<p>{LONG}</p>" * 4
    for name in ("entry-content search", "post related", "story alert", "content legal", "login-guide", "share-price", "notice-period-article", "copyright-law", "content-sidebar-wrap", "no-sidebar", "comments-container"):
        for page in ('<h1>Title</h1><div class="{}">{}</div>', '<div class="{}"><h1>Title</h1>{}</div>', '<article><h1>Title</h1><div class="{}">{}</div></article>', '<h1>Title</h1><div class="{0}"><div class="{0}">{1}</div></div>'):
            around = "<nav><a href=x>Home</a></nav>{}<div class=ad>Buy it now!</div><footer>All rights, reserved.</footer>"
            assert html_main.main_text(f"<body>{around.format(page.format(name, body))}</body>") == f"Title {text}", (name, page)


def test_marks_inside_a_void_one_count():
    page = f'<body><div class="layout with-sidebar"><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><div class="sidebar"><p>{LONG}</p></div><div class="comments"><p>{LONG * 3}</p></div></div></body>'
    assert html_main.main_text(page) == f"Title {LONG} {LONG}"
    assert html_main.main_text(f"<body><form action=x><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></form></body>") == f"Title {LONG} {LONG} {LONG}"


def test_long_comments_do_not_replace_a_short_article():
    assert html_main.main_text(f'<body><div class=text><h1>Title</h1><p>{LONG}</p></div><div class=comments>{f"<p>{LONG}</p>" * 12}</div></body>') == f"Title {LONG}"
    assert html_main.main_text('<body><nav><a>Home</a></nav><div class="cookie-banner">We use cookies, as you know. Accept them.</div></body>') == ""


def test_lists_of_linked_sources_stay():
    sources = "".join(f"<li><a href=/{i}>Author, A. ({2000 + i}): On the matter, part {i}. A journal.</a></li>" for i in range(4))
    want = " ".join(f"Author, A. ({2000 + i}): On the matter, part {i}. A journal." for i in range(4))
    assert html_main.main_text(f"<body><article><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><h2>Sources</h2><ol>{sources}</ol></article></body>") == f"Title {LONG} {LONG} Sources {want}"


def test_pages_without_an_article_element_by_ratios():
    menu = "".join(f"<div><a href=/{i}>Section {i}</a></div>" for i in range(9))
    teasers = "".join(f"<div><a href=/t{i}>Read about thing {i}</a></div>" for i in range(9))
    paras = [f"{LONG} Part {i}, it ends here." for i in range(5)]
    for wrap in ("<div>{}</div>", "<section><div>{}</div></section>", "<table><tr><td>{}</table>", "{}"):
        for block in ("<p>{}</p>", "<div>{}</div>"):
            page = f"<body><div>{menu}</div>{wrap.format(''.join(block.format(p) for p in paras))}<div>{teasers}</div></body>"
            assert html_main.main_text(page) == " ".join(paras), (wrap, block)
