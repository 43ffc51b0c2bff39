from __future__ import annotations

import html
import re
from collections import Counter

import pytest

from tablewright.llm import html_text as module
from tablewright.llm.catalog import QUERIES
from tests.llm.samples import FOLDER, needs_tables, prose

PAGES = "page_id long, url string, html string"


def page(seed, body):
    return (
        f"<!DOCTYPE html><html><head><title>t{seed}</title><script>var a='<p>no</p>';</script><style>p{{}}</style></head><body class='page sidebar-left'>"
        f"<header><h1>Site</h1></header><nav><ul><li><a href=x>Home {seed}</a><li>More</ul></nav><!-- <p>no</p> -->"
        f"{body}<footer><p>&copy; Site {seed}</p></footer>"
    )


CASES = {
    "article": ("<article><h1>T &amp; U</h1><p>One<br>two <b>three</b>.<p>Four&nbsp;\n five</article>", "T & U\n\nOne two three.\n\nFour five"),
    "parts": (
        "<div class='ad'>Buy</div><article><p>A</p><aside>no</aside><form><p>no</p></form><div class='share-box'>no</div>"
        "<ul><li>B<li>C</ul><section id='comments'><p>no</p></section><table><tr><td>D<td>E</table></article>",
        "A\n\nB\n\nC\n\nD\n\nE",
    ),
    "unclosed": ("<article><p><b>One.<br><p>Two &lt;tag&gt; &#x41;&eacute;<div>Three", "One.\n\nTwo <tag> Aé\n\nThree"),
    "hidden": ("<main><p hidden>no</p><p style='display: none'>no</p><p>Yes 1 < 2</p></main>", "Yes 1 < 2"),
    "quotes": ("<article data-x='a>b' title=\"</article>\"><p>In</p></article>", "In"),
    "none": ("<article></article>", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_single_pages(spark, name):
    body, wanted = CASES[name]
    rows = [(1, "http://one.example/x", page(1, body))]
    assert module.extract_text(spark.createDataFrame(rows, PAGES)).first().text == wanted


def test_texts_of_the_template_go_where_no_element_says_what_the_article_is(spark):
    rows, wanted = [], {}
    for k in range(8):
        own = [" ".join(prose(10 * k + j, 30)) for j in range(3)]
        body = "<div class='x1'><p>Read this first: all rights and so on</p>" + "".join(f"<p>{x}</p>" for x in own) + "</div><div class='x2'><p>Opening hours 9 to 5</p></div>"
        rows.append((k, f"https://user@Shop.example:80/{k}", page(k, body)))
        wanted[k] = "\n\n".join(own)
    found = module.extract_text(spark.createDataFrame(rows, PAGES).repartition(3))
    assert {r.page_id: r.text for r in found.collect()} == wanted


NAMED = {
    "side by side": "<div id=wrap><h1 class=entry-title>{t}</h1><div class=entry-content><p>{a}</p><p>{b}</p></div></div>",
    "shallower title": "<div id=wrap><h1 class=entry-title>{t}</h1><div class=x><div class=entry-content><p>{a}</p><p>{b}</p></div></div></div>",
    "title alone": "<div id=wrap><h1 class=post-title>{t}</h1><div class=x><p>{a}</p><p>{b}</p></div></div>",
    "around": "<div class=main><h1>{t}</h1><div class=x><p>{a}</p><p>{b}</p></div></div>",
    "several bodies": "<div class=wrap><div class=post><h1>{t}</h1></div><div class=story><p>{a}</p></div><div class=content><p>{b}</p></div></div>",
}


@pytest.mark.parametrize("name", NAMED)
def test_elements_named_as_content_keep_title_and_body(spark, name):
    rows, wanted = [], {}
    for k in range(6):
        t, a, b = " ".join(prose(900 + k, 5)), " ".join(prose(1000 + k, 60)), " ".join(prose(1100 + k, 50))
        rows.append((k, f"http://h.example/{k}", page(k, NAMED[name].format(t=t, a=a, b=b) + "<div class=low><p>Imprint</p></div>")))
        wanted[k] = f"{t}\n\n{a}\n\n{b}"
    found = module.extract_text(spark.createDataFrame(rows, PAGES).repartition(3))
    assert {r.page_id: r.text for r in found.collect()} == wanted


BUILT = {
    "page builder": "<div class='elementor-widget elementor-widget-theme-post-content'><div class='elementor-widget-container'><p>{a}</p><p>{b}</p></div></div>",
    "page with a sidebar": "<div id='content' class='has-right-sidebar'><p>{a}</p><p>{b}</p></div>",
    "nothing but a widget": "<div class='widget text'><p>{a}</p><p>{b}</p></div>",
    "comments open": "<div class='hentry post comments-open'><p>{a}</p><p>{b}</p></div>",
    "long comments": "<div class='text'><p>{a}</p><p>{b}</p></div><div id='post-comments'><p>{c}</p></div>",
    "a related box": "<div class='text'><p>{a}</p><p>{b}</p></div><div class='related-posts widget'><p>Read {k} too</p></div>",
    "a small content box": "<div class='text'><p>{a}</p><p>{b}</p></div><div class='sidebar content'><p>Box {k}</p></div>",
}


@pytest.mark.parametrize("name", BUILT)
@pytest.mark.parametrize("pages", [1, 7])
def test_names_alone_lose_no_article(spark, name, pages):
    rows, wanted = [], {}
    for k in range(pages):
        a, b, c = (" ".join(prose(x + k, n)) for x, n in ((2000, 60), (2100, 50), (2200, 900)))
        rows.append((k, f"http://b.example/{k}", page(k, BUILT[name].format(a=a, b=b, c=c, k=k))))
        wanted[k] = f"{a}\n\n{b}"
    found = module.extract_text(spark.createDataFrame(rows, PAGES).repartition(2))
    assert {r.page_id: r.text for r in found.collect()} == wanted


def test_adverts_of_the_template_inside_articles_go(spark):
    rows, wanted = [], {}
    for k in range(8):
        a, b = " ".join(prose(3000 + k, 60)), " ".join(prose(3100 + k, 50))
        body = f"<article><p>{a}</p><div class='zz9'>Buy our book now, half price</div><p>{b}</p></article>"
        rows += [(k, f"http://a.example/{k}", page(k, body))] * (1 + k % 2)  # a page given twice is no other page
        wanted[k] = f"{a}\n\n{b}"
    found = module.extract_text(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    assert len(found) == len(rows) and {r.page_id: r.text for r in found} == wanted


def test_a_page_repeated_over_a_host_keeps_its_article(spark):
    rows = [(k, "http://h.example/", page(0, CASES["article"][0])) for k in range(6)]
    found = module.extract_text(spark.createDataFrame(rows, PAGES))
    assert {r.text for r in found.collect()} == {CASES["article"][1]}


def test_awkward_rows(spark):
    rows = [
        (1, None, None),
        (2, "", ""),
        (None, "no host", "just text &amp; more"),
        (3, "http://h.example", "<"),
        (4, "http://h.example", "<p"),
        (5, "http://h.example", "<!-- open <p>x"),
        (6, "http://h.example", "<script>" + "x" * 200_000),
        (7, "http://h.example", "<article>" + "<div>" * 2_000 + "deep"),
        (8, "http://h.example", "</p></div><p>stray</p>" + "<p>" * 3),
        (8, "http://h.example", "</p></div><p>stray</p>" + "<p>" * 3),
        (9, "http://h.example", "<p title='open>x</p>"),
    ]
    frame = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS host", "2 AS region", "3 AS fixed", "4 AS text", "5 AS of")
    found = Counter((r.page_id, r.text) for r in module.extract_text(frame).collect())
    assert sum(found.values()) == len(rows)
    assert found[1, ""] == found[2, ""] == found[None, "just text & more"] == found[5, ""] == found[6, ""] == 1
    assert found[7, "deep"] == 1 and found[8, "stray"] == 2
    assert module.extract_text(spark.createDataFrame([], PAGES)).collect() == []


@needs_tables
def test_query(spark):
    """Against the articles' elements cut out by pattern, which these pages allow."""
    source = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    found = QUERIES["op6_html_text"](spark, FOLDER).collect()
    assert len(found) == len(source)
    for row in found:
        inner = re.search("(?s)<article>(.*?)</article>", source[row.page_id])[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert row.text == "\n\n".join(filter(None, blocks)) and row.n_chars == len(row.text)
