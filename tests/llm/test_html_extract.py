import html as html_lib
import re

import numpy as np
import pytest

from gavel.llm import html_extract as ext
from gavel.llm import queries

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def trees(spark):
    return ext.fit_extractor(spark.read.parquet(f"{DATA}/pages.parquet"))


def test_articles_of_all_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = queries.op7_html_extraction(spark, DATA).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search("<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        body = re.sub("<[^>]*>", "", re.sub("</?(?:p|h1|br)[^>]*>", " ", body))
        assert r["text"] == " ".join(html_lib.unescape(body).split())
        assert r["n_chars"] == len(r["text"])


PROSE = ["Thlyouble inesea of the ononedth, and ed shhe was worth less on rein, by the ndwhst of thouinor.",
         "In edston the lyes are a reresh of onnt, and shansh the onin tionly; the ndesat was in tieser.",
         "Er tion the thenti of ntlynd was hested by the onstble, a ththhetion of the ther shtion here."]
BODY = "".join(f"<p>{x}</p>" for x in PROSE * 3)
TEXT = " ".join(PROSE * 3)
NAV = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Sport</a></li></ul>'

LAYOUTS = {
    "main": f"<body><header>Site name</header><nav>{NAV}</nav><main>{BODY}</main><footer>&copy; us</footer></body>",
    "div": f'<body><div class="menu">{NAV}</div><div class="content">{BODY}</div><div class="copyright">(c) us</div></body>',
    "sidebar": f'<body><nav>{NAV}</nav><article>{BODY}<aside>{NAV}</aside></article><div class="sidebar">{NAV}</div></body>',
    "comments": f'<body><article>{BODY}</article><section class="comments"><p>I like this a lot.</p><p>Me too!</p></section></body>',
    "notice": f'<body><div class="cookie notice"><p>We use cookies.</p></div><article>{BODY}</article><form><p>Sign up now</p><input></form></body>',
    "advert": f'<body><article>{BODY}<div class="ad">Buy our things today.</div></article><div class="ad">More things.</div></body>',
    "scripts": f"<head><title>T</title><style>p{{}}</style></head><body><script>var a='</p><p>x';</script><noscript>on</noscript><article>{BODY}</article></body>",
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layouts(trees, name):
    assert ext.main_texts([f"<!DOCTYPE html><html>{LAYOUTS[name]}</html>"], trees) == [TEXT]


def test_parsing():
    def runs(html):
        return [n.text for n in ext._ordered(ext.parse(html)) if n.tag == ext.TEXT]

    assert runs("<p>a<b>b<i>c</b>d<br>e <a href='x>y'>f</a><p>g &amp; h&#233;&copy &am") == ["abcd e f", "g & hé© &am"]
    assert runs("a<!-- <p>b</p> -->c<script>'</p>'</SCRIPT >d<style>p") == ["acd"]
    assert runs("<li>a<li>b<ul><li>c</ul>d<td>e<td>f") == ["a", "b", "c", "d", "e", "f"]
    assert runs("x < y <p class=\"a b>c</p>d") and runs("") == [] and runs(" \n\t") == []
    assert runs("<p>a\n \tb</p>\n<p> c </p>") == ["a b", "c"]
    assert runs('<p title="a < b">hello</p>') == ["hello"]
    assert runs("<img alt='x < y > z'><p title=\"<b>\" id=q>one</p>two") == ["one", "two"]
    assert runs('<p title="open>one <b class="x">two</b></p>') == ["one two"]
    assert runs("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds") == ["so x=2 holds"]
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert runs(deep) == ["x"]


def shown(html):
    return [n.text for n in ext._ordered(ext.parse(html)) if n.tag == ext.TEXT]


@pytest.mark.parametrize("html", [
    "<html><head><title>T</title><meta charset=u><p>article</p>", "<head><title>T</title>article",
    "<head><link rel=x><noscript>on</noscript><div>article</div></head>",
    "<head><script>a</script><a href=x>article</a>", "<head></head><body>article"])
def test_a_head_without_an_end(html):
    assert shown(html) == ["article"]


@pytest.mark.parametrize("tag", ["button", "iframe", "noscript", "select", "object", "svg", "canvas", "map"])
def test_hidden_elements_without_an_end(tag):
    assert shown(f"<div><{tag}></div><p>article</p>") == ["article"]
    assert shown(f"<body><{tag}><p>article</p></body>") == ["article"]
    assert shown(f"<div><{tag}></div><p>article</p><div><{tag}>x</{tag}></div><p>more") == ["article", "more"]
    assert shown(f"<{tag}>x<{tag}/>y</{tag}><p>article") == ["article"]
    assert shown(f"<{tag}>x<{tag}>y</{tag}>z</{tag}><p>article") == ["article"]
    assert shown(f"<{tag}>" * 20_000 + "<p>article") == ["article"]


def test_raw_text_looks_like_markup():
    assert shown("<script>a <!-- b</script><p>article</p>") == ["article"]
    assert shown("<script>if (a <b && c == 'x</script><p>it's an article</p>") == ["it's an article"]
    assert shown("<title>T<p>article</p>") == ["T", "article"]


@pytest.mark.parametrize("tag", ["script", "style", "title", "textarea"])
def test_raw_text_after_letters_that_grow_in_lower_case(tag):
    before = "\u0130stanbul " * 30
    page = f"<article><p>{before}</p><{tag}>var a = '<p>x';</{tag.upper()} ><p>the rest</p></article>"
    assert shown(page) == [before.strip(), "the rest"]
    assert shown(f"<{tag}>a</{tag}x></{tag}\n<p>the rest") == ["the rest"]


def test_dropped_nodes_keep_nothing(trees):
    for html in LAYOUTS.values():
        nodes = ext._ordered(ext.parse(html))
        odds = np.linspace(-3, 3, len(nodes)) * (-1) ** np.arange(len(nodes))
        kept = {id(n) for n in ext.kept_nodes(nodes, odds)}
        assert all(n.parent is None or id(n.parent) in kept for n in nodes if id(n) in kept)


@pytest.mark.parametrize("sizes", [[5], [5, 9], [9, 9, 2], [*range(1, 200)], [*range(1, 301)], [7] * 500])
def test_largest_sibling_whatever_their_number(sizes):
    nodes = ext._ordered(ext.parse("".join(f"<p>{'x' * k}</p>" for k in sizes)))
    found = [row[22] for n, row in zip(nodes, ext.features(nodes)) if n.tag == "p"]
    others = [max(sizes[:i] + sizes[i + 1:], default=0) / k for i, k in enumerate(sizes)]
    assert found == pytest.approx(others)


def test_trees_learn():
    random = np.random.default_rng(0)
    x = random.normal(size=(4000, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = ext.fit_trees(x[:3000], y[:3000])
    assert ((model.log_odds(x[3000:]) > 0) == y[3000:]).mean() > 0.95


def test_defined_cases(spark, trees):
    long = "<body><article>" + "<p>word and word, here.</p>" * 20_000 + "</article></body>"
    rows = [(1, "u", None, "c"), (2, None, "", "c"), (3, "u", "<html></html>", "c"), (4, "u", long, "c"),
            (None, "u", f"<article>{BODY}</article>", "c"), (1, "u", None, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = ext.extract_text(pages, trees)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {(r["page_id"], r["url"]): r for r in out.collect()}
    assert out.count() == 6 and got[1, "u"]["text"] == "" and got[2, None]["n_chars"] == 0
    assert got[4, "u"]["text"].count("word") == 40_000 and got[None, "u"]["text"] == TEXT
    assert ext.extract_text(pages.where("false"), trees).collect() == []
    assert ext.fit_extractor(pages.where("false")) is None
    assert ext.main_texts(["<p>a</p><nav>b</nav>"], None) == ["a b"]
