"""Main text of pages against the known article."""

import html as H
import os
import re

import pytest

from arborel.llm.html_extract import Weights, extract, fit_weights, main_text

DATA = "/root/testdata/sf0.01"
WORDS = "ouea and the onsh in anst of erwh he edly with this"


def fitted(spark, sf):
    folder = f"/root/testdata/{sf}"
    return Weights() if sf == "priors" else fit_weights(spark.read.parquet(f"{folder}/pages.parquet"))


@pytest.fixture(scope="module", params=["priors", "sf0.01", "sf0.1"])
def weights(spark, request):
    """Priors alone and weights fitted on the tables' pages."""
    if request.param != "priors" and not os.path.isdir(f"/root/testdata/{request.param}"):
        pytest.skip("needs the driver's tables")
    return fitted(spark, request.param)


def page(body, head="", tail=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p><p>no';</script></head><body>{head}{body}{tail}</body></html>"


PARAS = [f"Para {i} &amp; {WORDS}. {WORDS}." for i in range(6)]
WANT = "\n".join(H.unescape(p) for p in PARAS)
INNER = "".join(f"<p>{p}</p>" for p in PARAS)
NAV = '<nav><ul><li><a href="/a">Home page here</a><li><a href="/b">About us and more</a></ul></nav><div class="cookie-notice">We use cookies on this site to serve you better.</div>'
FOOT = f'<div id="comments"><p>{WORDS} first comment.</p><p>{WORDS} second.</p></div><footer><p>&copy; 2020 all rights of the owner reserved, {WORDS}.</p></footer>'


@pytest.mark.parametrize("body", [f"<article>{INNER}</article>", f"<main>{INNER}</main>", f"<div class='content'>{INNER}</div>", f"<div>{INNER}</div>", INNER.replace("</p>", "")])
def test_templates_and_priors(body):
    assert extract(page(body, NAV, FOOT), Weights()) == WANT


def test_inner_boilerplate_goes_and_order_stays():
    ad = f'<div class="ad"><p>Buy now {WORDS}</p></div><form><label>Mail to us please</label><input name=x></form><aside>{WORDS} and more aside</aside>'
    body = "<article>" + "".join(f"<p>{p}</p>{ad}" for p in PARAS) + "</article>"
    assert extract(page(body, NAV, FOOT), Weights()) == WANT


def test_text_rules():
    body = "<article><h1>A  title\n of&nbsp;it</h1><p>one<br>two <b>th</b>ree &lt;x&gt; &#233; &unknown; a < b</p><ul><li>first item<li>second item</ul><pre>x\n  y</pre></article>"
    assert extract(page(body), Weights()) == "A title of it\none two three <x> é &unknown; a < b\nfirst item\nsecond item\nx y"


@pytest.mark.parametrize("end", ["End.", "It is over now."])
@pytest.mark.parametrize("notice", [f"<aside>ad of today</aside>", f'<div class="ad"><p>Buy now {WORDS} {WORDS}</p></div>', f"<form><label>Mail to us please</label></form><aside>{WORDS} {WORDS}</aside>"])
@pytest.mark.parametrize("box", ["article", "main", "div class='content'", "div class='story x'"])
def test_short_last_blocks_after_notices(box, notice, end):
    body = f"<{box}>{INNER}{notice}<p>{end}</p></{box.split()[0]}>"
    assert extract(page(body, NAV, FOOT), Weights()) == f"{WANT}\n{end}"


def test_subject_words_in_classes_of_paragraphs():
    mixed = f'<p class="legal">{PARAS[0]}</p><h2 id="sharing">Of sharing</h2><div class="legal"><p>{WORDS} terms</p></div><p class="advert">{PARAS[1]}</p><p>{PARAS[2]}</p>'
    want = f"{H.unescape(PARAS[0])}\nOf sharing\n{H.unescape(PARAS[2])}"
    assert extract(page(f"<article>{mixed}</article>", NAV, FOOT), Weights()) == want
    assert extract(page(f"<article>{INNER}</article>", NAV, f'<div><p class="legal">{WORDS} {WORDS}</p></div>'), Weights()) == WANT


CODE = [
    "<script>for(var i=0;i<n;i++){x()}</script>", "<style>a<b{c:'}</style>", "<SCRIPT>if(a<b)s='it\"s'</Script >", "<textarea>it's <b' \"</textarea>",
    "<script>x='</scripty>'; i<n</script>", "<script><!-- w('<script>i<n</script>') --></script>", "<script><!--> i<n</script>", "<noscript><img alt='></noscript>",
]


@pytest.mark.parametrize("code", CODE)
def test_code_is_not_cut_into_tags(code):
    body = "<article>" + "".join(f"<p>{p}</p>{code}" for p in PARAS) + "</article>"
    assert extract(page(body, NAV, FOOT), Weights()) == WANT
    for end in ("</head><body>", "</head>", "<body>", ""):
        assert extract(f"<html><head><title>a <b' c</title>{code if 'textarea' not in code else ''}<meta x=y>{end}{body}</html>", Weights()) == WANT


def test_head_without_end_tag():
    for start in ("<div>", "<span>", "<P>", ""):
        assert extract(f"<head><meta charset=x><template><p>{WORDS}</p></template><title>T</title>\n{start}{PARAS[0]} {PARAS[1]}", Weights()) == f"{WANT.splitlines()[0]} {WANT.splitlines()[1]}"
    assert extract(f"<head><title>T</title><script>never closed <p>{WORDS}</p>", Weights()) == ""


@pytest.mark.parametrize("odd", [None, "", "   ", "<", "<p", "<!-- never closed", "<script>alert(1)", "</p></p>", "<a href='x>y", '<div class="a > b">', "<nav><a href=x>menu here</a></nav>"])
def test_odd_pages_give_nothing(odd):
    assert extract(odd, Weights()) == ""


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_every_page_of_the_table(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: r for r in main_text(pages, fit_weights(pages)).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        blocks = re.split(r"</?(?:p|h1)>", inner)
        blocks = [" ".join(H.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["div", "section", "div class='x1'"])
def test_pages_without_their_mark(spark, name):
    """The table's pages with <article> renamed, by weights fitted on the marked ones."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    weights, wrong, rows = fit_weights(pages), 0, pages.collect()
    for r in rows:
        bare = r.html.replace("<article>", f"<{name}>").replace("</article>", f"</{name.split()[0]}>")
        wrong += extract(bare, weights) != extract(r.html, weights)
    assert wrong <= 0.02 * len(rows)


def test_table_edges(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "y"), (2, "u", page(f"<article>{INNER}</article>"), "z")], "page_id long, url string, html string, text string")
    rows = sorted((r.page_id, r.text) for r in main_text(df, fit_weights(df)).collect())
    assert rows == [(1, ""), (2, ""), (2, WANT)]
    assert main_text(df.limit(0), fit_weights(df.limit(0))).count() == 0


def test_very_long_page():
    big = "<article>" + f"<p>{PARAS[0]}</p>" * 20_000 + "</article>"
    assert extract(page(big, NAV, FOOT), Weights()).count("\n") == 19_999


BOXES = {
    "comments": f'<section class="comments"><p>{WORDS} said one reader, {WORDS}.</p><p>{WORDS}</p></section>',
    "comment ids": f'<div id="comments"><ol class="commentlist"><li><p>{WORDS} {WORDS}</p></li></ol></div>',
    "disqus": f'<div id="disqus_thread"><p>{WORDS} {WORDS}</p></div>',
    "aside": f"<aside><h2>By the way and more</h2><p>{WORDS} {WORDS}</p></aside>",
    "nav": f'<nav><ul><li><a href="/a">Home page of the site</a></li><li>{WORDS}</li></ul></nav>',
    "advert p": f'<p class="advert">Buy this now, {WORDS} {WORDS}</p>',
    "advert div": f'<div class="ad-banner"><p>Buy this now, {WORDS} {WORDS}</p></div>',
    "sponsored": f'<div class="post sponsored"><p>{WORDS} {WORDS}</p></div>',
    "newsletter": f'<div class="newsletter"><p>Get our letter, {WORDS} {WORDS}</p></div>',
    "cookies": f'<div class="cookie-notice"><p>We use cookies, {WORDS} {WORDS}</p></div>',
    "related": f'<div class="related"><article><h3>Other news of the day</h3><p>{WORDS} {WORDS}</p></article></div>',
    "sidebar": f'<div id="sidebar"><p>{WORDS} {WORDS}</p></div>',
    "footer": f"<footer><p>All rights reserved, {WORDS} {WORDS}</p></footer>",
    "header": f"<header><p>Masthead of the paper, {WORDS}</p></header>",
    "form": f"<form><p>Send us your mail, {WORDS}</p><label>Your name please</label></form>",
    "role": f'<div role="complementary"><p>{WORDS} {WORDS}</p></div>',
}


@pytest.mark.parametrize("place", ["between", "before", "after", "outside"])
@pytest.mark.parametrize("box", ["article", "main", "div class='content'", "div"])
@pytest.mark.parametrize("name", sorted(BOXES))
def test_boilerplate_goes_with_any_weights(weights, name, box, place):
    parts = [f"<p>{p}</p>" for p in PARAS]
    tail = ""
    if place == "between":
        inner = BOXES[name].join(parts)
    else:
        inner = {"before": BOXES[name], "after": "", "outside": ""}[place] + "".join(parts) + (BOXES[name] if place == "after" else "")
        tail = BOXES[name] if place == "outside" else ""
    assert extract(page(f"<{box}>{inner}</{box.split()[0]}>{tail}", NAV, FOOT), weights) == WANT


def test_content_stays_with_any_weights(weights):
    rich = (
        f'<article><h1>Of the title</h1><p>{WORDS} <a href="/x">with a link to that</a>, {WORDS}.</p><ul><li>first item</li><li><a href="/y">second</a> item</li></ul>'
        f"<blockquote>{WORDS}</blockquote><table><tr><td>cell one</td><td>cell two</td></tr></table><pre>code here</pre><h2>Next</h2><p>Short.</p></article>"
    )
    want = f"Of the title\n{WORDS} with a link to that, {WORDS}.\nfirst item\nsecond item\n{WORDS}\ncell one\ncell two\ncode here\nNext\nShort."
    for body in (rich, rich.replace("article>", "main>"), f'<div class="wrap">{rich}</div>'):
        assert extract(page(body, NAV, FOOT), weights) == want


def test_bad_names_around_labelled_articles_are_learned(spark):
    """A layout class with a bad word around every labelled article is no boilerplate there; a comment box inside still is."""
    rows = [(i, page(f'<div class="sidebar-layout"><article>{INNER}{BOXES["comments"]}</article></div>', NAV, FOOT)) for i in range(60)]
    learned = fit_weights(spark.createDataFrame(rows, "page_id long, html string"))
    assert all(extract(html, learned) == WANT for _, html in rows[:3])
