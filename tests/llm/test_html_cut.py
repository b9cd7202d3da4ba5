"""Pages where names do not decide: what the classifier, the smoothness edges and the cut each do. Blocks of content are marked `c`, boilerplate `b`."""

import re
import time
from collections import Counter

import pytest

from trellis.llm import html_extract

LONG = "This paragraph has many plain words in it, tells a part of the story, and ends as sentences do."
MENU = "".join(f"<li data-k=b><a href=/{w}>{w.title()}</a></li>" for w in "home news sport work shop help".split())
PAGES = {
    "no article": f"<div><ul>{MENU}</ul></div><div><p data-k=c>{LONG}</p><p data-k=c>Indeed</p><p data-k=c>{LONG}</p></div><div><a data-k=b href=/>Top</a></div>",
    "wrapped": f"<div class='with-sidebar'><div class='content has-comments'><p data-k=c>{LONG}</p><p data-k=c>No</p><p data-k=c>{LONG}</p></div><div class=sidebar><p data-k=b>Look at this</p></div></div>",
    "layout name": f"<div class='sidebar-right'><p data-k=c>{LONG}</p><p data-k=c>{LONG}</p><p data-k=c>Yes</p><p data-k=c>{LONG}</p></div><div class=banner><p data-k=b>Our new shop is open.</p></div>",
    "sponsored": f"<article class='post sponsored'><h1 data-k=c>A title of words</h1><p data-k=c>{LONG}</p><p data-k=c>Short</p><p data-k=c>{LONG}</p></article><footer><p data-k=b>{LONG}</p></footer>",
    "strays": f"<article><p data-k=c>{LONG}</p><div class=ad><p data-k=b>{LONG}</p></div><p data-k=c>On</p><aside><p data-k=b>{LONG}</p></aside><p data-k=c>{LONG}</p><section id=comments><article><p data-k=b>{LONG}</p></article></section></article>",
    "no end of head": f"<html><head><meta charset=utf-8><title>t</title><script>x</script><body><nav><ul>{MENU}</ul></nav><article><p data-k=c>{LONG}</p><p data-k=c>End</p></article></html>",
    "no head at all": f"<title>t</title><link rel=x><p data-k=c>{LONG}</p><p data-k=c>{LONG}</p>",
    "comments without article": f"<div class=story><p data-k=c>{LONG}</p></div><div id=comments>" + f"<p data-k=b>{LONG}</p>" * 30 + "</div>",
}


def labelled(page, mark):
    return " ".join(re.sub("<[^>]*>", "", x) for x in re.findall(rf"data-k={mark}[^>]*>(.*?)(?=<[^/]|</(?:p|a|li|h1)>)", page) if x)


@pytest.mark.parametrize("name", PAGES)
def test_labelled_pages(name):
    page = PAGES[name]
    assert html_extract.extract(page) == labelled(page, "c")


@pytest.mark.parametrize("name", ["no article", "layout name"])
def test_smoothness_decides(name):
    """Without its edges the classifier loses short lines; the cut is right with them."""
    page = PAGES[name]
    alone = html_extract.extract(page, 0.0, 0.0)
    assert alone != html_extract.extract(page) == labelled(page, "c") and len(alone) < len(labelled(page, "c"))


def test_flow_runs_on_ordinary_pages(monkeypatch):
    asked = []
    cut = html_extract.minimum_cut
    monkeypatch.setattr(html_extract, "minimum_cut", lambda s, t, e: asked.append((s, t, e)) or cut(s, t, e))
    for page in PAGES.values():
        html_extract.extract(page)
    mixed = [q for q in asked if {a > b for a, b in zip(q[0], q[1], strict=True)} == {True, False} and q[2]]
    assert len(mixed) >= len(PAGES) - 2


@pytest.mark.parametrize(
    "page",
    ["<div>" * 8_000 + "</b>" * 8_000, "<b>" * 8_000 + "<p>x</p>" * 8_000, "<article>" + "".join(f"<p>{LONG if i % 3 else 'Ok'}</p><div class=ad>x</div>" for i in range(4_000)), "<p>word " * 20_000],
)
def test_large_pages_take_linear_time(page):
    began = time.time()
    html_extract.extract(page)
    assert time.time() - began < 4


def test_text_before_any_element_ends_the_head():
    assert html_extract.extract(f"<head><title>t</title> {LONG}<p>{LONG}") == f"{LONG} {LONG}"
    assert html_extract.extract("<form><p>" + LONG + "</form>") == "" == html_extract.extract("<head><style>p</style></head>")


def test_a_trailing_slash_closes_foreign_elements_only():
    """Scripts run to their end tag whatever their tag ends in, unquoted addresses may end in a slash, and an empty drawing hides nothing."""
    page = f"<article><p>{LONG}</p><script src='a.js'/>var x = 1; {LONG}</script><svg/><p>{LONG}</p><div/><p>{LONG}</p></article>"
    blocks, _ = html_extract.blocks_of(page)
    assert [b.text for b in blocks] == [LONG] * 3 and html_extract.extract(page) == " ".join([LONG] * 3)
    links, _ = html_extract.blocks_of("<p><a href=/sport/>All the sport</a></p>")
    assert links[0].linked == len("All the sport")


def _bare(page):
    page = re.sub(r"<(/?)(article|nav|aside|footer|header|main|section|h[1-6])\b[^>]*>", r"<\1div>", page)
    return re.sub(r"""\s(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", "", page)


def _f1(got, true):
    a, b = Counter(got.split()), Counter(true.split())
    return 2 * (a & b).total() / ((a.total() + b.total()) or 1)


def test_fitted_weights_on_held_out_pages_without_names(spark):
    """Weights are learned from half of the pages; on the other half, stripped of all names, they give a better token F1 than the stated ones."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = html_extract.fit_weights(pages.filter("page_id % 2 = 0"))
    assert weights.keys() == html_extract.TEXT_WEIGHTS.keys()
    held_out = [r["html"] for r in pages.filter("page_id % 2 = 1").collect() if r["html"]]
    score = lambda w: sum(_f1(html_extract.extract(_bare(p), text_weights=w), html_extract.extract(p)) for p in held_out) / len(held_out)
    assert score(weights) > score(html_extract.TEXT_WEIGHTS)


def test_fit_weights_fall_back(spark):
    none = spark.createDataFrame([], "page_id long, html string")
    assert html_extract.fit_weights(none) == dict(html_extract.TEXT_WEIGHTS)
    only_content = spark.createDataFrame([(1, "<article><p>" + "word " * 30 + "</p></article>")] * 5, "page_id long, html string")
    assert html_extract.fit_weights(only_content) == dict(html_extract.TEXT_WEIGHTS)
