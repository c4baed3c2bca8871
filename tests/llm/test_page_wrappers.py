"""Pages whose wrappers, names or open tags once hid the text; header names that differ in case only."""

import pytest
from pyspark.sql import functions as F

from askbase.llm import extract, warc

MENU = "<nav><a href=x>Home</a></nav>"


@pytest.mark.parametrize("html", [
    '<div class="content no-sidebar"><article><p>The text.</p></article></div>',
    '<div id="page" class="site has-menu"><main><p>The text.</p></main></div>',
    '<article><p id="related-work">The text.</p></article>',
    '<article><p class="market-share">The text.</p></article>',
    '<div class="menu"><article><p>The text.</p></article></div>',
    '<nav><a href=x>Home</a><article><p>The text.</p></article>',
    '<svg><path d="M0"><main><p>The text.</p></main>',
    f'{MENU}<div class="sidebar-left"><p>Links</p></div><main><p>The text.</p></main><div id="footer">End</div>',
    '<article><p>The text.</p><div class="share-buttons">Share</div><div class="ad-slot-3">Buy</div></article>',
    '<article><p>The text.</p><div class="related posts"><p>More</p></div></article>',
    '<aside><article><p>Teaser</p></article></aside><article><p>The text.</p></article>',
    '<article><p>The text.</p><article class="comment"><p>First!</p></article></article>',
])
def test_text_of_wrapped_pages(html):
    for page in (html, f"<html><head><title>T</title></head><body>{MENU}{html}</body></html>"):
        assert extract.main_lines(extract.lines_of(page), set()) == ["The text."]


def test_nothing_but_furniture():
    assert extract.main_lines(extract.lines_of(MENU + "<footer>End</footer>"), set()) == []


def test_header_names_that_differ_in_case(spark):
    rows = [({"ETag": "a", "X": "1"},), ({"ETag": "a", "etag": "b", "Vary": None},), (None,), ({},)]
    got = spark.createDataFrame(rows, "h map<string,string>").select(warc.lower_names(F.col("h")).alias("h")).collect()
    assert got[0].h == {"etag": "a", "x": "1"} and got[1].h["etag"] in ("a", "b") and got[1].h["vary"] is None
    assert got[2].h == {} and got[3].h == {}
