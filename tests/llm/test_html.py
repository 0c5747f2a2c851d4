"""Main text of pages: the window scan against a plain one, and what classes and links do."""

import random

import pytest

pytest.importorskip("codefacts.llm")
from pyspark.sql import functions as F  # noqa: E402

from codefacts.llm import html_text, queries  # noqa: E402

LONG = "This paragraph is certainly long enough to make the window of lines surge by itself alone. "


def plain_regions(size, surge):
    """By the definition: a line is in a region from a line with text whose window reaches ``surge``
    to the first whose window is empty."""
    window = [sum(size[k : k + html_text.WINDOW]) for k in range(len(size))]
    kept, inside = [], False
    for k, s in enumerate(window):
        inside = s > 0 if inside else size[k] > 0 and s >= surge
        if inside:
            kept.append(k)
    return kept


def test_regions_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        size = [rng.choice([0, 0, 0, 5, 15, 25, 70]) for _ in range(rng.randrange(25))]
        lines = [(str(k), 0, True) for k in range(len(size))]
        want = plain_regions(size, html_text.SURGE)
        assert html_text.regions(lines, size, html_text.SURGE, True) == [str(k) for k in want]
        assert html_text.regions(lines, size, html_text.SURGE, False) == [str(k) for k in want if size[k]]


@pytest.mark.parametrize("marked", ["article", "div"])
@pytest.mark.parametrize("words", ["ad-hoc", "tags-of-war", "social history", "adverse", "shared", "searchlight"])
def test_words_that_only_look_like_noise(marked, words):
    page = f'<body><{marked}><p>{LONG}</p><p class="{words}">{LONG}Second.</p><p>Third. {LONG}</p></{marked}></body>'
    assert html_text.main_text(page).split("\n\n") == [LONG.strip(), f"{LONG}Second.", f"Third. {LONG}".strip()]


@pytest.mark.parametrize("junk", [
    '<div id="reader-responses"><p>{0}</p></div>', '<section class="comments">{0}</section>', '<ul class="site-footer"><li>{0}</li></ul>', '<div class="cookie-banner">{0}</div>',
    '<div class="x7 newsletter">Sign up now.</div>', '<p class="ad">{0}</p>', '<div class="c1 related"><a href="/">{0}</a> more</div>', '<div hidden>{0}</div>',
])
@pytest.mark.parametrize("marked", ["main", "div"])
def test_noise(junk, marked):
    page = f"<body><{marked}><h1>Title</h1><p>{LONG}</p>{junk.format(LONG)}<p>End.</p></{marked}></body>"
    assert html_text.main_text(page).split("\n\n") == ["Title", LONG.strip(), "End."]


def test_the_lines_decide():
    """In a marked article a list of links is a dive, a lone link is not; short lines surge together."""
    links = "".join(f'<li><a href="/{i}">Another story of the day {i}</a></li>' for i in range(5))
    page = f'<article><h1>Title</h1><p>{LONG}</p><p><a href="/x">Source of all that</a></p><p>Then.</p><ul>{links}</ul><p>{LONG}Last.</p><p><a href="/y">Read more</a></p></article>'
    kept = html_text.main_text(page).split("\n\n")
    assert kept[:4] == ["Title", LONG.strip(), "Source of all that", "Then."] and kept[-1] == f"{LONG}Last." and len(kept) == 5
    poem = "<article>" + "".join(f"<p>line {i}</p>" for i in range(9)) + "</article>"
    assert len(html_text.main_text(poem).split("\n\n")) == 9 and html_text.main_text("<main><p>Hi</p></main>") == "Hi"
    bare = f"<body><div><a href='/'>Menu</a></div><div>{LONG}</div><div>{LONG}</div><div>© 2024 Someone, all rights reserved</div></body>"
    assert html_text.main_text(bare).split("\n\n") == [LONG.strip()] * 2


def test_query(spark, tmp_path):
    long = "<article>" + "".join(f"<p>Line {i} of a very long page. {LONG}</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", long), (3, "u", long), (None, "v", f"<p>{LONG}&amp;&nbsp;&bogus;")]
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in queries.op2_html_text(spark, str(tmp_path)).collect()}
    assert got[1, "u"] == got[2, None] == ("", 0) and got[3, "u"][0].count("\n\n") == 19_999 and got[3, "u"][1] == len(got[3, "u"][0])
    assert got[None, "v"][0] == f"{LONG}& &bogus;"
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/empty/pages.parquet")
    assert queries.op2_html_text(spark, f"{tmp_path}/empty").count() == 0
