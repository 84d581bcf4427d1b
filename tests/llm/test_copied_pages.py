"""Hosts most of whose pages are copies of one."""

import pytest

from palisade.llm import html


def extracted(spark, rows):
    docs = spark.createDataFrame([(i, "http://d.org/", h) for i, h in enumerate(rows)], "page_id long, url string, html string")
    return {r.page_id: r["__text"] for r in html.extracted(docs).collect()}


@pytest.mark.parametrize("others", [0, 2, 6])
def test_copied_articles_stay(spark, others):
    copy = "<article><p>Long story</p><p>told again</p></article>"
    rows = [copy] * 60 + [f"<article><p>Story {i}</p></article>" for i in range(others)]
    got = extracted(spark, rows)
    assert {got[i] for i in range(60)} == {"Long story\n\ntold again"}
    assert all(got[60 + i] == f"Story {i}" for i in range(others))


def test_copied_pages_without_a_mark_stay(spark):
    rows = ["<p>Plain story</p><div>Subscribe now</div>"] * 30 + [f"<p>Story {i}</p><div>Subscribe now</div>" for i in range(9)]
    got = extracted(spark, rows)
    assert got[0] == "Plain story"
    assert got[30] == "Story 0"


def test_a_marked_article_is_not_emptied(spark):
    """All of its text is on nearly all pages, which differ elsewhere."""
    rows = [f"<p>Place {i}</p><article><p>One notice</p></article>" for i in range(30)]
    assert set(extracted(spark, rows).values()) == {"One notice"}


@pytest.mark.parametrize("copies", [1, 4, 5, 20])
@pytest.mark.parametrize("page", ["<article><p>Long story</p></article>", "<p>Long story</p>"])
def test_copies_of_one_page_stay(spark, copies, page):
    assert set(extracted(spark, [page] * copies).values()) == {"Long story"}
