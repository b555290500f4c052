"""Main text keeps what is linked inside the article, and measures links as text."""

from tideline.llm import extraction

LONG = "Some words of the text, long enough to be dense ground. " * 2


def test_links_of_the_article_stay():
    page = f"<nav><a href=x>Home</a></nav><article><h1><a href=#t>Title</a></h1><p>{LONG}</p><ul><li><a href=a>First</a><li><a href=b>Second</a></ul><div class=share><a href=c>Share</a></div></article>"
    assert extraction.main_text(page).split("\n") == ["Title", LONG.strip(), "First", "Second"]


def test_links_inside_a_span_stay():
    page = f"<div><a href=x>Home</a></div><p>{LONG}</p><p><a href=a>All of this is a link</a></p><div class=ad>Buy</div><p>{LONG}</p><div><a href=b>More</a></div>"
    assert extraction.main_text(page).split("\n") == [LONG.strip(), "All of this is a link", LONG.strip()]


def test_link_text_is_measured_decoded():
    page = f"<p>See <a href=a>{'&eacute;' * 20}{' ' * 200}</a> for more.</p>"
    assert extraction.main_text(page) == "See " + "é" * 20 + " for more."
