"""HTML extraction against a parser from the standard library, and on pages made for one rule each."""

import time
from html.parser import HTMLParser

import pytest

from granary.llm import html_text, queries


class Article(HTMLParser):
    """The blocks of the article element of a page without boilerplate in it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside = self.raw = False
        self.blocks = [""]

    def handle_starttag(self, tag, attrs):
        if tag in html_text.RAW_TAGS:
            self.raw = True
        if tag == "article":
            self.inside = True
        if tag in html_text.BLOCK_TAGS:
            self.blocks.append("")
        elif tag == "br" and self.inside:
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag in html_text.RAW_TAGS:
            self.raw = False
        if tag in html_text.BLOCK_TAGS:
            self.blocks.append("")
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        if self.inside and not self.raw:
            self.blocks[-1] += data


def test_query_equals_a_parser(spark, sf):
    pages = {r.page_id: r for r in queries.table(spark, sf, "pages").collect()}
    got = queries.op7_block_rules(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        parser = Article()
        parser.feed(pages[r.page_id].html or "")
        parser.close()
        want = "\n\n".join(t for t in (" ".join(b.split()) for b in parser.blocks) if t)
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))


LONG = "It was the best of the days and he was with her in the house that they had by the sea. " * 3
KEPT = [
    "<aside>Aside</aside><p>TEXT</p><aside>Aside</aside>",
    '<h1 class="post-header">TEXT</h1><p>Then.</p>',
    '<section id="related-work"><p>TEXT</p></section>',
    "<ul><li><a href=1>TEXT</a></ul>",
    "<p>As <math>TEXT</math> is.</p>",
    "<div><button>Buy</div><p>TEXT</p>",
    "<div><p>One<script>var a = 1</div><p>TEXT</p>",
    '<div class="ad">Buy it now</div><p>TEXT</p><div class="share-box">Tell it</div>',
    f'<div class="notice"><p>TEXT {LONG}</p></div>',
    "<header><h1>TEXT</h1></header>",
    '<p title="a > b">TEXT</p>',
    "<p>TEXT</p><!-- never closed <p>More.</p>",
]


@pytest.mark.parametrize("inner", KEPT)
def test_article_text_stays(inner):
    assert "TEXT" in html_text.main_text(f"<body><p>Out</p><article>{inner}</article><footer>F</footer>".encode())[0]


GONE = [
    "<nav>TEXT</nav>", "<aside><p>TEXT</p></aside>", "<form><p>TEXT</p></form>", "<script>TEXT</script>",
    '<div class="ad">TEXT</div>', '<div class="cookie-notice">TEXT</div>', "<button>TEXT</button>", "<footer>TEXT</footer>",
    f'<div class="comments"><p>TEXT {LONG}</p></div>', f'<ol id="comment-list"><li>TEXT {LONG}</li></ol>',
    "<p><a href=1>TEXT</a></p><p><a href=2>Shop</a></p><p><a href=3>Contact</a></p>",
]


@pytest.mark.parametrize("inner", GONE)
def test_boilerplate_goes(inner):
    assert "TEXT" not in html_text.main_text(f"<article><p>{LONG}</p>{inner}<p>{LONG}</p></article>".encode())[0]


def test_densities_decide_in_a_marked_article():
    """The same three blocks stay if they are not links, or have stop words."""
    page = "<article><p>First.</p>" + "<p><a href=1>%s</a></p>" * 3 + "</article>"
    assert html_text.main_text((page % ("Shop", "Contact", "Help")).encode())[0] == "First."
    assert "Shop" in html_text.main_text((page % ("Shop", "Contact", "Help")).replace("<a href=1>", "").encode())[0]
    assert "the sea" in html_text.main_text((page % ("By the sea", "In the house", "It was the day")).encode())[0]


def test_unmarked_pages_are_decided_by_density():
    plain = f"<body><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><p>{LONG}<p>Well.<p>{LONG}</p><p>Buy now"
    assert html_text.main_text(plain.encode())[0] == f"{LONG.strip()}\n\nWell.\n\n{LONG.strip()}"
    noise = "Xyzzy plugh frobnicate quux corge grault garply waldo fred " * 5
    assert html_text.main_text(f"<body><p>{noise}</p><p>{LONG}</p>".encode())[0] == LONG.strip()


SOUP = ["<script ", "<a ", "<", "<!--", '<a "', "<a '\"", "<div>", "</div>", "<p><b>", "<script>", "<title>x", '<a b="c>', "<li>x</ul>", "<aside>x", "&", "<div></p></ul>"]


@pytest.mark.parametrize("piece", SOUP)
def test_tag_soup_takes_linear_time(piece):
    page = (piece * (2_000_000 // len(piece))).encode()
    for end in (b"", b">"):
        start = time.process_time()
        html_text.main_text(page + end)
        assert time.process_time() - start < 20


def test_odd_pages(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "<p", "z"), (3, "<p", "z"), (4, "<" * 5000 + "\"'<!--", "z"), (None, "a &lt; b", None)]
    pages = spark.createDataFrame(rows, "page_id int, html string, text string")
    got = sorted((str(r.page_id), r.n_chars) for r in html_text.extract(pages).collect())
    assert [n for _, n in got] == [0] * 6
    assert html_text.blocks("a &lt; b <p")[0].text == "a < b <p"
    assert html_text.extract(pages.limit(0)).count() == 0
