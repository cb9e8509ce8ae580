"""HTML extraction: two passes of block rules over a page.

One scanner goes over the page from left to right and cuts it into blocks at
block-level tags. The first pass classifies a block by its link density, its
length and its density of stop words: good, bad, near (looks like prose but is
not sure) or short. The second pass gives near and short blocks the labels of
the nearest decided neighbours on both sides.

Elements that are no part of a text whatever they say are left out before the
first pass and are nobody's neighbours: menus, headers, footers, sidebars,
forms and dialogs by their tag or role, reader comments by a class or id that
consists of words for them, scripts, styles and the like. Other words in class
and id (adverts, notices, sharing) only lower a block's chances: it is bad
unless it reads as prose.

Where a page marks its article (article, main or role main), what is outside is
bad and the ends of the region count as good neighbours. Inside, words that no
list knows must not cost the text, so a block that would be bad for its words
is near, one with many links is short, and a run of LINK_RUN blocks or more
that are mostly links and have few stop words is bad, as a menu is. A header
element inside the article is part of it. Without such a mark the ends of the
page count as bad.

Whole pages are read, in time linear in their length. An element that is never
closed ends where its parent does; a `<` that no `>` follows is text. Null and
empty pages give an empty text; repeated rows give equal ones; a column with
the name of a result is replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import added, as_bytes, row_function, session

RESULT = "text string, n_chars bigint, n_blocks bigint, n_kept bigint"
SHORT, LONG = 70, 200
FEW_STOPS, MANY_STOPS = 0.15, 0.30
MAX_LINKS, LINK_RUN = 0.33, 3
#: Tags whose quotes do not match that a page may have before a tag ends at the first `>`.
MAX_UNMATCHED = 64

# Common function words, by language.
STOP_WORDS = frozenset(
    """
    the of and to in a is that it for was on are as with be by this from or an at not have which you but
    der die das und in den von zu mit ist im für nicht ein eine dem des sich auf auch als an es werden aus er
    le la les de des du et en un une est que qui dans pour pas par sur au avec ce il se plus
    el la los las de que y en un una es por con no para se del al lo como más su
    """.split()
)
# Element names by their part in a page.
BLOCK_TAGS = frozenset(
    """
    address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript object ol option p pre section
    select summary svg table tbody td template tfoot th thead tr ul
    """.split()
)
CONTAINERS = BLOCK_TAGS - {"p", "hr", "li", "option", "dt", "dd", "td", "th", "tr", "h1", "h2", "h3", "h4", "h5", "h6"}
LEFT_OUT_TAGS = frozenset("aside button dialog footer form head header menu nav noscript object select svg template".split())
LEFT_OUT_ROLES = frozenset("alertdialog banner complementary contentinfo dialog form menu navigation search".split())
RAW_TAGS = frozenset("script style textarea title iframe".split())
# Words in class and id, for reader comments and for other boilerplate.
COMMENT_WORDS = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
BOILERPLATE_WORDS = COMMENT_WORDS | frozenset(
    """
    ad ads adsense advert adverts advertisement advertising banner box breadcrumb breadcrumbs consent container cookie
    cookies copyright disclaimer footer gdpr header list login masthead menu modal nav navbar navigation newsletter
    notice notices notification pager pagination popup promo promoted promotion recommended related search section
    share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget
    """.split()
)
#: Words that say nothing alone, only beside others.
NEUTRAL_WORDS = frozenset("box container list section".split())

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?])")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")
_NOT_ALNUM = re.compile(r"[^a-z0-9]+")


class Block:
    """A run of text, the part of it inside links, and where it stands."""

    __slots__ = ("doubted", "label", "left_out", "links", "region", "stops", "text")

    def __init__(self, text: str, links: int, left_out: bool, doubted: bool, region: int) -> None:
        words = [w.lower() for w in _WORD.findall(text)]
        self.text, self.left_out, self.doubted, self.region = text, left_out, doubted, region
        self.links = links / len(text)
        self.stops = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
        self.label = ""


def _marks(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is left out, whether its names speak against it, and whether it is a main region."""
    out, doubted, main = tag in LEFT_OUT_TAGS, False, tag in ("article", "main")
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            out |= value in LEFT_OUT_ROLES
            main |= value == "main"
        elif tag not in ("html", "body"):
            for name in value.split():
                words = {w for w in _NOT_ALNUM.split(name) if w}
                if words <= BOILERPLATE_WORDS and words - NEUTRAL_WORDS:
                    doubted = True
                    out |= words - NEUTRAL_WORDS <= COMMENT_WORDS
    return out, doubted, main and not out and not doubted


class Scanner:
    """Finds the tags of a page, one after the other; nothing is looked at more than a few times."""

    def __init__(self, page: str) -> None:
        self.page, self.last, self.unmatched = page, page.rfind(">"), 0
        self.lower, self.missing = page.lower() if len(page.lower()) == len(page) else page, set()

    def find(self, what: str, at: int) -> int:
        """The place of what from at on, or -1; what was missed once is not looked for again."""
        if what in self.missing:
            return -1
        found = self.lower.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def end_of_tag(self, at: int) -> int:
        if self.unmatched < MAX_UNMATCHED:
            m = _REST.match(self.page, at)
            if m:
                return m.end()
            self.unmatched += 1
        return self.page.index(">", at) + 1

    def after_raw(self, tag: str, parent: str, at: int) -> int:
        """Where the text of a raw element ends: at its end tag, or else that of its parent, or with the page."""
        for name in (tag, parent):
            found = self.find(f"</{name}", at) if name else -1
            if found >= 0:
                return found
        return len(self.page)


def blocks(page: str) -> list[Block]:
    scan = Scanner(page)
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = []  # open containers: tag, left out, doubted, region (0: none)
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[str] = []
    state = {"link": False, "out": False, "doubted": False}
    regions = at = 0

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            _, left_out, doubted, region = stack[-1] if stack else ("", False, False, 0)
            links = len(" ".join(html.unescape("".join(linked)).split()))
            out.append(Block(text, links, left_out or state["out"], doubted or state["doubted"], region))
        parts.clear()
        linked.clear()
        state.update(link=False, out=False, doubted=False)

    def say(text: str) -> None:
        if text:
            parts.append(text)
            if state["link"]:
                linked.append(text)

    while m := _OPEN.search(page, at):
        if m.start() >= scan.last:
            break
        say(page[at : m.start()])
        if page.startswith("<!--", m.start()):
            end = scan.find("-->", m.start() + 2)
            at = end + 3 if end >= 0 else scan.end_of_tag(m.end())
            continue
        at = scan.end_of_tag(m.end())
        if not m[2]:
            continue
        tag, closing, attributes = m[2].lower(), bool(m[1]), page[m.end() : at - 1]
        if tag == "br":
            say(" ")
        elif tag == "a":
            state["link"] = not closing
        elif tag in RAW_TAGS:
            if not closing:
                at = scan.after_raw(tag, stack[-1][0] if stack else "", at)
        elif tag in BLOCK_TAGS:
            close()
            if tag not in CONTAINERS:
                if not closing:
                    state["out"], state["doubted"], _ = _marks(tag, attributes)
                    state["doubted"] &= tag[0] != "h"
            elif not closing:
                left_out, doubted, main = _marks(tag, attributes)
                _, was_out, was_doubted, region = stack[-1] if stack else ("", False, False, 0)
                if tag == "header" and region:
                    left_out = False
                if main and not region and not was_out:
                    regions += 1
                    region = regions
                stack.append((tag, was_out or left_out, was_doubted or doubted, region))
                opened[tag] += 1
            elif opened[tag]:
                while True:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == tag:
                        break
    say(page[at:])
    close()
    return out


def classify(found: list[Block]) -> bool:
    """The first pass. True if the page marks its article."""
    marked = any(b.region and not b.left_out for b in found)
    for b in found:
        prose = b.stops >= MANY_STOPS and b.links <= MAX_LINKS
        if b.left_out or marked and not b.region or b.doubted and not (prose and len(b.text) > LONG):
            b.label = "bad"
        elif b.links > MAX_LINKS:
            b.label = "short" if marked else "bad"
        elif len(b.text) < SHORT:
            b.label = "short"
        elif prose:
            b.label = "good" if len(b.text) > LONG else "near"
        else:
            b.label = "near" if marked or b.stops >= FEW_STOPS else "bad"
    if marked:
        for linked, run in groupby((b for b in found if not b.left_out), key=lambda b: (b.region, b.links > MAX_LINKS)):
            menu = list(run)
            if linked[1] and len(menu) >= LINK_RUN and sum(b.stops for b in menu) < FEW_STOPS * len(menu):
                for b in menu:
                    b.label = "bad"
    return marked


def inherit(found: list[Block], marked: bool) -> list[bool]:
    """The second pass: which blocks are kept."""
    edge = "good" if marked else "bad"

    def nearest(order: list[Block]) -> list[str]:
        """For each block, the last decided label before it in its region."""
        out, last, region = [], edge, 0
        for b in order:
            if marked and b.region != region and not b.left_out:
                last, region = edge, b.region
            out.append(last)
            if b.label in ("good", "bad") and not b.left_out and not b.doubted:
                last = b.label
        return out

    before, after = nearest(found), nearest(found[::-1])[::-1]
    kept = []
    for b, x, y in zip(found, before, after, strict=True):
        if b.label in ("good", "bad"):
            kept.append(b.label == "good")
        else:
            kept.append("good" in (x, y) if marked or b.label == "near" else x == y == "good")
    return kept


def main_text(page: bytes) -> tuple[str, int, int, int]:
    found = blocks(page.decode("utf-8", "replace"))
    marked = classify(found)
    texts = [b.text for b, keep in zip(found, inherit(found, marked), strict=True) if keep]
    text = "\n\n".join(texts)
    return text, len(text), len(found), len(texts)


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """pages with the columns of RESULT."""
    session(pages)
    return added(pages, row_function(main_text, RESULT)(as_bytes(F.col(page))), RESULT)
