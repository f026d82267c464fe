"""Main text of web pages by two passes over blocks.

A page becomes a list of blocks: stretches of text between block-level tags, each with its length, the share of its text in links, the share of
stop words and the part of the page it stands in. The first pass decides the blocks that these tell apart and leaves short ones open. In the second pass open blocks
take the label of the nearest decided neighbours in the same part of the page, where the part's own kind (an article, or none) settles what has no such neighbour.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.shared import map_rows

LONG, SHORT = 140, 70
MANY_LINKS, STOP_HIGH, STOP_LOW = 0.4, 0.3, 0.15
TEXTS = "page_id long, url string, text string, n_chars long, n_blocks int, n_kept int"

# Words that occur in any running text of the four languages.
STOP_WORDS = frozenset(
    """a an and are as at be by for from he her his in is it not of on or that the their they this to was were with you
    aber als am auf aus bei das dem den der des die ein eine einer es für im ist mit nicht sich sie sind und von wie zu zum
    au aux avec ce dans de des du elle en est et il la le les mais ne par pas pour que qui se sur un une
    al como con del el en es la las lo los más no para pero por que se si sin su sus un una y""".split()
)
# Fixed values of HTML.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul""".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template textarea iframe object svg math canvas audio video select".split())
OUTSIDE_TAGS = frozenset("head title nav footer aside form button menu dialog fieldset legend".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form toolbar".split())
OUTSIDE_NAMES = frozenset(
    """ad ads advert advertisement alert adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr
    header masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted promotion related replies respond share sharing
    sidebar sidebars signup social sponsor sponsored subscribe topbar widget widgets""".split()
)
# Parts with one of these names hold articles of their own that are not the page's; below any other name an article is the page's.
ARTICLE_LISTS = frozenset(
    """ad ads advert advertisement adverts comment comments commentlist disqus popup promo promoted promotion related replies respond sponsor sponsored widget widgets""".split()
)
# An article is outside only if one of these is its class as a whole: classes of real articles mention comments, too.
OUTSIDE_ARTICLES = frozenset("ad advert comment promo related reply sponsored teaser".split())
IMPLIED_END = {"p": BLOCK_TAGS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[^\W\d_]+")
NAME = re.compile(r"[a-z]+")
LETTER = re.compile(r"[A-Za-zÀ-ÿ]")


@dataclass
class Block:
    text: str
    linked: int
    outside: bool
    part: int
    article: bool
    label: bool | None = None


@dataclass
class _Open:
    tag: str
    outside: bool
    part: int
    article: bool
    link: bool = False
    block_outside: bool = False
    named: bool = False  # outside by a class or id only, which an article or main below takes back
    suspect: bool = False


@dataclass
class _Page:
    """Blocks of one page; ``feed`` is called with its markup once."""

    blocks: list[Block] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    linked: int = 0

    def _text(self, raw: str, top: _Open) -> None:
        if raw and (top.block_outside or not top.outside):  # an inline advert leaves its block
            text = html.unescape(raw) if "&" in raw else raw
            self.pieces.append(text)
            if top.link:
                self.linked += len("".join(text.split()))

    def _end_block(self, top: _Open) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self.blocks.append(Block(text, self.linked, top.outside, top.part, top.article and not top.suspect))
        self.pieces, self.linked = [], 0

    def feed(self, page: str) -> list[Block]:
        stack = [_Open("", False, 0, False)]
        parts, at = 0, 0
        while at < len(page):
            found = TOKEN.search(page, at)
            if found is None:
                self._text(page[at:], stack[-1])
                break
            self._text(page[at : found.start()], stack[-1])
            at = found.end()
            tag = (found[2] or found[5] or "").lower()
            if not tag:
                continue
            closing, attributes = bool(found[1] or found[4]), found[3] or ""
            if tag in BLOCK_TAGS:
                self._end_block(stack[-1])
            if closing:
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
                if k:
                    del stack[k:]
                continue
            if tag == "br":
                self.pieces.append(" ")
            if tag in VOID_TAGS:
                continue
            if tag in RAW_TAGS:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            while len(stack) > 1 and tag in IMPLIED_END.get(stack[-1].tag, ()):
                stack.pop()
            if tag in BLOCK_TAGS:  # a paragraph ends at any block even below open inline tags
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in BLOCK_TAGS), 0)
                if k and stack[k].tag == "p":
                    del stack[k:]
            top, own = stack[-1], _Open(tag, stack[-1].outside, stack[-1].part, stack[-1].article, stack[-1].link or tag == "a")
            own.named, own.suspect = top.named, top.suspect
            if tag in ("article", "main"):
                own.article, own.suspect = True, False
                if own.named:
                    own.outside = own.named = False
            if tag in ("article", "main", "section", "aside", "nav", "header", "footer", "form"):
                parts += 1
                own.part = parts
            if not own.outside or own.named:
                kind = _outside(tag, attributes, top.article)
                if kind in ("firm", "name") and not (own.named and kind == "name"):
                    own.outside, own.named = True, kind == "name"
                own.suspect = own.suspect or kind == "suspect"
                if kind and tag in BLOCK_TAGS:
                    parts += 1
                    own.part = parts
            own.block_outside = own.outside if tag in BLOCK_TAGS else top.block_outside
            stack.append(own)
        self._end_block(stack[-1])
        return self.blocks


def _outside(tag: str, attributes: str, in_article: bool) -> str:
    """How an element begins a part of the page that is not the article: ``firm``, by a ``name`` only, ``suspect`` of it, or not at all (empty)."""
    if tag in OUTSIDE_TAGS or (tag == "header" and not in_article):
        return "firm"
    if not attributes or tag in ("html", "body", "main"):
        return ""
    if tag == "article":
        classes = [name for key, *values in ATTRIBUTE.findall(attributes) if key.lower() == "class" for name in "".join(values).lower().split()]
        return "" if OUTSIDE_ARTICLES.isdisjoint(classes) else "firm"
    return _named_outside(attributes, in_article)


def _named_outside(attributes: str, in_article: bool) -> str:
    """What id, class and role say. A name counts in full if all its parts are names of outside parts (``cookie-notice``).

    With other parts (``has-sidebar``, ``site-footer``) it may be a layout as well, and is evidence only: the element's blocks are judged by themselves, without the benefit of an article.
    """
    found = ""
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values).lower(), name.lower()
        if name == "role" and value.strip() in OUTSIDE_ROLES or name == "hidden" or (name == "aria-hidden" and value == "true"):
            return "firm"
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "firm"
        for token in value.split() if name in ("class", "id") else ():
            parts = set(NAME.findall(token))
            known = parts & OUTSIDE_NAMES
            if not known or (known == {"header"} and (in_article or known < parts)):
                continue
            if known < parts:
                found = found or "suspect"
            elif parts & ARTICLE_LISTS:
                return "firm"
            else:
                found = "name"
    return found


def _stop_words(block: Block) -> tuple[int, int]:
    words = WORD.findall(block.text.lower())
    return sum(word in STOP_WORDS for word in words), len(words)


def _decide(block: Block, known_language: bool) -> bool | None:
    """First pass: True is text, False is not, None is open.

    Stop words judge blocks that consist mostly of the letters of the known languages. A list of numbers or text in another script has none whatever it is and stays open, and on a page
    without any known stop word the length decides.
    """
    if block.outside:
        return False
    size = len("".join(block.text.split()))
    if block.linked > MANY_LINKS * size and not (block.article and block.linked < size):
        return False
    if size < SHORT:
        return None
    if block.article:
        return True
    if not known_language:
        return True if size >= LONG else None
    stops, words = _stop_words(block)
    share = stops / max(words, 1)
    if share >= (STOP_LOW if size >= LONG else STOP_HIGH):
        return True
    unjudged = 2 * len(LETTER.findall(block.text)) < size
    return None if unjudged or (size < LONG and share >= STOP_LOW) else False


def _nearest(blocks: list[Block], decided: list[bool | None], order: range) -> list[tuple[int, bool] | None]:
    """For every block the last decided one before it, in this order, of the same part of the page."""
    last: dict[int, tuple[int, bool]] = {}
    out: list[tuple[int, bool] | None] = [None] * len(blocks)
    for k in order:
        out[k] = last.get(blocks[k].part)
        if decided[k] is not None:
            last[blocks[k].part] = (k, decided[k])
    return out


def main_blocks(page: str | None) -> list[Block]:
    """All blocks of a page in order, labelled. Of two neighbours equally near, text wins. A page on which nothing is text by then has its open blocks for text."""
    blocks = _Page().feed(page or "")
    known_language = any(_stop_words(block)[0] for block in blocks if not block.outside)
    decided = [_decide(block, known_language) for block in blocks]
    before = _nearest(blocks, decided, range(len(blocks)))
    after = _nearest(blocks, decided, range(len(blocks) - 1, -1, -1))
    for k, block in enumerate(blocks):
        sides = [(abs(side[0] - k), side[1]) for side in (before[k], after[k]) if side]
        if decided[k] is not None:
            block.label = decided[k]
        elif sides:
            closest = min(distance for distance, _ in sides)
            block.label = any(label for distance, label in sides if distance == closest)
        else:
            block.label = block.article
    if not any(block.label for block in blocks):
        for k, block in enumerate(blocks):
            block.label = decided[k] is None
    return blocks


def main_text(page: str | None) -> str:
    return "\n\n".join(block.text for block in main_blocks(page) if block.label)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks, n_kept`` of every row; null and empty pages have an empty text.

    Rows that repeat a page are extracted each; a very long page is a slice of its own and read whole.
    """

    def work(slices: Iterator[list[tuple]]) -> Iterable[dict]:
        for rows in slices:
            labelled = [main_blocks(row[2]) for row in rows]
            texts = ["\n\n".join(block.text for block in blocks if block.label) for blocks in labelled]
            yield {
                "page_id": [row[0] for row in rows],
                "url": [row[1] for row in rows],
                "text": texts,
                "n_chars": [len(text) for text in texts],
                "n_blocks": [len(blocks) for blocks in labelled],
                "n_kept": [sum(bool(block.label) for block in blocks) for blocks in labelled],
            }

    return map_rows(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html"), work, TEXTS)
