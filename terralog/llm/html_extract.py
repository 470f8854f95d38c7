"""Main text of raw pages: parser events to blocks, text-to-tag ratios, Gaussian smoothing, threshold clusters.

The standard library's event parser runs over the whole page. Events form blocks (paragraphs, headings, cells, items); a block knows how many tags and
link characters it has and which containers it stands in. Containers that name themselves as something else than the article
(by tag, role, class or id) count nothing, unless a class, an id or a form turns out to wrap the article. The text-to-tag ratios of the blocks in page order, smoothed by a Gaussian, are cut at a
threshold into content clusters. Where the articles (or main parts) that a page marks hold most of the clusters, their whole content is the text; else that of
the innermost container with nearly all of the clusters is, and clusters beside it.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML and words that sites use for parts outside the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OUTSIDE = frozenset("""aside audio button canvas datalist dialog fieldset footer head iframe menu nav noscript object script select style svg
    template textarea title video""".split())
OUTSIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
OUTSIDE_WORDS = frozenset("""ad ads advert advertisement adverts advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright
    discussion disqus footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup
    promo promoted promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags
    teaser toolbar topbar widget widgets""".split())
TITLE_WORDS = frozenset(("header",))             # an article's own header holds its title
COMMENT_WORDS = frozenset("comment comments discussion disqus replies reply respond".split())
CARD_WORDS = frozenset("card cards".split())       # of an article in an article
PART_WORDS = frozenset("area bar block box buttons container content form group inner items links list panel section widget wrap wrapper".split())
TEXT_WORDS = frozenset("article entry post story".split())
WHOLE, MOST, NEARLY_ALL = 0.9, 0.5, 0.8         # shares of text that make a container the content
SHORT, LINKED = 0.25, 0.5                        # a named part of an article goes if it is shorter against the article, or that much of it is links
LEFT_OPEN = frozenset("aside footer header menu nav".split())
UNFINISHED = re.compile(r"<[A-Za-z/!?]")
CLOSED_BY = {"li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")),
             "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",))}
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Element:
    __slots__ = ("tag", "outside", "article", "link", "path", "marks", "number", "holds")

    def __init__(self, tag, outside, article, link, path, marks, number=0):
        self.tag, self.outside, self.article, self.link, self.path, self.marks, self.number, self.holds = tag, outside, article, link, path, marks, number, False


class Block:
    __slots__ = ("parts", "tags", "linked", "outside", "article", "path", "marks", "tag", "heading")

    def __init__(self, at: Element):
        self.parts, self.tags, self.linked = [], 0, 0
        self.outside, self.article, self.path, self.marks, self.tag, self.heading = at.outside, at.article, at.path, at.marks, at.tag, at.tag in HEADINGS

    @property
    def text(self) -> str:
        return SPACE.sub(" ", "".join(self.parts)).strip()


def names_outside(tag: str, attrs: dict[str, str | None], in_article: bool) -> bool:
    if tag in OUTSIDE or (tag == "header" and not in_article):
        return True
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", ""):
        return True
    return (attrs.get("role") or "").lower() in OUTSIDE_ROLES


def marks_outside(tag: str, attrs: dict[str, str | None], in_article: bool) -> bool:
    """Whether a name marks the element as outside, unless it turns out to hold the article."""
    if tag == "form":
        return True
    if tag in ("html", "body", "article", "main") and not in_article:
        return False
    names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
    if in_article:
        return bool(whole_names(names) & (OUTSIDE_WORDS - TITLE_WORDS | (CARD_WORDS if tag in ("article", "main") else frozenset())))
    words = {w.lower() for w in WORD.findall(names)}
    return bool(words & (OUTSIDE_WORDS - TITLE_WORDS if words & TEXT_WORDS else OUTSIDE_WORDS))


def whole_names(names: str) -> frozenset[str]:
    """Names that stand alone, or beside words that only say what kind of part it is: ``share-buttons`` is ``share``, ``notice-period`` is neither word."""
    found = set()
    for name in names.split():
        words = [w.lower() for w in WORD.findall(name)]
        plain = [w for w in words if w not in PART_WORDS]
        if len(plain) == 1 or plain and all(w in OUTSIDE_WORDS for w in plain):
            found.update(plain)
    return frozenset(found)


class Blocks(HTMLParser):
    """Collects the blocks of a page in order."""

    def __init__(self, ignored: frozenset[int] = frozenset()):
        """``ignored`` are numbers of elements whose tag does not put them outside."""
        super().__init__(convert_charrefs=True)
        self.ignored, self.elements, self.left_open = ignored, 0, set()
        self.inner: dict[int, tuple[int, bool, bool]] = {}          # mark -> article, whether it is a paragraph or inline, whether it goes whatever its length
        self.stack = [Element("", False, 0, False, (), ())]
        self.blocks: list[Block] = [Block(self.stack[0])]
        self.places = self.articles = self.marked = 0

    def _new_block(self):
        if self.blocks[-1].parts:
            self.blocks.append(Block(self.stack[-1]))
        else:
            tags = self.blocks[-1].tags
            self.blocks[-1] = Block(self.stack[-1])
            self.blocks[-1].tags = tags

    def _pop_to(self, tags: frozenset[str], stop: frozenset[str]):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                self.left_open.update(e.number for e in self.stack[k + 1:] if e.holds and e.tag in LEFT_OPEN)
                del self.stack[k:]
                return True
            if self.stack[k].tag in stop:
                break
        return False

    def handle_starttag(self, tag, attrs):
        if tag == "br" or tag == "wbr" or tag == "img":
            self.blocks[-1].tags += 1
            if tag == "br" and self.blocks[-1].parts:
                self.blocks[-1].parts.append(" ")
            return
        block = tag in BLOCKS
        if block:
            if tag != "option":
                self._pop_to(frozenset(("p", *HEADINGS)) if tag in HEADINGS else frozenset(("p",)), BLOCKS - HEADINGS)
            if tag in CLOSED_BY:
                self._pop_to(CLOSED_BY[tag], frozenset("ul ol dl table select menu article body".split()))
        if tag not in VOID:
            top = self.stack[-1]
            self.elements += 1
            article, outside = top.article, top.outside or (self.elements not in self.ignored and names_outside(tag, dict(attrs), bool(top.article)))
            if tag in ("article", "main"):
                for e in self.stack:
                    e.holds = True
            if tag in ("article", "main") and not outside and not article:
                self.articles += 1
                article = self.articles
            path, marks = top.path, top.marks
            if not outside and marks_outside(tag, dict(attrs), bool(top.article)):
                self.marked += 1
                marks = (*marks, self.marked)
                if top.article:
                    names = whole_names(f"{dict(attrs).get('class') or ''} {dict(attrs).get('id') or ''}")
                    self.inner[self.marked] = top.article, tag not in BLOCKS or tag == "p" or tag in HEADINGS, tag == "form" or bool(names & COMMENT_WORDS)
            if tag in ("article", "main", "section", "div", "td", "blockquote", "body", "ul", "ol", "table"):
                self.places += 1
                path = (*path, self.places)
            self.stack.append(Element(tag, outside, article, top.link or tag == "a", path, marks, self.elements))
        if block:
            self._new_block()
        self.blocks[-1].tags += 1

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or tag not in BLOCKS:
            self.handle_starttag(tag, attrs)
            if tag not in VOID:
                self.handle_endtag(tag)
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        inline = tag not in BLOCKS
        # an inline end tag never closes a block, a block's closes all it holds; a stray one closes nothing
        closed = self._pop_to(frozenset((tag,)), BLOCKS if inline else frozenset(("body",)) if tag not in ("body", "html") else frozenset())
        if not inline and closed:
            self._new_block()
        self.blocks[-1].tags += closed

    def handle_data(self, data):
        top = self.stack[-1]
        if (top.outside, top.marks) != (self.blocks[-1].outside, self.blocks[-1].marks):       # an inline element such as a hidden span
            self._new_block()
        if not self.blocks[-1].parts and not data.strip():
            return
        self.blocks[-1].parts.append(data)
        if top.link:
            self.blocks[-1].linked += len(data)


def smooth(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, mode="edge" if len(values) else "constant"), kernel / kernel.sum(), mode="valid")


def settle_marks(blocks: list[tuple[Block, str]], inner: dict[int, tuple[int, bool, bool]]):
    """Names mark a container as outside, but one that holds the article or nearly all text of a page does not count.

    Inside an article a named part goes if it holds readers' comments or a form, if most of it is links, or if it is short against the article and no plain paragraph.
    """
    open_ = [(b, len(t)) for b, t in blocks if not b.outside]
    total = sum(n for _, n in open_)
    held, main, linked, article = {}, set(), {}, {}
    for b, n in open_:
        article[b.article] = article.get(b.article, 0) + n
        for m in b.marks:
            held[m] = held.get(m, 0) + n
            linked[m] = linked.get(m, 0) + min(b.linked, n)
            if b.article or b.tag == "h1":
                main.add(m)
    told = any(b.article and not b.marks for b, _ in open_)
    lifted = {m for m, n in held.items() if m not in inner and not told and n > (MOST if m in main else NEARLY_ALL) * total}
    for m, (of, plain, gone) in inner.items():
        n = held.get(m, 0)
        if not gone and linked.get(m, 0) < LINKED * n and (plain or n >= SHORT * article.get(of, 0)):
            lifted.add(m)
    for b, _ in open_:
        b.outside = any(m not in lifted for m in b.marks)


def container(blocks: list[tuple[Block, str]], content: np.ndarray) -> int:
    """The innermost container with nearly all text of the clusters; 0 without one."""
    held, depth = {}, {}
    for (b, t), yes in zip(blocks, content):
        for k, place in enumerate(b.path if yes else ()):
            held[place], depth[place] = held.get(place, 0) + len(t), k
    total = sum(len(t) for (_, t), yes in zip(blocks, content) if yes)
    return max((p for p, n in held.items() if n >= WHOLE * total), key=depth.get, default=0)


def parsed(html: str, ignored: frozenset[int] = frozenset()) -> Blocks:
    """The events of a page; a comment or tag that never ends goes to the end of the page, as in a browser."""
    parser = Blocks(ignored)
    parser.feed(html)
    if UNFINISHED.match(parser.rawdata):
        parser.rawdata = ""
    parser.close()
    return parser


def extract(html: str | None, threshold: float = 0.5) -> str:
    """Main text of one page; null, empty and pages without any give the empty text."""
    if not html:
        return ""
    parser = parsed(html)
    # a part left open in front of the article does not swallow it
    if open_ := parser.left_open | {e.number for e in parser.stack if e.holds and e.tag in LEFT_OPEN}:
        parser = parsed(html, frozenset(open_))
    blocks = [(b, t) for b in parser.blocks if (t := b.text)]
    settle_marks(blocks, parser.inner)
    inside = [(b, t) for b, t in blocks if not b.outside]
    if not inside:
        return ""
    # ratio of text outside links to tags; what is outside the article has none
    ratio = np.asarray([0.0 if b.outside else max(len(t) - b.linked, 0) / (1 + b.tags) for b, t in blocks])
    level = smooth(ratio)
    content = (level >= threshold * level.std()) & (ratio > 0)
    size = np.asarray([len(t) for _, t in blocks])
    marked = {b.article for (b, _), yes in zip(blocks, content) if yes and b.article}
    if marked and size[content & np.asarray([bool(b.article) for b, _ in blocks])].sum() <= MOST * size[content].sum():
        marked = set()
    if not content.any():
        marked = {b.article for b, _ in inside if b.article}
    if marked:
        return "\n".join(t for b, t in inside if b.article in marked)
    at = np.flatnonzero(content)
    if not len(at):
        return ""
    whole, keep = container(blocks, content), content.copy()
    for i, (b, _) in enumerate(blocks):               # the container whole, short runs and its end too; every block where the page has none
        keep[i] |= not b.outside and (whole in b.path or not whole)
    for i in range(at[0] - 1, -1, -1):
        if blocks[i][0].outside or not (blocks[i][0].heading or keep[i]):
            break
        keep[i] = True
    return "\n".join(t for (_, t), yes in zip(blocks, keep) if yes)


def _texts(batches):
    for b in batches:
        yield pa.record_batch([b.column(0), b.column(1), pa.array([extract(x.as_py()) for x in b.column(2)], pa.string())], names=["page_id", "url", "text"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``, one row per page, repeated ones too; null ids and urls stay null. An empty table gives no rows."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    out = rows.mapInArrow(_texts, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
