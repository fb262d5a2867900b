"""Main text of HTML pages by tag-path ratios.

A page is cut into text blocks (the text of one block-level element, inline
elements flattened).  Each block has the path of block-level tags from the root,
in which elements that are named as another part stand apart.  Over all blocks of a
path, text length and punctuation outside links are summed and divided by the blocks
of that path: two ratios.  The ratios are laid out in page order, smoothed with a
Gaussian, multiplied, and weighed: parts that are menus, headers, footers, sidebars,
notices, adverts, forms or comments by element, role, class or id weigh next to
nothing, names that may mean something else (``legal-text``, ``discussion``) weigh
less.  Paths whose mean fused ratio reaches a share of the best path's are content
paths, so a named part is content exactly if no other part of the page is.

The content is every block of a content path, and its unnamed neighbours: what
stands in the narrowest element that holds most text of content paths or in an
article or main element that holds some, and what stands beside these in the same
container.  Scripts, styles and what is hidden are no text, inside a paragraph too.

Blocks come in page order, joined by an empty line; white space inside a block is
one space; character references are decoded.  Reading takes time in proportion to
the page: elements nested deeper than ``DEEPEST`` stand at that depth, as in browsers.

Defined results: a null or empty page, or one without text, gives an empty text;
a very long page is read whole; null keys and repeated rows are kept; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm import tokens


@dataclass(frozen=True)
class Params:
    #: Standard deviation of the smoothing, in blocks.
    width: float = 0.6
    #: Paths pass at this share of the best path's fused ratio.
    share: float = 0.12
    #: What the ratio of a part counts that is named as another one than the main text, surely or perhaps.
    named: float = 1e-4
    doubted: float = 0.1
    #: The element whose blocks are all kept holds at least this share of the text of content paths.
    coverage: float = 0.85
    #: Blocks with a larger share of text in links are no content.
    most_links: float = 0.6


# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
OTHER = frozenset("nav footer aside form button select option dialog menu head object audio video canvas fieldset".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody")}
STOPS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
#: Between these and a paragraph inside them no paragraph further out ends.
HOLD_PARAGRAPHS = ("table", "td", "th", "li", "div", "article", "section", "body")
#: Words of a class, id or role that mark other parts than the main text.
MARKS = frozenset(
    "nav navbar navigation navi menu menubar breadcrumb breadcrumbs crumbs pagination pager header masthead topbar footer bottombar colophon sidebar sidenav aside rail widget widgets ad ads advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login signin register form search searchbox share sharing social comment comments commentlist disqus respond reply replies discussion related recommended recommendations outbrain taboola tagcloud skip copyright disclaimer legal toolbar complementary contentinfo hidden offscreen".split()
)
#: Those that alone, or with one another, are never a name for the main text.
SURE = frozenset(
    "nav navbar navigation navi menu menubar breadcrumb breadcrumbs crumbs pagination pager footer sidebar sidenav widget widgets ad ads advert adverts advertisement advertising adsense adbox adslot sponsored promo promotion cookie cookies newsletter popup modal share sharing comment comments commentlist disqus related outbrain taboola tagcloud offscreen".split()
)
#: What comes after these in a name is something an element only has or lacks.
HAS = frozenset("has no with without is".split())
#: Elements whose own marks count less than what they are.
KEPT = frozenset("html body main".split())
#: Elements that hold texts; all others are parts of one.
HOLDERS = frozenset("html body main article section div".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
#: Depth of nesting, as browsers limit it.
DEEPEST = 512
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>]|$)""", re.I)
_PARTS = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?。，；：！？、…]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Element:
    __slots__ = ("above", "tag", "path", "named", "doubted", "semantic", "depth", "chars")

    def __init__(self, above: Element | None, tag: str, path: int, named: bool = False, doubted: bool = False, semantic: bool = False):
        self.above, self.tag, self.path, self.semantic, self.chars = above, tag, path, semantic, 0
        self.depth = above.depth + 1 if above else 0
        #: Whether its own names say, surely or perhaps, that it is another part than the main text.
        self.named, self.doubted = named, doubted


class Block:
    __slots__ = ("at", "parts", "chars", "linked", "text")

    def __init__(self, at: Element):
        self.at, self.parts, self.chars, self.linked, self.text = at, [], 0, 0, ""


def _names(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, str, bool]:
    """Of an element's attributes: whether it is hidden, surely another part, the names by which it may be one, and whether it is main text."""
    hidden = named = semantic = False
    doubts = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden":
            hidden = hidden or value.lower() != "until-found"
        elif name == "aria-hidden":
            hidden = hidden or value.lower() == "true"
        elif name == "style":
            hidden = hidden or bool(_HIDDEN.search(value))
        else:
            for token in value.split():
                parts = [p.lower() for p in _PARTS.findall(_CAMEL.sub(" ", token))]
                own = parts[: next((i for i, p in enumerate(parts) if p in HAS), len(parts))]
                found = MARKS.intersection(own)
                if in_article and name != "role":
                    found = found - {"header"}  # as the element header
                if found and (name == "role" or SURE.issuperset(parts)):
                    named = True
                elif found:
                    doubts.add(token)
            semantic = semantic or name == "role" and value.lower() in ("main", "article")
    if tag in KEPT:
        return False, False, "", semantic
    return hidden, named, " ".join(sorted(doubts)), semantic


class _Reader:
    """Builds the elements and text blocks of a page."""

    def __init__(self):
        self.paths: dict[tuple, int] = {}
        self.root = self.top = Element(None, "", 0)
        self.elements, self.found = [self.root], []
        self.block: Block | None = None
        self.links = 0
        #: The open elements of each tag, from the outside; how many are open beyond the deepest level.
        self.open: dict[str, list[Element]] = defaultdict(list)
        self.beyond: dict[str, int] = defaultdict(int)
        #: Open inline elements of which nothing is read, from the outside.
        self.muted: list[str] = []
        self.hidden: Element | None = None

    def text(self, text: str) -> None:
        if self.muted or self.hidden is not None:
            return
        if "&" in text:
            text = entities.unescape(text)
        if self.block is None:
            if not text.strip():
                return
            self.block = Block(self.top)
            self.found.append(self.block)
        self.block.parts.append(text)
        if self.links:
            self.block.linked += len(text.strip())

    def ends(self) -> None:
        self.block, self.links = None, 0
        self.muted.clear()

    def pop(self) -> None:
        self.open[self.top.tag].pop()
        if self.top is self.hidden:
            self.hidden = None
        self.top = self.top.above

    def pop_to(self, e: Element) -> None:
        """Closes an element and all inside it."""
        while self.top is not e:
            self.pop()
        self.pop()

    def depth(self, tags: tuple[str, ...]) -> int:
        """Of the innermost open element of these tags."""
        return max((self.open[t][-1].depth for t in tags if self.open[t]), default=0)

    def inline(self, tag: str, closing: bool, attributes: str) -> None:
        if self.muted:
            if tag == self.muted[-1] and closing:
                self.muted.pop()
            elif tag == self.muted[-1]:
                self.muted.append(tag)
        elif not closing and attributes and (seen := _names(tag, attributes, True))[0] | seen[1] and not attributes.endswith("/"):
            self.muted.append(tag)
        elif tag == "a":
            self.links = 0 if closing else 1

    def close(self, tag: str) -> None:
        if self.beyond[tag]:
            self.beyond[tag] -= 1
            self.ends()
        elif self.open[tag]:
            self.pop_to(self.open[tag][-1])
            self.ends()
        elif tag == "p":
            self.ends()

    def start(self, tag: str, attributes: str) -> None:
        self.ends()
        if self.open["p"] and self.open["p"][-1].depth > self.depth(HOLD_PARAGRAPHS):  # any block-level element ends a paragraph
            self.pop_to(self.open["p"][-1])
        if tag in CLOSES:
            level, found = self.depth(STOPS[tag]), None
            for t in CLOSES[tag]:
                for e in reversed(self.open[t]):
                    if e.depth <= level:
                        break
                    found = e if found is None or e.depth < found.depth else found
            if found is not None:
                self.pop_to(found)
        if tag == "body" and self.open["head"]:
            self.pop_to(self.open["head"][-1])
        if attributes.endswith("/") and tag not in ("p", "div", "li", "td", "article", "section"):
            return
        if self.top.depth >= DEEPEST:
            self.beyond[tag] += 1
            return
        in_article = bool(self.open["article"] or self.open["main"])
        hidden, named, doubts, main = _names(tag, attributes, in_article) if attributes else (False, False, "", False)
        # A header is a part of its article there, and a page's header elsewhere.
        named = named or tag in OTHER or tag == "header" and not in_article
        path = self.paths.setdefault((self.top.path, tag, named, doubts), len(self.paths) + 1)
        self.top = Element(self.top, tag, path, named, bool(doubts), tag in ("article", "main") or main)
        self.elements.append(self.top)
        self.open[tag].append(self.top)
        if hidden and self.hidden is None:
            self.hidden = self.top


def read(page: str) -> tuple[list[Element], list[Block]]:
    """The elements of a page, those above others first, and its text blocks in page order."""
    r, at, size = _Reader(), 0, len(page)
    last, no_data = page.rfind(">"), False
    while at < size:
        to = page.find("<", at)
        if to < 0:
            r.text(page[at:])
            break
        if to > at:
            r.text(page[at:to])
        at = to
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else size
            continue
        if page.startswith("<![CDATA[", at) and not no_data:
            end = page.find("]]>", at)
            if end >= 0:
                r.text(page[at + 9 : end])
                at = end + 3
                continue
            no_data = True
        if at > last:  # nothing closes a tag any more
            if page[at + 1 : at + 2].isalpha() or page[at + 1 : at + 2] in ("/", "!", "?"):
                break
            r.text("<")
            at += 1
            continue
        if page[at + 1] in "!?":
            at = page.find(">", at) + 1
            continue
        m = _TAG.match(page, at)
        if m is None:
            r.text("<")
            at += 1
            continue
        at = m.end()
        tag, closing, attributes = (m[2], m[1], m[3]) if m[2] else (m[5], m[4], m[6])
        tag, closing = tag.lower(), bool(closing)
        if tag in INLINE:
            r.inline(tag, closing, attributes)
        elif tag == "br" or tag == "wbr":
            if r.block is not None and tag == "br":
                r.block.parts.append(" ")
        elif closing:
            r.close(tag)
        elif tag in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
        elif tag in VOID:
            if tag == "hr":
                r.ends()
        else:
            r.start(tag, attributes)
    for b in r.found:
        b.text = " ".join("".join(b.parts).split())
        b.chars = len(b.text)
    return r.elements, [b for b in r.found if b.text]


def fused_ratios(found: list[Block], weight: dict[Element, float], p: Params) -> np.ndarray:
    """The fused, smoothed and weighed ratio of each block's path, in page order."""
    length: dict[int, float] = defaultdict(float)
    marks: dict[int, float] = defaultdict(float)
    count: dict[int, int] = defaultdict(int)
    for b in found:
        free = max(0, b.chars - b.linked)
        length[b.at.path] += free
        marks[b.at.path] += len(_PUNCTUATION.findall(b.text)) * free / b.chars
        count[b.at.path] += 1
    ratios = np.array([[length[b.at.path] / count[b.at.path], marks[b.at.path] / count[b.at.path]] for b in found])
    reach = int(3 * p.width + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / p.width) ** 2)
    smooth = np.stack([np.convolve(np.pad(r, reach, mode="edge"), kernel / kernel.sum(), "valid") for r in ratios.T])
    return smooth[0] * smooth[1] * np.array([weight[b.at] for b in found])


def content_paths(found: list[Block], weight: dict[Element, float], p: Params) -> set[int]:
    """The paths whose mean fused ratio reaches the threshold."""
    by_path: dict[int, list[float]] = defaultdict(list)
    for b, f in zip(found, fused_ratios(found, weight, p), strict=True):
        by_path[b.at.path].append(float(f))
    mean = {path: sum(values) / len(values) for path, values in by_path.items()}
    return {path for path, value in mean.items() if value >= p.share * max(mean.values())}


def main_text(page: str | None, p: Params = Params()) -> str:
    elements, found = read(page or "")
    if not found:
        return ""
    weight: dict[Element, float] = {}
    for e in elements:  # from the root down: the least weight of an element and those above it
        weight[e] = min(weight[e.above] if e.above else 1.0, p.named if e.named else p.doubted if e.doubted else 1.0)
    content = content_paths(found, weight, p)
    chosen = [b for b in found if b.at.path in content and b.linked <= p.most_links * b.chars] or [b for b in found if b.at.path in content]
    for b in chosen:
        b.at.chars += b.chars
    for e in reversed(elements):
        if e.above:
            e.above.chars += e.chars
    need = p.coverage * sum(b.chars for b in chosen)
    box = max((e for e in elements if e.chars >= need), key=lambda e: e.depth)
    # Content paths are kept wherever they stand; the rest of what holds them are their neighbours.
    inside: dict[Element, bool] = {}
    holding: dict[Element, Element] = {}
    for e in elements:
        inside[e] = e is box or e.semantic and e.chars > 0 or e.above is not None and inside[e.above]
        holding[e] = e if e.tag in HOLDERS or e.above is None else holding[e.above]

    def holder(e: Element) -> Element:
        """The container an element is a part of: a paragraph's, list's, table's or quote's; a div may be like a paragraph."""
        return holding[e.above if e.tag == "div" and e.above is not None else e]

    holders = {holder(b.at) for b in chosen} | {b.at for b in chosen}
    e = box
    while e is not None:
        holders.add(e)
        e = e.above
    plain = weight[box]  # a name that all of the content bears says nothing
    kept = []
    for b in found:
        if b.linked > p.most_links * b.chars:
            continue
        if b.at.path in content or weight[b.at] >= plain and (inside[b.at] or holder(b.at) in holders):
            kept.append(b.text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, p: Params = Params(), html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, 2, 4 * tokens.SLICE_BYTES):
                texts = [main_text(h, p) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", html_col).mapInArrow(tokens.tidied(run), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
