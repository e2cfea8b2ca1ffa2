"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags; elements are tracked with a stack, so unclosed
``p``, ``li`` and the like end where HTML ends them. The stack keeps each tag's places, so a page takes
time in proportion to its length whatever it leaves open.

Pass one decides a block by its features: link density, length, stop-word density, and where it stands.
Menus, forms, side bars and the like (by tag, role, class or id) are not text; places whose names only hint at
that (``HINTS``) are text if long and dense inside the article. In an article or main part a lower density will do, beside one a
higher is asked for. Short blocks, headings and unclear ones stay open. Density counts only on pages with a stop word at all, so
pages in other languages are judged by length.

Pass two gives an open block the label of the nearest decided blocks in its own container (ties: text). In a container
where nothing is decided, the open blocks are judged together, as one block; if that is too short to decide, each
takes the label of the nearest decided block of the page (ties: text), and without any it is text only in an article.

Null and empty pages give an empty text; so do pages without main text. Repeated rows each give a
row; a null page_id or url is carried through. Pages are read whole, however long; one that ends in the middle of a tag,
a script or a comment is read up to there. Empty tables give empty results. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Element names.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = ("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "xmp")
DROPPED_TAGS = frozenset("head nav aside footer form button select option label input menu dialog canvas audio video".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr popup modal overlay subscribe newsletter signup login comment comments commentlist disqus respond replies pagination pager toolbar".split()
)
#: Names that also stand at parts of articles.
HINTS = frozenset("promo promotion banner widget notice notices disclaimer share sharing social related recommended copyright".split())
#: Elements whose blocks are judged together.
CONTAINERS = frozenset("html body article main section div td th blockquote details center dir".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Which open elements a start tag ends, if they are the innermost blocks.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Frequent words of four languages.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i if in is it its not of on or she that the their there they this to was were which will with you "
    "au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour que qui sa se ses son sont sur un une vous "
    "aber als am an auch auf aus bei das dass dem den der des die ein eine einen einer es für hat ich im ist mit nach nicht oder sich sie sind so und von war werden wie wird zu zum zur "
    "al como con cuando del el ella en entre era es esta este fue ha hay la las lo los más no o para pero por que se sin sobre su sus un una y ya".split()
)
SHORT, LONG = 70, 140
MAX_LINK_DENSITY = 0.5
STOP_GOOD, STOP_BAD = 0.2, 0.05
BESIDE = 0.15  # what a block beside the article needs more
MAX_TAG = 1 << 16  # a longer tag ends at its first >, quoted or not

_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW_TAGS}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME_PARTS = re.compile(r"[^a-z0-9]+")
_WORD = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    text: str
    linked: int  # characters in links
    inside: bool  # an article or the main part of the page
    place: int  # 2: not a place of text, 1: a hint of that, 0: neither
    heading: bool
    container: int

    def words(self) -> list[str]:
        return _WORD.findall(self.text.lower())


def _place(tag: str, attributes: str, inside: bool) -> int:
    """``Block.place`` of what an element holds."""
    if tag in DROPPED_TAGS or (tag == "header" and not inside):
        return 2
    out = 0
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in DROPPED_ROLES) or (name == "style" and _HIDDEN.search(value)):
            return 2
        if name in ("class", "id"):
            parts = set(_NAME_PARTS.split(value))
            if tag not in ("html", "body", "article", "main") and parts & DROPPED_NAMES or tag == "article" and "comment" in parts:
                return 2
            out = 1 if tag not in ("html", "body", "article", "main") and parts & HINTS else out
    return out


class _Stack:
    """Open elements, with the places of each tag's, of the block elements and of the containers among them."""

    def __init__(self):
        self.elements: list[tuple[str, int, bool]] = []  # tag, place, inside
        self.by_tag: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.containers: list[tuple[int, int]] = [(-1, 0)]  # place in the stack, number
        self.numbers = 0

    def push(self, tag: str, place: int, inside: bool) -> None:
        at = len(self.elements)
        self.elements.append((tag, place, inside))
        self.by_tag.setdefault(tag, []).append(at)
        if tag in BLOCK_TAGS:
            self.blocks.append(at)
        if tag in CONTAINERS:
            self.numbers += 1
            self.containers.append((at, self.numbers))

    def close(self, at: int) -> None:
        """Ends the element at this place and all in it."""
        while len(self.elements) > at:
            tag = self.elements.pop()[0]
            self.by_tag[tag].pop()
            if tag in BLOCK_TAGS:
                self.blocks.pop()
            if tag in CONTAINERS:
                self.containers.pop()

    def last(self, tag: str) -> int:
        return places[-1] if (places := self.by_tag.get(tag)) else -1

    def top(self) -> tuple[str, int, bool]:
        return self.elements[-1] if self.elements else ("", 0, False)


def blocks(page: str) -> tuple[list[Block], bool]:
    """The blocks in page order, and whether the page marks an article or main part."""
    out: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    linked, marked = 0, False

    def end_block() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            _, place, inside = stack.top()
            out.append(Block(text, linked, inside, place, any(t in HEADINGS for t, _, _ in stack.elements[-3:]), stack.containers[-1][1]))
        parts.clear()
        linked = 0

    i, n = 0, len(page)
    while i < n:
        j = page.find("<", i)
        if j < 0:
            j = n
        if j > i:
            parts.append(page[i:j])
            linked += (j - i) if stack.by_tag.get("a") else 0
        if j >= n:
            break
        if page.startswith("<!--", j):
            k = page.find("-->", j + 4)
            i = n if k < 0 else k + 3
            continue
        if page[j + 1 : j + 2] in ("!", "?"):
            k = page.find(">", j)
            i = n if k < 0 else k + 1
            continue
        m = _TAG.match(page, j, j + MAX_TAG) or _LOOSE_TAG.match(page, j)
        if not m:
            if re.match(r"</?[a-zA-Z]", page[j : j + 3]):  # the page ends in a tag
                break
            parts.append("<")
            i = j + 1
            continue
        i = m.end()
        ending, tag, attributes = m[1], m[2].lower(), m[3]
        is_block = tag in BLOCK_TAGS
        if ending:
            at = stack.last(tag)
            if is_block:
                end_block()
            if at >= 0 and (is_block or at > (stack.blocks[-1] if stack.blocks else -1)):
                if stack.elements[at][1] == 2 and not is_block:  # what it held doesn't run on
                    end_block()
                stack.close(at)
            continue
        if tag in _RAW:
            k = _RAW[tag].search(page, i)
            i = k.end() if k else n
            parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
        if is_block:
            end_block()
            while stack.blocks:
                over = stack.elements[stack.blocks[-1]][0]
                if not (over == "p" or over in ENDS.get(tag, ()) or (tag in HEADINGS and over in HEADINGS)):
                    break
                stack.close(stack.blocks[-1])
        if tag in VOID_TAGS or attributes.endswith("/") and not is_block:
            continue
        _, place, inside = stack.top()
        own = 2 if place == 2 else _place(tag, attributes, inside)
        if own == 2 and place < 2 and not is_block:
            end_block()
        place = max(place, own)
        if tag in ("article", "main") and place < 2:
            inside = marked = True
        stack.push(tag, place, inside)
    end_block()
    return out, marked


def _judge(blocks: list[Block], marked: bool, dense: bool) -> bool | None:
    """Pass one for a block, or for some of a container's as if they were one: True (text), False (not text) or None (open)."""
    first, length = blocks[0], sum(len(b.text) for b in blocks)
    if first.place == 2 or sum(b.linked for b in blocks) > MAX_LINK_DENSITY * length:
        return False
    if length < SHORT or all(b.heading for b in blocks):
        return None
    if dense:
        words = [w for b in blocks for w in b.words()]
        density = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
    else:
        density = STOP_GOOD if length >= LONG else STOP_BAD
    need = STOP_BAD if first.inside else STOP_GOOD + (BESIDE if marked else 0)
    if first.place == 1:
        return first.inside and length >= LONG and density >= STOP_GOOD
    if density >= need:
        return True
    if marked and not first.inside:
        return False
    return False if not first.inside and length >= LONG and density < STOP_BAD else None


def _nearest(labels: list[bool | None]) -> list[bool | None]:
    """Of each place the label of the nearest decided ones, True if they differ; None without any."""
    out, near = list(labels), [(len(labels), None)] * len(labels)
    for step in (range(len(labels)), range(len(labels) - 1, -1, -1)):
        last = None
        for i in step:
            last = i if labels[i] is not None else last
            if labels[i] is None and last is not None:
                gap, label = abs(i - last), labels[last]
                near[i] = (gap, label) if gap < near[i][0] else (gap, label or near[i][1]) if gap == near[i][0] else near[i]
                out[i] = near[i][1]
    return out


def classify(found: list[Block], marked: bool) -> list[bool]:
    """Which blocks are text."""
    dense = any(w in STOP_WORDS for b in found for w in b.words())
    labels = [_judge([b], marked, dense) for b in found]
    by: dict[tuple, list[int]] = {}
    for i, b in enumerate(found):
        if b.place < 2:
            by.setdefault((b.container, b.inside), []).append(i)
    second = list(labels)
    for group in by.values():
        if all(labels[i] is None for i in group):
            got = [_judge([found[i] for i in group], marked, dense)] * len(group)
        else:
            got = _nearest([labels[i] for i in group])
        for i, label in zip(group, got, strict=True):
            second[i] = label
    some = [i for i, b in enumerate(found) if b.place < 2]
    for i, label in zip(some, _nearest([second[i] for i in some]), strict=True):
        second[i] = found[i].inside if label is None else label
    return [bool(x) for x in second]


def extract(page: str | None) -> str:
    found, marked = blocks(page or "")
    return "\n\n".join(b.text for b, good in zip(found, classify(found, marked), strict=True) if good)


def main_text(pages: DataFrame, rows_at_once: int = 512) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""

    def apply(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(i, rows_at_once)
                texts = [extract(x.as_py()) for x in part.column("html")]
                yield pa.record_batch({"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.select("page_id", "url", "html").mapInArrow(apply, "page_id long, url string, text string, n_chars long")
