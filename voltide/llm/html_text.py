"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags; what is named by its element as
no text of an article (menus, footers, forms, adverts, comments and their like)
is taken out. The first pass decides a block by stop-word density, length and
link density. Where it stands moves the limits: inside the page's article no
stop words are asked for, outside of it no density is enough. Blocks too short
or too plain to decide then take the label of the nearest decided neighbours,
within the article first; where those differ, of the nearer one, and of the
following one for a heading. Good blocks are joined in page order.

An article or main element counts as the page's article if it holds a fair part
of the text that the first pass likes wherever it stands. A class, id or role
that sounds like an aside is a hint: it is overruled where its element holds
most of that text, or the page's only article. Stop words are not asked for in
scripts other than Latin, nor on a page that has next to none.

Defined results: null, empty and textless pages give an empty text; unclosed,
misnested and cut-off tags are read to the end of the page; a block as near to a
good neighbour as to a bad one is bad unless it is in the article; a page takes
time in proportion to its length; every row gives one row, repeated rows and null
ids too; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from voltide.llm.common import c, map_frames
from voltide.session import spread

TEXTS = "page_id long, url string, text string, n_chars long"

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"([A-Za-z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_EDGE = re.compile(r"^\W+|\W+$")
_HINT_CUT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")

#: Elements whose content is no markup, and whether it is ever text.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that are never part of an article's text.
ASIDE = frozenset("nav footer aside form button select textarea dialog menu noscript template svg math object canvas audio video head search".split())
#: Words of class, id and role that name such a part.
HINTS = frozenset(
    "nav navbar navigation menu menubar footer sidebar aside complementary contentinfo ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog newsletter subscribe subscription signup login signin search share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager comment comments commentlist disqus reply replies respond discussion widget toolbar copyright legal disclaimer hidden skip".split()
)
#: These also stand at the head of an article.
HEADS = frozenset({"header", "masthead", "topbar"})
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
STOP = frozenset(
    "the of and to in a is that it for was on are as with be by at this from have or an not which but they you we his her there their has been will would can if so all when out up who what about more no into than then them some could only over also after other "
    "der die das und in zu den von mit ist des dem nicht ein eine auf für im sich auch als es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben oder vor zur bis mehr durch "
    "le la les de des et en un une du que qui dans pour par sur est pas au avec se ce il elle ne sont plus ou son sa ses mais comme nous vous aux cette être ont leur "
    "el los las y que del se por con una su para es al lo como más pero sus o este sí porque esta entre cuando muy sin sobre ser tiene también me hasta hay donde han quien está desde todo nos".split()
)

LONG, SHORT = 200, 70
#: Parts of the page's text: above MOST a hint is overruled, from FAIR on an
#: article element is the page's article.
MOST, FAIR = 2 / 3, 1 / 4
_FOREIGN = re.compile(r"[^\W\d_a-zA-Z\u00aa-\u024f]")


@dataclass(frozen=True)
class Limits:
    """Of the first pass: below ``short`` characters a block is open; with stop
    words from ``high`` on (or ``low``, if over ``long``) it is good, below
    ``low`` bad, between open; above ``links`` it is what ``linked`` says."""

    short: int
    long: int
    low: float
    middle: float
    high: float
    links: float
    linked: str


#: By where a block stands: in the page's article, on a page that has one but
#: outside of it, on a page without.
INSIDE = Limits(SHORT, 0, 0.0, 0.0, 0.0, 0.5, "")
OUTSIDE = Limits(0, LONG, 2.0, 2.0, 2.0, 0.5, "bad")
ANYWHERE = Limits(SHORT, LONG, 0.1, 0.2, 0.3, 0.5, "bad")


@dataclass
class Block:
    text: str
    linked: int
    part: bool  # of an element that is no article text for sure
    hint: int  # innermost element that sounds like none, -1 without one
    inside: bool
    heading: bool
    label: str = ""
    stop: float = 0.0


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)}


def _is_aside(tag: str, raw: str, inside: bool) -> str:
    """Whether an element opens a part that is no article text: "part" if for
    sure, "hint" if what it holds can say otherwise."""
    if tag in ASIDE or (tag == "header" and not inside):
        sure = tag != "form"  # some pages are one form
        if sure or not raw.strip():
            return "part" if sure else "hint"
    if not raw.strip():
        return ""
    a = _attributes(raw)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return "part"
    named = {x.lower() for k in ("class", "id", "role") for x in _HINT_CUT.split(a.get(k, ""))}
    if tag in ("html", "body", "main"):
        return ""
    if named & COMMENTS:
        return "part"
    if tag == "article":
        return ""
    return "hint" if tag == "form" or named & HINTS or (not inside and named & HEADS) else ""


class _Reader:
    """Cuts a page into blocks."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, bool, int, bool]] = []  # tag, part, hint, inside an article
        self.opened: Counter[str] = Counter()
        self.hints: list[int] = []  # the hint around each hint
        self.holds: set[int] = set()  # hints that hold an article or main element
        self.parts: list[str] = []
        self.linked = self.links = 0
        self.heading = False

    def state(self) -> tuple[bool, int, bool]:
        return self.stack[-1][1:] if self.stack else (False, -1, False)

    def text(self, raw: str) -> None:
        if raw:
            t = html.unescape(raw) if "&" in raw else raw
            self.parts.append(t)
            if self.links:
                self.linked += len(_SPACE.sub(" ", t).strip())

    def flush(self) -> None:
        t = _SPACE.sub(" ", "".join(self.parts)).strip()
        if t:
            self.blocks.append(Block(t, self.linked, *self.state(), self.heading))
        self.parts, self.linked = [], 0

    def pop(self) -> None:
        self.opened[self.stack.pop()[0]] -= 1

    def open(self, tag: str, raw: str) -> None:
        if tag == "a":
            self.links = 1
            return
        if tag == "br":
            self.parts.append(" ")
            return
        part, hint, inside = self.state()
        marks = _is_aside(tag, raw, inside)
        if tag in BLOCK or marks:
            self.flush()
            self.heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
            self.links = 0
        if tag in VOID or not (tag in BLOCK or marks):
            return
        if self.stack:
            top = self.stack[-1][0]
            if top == tag and tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") or tag != "p" and top == "p":
                self.pop()
                part, hint, inside = self.state()
                marks = _is_aside(tag, raw, inside)
        if marks == "hint":
            self.hints.append(hint)
            hint = len(self.hints) - 1
        main = tag in ("article", "main") and not marks
        if main and not part and hint >= 0:
            self.holds.add(hint)
        self.stack.append((tag, part or marks == "part", hint, inside or main))
        self.opened[tag] += 1

    def close(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
        known = self.opened[tag] > 0 if tag in self.opened else False
        if tag in BLOCK or known:
            self.flush()
            self.heading, self.links = False, 0
        if known:
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()


def blocks_of(page: str) -> _Reader:
    """The page's blocks with text, in order, and its hints."""
    r, at = _Reader(), 0
    while m := _TOKEN.search(page, at):
        r.text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            r.close(tag)
            continue
        raw = (m[3] if m[2] else m[6]) or ""
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s>/]|\\Z)[^>]*(?:>|\\Z)", re.IGNORECASE).search(page, at)
            r.flush() if tag in BLOCK else None
            at = end.end() if end else len(page)
            continue
        r.open(tag, raw)
    r.text(page[at:])
    r.flush()
    return r


def stop_density(text: str) -> float:
    """Part of the words that are stop words; 1 in scripts that have none here."""
    if len(_FOREIGN.findall(text)) * 2 > len(text) - text.count(" "):
        return 1.0
    words = [_EDGE.sub("", w).lower() for w in text.split()]
    return sum(w in STOP for w in words) / max(1, len(words))


def first_pass(b: Block, limits: Limits) -> str:
    """good, bad, or empty where a block alone does not tell."""
    n, density = len(b.text), b.linked / len(b.text)
    if density > limits.links:
        return limits.linked
    if n < limits.short:
        return "bad" if density > 0.2 and limits.linked else ""
    if b.stop >= limits.middle and n > limits.long or b.stop >= limits.high:
        return "good"
    return "" if b.stop >= limits.low else "bad"


def second_pass(first: list[str], side: list[bool], heading: list[bool]) -> list[str]:
    """Open blocks take the label of the nearest decided neighbours; those in
    the article (``side``) look there first and are good without any."""

    def nearest(order: range, same_side: bool) -> list[int | None]:
        out: list[int | None] = [None] * len(first)
        last: dict[bool, int | None] = {True: None, False: None}
        for i in order:
            key = side[i] if same_side else False
            if first[i]:
                last[key] = i
            out[i] = last[key]
        return out

    up, down = range(len(first)), range(len(first) - 1, -1, -1)
    before, after = nearest(up, True), nearest(down, True)
    wide_before, wide_after = nearest(up, False), nearest(down, False)
    labels = list(first)
    for i, label in enumerate(first):
        if label:
            continue
        lo, hi = before[i], after[i]
        if lo is None and hi is None and not side[i]:
            lo, hi = wide_before[i], wide_after[i]
        if lo is None and hi is None:
            labels[i] = "good"
        elif lo is None or hi is None:
            labels[i] = first[hi if lo is None else lo]
        elif first[lo] == first[hi] or i - lo != hi - i:
            labels[i] = first[lo if i - lo < hi - i else hi]
        else:
            labels[i] = "good" if side[i] or (heading[i] and first[hi] == "good") else "bad"
    return labels


def _asides(r: _Reader, liked: list[float]) -> list[bool]:
    """Which hints hold: those whose element has less than most of what is
    liked, unless it is around the page's only article; and all within them."""
    weight = [0.0] * len(r.hints)
    for b, x in zip(r.blocks, liked, strict=True):
        if b.hint >= 0:
            weight[b.hint] += x
    holds = set(r.holds)
    for h in range(len(r.hints) - 1, -1, -1):  # an inner hint has the higher number
        if r.hints[h] >= 0:
            weight[r.hints[h]] += weight[h]
            if h in holds:
                holds.add(r.hints[h])
    total, free = sum(liked), any(b.inside and not b.part and b.hint < 0 for b in r.blocks)
    out: list[bool] = []
    for h, up in enumerate(r.hints):
        overruled = weight[h] > MOST * total or (h in holds and not free)
        out.append(not overruled or (up >= 0 and out[up]))
    return out


def label_blocks(r: _Reader) -> list[Block]:
    """Both passes over what no element takes out."""
    for b in r.blocks:
        b.stop = stop_density(b.text)
    free = [b for b in r.blocks if not b.part]
    long = [b for b in free if len(b.text) >= SHORT and b.linked <= 0.5 * len(b.text)]
    if sum(b.stop * len(b.text) for b in long) < 0.05 * sum(len(b.text) for b in long):
        for b in free:  # a language without stop words here
            b.stop = 1.0
    liked = [0.0 if b.part or first_pass(b, ANYWHERE) == "bad" else float(len(b.text) - b.linked) for b in r.blocks]
    asides = _asides(r, liked)
    taken = [b.part or (b.hint >= 0 and asides[b.hint]) for b in r.blocks]
    left = [(b, x) for b, x, out in zip(r.blocks, liked, taken, strict=True) if not out]
    article = sum(x for b, x in left if b.inside)
    trusted = article > 0 and article >= FAIR * sum(x for _, x in left)
    blocks, side = [b for b, _ in left], [trusted and b.inside for b, _ in left]
    first = [first_pass(b, INSIDE if s else OUTSIDE if trusted else ANYWHERE) for b, s in zip(blocks, side, strict=True)]
    for b, label in zip(blocks, second_pass(first, side, [b.heading for b in blocks]), strict=True):
        b.label = label
    if not any(b.label == "good" for b in blocks):  # a page of one odd text: what is no menu or advert is it
        for b in blocks:
            if b.linked <= 0.5 * len(b.text):
                b.label = "good"
    return r.blocks


def main_text(page: str | None) -> str:
    """The article's blocks, joined by empty lines."""
    return "\n\n".join(b.text for b in label_blocks(blocks_of(page)) if b.label == "good") if page else ""


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per page; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return map_frames(spread(pages.select(c(id_col).cast("long").alias("page_id"), c(url_col).cast("string").alias("url"), c(html_col).cast("string").alias("html"))), run, TEXTS)
