"""Main text of web pages by two passes of block rules.

A page is cut into blocks: runs of text between block-level tags, inline markup removed,
character references decoded, white space turned into single spaces. Scripts, styles,
comments in the markup and form controls have no text. Elements that say what they are, by
their tag, role, class or id (menus, page headers and footers, sidebars, notices, adverts,
forms, readers' comments), are taken out before the rules.

First pass, each block on its own: the share of its characters inside links, its length and
the share of its words that are stop words make it good, bad or undecided (too short, or
nearly good). Where no block of a page has enough stop words, its language is not one of
theirs, and length and links decide alone. Second pass: an undecided block takes the label of
the nearest decided block of its container or, if that has none, of its page. Where two are
equally near and differ, a nearly good one becomes good, and a short one, such as a heading,
goes with what follows it; where a page has no decided block at all, undecided ones are good.
The text is made of the good blocks in page order, joined by one space.

Where a page marks its article (``article``, ``main`` or the matching roles), blocks outside
are bad and blocks inside are good, but for runs of ``menu_run`` or more list entries that are links.

Pages are parsed in one pass of a regular expression that never backs up, so the time is
linear in the page, broken markup included; open elements are counted, so that closing tags
cost no search. The rules run in numpy over all blocks of an Arrow batch. There is no
shuffle; memory is bounded by an Arrow batch or, if larger, one page.

Cases: a null or empty page has an empty text; repeated rows are extracted row by row; tags,
comments and scripts that never end reach to the end of the page; other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import buffers, groups

#: Frequent function words (fixed values): English, German, French, Spanish.
STOP_WORDS = frozenset(
    """the of and to in a is that it for was on are as with be by at this from or an have not which they you were but
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er sie aus bei sind noch
    le la les de des et un une du en que qui dans pour par sur au avec ce il ne pas plus est se son elle ou
    el los las y del se con una su para es al lo como más o pero sus este ya entre cuando muy sin sobre también me hasta""".split()
)
#: Elements that hold no article text (fixed values), with all they contain.
REMOVED = frozenset("nav aside footer form noscript template svg select datalist button label canvas object video audio dialog menu fieldset".split())
#: Elements whose content is not markup (fixed values).
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements without an end tag (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that nest (fixed values).
CONTAINERS = frozenset(
    "address article aside blockquote body center details dialog div dl fieldset figure footer form header hgroup html main menu nav ol section table ul template noscript svg select object video audio canvas".split()
)
#: Elements that start a new block beside the containers (fixed values).
BREAKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot caption figcaption pre summary hr legend option body html head".split())
#: Roles of elements without article text (fixed values).
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
#: Words of a class or id that mark an element as no article text (fixed values).
MARKS = frozenset(
    """nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar sidenav rail footer colophon masthead
    ad ads advert adverts advertisement advertising adsense sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe
    comment comments commentlist respond reply replies disqus discussion share sharing social related recommended recommendations login signup searchform""".split()
)
#: Words of a class or id that mark a page's header, outside articles only (fixed values).
HEADS = frozenset("header topbar".split())
#: Words after which a mark names what the element has beside it (fixed values).
BESIDE = frozenset("with has no without".split())
#: Words before which a mark tells a state of the element (fixed values).
STATES = frozenset("open opened closed enabled disabled on off allowed count".split())
NEUTRAL, ARTICLE, GONE = 0, 1, 2

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|</?+[a-zA-Z][^\s/>]*+(?:=\s*+"[^"]*+(?:"|\Z)|=\s*+'[^']*+(?:'|\Z)|[^>=]++|=)*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s>"']++))?""")
_RAW_END = {name: re.compile(rf"</{name}(?![a-z0-9-])", re.I) for name in RAW}
_WORD, _CLASS = re.compile(r"[^\W\d_]+"), re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


@dataclass(frozen=True)
class ExtractParams:
    """Limits of the first pass; lengths are characters, the rest shares. A document in another language needs its own ``stop_words``."""

    max_link_density: float = 0.2
    short: int = 70
    long: int = 140
    few_stop_words: float = 0.12
    many_stop_words: float = 0.20
    menu_run: int = 3
    menu_link_density: float = 0.9
    stop_words: frozenset[str] = STOP_WORDS


def _kind(name: str, tag: str, outer: int) -> int:
    """What the text in an element is, given what the text around it is."""
    kind = GONE if name in REMOVED or (name == "header" and outer != ARTICLE) else ARTICLE if name in ("article", "main") else outer
    if len(tag) > len(name) + 2:
        for key, value in _ATTRIBUTE.findall(tag, len(name) + 1):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id") and name not in ("html", "body", "main"):
                words = ["", *map(str.lower, _CLASS.findall(value)), ""]
                for last, word, then in zip(words, words[1:], words[2:]):
                    if (word in MARKS or (word in HEADS and outer != ARTICLE)) and last not in BESIDE and then not in STATES:
                        return GONE
            elif key == "role":
                if value.lower() in ROLES:
                    return GONE
                kind = ARTICLE if value.lower() in ("main", "article") and kind == NEUTRAL else kind
            elif key == "itemprop" and value.lower() == "articlebody" and kind == NEUTRAL:
                kind = ARTICLE
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                return GONE
    return kind


class _Frame:
    """An open container and the elements that are open directly in it."""

    def __init__(self, name: str, kind: int, link: bool = False, comments: bool = False, number: int = 0):
        self.name, self.kind, self.link, self.comments, self.number = name, kind, link, comments, number
        self.open: list[tuple[str, int, bool]] = []  # name, kind, in a link
        self.count: Counter = Counter()

    def now(self) -> tuple[int, bool]:
        return self.open[-1][1:] if self.open else (self.kind, self.link)

    def close(self, name: str) -> None:
        if self.count[name]:
            while True:
                top = self.open.pop()[0]
                self.count[top] -= 1
                if top == name:
                    return


def blocks_of(html: str) -> list[tuple[str, int, int, bool, int]]:
    """(text, characters in links, kind, in a list, number of its container) of the blocks of a page that no removed element holds."""
    out: list[tuple[str, int, int, bool, int]] = []
    pieces: list[str] = []
    linked, kind_now, n_frames = 0, NEUTRAL, 0
    frames, open_frames = [_Frame("", NEUTRAL)], Counter({"": 1})
    at, end = 0, len(html)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((text, min(linked, len(text)), kind_now, open_frames["ul"] + open_frames["ol"] > 0, frames[-1].number))
            pieces.clear()
        linked = 0

    while at < end:
        m = _TOKEN.search(html, at)
        stop = m.start() if m else end
        if stop > at:
            kind, link = frames[-1].now()
            if kind != GONE:
                if kind != kind_now:
                    flush()
                    kind_now = kind
                text = html[at:stop]
                text = unescape(text) if "&" in text else text
                pieces.append(text)
                if link:
                    linked += len(text.strip())
        if not m:
            break
        at, tag = m.end(), m.group()
        found = _NAME.match(tag)
        if not found:
            continue
        name = found.group(1).lower()
        if name == "br":
            pieces.append(" ")
        elif name in RAW and tag[1] != "/":
            closing = _RAW_END[name].search(html, at)
            at = closing.start() if closing else end
        elif tag[1] == "/":
            if name in CONTAINERS:
                flush()
                if name not in ("html", "body") and open_frames[name]:
                    while True:
                        frame = frames.pop()
                        open_frames[frame.name] -= 1
                        if frame.name == name:
                            break
            else:
                if name in BREAKS:
                    flush()
                frames[-1].close(name)
        elif name in CONTAINERS:
            flush()
            if name in ("html", "body"):
                continue
            frame = frames[-1]
            outer, link = frame.now()
            kind = _kind(name, tag, outer)
            # an article inside a form or a container that was never closed is an article still; one among comments or beside the page isn't
            if outer == GONE and not (name in ("article", "main") and not frame.comments):
                kind = GONE
            beside = frame.comments or (kind == GONE and (name in ("aside", "article") or any(w in tag.lower() for w in ("comment", "repl", "respond", "disqus", "discussion", "sidebar", "related", "recommend"))))
            n_frames += 1
            frames.append(_Frame(name, kind, link, beside, n_frames))
            open_frames[name] += 1
        else:
            frame = frames[-1]
            if name in BREAKS:
                flush()
                frame.close(name)
            if name in VOID or tag.endswith("/>"):
                continue
            outer, link = frame.now()
            kind = GONE if outer == GONE else _kind(name, tag, outer)
            frame.open.append((name, kind, link or name == "a"))
            frame.count[name] += 1
    flush()
    return out


def _inherited(group: np.ndarray, place: np.ndarray, label: np.ndarray, decided: np.ndarray, near: int) -> np.ndarray:
    """Label of the nearest decided block of the same group, -1 without one; groups and places rise."""
    n, far = len(group), np.iinfo(np.int64).max
    at = np.arange(n)
    before = np.maximum.accumulate(np.where(decided, at, -1))
    after = np.minimum.accumulate(np.where(decided, at, n)[::-1])[::-1]
    up = np.where(before >= np.searchsorted(group, group), place - place[before], far)
    down = np.where(after < np.searchsorted(group, group, "right"), place[np.minimum(after, n - 1)] - place, far)
    above, below = label[before], label[np.minimum(after, n - 1)]
    taken = np.where(up < down, above, below)
    taken = np.where((up == down) & (label == near) & (above != below), 1, taken)
    return np.where((up == far) & (down == far), -1, taken)


def judge(page: np.ndarray, length: np.ndarray, linked: np.ndarray, kind: np.ndarray, listed: np.ndarray, stops: np.ndarray, marked: np.ndarray, p: ExtractParams, box: np.ndarray | None = None) -> np.ndarray:
    """True for the good ones of the blocks of several pages in order (``page`` rises).

    ``marked``: the page marks its article; ``stops``: share of stop words; ``box``: number of the block's container in its page.
    """
    n = len(page)
    density = linked / np.maximum(length, 1)
    good, bad, near, unknown = 1, 0, 2, 3
    # pages in a language that the stop words are not of: length and links decide alone
    foreign = np.bincount(page, (stops >= p.few_stop_words) & (length >= p.short), minlength=page[-1] + 1 if n else 0)[page] == 0
    label = np.full(n, bad)
    label[(stops >= p.few_stop_words) | foreign] = near
    label[((stops >= p.many_stop_words) | foreign) & (length > p.long)] = good
    brief = length < p.short
    label[brief] = np.where(linked[brief] > 0, bad, unknown)
    label[density > p.max_link_density] = bad
    # runs of links in lists
    link = listed & (density >= p.menu_link_density)
    cut = np.flatnonzero((np.diff(link.astype(np.int8), prepend=-1) != 0) | (np.diff(page, prepend=-1) != 0))
    run = np.repeat(np.diff(cut, append=n), np.diff(cut, append=n))
    label[marked] = np.where((kind == ARTICLE) & ~(link & (run >= p.menu_run)), good, bad)[marked]
    # second pass: neighbours in the same container, then those in the page
    decided, place = label < near, np.arange(n)
    taken = np.where(decided, label, -1)
    for group in ([] if box is None else [page * (box.max(initial=0) + 1) + box]) + [page]:
        order = np.argsort(group, kind="stable")
        found = np.empty(n, label.dtype)
        found[order] = _inherited(group[order], place[order], label[order], decided[order], near)
        taken = np.where(taken < 0, found, taken)
    return taken != bad


def extract(pages: list[str | None], p: ExtractParams = ExtractParams()) -> list[str]:
    """The main texts of pages."""
    texts, page, rest = [], [], []
    for i, html in enumerate(pages):
        got = blocks_of(html or "")
        marked = any(k == ARTICLE for _, _, k, _, _ in got)
        for text, linked, kind, listed, box in got:
            stops = 0.0
            if not marked:
                words = _WORD.findall(text.lower())
                stops = sum(w in p.stop_words for w in words) / max(1, len(words))
            texts.append(text)
            page.append(i)
            rest.append((len(text), linked, kind, listed, stops, marked, box))
    out = [[] for _ in pages]
    if texts:
        length, linked, kind, listed, stops, marked, box = map(np.array, zip(*rest, strict=True))
        for k in np.flatnonzero(judge(np.array(page), length, linked, kind, listed, stops, marked, p, box)).tolist():
            out[page[k]].append(texts[k])
    return [" ".join(x) for x in out]


def html_extract(pages: DataFrame, params: ExtractParams = ExtractParams(), batch_bytes: int = 16 << 20) -> DataFrame:
    """(page_id, url, text, n_chars) of ``pages`` (page_id, url, html)."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.select("page_id", "url").schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = buffers(batch.column(2))
            for i, j in groups(offsets, batch_bytes):
                part = batch.slice(i, j - i)
                texts = extract(part.column(2).to_pylist(), params)
                cols = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
