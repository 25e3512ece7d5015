"""Main text of web pages by tag-path ratios.

Text blocks are grouped by their tag path, the block elements from the root to the one that holds the text. A
path's ratio is its text length per block, and punctuation per block makes an extended ratio; along the page
both are smoothed and fused with the path's own. A path is content if its fused ratio, times a bounded prior, reaches a
share of the greatest ratio of the page (less what speaks against its path). The prior is what the page says of its elements: those made for text
(paragraphs, list items, cells) may be shorter than boxes, what lies outside a marked article must be longer, names that
hint at boilerplate and text that is all links count against a path. Elements that are no article by their meaning
(menus, footers, forms, scripts), hidden ones, and those whose whole name says menu, advert, comments of readers or the
like have no content, whatever their ratio.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes to either side that smoothing takes in, and the weight of a path's own ratio among the three that are fused.
RADIUS, OWN = 2, 2 / 3
#: Share of the page's greatest fused ratio, less what speaks against its path, that content reaches.
SHARE = 0.2
#: Priors: of elements made for text, of what lies outside a marked article, of a name that hints at boilerplate, and of
#: a path of links.
TEXT, OUTSIDE, MAYBE, LINKED = 64.0, 1 / 256, 0.5, 0.01
#: Share of a path's text in links, and its blocks, from which on it is a path of links.
LINK_SHARE, LINK_BLOCKS = 0.8, 3

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
NEVER = frozenset("script style noscript template head title nav header footer aside form button select option textarea iframe object svg canvas menu dialog fieldset label input noembed noframes audio video map math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
LEVEL = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
HEADING = re.compile(r"h[1-6]$")
FOR_TEXT = frozenset("p li dd dt td th pre blockquote figcaption caption h1 h2 h3 h4 h5 h6".split())
# Words in class and id names by which pages mark what is not their article, and words that say nothing
# beside them. A name of such words only, one of the first kind among them, is the name of boilerplate.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr nav navbar navigation menu menus breadcrumb breadcrumbs pager pagination "
    "sidebar widget widgets footer masthead topbar comment comments commentlist discussion discussions respond replies reply disqus share sharing sharebar related recommended recommendations newsletter subscribe subscription signup login popup modal "
    "overlay skiplink toolbar notice notices".split()
)
NEUTRAL = frozenset(
    "area bar block body bottom box button buttons center col column container content element form group holder icons inner item items js left layout links list main module outer page panel posts primary reader readers right row secondary section site slot small "
    "social static sticky thread top unit user users wrap wrapper".split()
)
HINTS = frozenset("alert header social tags tag copyright legal byline meta info tools print side bar list links".split())
#: Words of names that say that a block belongs to the article, and words of names that only mention a thing.
ARTICLE_WORDS = frozenset("article post entry content story body text main page prose".split())
NEGATING = frozenset("no has with without none".split())
NO_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKED = frozenset(["article", "main"])
NAME_WORD = re.compile(r"[a-z]+")
#: The factor of a named boilerplate element: no prior, as it puts the element out of reach.
BY_NAME = 1e-9

# Quotes are passed over whole, so a > inside one does not end the tag; nothing is scanned twice.
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
INSIDE = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
ASIDE = re.compile(r"<!--.*?(?:-->|$)|<[!?/][^>]*+>?", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+")
PUNCTUATION = re.compile(r"[.,;:!?…。、！？]")
SPACE = re.compile(r"\s+")


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(raw)}


def evidence(name: str, raw: str) -> float:
    """What an element's name and attributes say of its content: 0 if it has none, BY_NAME if its name is boilerplate's, else a prior."""
    if name in NEVER:
        return 0.0
    if not raw.strip():
        return 1.0
    has = _attributes(raw)
    if "hidden" in has or has.get("aria-hidden", "").lower() == "true" or has.get("role", "").lower() in NO_ROLE:
        return 0.0
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", has.get("style", ""), re.IGNORECASE):
        return 0.0
    if name in ("body", "html"):  # their names are those of the page's layout
        return 1.0
    names = [{*NAME_WORD.findall(x)} for x in f"{has.get('class', '')} {has.get('id', '')}".lower().split()]
    names = [x for x in names if x and not x & NEGATING]
    if any(x & BOILERPLATE and x <= BOILERPLATE | NEUTRAL for x in names):
        return BY_NAME
    return MAYBE if any(x & (BOILERPLATE | HINTS) for x in names) else 1.0


class Blocks:
    """The text blocks of a page that may be content: path, text, characters in links, factor, and whether in a mark."""

    def __init__(self, page: str):
        self.path: list[str] = []
        self.text: list[str] = []
        self.linked: list[int] = []
        self.factor: list[float] = []
        self.marked: list[bool] = []
        self._open: list[tuple[str, float, bool]] = []  # name, factor of it and all around it, whether in a marked article
        self._held: list[str] = []
        self._linked = 0
        self._links = 0
        self._read(page)
        self._flush()

    def _flush(self) -> None:
        text, linked = SPACE.sub(" ", "".join(self._held)).strip(), self._linked
        self._held, self._linked = [], 0
        if not text:
            return
        _, factor, marked = self._open[-1] if self._open else ("", 1.0, False)
        self.path.append("/".join(n if f == 1 else f"{n}~{f:g}" for n, f, _ in self._open if n not in INLINE))
        self.text.append(text)
        self.linked.append(linked)
        self.factor.append(factor)
        self.marked.append(marked)

    def _pop_to(self, k: int) -> None:
        """Closes all elements from place k on. Blocks and excluded inline parts end here."""
        if any(n not in INLINE for n, _, _ in self._open[k:]):
            self._flush()
        self._links -= sum(n == "a" for n, _, _ in self._open[k:])
        del self._open[k:]

    def _start(self, name: str, raw: str) -> None:
        if name in CLOSES_P:
            for k in range(len(self._open) - 1, -1, -1):
                if self._open[k][0] == "p":
                    self._pop_to(k)
                    break
                if self._open[k][0] not in INLINE:
                    break
        if name in LEVEL:
            ends, limits = LEVEL[name]
            for k in range(len(self._open) - 1, -1, -1):
                if self._open[k][0] in ends.split():
                    self._pop_to(k)
                    if name != "tr":
                        break
                elif self._open[k][0] in limits:
                    break
        if name in VOID:
            if name == "br":
                self._held.append(" ")
            elif name not in INLINE:
                self._flush()
            return
        if name not in INLINE:
            self._flush()
        _, factor, marked = self._open[-1] if self._open else ("", 1.0, False)
        factor *= evidence(name, raw)
        marked |= factor > 0 and (name in MARKED or "main" in _attributes(raw).get("role", "").split())
        self._links += name == "a"
        self._open.append((name, factor, marked))

    def _end(self, name: str) -> None:
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] == name:
                self._pop_to(k)
                return
            if name in INLINE and self._open[k][0] not in INLINE:
                return

    def _take(self, text: str) -> None:
        if self._open and not self._open[-1][1]:
            return
        text = html.unescape(text) if "&" in text else text
        self._held.append(text)
        if self._links:
            self._linked += len(text.strip())

    def _read(self, page: str) -> None:
        at, loose = 0, False
        while at < len(page):
            if page[at] != "<":
                end = page.find("<", at)
                end = len(page) if end < 0 else end
                self._take(page[at:end])
                at = end
                continue
            found = NAME.match(page, at)
            if not found:
                aside = ASIDE.match(page, at)
                if aside:
                    at = aside.end()
                else:
                    self._take("<")
                    at += 1
                continue
            end = len(page) if loose else INSIDE.match(page, found.end()).end()
            if end == len(page) or page[end] != ">":
                # A quote that never ends: from here on the next > ends a tag. Without one the rest is an unfinished tag.
                loose = True
                end = page.find(">", found.end())
                if end < 0:
                    return
            name, raw, at = found[1].lower(), page[found.end() : end], end + 1
            if page[found.start() + 1] == "/":
                self._end(name)
                continue
            self._start(name, raw)
            if name in RAW and not raw.endswith("/"):
                close = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
                end = page.find(">", close.end()) if close else -1
                at = end + 1 if end >= 0 else len(page)
                self._end(name)


def smoothed(x: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Gaussian means over the nodes to either side; weights beyond the ends are left out."""
    d = np.arange(-radius, radius + 1)
    weight = np.exp(-(d**2) / (2 * max(1, radius) ** 2))
    full = np.convolve(x, weight, "full")[radius : radius + len(x)]
    return full / np.convolve(np.ones(len(x)), weight, "full")[radius : radius + len(x)]


def path_ratios(path: np.ndarray, length: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Fused ratio of each path: text a block, and text by punctuation a block, smoothed along the page, with its own; mean over its blocks."""
    blocks = np.bincount(path)
    text, punctuation = np.bincount(path, length) / blocks, np.bincount(path, marks) / blocks
    plain, extended = smoothed(text[path]), smoothed((text * np.log2(2 + punctuation))[path])
    fused = text[path] ** OWN * (plain * extended) ** ((1 - OWN) / 2)
    return np.bincount(path, fused) / blocks


def priors(names: np.ndarray, factor: np.ndarray, inside: np.ndarray, links: np.ndarray) -> np.ndarray:
    """What the page says of each path, its names' factor among it."""
    own = factor.copy()
    # A name alone does not empty an article: if all that is inside has such names, they only count against it.
    if inside.any() and (own[inside] < MAYBE**8).all():
        own[inside] = MAYBE
    leaf = [x.rpartition("/")[2].partition("~")[0] for x in names]
    own = own * np.where([x in FOR_TEXT for x in leaf], TEXT, 1.0) * np.where(links, LINKED, 1.0)
    return own * np.where(inside, 1.0, OUTSIDE) if inside.any() else own


def main_text(page: str | None) -> str:
    """Blocks of the content's paths in page order, joined by a line end."""
    blocks = Blocks(page or "")
    if not blocks.text:
        return ""
    keys = [f"{p}{'*' if m else ''}" for p, m in zip(blocks.path, blocks.marked, strict=True)]
    names, first, path = np.unique(keys, return_index=True, return_inverse=True)
    names = np.array([x.rstrip("*") for x in names])
    length = np.array([len(t) for t in blocks.text])
    ratio = path_ratios(path, length, np.array([len(PUNCTUATION.findall(t)) for t in blocks.text]))
    links = (np.bincount(path, blocks.linked) >= LINK_SHARE * np.bincount(path, length)) & (np.bincount(path) >= LINK_BLOCKS)
    prior = priors(names, np.array(blocks.factor)[first], np.array(blocks.marked, bool)[first], links)
    able = prior > BY_NAME * TEXT
    if not able.any():
        return ""
    heading = np.array([bool(HEADING.match(x.rpartition("/")[2].partition("~")[0])) for x in names])
    judged = able & ~heading if (able & ~heading).any() else able
    keep = able & (ratio * prior >= SHARE * (ratio * np.minimum(prior, 1))[judged].max())
    if not (keep & judged).any():
        keep |= judged & (ratio * prior == (ratio * prior)[judged].max())
    # A heading goes with the content of its own parent; inside a marked article it stands by its ratio, too.
    parents = {names[k].rpartition("/")[0] for k in np.flatnonzero(keep & ~heading)}
    marked = np.array(blocks.marked, bool)[first]
    for k in np.flatnonzero(able & heading):
        keep[k] = names[k].rpartition("/")[0] in parents or keep[k] and (marked[k] or not (able & ~heading).any())
    return "\n".join(blocks.text[k] for k in np.flatnonzero(keep[path]))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, len(batch), 500):
            part = batch.slice(a, 500)
            texts = [main_text(x.as_py()) for x in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, whole html; pages are not shuffled.

    Null or empty html, and html without content, give an empty text. Unclosed and misnested elements are
    closed as browsers do for paragraphs, list items and table cells. Repeated rows each have their row; null
    ids and urls stay null. Empty table: no rows. Other columns are ignored.
    """
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
