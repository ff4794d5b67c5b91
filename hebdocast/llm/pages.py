"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with the path of block elements (and their classes) from the root to it. For
each path the text, link text counted out, and the punctuation of all of its blocks are added up; both sums, as
shares of the page's largest, are fused into the path's score. Scores are smoothed along the page with a
Gaussian, among blocks below the same child of the body, and held against a threshold of the page's spread: what
is under it isn't content, whatever its element is called; nor is a child of the body whose
paths score less than half of the best and are none of those of the child that has it. The deepest element with all content is the article,
or the ``article`` or ``main`` around it, and its headings, lists and short paragraphs are its text, too; in a container
without a telling name, other blocks under the threshold are not. If that element is the whole body, what is
selected stays, with headings and gaps between and all of the deepest element with nearly all of it.

Elements and names (menus, adverts, comments, footers, by element, role, class or id) only break ties: if some of the content
lies in such elements, it is taken out and the rest is scored anew. A class or id doesn't count against an element that
holds ``main`` or, if its name isn't of adverts, comments, related pages or consent, most of the page's text, and
classes of states (``has-sidebar``, ``comments-open``) don't count at all. Forms, scripts and hidden elements are no text.

Scale: one page at a time inside the scan, no shuffle. Work and memory are linear in the length of a page: paths are
numbers of a prefix tree, what holds for an element is handed down when it opens, open elements are found by their tag,
and the scanner never reads a stretch again.

Defined results: a null page is empty and has an empty text; null ids and urls are kept; every row gives
one row, repeated ones too; markup that never ends counts as text up to the end; a quote in a tag that never closes is
a character; an empty table gives no rows.
"""

from __future__ import annotations

import html as references
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type

TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"""[>"']""")
ATTR = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
# Element kinds of HTML.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup
    option p pre section summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp svg math object".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
         "th": {"tr", "table"}, "option": {"select"}, "body": set()}
# No text in any case; and what speaks against text.
NO_TEXT = frozenset("head form dialog button select textarea input label fieldset canvas audio video".split())
NO_TEXT_ROLES = frozenset("search form dialog alert".split())
AGAINST = frozenset("nav footer aside menu".split())
ROLES = frozenset("navigation banner contentinfo complementary menu menubar toolbar".split())
TELLING = re.compile(r"(?:^|[^a-z])(?:article|body|content|entry|main|post|story|text)(?:$|[^a-z])")
NAMES = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|banners?|breadcrumbs?|comments?|commentlist|cookies?|consent|disqus|footers?|gdpr"
    r"|headers?|masthead|menus?|modal|nav|navbar|navigation|newsletter|notices?|alerts?|pager|pagination|popup|promos?"
    r"|promoted|promotion|related|recommended|replies|responses|shar(?:e|ing)|side-?bar|sidebars?|signup|login|skip"
    r"|social|sponsor\w*|subscribe|subscription|toolbar|widgets?)(?:$|[^a-z])")
HEADERS = re.compile(r"(?:^|[^a-z])(?:headers?|masthead)(?=$|[^a-z])")
STATES = re.compile(r"(?:has|with|without|no|category|tag)[-_].*|.*[-_](?:open|closed)")
# Names that stand whatever share of the text their elements hold.
APART = re.compile(r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|comments?|commentlist|cookies?|consent|disqus|gdpr|related|recommended|replies"
                   r"|responses)(?:$|[^a-z])")
# Parts of an article, never the whole of it.
PARTS = frozenset("""p h1 h2 h3 h4 h5 h6 li blockquote ul ol menu dl dt dd table caption tbody thead tfoot tr td th pre
    section figure figcaption details summary""".split())
PUNCTUATION = re.compile(r"[.,;:!?…¿¡，。；：！？、]")
KERNEL = np.exp(-np.arange(-2, 3) ** 2 / 2.0)


class Element:
    """An open element. What holds for all inside it is set when it opens; ``place`` numbers elements, parents first."""

    __slots__ = ("tag", "up", "place", "path", "void", "barred", "named", "apart", "within", "region", "telling")

    def __init__(self, tag: str, up: "Element | None", path: int, void: bool = False, barred: bool = False,
                 named: bool = False, apart: bool = False, telling: bool = False):
        self.tag, self.up, self.path, self.place = tag, up, path, 0
        self.void = void or (up is not None and up.void)  # forms, hidden
        self.barred, self.named, self.apart = barred, named, apart  # against it: by element or role; by name, in any case
        self.within = tag in ("article", "main") or (up is not None and up.within)
        self.telling = telling
        # the child of the body that it is below
        self.region = self if up is None or up.tag in ("", "html", "body") else up.region


class Page:
    """Elements in the order in which they open, and blocks: element, text with single spaces, characters in links."""

    def __init__(self):
        self.elements: list[Element] = []
        self.blocks: list[tuple[Element, str, int]] = []
        self.paths: dict[tuple[int, str], int] = {}
        self.open: list[Element] = []
        self.by_tag: dict[str, list[int]] = {}  # places in ``open``

    def start(self, element: Element) -> None:
        element.place = len(self.elements)
        self.elements.append(element)
        self.by_tag.setdefault(element.tag, []).append(len(self.open))
        self.open.append(element)

    def nearest(self, tags) -> int:
        """Place of the innermost open element of these kinds, or -1."""
        return max((self.by_tag[t][-1] for t in tags if self.by_tag.get(t)), default=-1)

    def close(self, place: int) -> None:
        """Close the open elements from a place on."""
        while len(self.open) > max(place, 1):
            self.by_tag[self.open.pop().tag].pop()

    def path(self, up: Element, step: str) -> int:
        return self.paths.setdefault((up.path, step), len(self.paths) + 1)

    def handed_down(self, own) -> np.ndarray:
        """For every element, whether ``own`` holds for it or one around it."""
        out = np.zeros(len(self.elements), bool)
        for e in self.elements:
            out[e.place] = own(e) or (e.up is not None and out[e.up.place])
        return out

    def summed_up(self, values: dict[int, float]) -> np.ndarray:
        """Sums over all inside each element of values by place."""
        out = np.zeros(len(self.elements))
        for place, v in values.items():
            out[place] += v
        for e in reversed(self.elements):
            if e.up is not None:
                out[e.up.place] += out[e.place]
        return out


def _opened(page: Page, tag: str, attrs: str, up: Element) -> Element:
    """An element with what its tag and attributes say about its text."""
    values = {}
    if attrs.strip():
        for name, value in ATTR.findall(attrs):
            values.setdefault(name.lower(), value.strip("\"'"))
    classes, own = values.get("class", "").lower(), values.get("id", "").lower()
    label = classes + " " + own
    step = tag + ("." + ".".join(label.split()) if label.strip() else "")
    if tag in ("html", "body", "main"):
        return Element(tag, up, page.path(up, step))
    style, role = values.get("style", "").replace(" ", "").lower(), values.get("role", "").lower()
    void = (tag in NO_TEXT or role in NO_TEXT_ROLES or "hidden" in values or "display:none" in style or "visibility:hidden" in style)
    barred = tag in AGAINST or tag == "header" and not up.within or role in ROLES
    names = [x for x in classes.split() if not STATES.fullmatch(x)] + own.split()
    telling = bool(TELLING.search(" ".join(names)))
    if up.within:  # the header of an article is part of it
        names = [HEADERS.sub(" ", x) for x in names]
    if tag == "article":  # only whole names count
        names = [x for x in names if NAMES.fullmatch(x)]
    text = " ".join(names)
    return Element(tag, up, page.path(up, step), void, barred, tag not in HEADINGS and bool(NAMES.search(text)),
                   bool(APART.search(text)), telling)


def _overruled(page: Page) -> None:
    """A name doesn't count against an element that holds most of the text of the page, unless an
    article or main stands beside it."""
    against = page.handed_down(lambda e: e.void or e.barred or e.named and e.apart)
    named = page.handed_down(lambda e: e.named)
    own: dict[int, float] = {}
    for e, text, link in page.blocks:
        if not against[e.place]:
            own[e.place] = own.get(e.place, 0) + max(0, len(text) - text.count(" ") - link)
    inside = page.summed_up(own)
    has = page.summed_up({p: 1 for p in own})
    free = {e.place for e in page.elements if e.tag in ("article", "main") and not named[e.place] and has[e.place]}
    around = np.zeros(len(page.elements), np.int64)
    for e in page.elements:
        around[e.place] = (e.place in free) + (around[e.up.place] if e.up is not None else 0)
    total = inside[0]
    for e in page.elements:
        if e.named and has[e.place] and 2 * inside[e.place] > total and around[e.place] == len(free):
            e.named = False


def parsed(html_: str) -> Page:
    """Elements and blocks of a page."""
    page = Page()
    page.start(Element("", None, 0))
    links, parts, link = 0, [], 0
    holder = page.open[0]
    size, last_end = len(html_), html_.rfind(">")
    last_quote = {q: html_.rfind(q) for q in "\"'"}
    quotes, endless = True, set()

    def flush():
        nonlocal holder, parts, link
        text = " ".join("".join(parts).split())
        if text:
            page.blocks.append((holder, text, link))
        holder, parts, link = page.open[-1], [], 0

    def write(text):
        nonlocal link
        text = references.unescape(text)
        parts.append(text)
        if links:
            link += len("".join(text.split()))

    def tag_end(at: int) -> int:
        """Place of the ``>`` of a tag, outside quotes that close."""
        nonlocal quotes
        first = html_.find(">", at)
        while quotes:
            m = STOP.search(html_, at)
            if m is None:  # every end lies in quotes: they aren't taken for quotes any more
                quotes = False
            elif m[0] == ">":
                return m.start()
            else:
                at = m.end() if last_quote[m[0]] < m.end() else html_.find(m[0], m.end()) + 1
        return first

    def end_of(tag: str, at: int) -> int:
        """Place behind the end tag of an element whose inside is passed over, or -1."""
        if tag in endless:
            return -1
        m = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html_, at)
        if m is None:
            endless.add(tag)
        return m.end() if m else -1

    at = 0
    while at < size:
        m = html_.find("<", at)
        if m < 0 or m > last_end and not html_.startswith("<!--", m):
            write(html_[at:])
            break
        if m > at:
            write(html_[at:m])
        at = m
        if html_.startswith("<!--", at):
            end = html_.find("-->", at + 4)
            at = end + 3 if end >= 0 else size
            continue
        if html_.startswith("<![CDATA[", at) and "cdata" not in endless:
            end = html_.find("]]>", at)
            if end >= 0:
                at = end + 3
                continue
            endless.add("cdata")
        if html_.startswith(("<!", "<?"), at):
            at = html_.find(">", at) + 1
            continue
        name = TAG.match(html_, at)
        if name is None:
            write("<")
            at += 1
            continue
        closes, tag = html_[at + 1] == "/", name[1].lower()
        end = tag_end(name.end())
        if end < 0:
            write(html_[at:])
            break
        attrs, at = html_[name.end():end], end + 1
        if closes:
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCKS:
                place = page.nearest((tag,))
                if place >= 0:
                    page.close(place)
                flush()
            continue
        if tag in RAW:
            if not attrs.rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                after = end_of(tag, at)
                at = after if after >= 0 else size
            parts.append(" ")
            continue
        if tag in VOID and tag != "hr":
            parts.append(" ")
            continue
        if tag == "a":
            links += 1
        up = page.open[-1]
        if tag not in BLOCKS:
            if tag not in ("a", "b", "i", "em", "strong", "label"):
                e = _opened(page, tag, attrs, up)
                if e.void and not up.void or e.barred or e.named:  # an inline advert or button: its text goes
                    after = end_of(tag, at)
                    at = after if after >= 0 else at
            continue
        if tag == "hr":
            flush()
            continue
        # an open paragraph ends at any block; items and cells end at the next of their kind
        if up.tag == "p" or up.tag in HEADINGS and tag in ("p", "div"):
            page.close(len(page.open) - 1)
        if tag in CLOSED_BY:
            place = page.nearest(CLOSED_BY[tag])
            if place > page.nearest(SCOPE[tag]):
                page.close(place)
        e = _opened(page, tag, attrs, page.open[-1])
        if tag == "main":
            for x in page.open:
                x.named = False
        page.start(e)
        flush()
    page.open = page.open[:1]
    flush()
    _overruled(page)
    return page


def ratios(page: Page, may: np.ndarray) -> np.ndarray:
    """Fused and smoothed text and punctuation score of every block's path, over the blocks that ``may`` be content."""
    blocks = page.blocks
    _, index = np.unique([e.path for e, _, _ in blocks], return_inverse=True)
    length = np.array([max(0, len(t) - t.count(" ") - link) for _, t, link in blocks], float) * may
    marks = np.array([len(PUNCTUATION.findall(t)) * (link * 2 < len(t)) for _, t, link in blocks], float) * may
    share = [np.bincount(index, weights=v)[index] for v in (length, marks)]
    fused = sum(w * v / max(1e-9, v.max()) for w, v in zip((0.7, 0.3), share)) * may
    region = np.array([e.region.place for e, _, _ in blocks])
    out, weight = np.zeros(len(fused)), np.zeros(len(fused))
    for shift, w in zip(range(-2, 3), KERNEL):
        here, there = slice(max(0, -shift), len(fused) - max(0, shift)), slice(max(0, shift), len(fused) - max(0, -shift))
        same = (region[here] == region[there]) & may[there]
        out[here] += w * fused[there] * same
        weight[here] += w
    return np.maximum(out / np.maximum(weight, 1e-9), fused) * may


def selected(page: Page, may: np.ndarray, spread: float) -> np.ndarray:
    score = ratios(page, may)
    chosen = score > 0
    if chosen.any():
        chosen &= score >= min(spread * score.std(), score.max())
        chosen = _main_regions(page, chosen, score)
    return chosen


def _main_regions(page: Page, chosen: np.ndarray, score: np.ndarray, least: float = 0.5) -> np.ndarray:
    """Selected blocks without the children of the body whose best path scores less than half of the best of all, and which
    share no path with the child that has it. Paragraphs, headings and lists right below the body are one region."""
    at = np.flatnonzero(chosen)
    region = [0 if page.blocks[i][0].region.tag in PARTS else page.blocks[i][0].region.place for i in at.tolist()]
    best: dict[int, float] = {}
    paths: dict[int, set] = {}
    for r, i in zip(region, at.tolist()):
        best[r] = max(best.get(r, 0.0), float(score[i]))
        paths.setdefault(r, set()).add(page.blocks[i][0].path)
    top = max(best, key=lambda r: (best[r], -r))
    out = np.zeros(len(chosen), bool)
    out[at] = [best[r] >= least * best[top] or bool(paths[r] & paths[top]) for r in region]
    return out


def main_text(html_: str, spread: float = 0.5) -> str:
    """Text of the article of a page; empty if there is none."""
    page = parsed(html_)
    blocks = page.blocks
    if not blocks:
        return ""
    place = np.array([e.place for e, _, _ in blocks])
    void = page.handed_down(lambda e: e.void)[place]
    against = page.handed_down(lambda e: e.barred or e.named)[place]
    chosen = selected(page, ~void, spread)
    if (chosen & against).any():  # a tie of regions: those that are named otherwise are taken out
        chosen = selected(page, ~void & ~against, spread)
    if not chosen.any():
        return ""
    size = np.array([len(t) for _, t, _ in blocks])
    total = int(size[chosen].sum())
    inside = page.summed_up(dict(_totals(place[chosen], size[chosen])))
    depth = np.zeros(len(page.elements), np.int64)
    for e in page.elements:
        depth[e.place] = depth[e.up.place] + 1 if e.up is not None else 0

    def deepest(least: float) -> Element:
        fit = np.flatnonzero(inside >= least)
        return page.elements[int(fit[np.argmax(depth[fit])])]

    def around(e: Element) -> Element:
        """The article or main around an element, or the first element around it that isn't a part of one."""
        x = e
        while x is not None and x.within:
            if x.tag in ("article", "main"):
                return x
            x = x.up
        while e.tag in PARTS and e.up is not None:
            e = e.up
        return e

    def within(element: Element) -> np.ndarray:
        return page.handed_down(lambda e: e is element)[place]

    top = ("", "html", "body")
    prose = np.array([link * 2 < len(t) for _, t, link in blocks])
    part = np.array([e.tag in PARTS for e, _, _ in blocks])
    core = deepest(total)
    article = around(core)
    if article.tag in top:
        heading = np.array([e.tag in HEADINGS for e, _, _ in blocks])
        before = np.concatenate([chosen[1:], [False]])
        ends = np.flatnonzero(chosen)
        middle = np.zeros(len(blocks), bool)
        middle[ends[0]:ends[-1]] = True
        keep = chosen | heading & before | middle & prose & part
        most = around(deepest(0.9 * total))
        if most.tag in top:
            most = deepest(0.9 * total)
        if most.tag not in top:
            keep |= within(most)
    else:
        # what lies around the selected text: all of an article, else without lists of links
        keep = within(article) & (prose | (article.tag == "article") | within(core))
        if article.tag not in ("article", "main") and not article.telling:
            # a container that may be a layout: beside the content, its headings, items and paragraphs
            content = page.handed_down(lambda e: e.up is article and inside[e.place] > 0)[place]
            keep &= chosen | part | content
    return "\n\n".join(blocks[i][1] for i in np.flatnonzero(keep & ~void & ~against).tolist())


def _totals(place: np.ndarray, size: np.ndarray):
    keys, which = np.unique(place, return_inverse=True)
    return zip(keys.tolist(), np.bincount(which, weights=size).tolist())


def main_texts(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""

    def run(batches):
        for batch in batches:
            texts = [main_text((x.as_py() or b"").decode("utf-8", "replace")) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.col(f"`{html_col}`").cast("binary").alias("html"))
    return rows.mapInArrow(run, f"page_id {id_type(pages, id_col)}, url string, text string, n_chars bigint")
