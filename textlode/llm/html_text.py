"""Main text of HTML pages from text-to-tag ratios.

The parser of the standard library streams events; they become lines, one for each
block of the page, with their text, tags and place.  The ratio of text to tags is
smoothed along the page with a Gaussian and lines above a threshold are clustered;
the clusters choose the content region, the smallest container that holds them all,
and all of the region's blocks make the text.  Elements that a page marks as its article
are the region whatever their ratio.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, texts_of

# Fixed values of HTML: elements without an end tag, elements that are blocks,
# elements that start a new one of their kind, and elements without main text.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
SKIPPED = frozenset(
    "head title script style noscript template svg math iframe object audio video canvas "
    "select textarea input label applet map".split()
)
# Elements around an article, unless nearly all of the text is in one: a page within a form, or
# behind a start tag whose end is missing.
AROUND = frozenset("nav footer aside form menu dialog search button".split())
# Words in class or id that mark what surrounds an article.
SURROUNDINGS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo "
    "promotion promoted banner cookie cookies consent gdpr notice notices notification alert "
    "popup modal overlay newsletter subscribe subscription signup share sharing social comment "
    "comments commentlist disqus reply replies respond discussion sidebar widget widgets related "
    "recommended recommendations recirculation teaser teasers menu navbar navigation nav "
    "breadcrumb breadcrumbs footer masthead topbar pagination pager login search paywall toolbar "
    "skip legal copyright disclaimer hidden".split()
)
# Those that mark texts of their own, which may be longer than the article or be articles.
OTHERS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo "
    "promotion promoted comment comments commentlist disqus reply replies respond related "
    "recommended recommendations recirculation teaser teasers".split()
)
# Those that can also name what a text is about; they count on elements of groups only.
TOPICS = frozenset(
    "consent notice notices alert social share sharing search legal disclaimer discussion related "
    "recommended navigation login respond reply promotion subscription".split()
)
GROUPS = frozenset("div section ul ol dl table center header fieldset details".split())
# Parts of a name that turn its meaning, and last parts that leave it.
WITHOUT = frozenset("has have no not non with without hide hides show shows toggle".split())
ENDINGS = frozenset("list links buttons icons box bar slot unit posts stories".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu "
    "menubar toolbar".split()
)
ITEMS = frozenset("li dt dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main section div td body blockquote center".split())

SIGMA = 1.0
#: Share of the deviation of the smoothed ratios that a content line is above.
THRESHOLD = 0.5
#: A line whose text is by so much in links, and so short, is an entry of a menu if it
#: stands in a list beside another one.
LINKED, ENTRY_CHARS = 0.7, 80
#: Share of the clustered text above which an element is content whatever its name says;
#: the second one is for names of :data:`OTHERS`.
MOST, NEARLY_ALL = 0.5, 0.9
#: Code points beside links without which an element of :data:`AROUND` is no article's.
ENOUGH = 200

_PARTS = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_CUT_OFF = re.compile(r"<[a-zA-Z/!?]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(eq=False)
class Place:
    """A container, with the one around it; a path of them takes no more room than its last."""

    number: int
    around: Place | None
    depth: int
    #: Marked elements that it lies in, itself included.
    marked: tuple[int, ...]


@dataclass
class Line:
    text: str
    tags: int
    link_chars: int
    place: Place | None
    listed: bool = False


@dataclass
class Block:
    """A line before its doubtful parts are decided: (text, doubts, inside a link)."""

    parts: list[tuple[str, tuple[int, ...], bool]]
    tags: int
    place: Place | None
    listed: bool


@dataclass
class Element:
    tag: str
    number: int
    skipped: bool
    inside_main: bool
    place: Place | None
    in_item: bool
    in_heading: bool
    #: Elements around it, and itself, that surround an article by their names.
    doubts: tuple[int, ...]


@dataclass
class Lines(HTMLParser):
    """Collects the lines of one page."""

    blocks: list[Block] = field(default_factory=list)
    #: Marked elements with the doubts about them; those marked beyond doubt; doubtful
    #: elements, each with whether its name is one of OTHERS.
    mains: dict[int, tuple[int, ...]] = field(default_factory=dict)
    sure: set[int] = field(default_factory=set)
    doubtful: dict[int, bool] = field(default_factory=dict)
    surrounding: set[int] = field(default_factory=set)

    def __post_init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[Element] = []
        self.parts: list[tuple[str, tuple[int, ...], bool]] = []
        self.tags = self.links = 0
        self.numbers = 0
        #: How many elements of a name are open.
        self.open: Counter[str] = Counter()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            if "p" not in CLOSES.get(tag, ()):
                self.close_open({"p"}, barrier=BLOCKS)
            self.close_open(CLOSES.get(tag, set()), barrier={"ul", "ol", "dl", "table", "div"})
        elif tag == "br":
            self.parts.append((" ", (), False))
        self.tags += 1
        if tag in VOID:
            return
        self.links += tag == "a"
        parent = self.stack[-1] if self.stack else None
        inside = bool(parent and parent.inside_main) or tag in ("article", "main")
        skipped = bool(parent and parent.skipped) or tag in SKIPPED
        self.numbers += 1
        values = dict(attrs)
        sure = tag == "main" or values.get("role") == "main" or values.get("itemprop") == "articleBody"
        doubts = parent.doubts if parent else ()
        if not skipped and not sure and tag not in ("html", "body"):
            in_main = bool(parent and parent.inside_main)
            words = named(tag, values, in_main) if attrs else set()
            around = self.around(tag, values, in_main)
            if words or around:
                doubts = (*doubts, self.numbers)
                self.doubtful[self.numbers] = around or not words.isdisjoint(OTHERS)
            if around:
                self.surrounding.add(self.numbers)
        marked = sure or tag == "article"
        place = parent.place if parent else None
        if marked or tag in CONTAINERS:
            inner = place.marked if place else ()
            inner = (*inner, self.numbers) if marked and not skipped else inner
            place = Place(self.numbers, place, place.depth + 1 if place else 1, inner)
        in_item = tag in ITEMS or bool(parent and parent.in_item)
        in_heading = tag in HEADINGS or bool(parent and parent.in_heading)
        self.stack.append(
            Element(tag, self.numbers, skipped, inside, place, in_item, in_heading, doubts)
        )
        self.open[tag] += 1
        if marked and not skipped:
            self.mains[self.numbers] = doubts
            if sure:
                self.sure.add(self.numbers)

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.parts.append((" ", (), False))
        self.tags += 1

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "br":
            self.parts.append((" ", (), False))
        for at in range(len(self.stack) - 1, -1, -1) if self.open[tag] else ():
            if self.stack[at].tag == tag:
                if any(e.tag in BLOCKS for e in self.stack[at:]):
                    self.flush()
                self.pop(at)
                return
        if tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        if self.stack and self.stack[-1].skipped:
            return
        self.parts.append((data, self.stack[-1].doubts if self.stack else (), self.links > 0))

    def close(self):
        super().close()
        self.flush()

    def close_open(self, tags, barrier):
        if not any(self.open[tag] for tag in tags):
            return
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].tag in tags:
                self.pop(at)
                return
            if self.stack[at].tag in barrier:
                return

    def pop(self, at):
        for element in self.stack[at:]:
            self.links -= element.tag == "a"
            self.open[element.tag] -= 1
        del self.stack[at:]

    def parse_marked_section(self, i, report=1):
        """A section that the parser does not know is a comment up to the next ``>``."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.rawdata.find(">", i) + 1 or -1

    def around(self, tag: str, values: dict[str, str | None], inside_main: bool) -> bool:
        """Whether an element surrounds articles by what it is, whatever it is called."""
        if tag in AROUND or (tag == "header" and not inside_main):
            return True
        if "hidden" in values or values.get("aria-hidden") == "true":
            return True
        style, role = values.get("style") or "", (values.get("role") or "").lower()
        return bool(_HIDDEN.search(style)) or role in ROLES

    def flush(self):
        if any(not text.isspace() for text, _, _ in self.parts if text):
            last = self.stack[-1] if self.stack else None
            listed = bool(last and last.in_item and not last.in_heading)
            self.blocks.append(Block(self.parts, self.tags, last.place if last else None, listed))
            self.tags = 0
        self.parts = []

    def surroundings(self) -> set[int]:
        """The doubtful elements that are no part of the article.

        An element is one in spite of its name if it holds a main element or most of
        the clustered text, or articles with more text than all that is beyond doubt.
        """
        if not self.doubtful:
            return set()
        chosen = content(lines_of(self.blocks, set())).tolist()
        mass, articles, plain = (dict.fromkeys(self.doubtful, 0) for _ in range(3))
        total = free = 0
        marked = False
        for block, is_content in zip(self.blocks, chosen, strict=True):
            inside = [self.mains[n] for n in block.place.marked] if block.place else []
            for text, doubts, link in block.parts:
                size = len(" ".join(text.split()))
                total += size * is_content
                for number in doubts:
                    mass[number] += size * is_content
                    plain[number] += size * (not link)
                if not doubts:
                    free += size * (not link)
                    marked = marked or bool(size and inside)
                elif doubts in inside:
                    for number in doubts:
                        articles[number] += size * (not link)
        kept = {n for main in self.sure for n in self.mains[main]}
        for number, other in self.doubtful.items():
            if number in self.surrounding and plain[number] < ENOUGH:
                continue
            if mass[number] > (NEARLY_ALL if other else MOST) * total and not (other and marked):
                kept.add(number)
            elif not other and not marked and articles[number] and articles[number] >= free:
                kept.add(number)
        return self.doubtful.keys() - kept


def named(tag: str, attrs: dict[str, str | None], inside_main: bool) -> set[str]:
    """Words by which an element's class and id say that it surrounds an article.

    A word counts as the whole name or its last part: ``page-sidebar`` is a sidebar,
    ``has-sidebar`` and ``sidebar-open`` are not.
    """
    found = set()
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        parts = [p for p in _PARTS.findall(name) if p.isalpha()]
        whole = "".join(parts).lower() if len(parts) == 1 else ""
        words = [w.lower() for p in parts for w in _CAMEL.findall(p)]
        while len(words) > 1 and words[-1] in ENDINGS:
            words.pop()
        if WITHOUT.isdisjoint(words):
            found.update(words[-1:], [whole])
    wanted = OTHERS if tag == "article" else SURROUNDINGS if tag in GROUPS else SURROUNDINGS - TOPICS
    header = {"header"} if not inside_main and tag not in ("h1", "h2", "article") else set()
    return found & (wanted | header)


def lines_of(blocks: list[Block], left_out: set[int]) -> list[Line]:
    """Lines of the blocks without what lies in the elements ``left_out``."""
    lines, tags = [], 0
    for block in blocks:
        tags += block.tags
        parts = [part for part in block.parts if left_out.isdisjoint(part[1])]
        text = " ".join("".join(part[0] for part in parts).split())
        if text:
            link_chars = sum(len(part[0]) for part in parts if part[2])
            lines.append(Line(text, tags, link_chars, block.place, block.listed))
            tags = 0
    return lines


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Ratios averaged along the page with the weights of a Gaussian."""
    radius = max(1, math.ceil(2 * sigma))
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    total = np.convolve(ratios, weights, mode="full")[radius : radius + len(ratios)]
    norm = np.convolve(np.ones(len(ratios)), weights, mode="full")[radius : radius + len(ratios)]
    return total / norm


def content(lines: list[Line]) -> np.ndarray:
    """Which lines are above the threshold on the smoothed text-to-tag ratio."""
    ratios = np.array([len(line.text) / max(line.tags, 1) for line in lines])
    smoothed = smooth(ratios)
    return smoothed >= np.minimum(THRESHOLD * smoothed.std(), smoothed.max())


def main_text(html: str) -> str:
    """Main text of a page; see :func:`extract`."""
    page = Lines()
    # A tag that the end of the page cuts off is no text, and nor is what follows it.
    cut = _CUT_OFF.search(html, html.rfind(">") + 1)
    page.feed(html[: cut.start()] if cut else html)
    page.close()
    lines = lines_of(page.blocks, page.surroundings())
    if not lines:
        return ""
    texts = [line.text for line in lines]
    marked = [bool(line.place and line.place.marked) for line in lines]
    if any(marked):
        return "\n".join(t for t, inside in zip(texts, marked, strict=True) if inside)
    # Without a marked article, runs of links in lists are menus.
    menus = menu_lines(lines)
    clustered = zip(lines, content(lines).tolist(), menus, strict=True)
    inside = within(smallest([line.place for line, is_content, menu in clustered if is_content and not menu]))
    kept = [
        line.text
        for line, is_menu in zip(lines, menus, strict=True)
        if inside(line.place) and not is_menu
    ]
    return "\n".join(kept or texts)


def smallest(places: list[Place | None]) -> Place | None:
    """The smallest container around all places; each container is passed once."""
    if not places or None in places:
        return None
    chain, at = set(), places[0]
    while at is not None:
        chain.add(at)
        at = at.around
    region, passed = places[0], set(chain)
    for at in places:
        while at is not None and at not in passed:
            passed.add(at)
            at = at.around
        if at is None:
            return None
        if at in chain and at.depth < region.depth:
            region = at
    return region


def within(region: Place | None) -> Callable[[Place | None], bool]:
    """Whether a place is a region or lies in it; everything lies in no region."""
    known: dict[Place | None, bool] = {region: True, None: region is None}

    def inside(place: Place | None) -> bool:
        passed = []
        while place not in known:
            passed.append(place)
            place = place.around
        found = known[place]
        known.update(dict.fromkeys(passed, found))
        return found

    return inside


def menu_lines(lines: list[Line]) -> list[bool]:
    """Which lines are entries of a menu: short links in list items, two or more in a run."""
    links = [
        line.listed and len(line.text) <= ENTRY_CHARS and line.link_chars >= LINKED * len(line.text)
        for line in lines
    ]
    beside = zip([False, *links], links, [*links[1:], False], strict=False)
    return [link and (before or after) for before, link, after in beside]


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of the whole page.

    Character references are decoded, white space inside a block becomes one space,
    blocks are joined in page order by one line end.  Menus, headers, footers,
    sidebars, notices, adverts, forms, scripts, styles and comments are left out; of
    the content region only runs of short links in lists are, and of an article that the
    page marks nothing.  A null or empty page and one without text give
    an empty text.  All columns and repeated rows stay.
    """

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([main_text(page) for page in texts_of(batch, html)], pa.string())]

    return append_columns(pages, compute, [(text, T.StringType())])


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    source = pages.select("page_id", "url", "html")
    return extract(source).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")
    )
