"""Main text of web pages: streaming parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard-library parser reads a page once. Block tags end a line; each line keeps its text, its tags, how much of it
is link text, and the containers around it. Scripts, styles and hidden elements have no text. Menus, headers, footers,
sidebars, notices, adverts, forms and reader comments (by element, or by a class, id or role that says nothing else) are
dropped, with two exceptions that only measured text decides: an article or main element inside one is its own content, and what holds more
than half of all text is a wrapper (a form around the page, a menu that is never closed), not a part. A name that says
more (``has-sidebar``) and phrases that notices use (outside of articles) only lower the ratio of a line.

The ratio of a line (characters outside links per tag, as a logarithm) is smoothed by a Gaussian over neighbouring lines and
split into two clusters by the threshold between their means, in which lines weigh by their characters. The upper cluster is the
core. An article or main element that holds most of the core (``MOST``) is the region, else the page is. In an article, and
in articles beside it, all lines stay. In any other region articles with a core line stay whole, and menus (lines of links)
and notices go; where the region is the page, so do lines before the first and after the last line that is core, stands beside core
lines in one part of the page, or is a heading or a sentence.

Defined results: null, empty and text-free pages give an empty text. Character references are decoded, white space inside
a line becomes one space, lines are joined by one line end in page order. Unclosed and crossed tags end with the nearest
enclosing block; an undecodable declaration counts as text.
"""

import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from prefmill.llm.base import map_steps

SPREAD = 1.5
NAMED = 0.5  # what a name or phrase that may mean a menu or the like leaves of a line's logarithmic ratio
MOST = 0.8  # share of the core's characters that a region holds
APART = 0.7  # least distance of two clusters' means: twice the characters per tag
PHRASE = 200  # a line that begins like a notice is one up to this length

#: Element names, and words of classes, ids and roles, as pages commonly use them.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre
    section summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("""button canvas head iframe math noscript object script select style svg template textarea title audio
    video""".split())
#: Dropped unless they turn out to be wrappers.
PARTS = frozenset("aside dialog footer form menu nav".split())
CONTAINERS = frozenset("article body center div form main section table td".split())
#: Containers that may hold a page rather than a part of it.
PAGE = frozenset("body center form table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED_WORDS = frozenset("""ad ads adsense advert adverts advertisement advertising adbox banner sponsor sponsored promo
    promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice
    notices notification alert popup modal overlay newsletter subscribe signup social share sharing related recommended
    recommendations comment comments disqus respond reply replies discussion responses toolbar pagination pager login contentinfo
    complementary search dialog""".split())
#: Dropped outside articles only: inside one they hold its title.
OUTER_WORDS = frozenset("header masthead topbar".split())
#: Words that add nothing to the above.
PLAIN_WORDS = frozenset("area bar block bottom box global item left link links list page right section site top widget".split())
#: An article with such a name is no article of its own inside an element that is dropped by name.
REPLY_WORDS = frozenset("comment comments discussion disqus respond responses reply replies".split())
NOTICE = re.compile("|".join((
    "\u00a9", r"\(c\) ", r"copyright\b", "all rights reserved", r"(posted|published|written) (by|on|in)\b", r"terms (of|and)\b", "privacy policy",
    "we use cookies", "this (web)?site uses", "by (using|continuing)", r"cookies?\b.{0,20}$", "subscribe", "sign (up|in)", "log ?in",
    "share (this|on)", "read more", "skip to", "leave a (reply|comment)", "related (posts|articles|stories)", "home$", "contact( us)?$",
    "about( us)?$", "advertisement$", "powered by")), re.I)
SENTENCE = re.compile(r"[.!?\u2026:;\u3002\uff01\uff1f][\"')\]\u00bb\u201c\u201d]*$")
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
#: An end tag or an implied end never reaches beyond these.
SCOPES = frozenset("article aside body div footer form header main nav section table".split())
_WORDS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Line(NamedTuple):
    text: str
    tags: int
    linked: int  # characters
    within: tuple[int, ...]  # containers, from the page down
    whole: int  # the article around it, or 0
    heading: bool
    lowered: bool


class Element(NamedTuple):
    tag: str
    drops: bool
    parts: tuple[int, ...]  # what held before it: parts around, containers, article
    within: tuple[int, ...]
    whole: int
    reply: bool
    lowered: bool


class Lines(HTMLParser):
    def __init__(self, names: bool = True):
        super().__init__(convert_charrefs=True)
        self.names = names
        self.open: list[Element] = []
        self.dropped = self.linked = self.tags = self.count = self.replies = self.lowered = self.headings = self.whole = 0
        self.parts: tuple[int, ...] = ()  # open elements that drop their text unless they are wrappers
        self.within: tuple[int, ...] = ()
        self.kinds: dict[int, str] = {}
        self.firm: set[int] = set()  # parts that are never wrappers
        self.pieces: list[tuple[str, tuple[int, ...], bool]] = []
        self.rows: list[tuple] = []

    def flush(self):
        if self.pieces or self.tags:
            self.rows.append((self.pieces, self.tags, self.within, self.whole, self.headings > 0, self.lowered > 0))
        self.pieces, self.tags = [], 0

    def _pop(self):
        e = self.open.pop()
        self.dropped -= e.drops
        self.linked -= e.tag == "a"
        self.headings -= e.tag in HEADINGS
        self.replies -= e.reply
        self.lowered -= e.lowered
        self.parts, self.within, self.whole = e.parts, e.within, e.whole

    def _close(self, tags: set, scopes=SCOPES):
        """Close the nearest open element of ``tags`` and all inside it, if no scope stands between."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag in tags:
                while len(self.open) > i:
                    self._pop()
                return
            if self.open[i].tag in scopes:
                return

    def _hides(self, tag: str, attributes: dict) -> bool:
        if tag in ("html", "body", "main") or not attributes:
            return tag in DROPPED
        return tag in DROPPED or "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(
            _HIDDEN.search((attributes.get("style") or "").lower()))

    def _means(self, tag: str, attributes: dict) -> tuple[bool, bool, bool]:
        """Whether the names of an element say that it is no content, might say so, and speak of comments."""
        if not self.names or not attributes or tag in ("html", "body", "main"):
            return False, False, False
        unwanted = DROPPED_WORDS if self.whole or tag == "article" else DROPPED_WORDS | OUTER_WORDS
        sure = might = reply = False
        for name in " ".join(attributes.get(k) or "" for k in ("class", "id", "role")).lower().split():
            found = set(_WORDS.findall(name))
            if found & unwanted:
                might = True
                if found <= unwanted | PLAIN_WORDS:
                    sure = True
                    reply |= bool(found & REPLY_WORDS)
        return sure, might, reply

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
            self._close({"p"})
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPES | {"ul", "ol", "dl"})
        if tag == "br":
            self.pieces.append((" ", (), False))
        if tag in VOID:
            return
        self.count += 1
        attributes = dict(attrs)
        sure, might, reply = self._means(tag, attributes)
        own = tag in ("article", "main") and not reply and not self.replies
        element = Element(tag, self._hides(tag, attributes), self.parts, self.within, self.whole, reply, might and not sure and not own)
        self.open.append(element)
        if own:
            self.parts = ()  # content of its own, whatever it lies in
            self.tags = 1
        elif sure or tag in PARTS or tag == "header" and not self.whole:
            self.parts += (self.count,)
            if reply:
                self.firm.add(self.count)
        if tag in CONTAINERS:
            self.within += (self.count,)
            self.kinds[self.count] = tag
        if tag == "article" and own:
            self.whole = self.count
        self.dropped += element.drops
        self.linked += tag == "a"
        self.headings += tag in HEADINGS
        self.replies += reply
        self.lowered += element.lowered

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash closes nothing but void elements

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if tag not in VOID:
            self._close({tag}, frozenset() if tag in SCOPES else SCOPES)

    def handle_data(self, data):
        if not self.dropped:
            self.pieces.append((data, self.parts, self.linked > 0))

    def unknown_decl(self, data):
        pass

    def finished(self) -> list[Line]:
        self.close()
        self.flush()
        held: Counter = Counter()
        total = 0
        for pieces, *_ in self.rows:
            for text, parts, _ in pieces:
                size = len(text.strip())
                total += size
                held.update(dict.fromkeys(parts, size))
        wrappers = {p for p, size in held.items() if 2 * size > total and p not in self.firm}
        out, before = [], 0  # tags without text count for the line that follows
        for pieces, tags, within, whole, heading, lowered in self.rows:
            kept = [(t, link) for t, parts, link in pieces if wrappers.issuperset(parts)]
            text = " ".join("".join(t for t, _ in kept).split())
            before += tags
            if text:
                out.append(Line(text, before, sum(len(t) for t, link in kept if link), within, whole, heading, lowered))
                before = 0
        return out


def lines(page: str, names: bool = True) -> tuple[list[Line], dict[int, str]]:
    """All lines, and the tags of their containers."""
    try:
        parser = Lines(names)
        parser.feed(page)
        return parser.finished(), parser.kinds
    except AssertionError:  # the parser's answer to an unknown declaration
        parser = Lines(names)
        parser.feed(page.replace("<![", "&lt;!["))
        return parser.finished(), parser.kinds


def smoothed(ratio: np.ndarray) -> np.ndarray:
    reach = int(3 * SPREAD)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SPREAD) ** 2)
    near = np.convolve(ratio, kernel)[reach:reach + len(ratio)]
    return near / np.convolve(np.ones(len(ratio)), kernel)[reach:reach + len(ratio)]  # a page's ends have fewer neighbours


def threshold(values: np.ndarray, weights: np.ndarray | None = None) -> float:
    """The border between two clusters of numbers: half-way between their weighted means, found by repeated assignment. Means
    less than ``APART`` from each other are one cluster, and the border is the least value."""
    weights = np.ones(len(values)) if weights is None else weights
    values, weights = values[weights > 0], weights[weights > 0]
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        above = values >= (low + high) / 2
        if above.all() or not above.any():
            return float(values.min())
        new = float(np.average(values[~above], weights=weights[~above])), float(np.average(values[above], weights=weights[above]))
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2 if high - low >= APART else float(values.min())


def _notice(r: Line) -> bool:
    return not r.whole and len(r.text) <= PHRASE and bool(NOTICE.match(r.text))


def ratios(rows: list[Line]) -> np.ndarray:
    """Logarithm of characters outside links per tag, lowered for names and phrases of notices."""
    outside = np.array([max(len(r.text) - r.linked, 0) for r in rows], float)
    weight = np.array([NAMED if r.lowered or _notice(r) else 1.0 for r in rows])
    return np.log1p(outside / (1 + np.array([r.tags for r in rows]))) * weight


def region(rows: list[Line], core: np.ndarray, kinds: dict[int, str]) -> int:
    """The innermost article or main element that holds most of the core's characters (0: the page)."""
    mass: Counter = Counter()
    for r, inside in zip(rows, core):
        if inside:
            mass.update(dict.fromkeys(r.within, len(r.text)))
    total = sum(len(r.text) for r, inside in zip(rows, core) if inside)
    return max((c for c, n in mass.items() if kinds[c] in ("article", "main") and n >= MOST * total), default=0)


def main_text(page: str) -> str:
    rows, kinds = lines(page)
    if not rows:
        rows, kinds = lines(page, names=False)
    if not rows:
        return ""
    ratio = ratios(rows)
    near = smoothed(ratio)
    cut = threshold(near, np.array([len(r.text) for r in rows], float))
    prose = np.array([2 * r.linked <= len(r.text) for r in rows])
    # Its own ratio counts as well: a short line is no core for the sake of a long neighbour alone.
    notice = np.array([_notice(r) for r in rows])
    core = (near >= cut) & ((ratio >= cut) | (cut <= near.min())) & prose & ~notice  # one cluster: every line
    if not core.any():
        core = (ratio >= cut) & prose if ((ratio >= cut) & prose).any() else np.ones(len(rows), bool)
    at = region(rows, core, kinds)
    if kinds.get(at) == "article":
        # Articles that stand beside it are of the same page.
        beside = next(r.within[:r.within.index(at)] for r in rows if at in r.within)
        keep = np.array([r.whole > 0 and r.within[:r.within.index(r.whole)] == beside for r in rows])
    else:
        inside = np.array([not at or at in r.within for r in rows])
        near_core = inside
        if not at:
            # Everything between what is content: core lines, their neighbours in a part of the page, headings, sentences.
            mates = {r.within[-1] for r, c in zip(rows, core) if c and r.within} - {c for c, tag in kinds.items() if tag in PAGE}
            content = core | np.array([bool(r.within) and r.within[-1] in mates or r.heading or bool(SENTENCE.search(r.text)) for r in rows]) & prose & ~notice
            places = np.flatnonzero(content & inside)
            near_core = np.zeros(len(rows), bool)
            near_core[places[0]:places[-1] + 1] = True
        whole = np.isin([r.whole for r in rows], [r.whole for r, c in zip(rows, core) if c and r.whole])
        keep = inside & (whole | core | near_core & prose & ~notice)
    return "\n".join(r.text for r, k in zip(rows, keep) if k)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    def step(batch):
        texts = [main_text(h) if h else "" for h in batch.column("html").to_pylist()]
        return [batch.column("page_id"), batch.column("url"), texts, [len(t) for t in texts]]

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_steps(pages.select("page_id", "url", "html"), f"page_id {kind}, url string, text string, n_chars long", step, "html")
