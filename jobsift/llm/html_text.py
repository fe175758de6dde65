"""Main text of web pages by the line-block distribution (Chen, 2010).

Markup is stripped to lines, one for each block element. Text lengths of lines are summed over a sliding
window of lines with text; where the sum surges the article begins, where it dives to nothing it pauses, and
the lines of all such regions are kept. What is never text to read is left out before: lines of menus, headers, footers,
sidebars, notices, adverts, forms and reader comments, as their element or role says, or a class or id all of whose
words name such parts. Other markup weighs lines: those that are mostly links have no length, nor have those
outside of articles if a page marks some, and marked lines count more.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, schema_with, ship

WINDOW = 3
#: The window sum at which an article begins, or the largest one if none is so large.
SURGE = 86
#: How many times a line counts that the page marks as its article's.
MARKED = 4

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style|href)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_RAW = frozenset("script style textarea title xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSE_P = _BLOCKS - {"br"}
_OUT = frozenset("nav footer aside form button select svg noscript template iframe object canvas dialog menu head audio video".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_NAMES = frozenset(
    "ad ads adbox adslot adunit adsense sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices"
    " notification alert popup modal overlay newsletter subscribe subscription signup sidebar sidebars aside widget widgets related recommended"
    " recommendations trending share sharing social menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment"
    " comments commentlist disqus reply replies respond responses login search pagination pager paywall disclaimer copyright skiplink".split()
)
#: Words that say nothing by themselves: a name made of these and the words above still names such a part.
_NEUTRAL = frozenset(
    "site page main primary secondary global mobile desktop top bottom left right inner outer wrap wrapper container box bar slot unit item items"
    " list block area section panel group row col column button buttons btn link links icon icons field input label body content post posts"
    " article articles story stories entry user reader readers sticky fixed floating inline law info message text title header head"
    " close accept settings preferences manager small large big mini full new latest popular more by author".split()
)
#: Names of parts that a reader's comments and strangers' notices are in; inside an article an id needs one of these.
_FOREIGN = frozenset("ad ads adbox adslot adunit adsense sponsor sponsored cookie cookies consent gdpr comment comments commentlist disqus reply replies respond".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BEGINNINGS = ("advert", "breadcrumb", "cookie", "navbar", "newsletter", "sidebar")
_NUMBERED = re.compile(r"(?:ads?|banner|comment|sidebar|widget)\d+")
_STATE = frozenset("has with no not is without".split())
_NOT_HIDING = frozenset("html body main article".split())
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_END_NOTE = re.compile(r"\s*(?:copyright\s*)?(?:©|\(c\)\s|copyright\s+\d{4}\b)", re.I)
#: What a start tag ends if it is open within the same list or table, and what bounds the search for it.
_ENDS = {
    **dict.fromkeys(["li"], (frozenset(["li"]), frozenset("ul ol menu dir".split()))),
    **dict.fromkeys(["dt", "dd"], (frozenset(["dt", "dd"]), frozenset(["dl"]))),
    **dict.fromkeys(["td", "th"], (frozenset(["td", "th"]), frozenset(["table", "tr"]))),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    **dict.fromkeys(["tbody", "thead", "tfoot"], (frozenset("tbody thead tfoot caption".split()), frozenset(["table"]))),
    "option": (frozenset(["option"]), frozenset(["select"])),
}


@dataclass
class Line:
    text: str
    links: int  # characters that are in links
    heading: bool
    out: bool  # in a part that isn't article text
    article: int  # which marked article it is in, -1: none
    main: bool
    place: int = 0  # among all lines, empty ones too


@dataclass
class _Open:
    parts: list[str] = field(default_factory=list)
    links: int = 0
    heading: bool = False


def _names_part(token: str) -> set[str]:
    """The words of a class or id that name a part that isn't article text, if it has no other words."""
    words = [w for w in re.split(r"[-_:]+", _CAMEL.sub("-", token).lower()) if w]
    if not words or words[0] in _STATE:
        return set()
    hit = {w for w in words if w in _NAMES or w.startswith(_BEGINNINGS) or _NUMBERED.fullmatch(w)}
    return hit if all(w in hit or w in _NEUTRAL or w.isdigit() for w in words) else set()


def _named_out(attributes: str, tag: str, inside: bool) -> bool:
    """Whether attributes say that an element isn't article text. A heading's names don't, nor do ids of a part of an
    article, but for a few: they are there to be linked to."""
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.lower() in _ROLES:
            return True
        if name in ("class", "id") and tag not in _HEADINGS:
            for token in value.split():
                hit = _names_part(token)
                if inside:  # an article's own heading part
                    hit -= {"header"}
                if tag in _NOT_HIDING:
                    hit &= {"comment", "comments", "reply"} if tag == "article" else set()
                if inside and name == "id":
                    hit = {w for w in hit if w in _FOREIGN or w.startswith(_BEGINNINGS)}
                if hit:
                    return True
    return False


class _Tree:
    """The open elements, with the end tags that pages may leave out, and where among them a part begins that isn't
    article text."""

    def __init__(self) -> None:
        self.open: list[str] = []
        self.count: Counter[str] = Counter()
        self.zone: int | None = None

    def push(self, tag: str) -> None:
        self.open.append(tag)
        self.count[tag] += 1

    def cut(self, n: int) -> None:
        self.count.subtract(self.open[n:])
        del self.open[n:]
        if self.zone is not None and self.zone >= n:
            self.zone = None

    def find(self, tags: frozenset[str], bounds: frozenset[str]) -> int | None:
        """The innermost open one of the tags that isn't beyond a bound."""
        if not any(self.count[t] for t in tags):
            return None
        for i in reversed(range(len(self.open))):
            if self.open[i] in tags:
                return i
            if self.open[i] in bounds:
                return None
        return None

    def start(self, tag: str) -> None:
        """What a start tag ends."""
        if tag in _CLOSE_P and (i := self.find(frozenset(["p"]), _NO_END)) is not None:
            self.cut(i)
        if tag in _ENDS and (i := self.find(*_ENDS[tag])) is not None:
            self.cut(i)

    def end(self, tag: str) -> None:
        """End the innermost such element and all that are open in it. Only an article's end ends an article."""
        bounds = frozenset() if tag in ("article", "main", "body", "html") else _NO_END if tag == "p" else frozenset(["article", "main"])
        if tag not in ("table", "body", "html", "article", "main"):
            bounds |= frozenset(["table"]) if tag not in _ENDS or tag in ("li", "dt", "dd", "option") else frozenset()
        if (i := self.find(frozenset([tag]), bounds)) is not None:
            self.cut(i)


_NO_END = frozenset("article main table td th li dd dt caption body button object".split())


def lines_of(page: str) -> list[Line]:
    """The page's blocks in order, white space made single spaces; empty ones count as lines too. End tags may be missing
    where HTML lets them; others count as there once what holds the element ends, and those without a start as not there."""
    out: list[Line] = []
    now = _Open()
    tree = _Tree()
    articles, link, current = -1, 0, -1

    def close(heading: bool = False) -> None:
        nonlocal now
        text = " ".join("".join(now.parts).split())
        marked = current if tree.count["article"] else -1
        out.append(Line(text, min(now.links, len(text)), now.heading, tree.zone is not None, marked, tree.count["main"] > 0, len(out)))
        now = _Open(heading=heading)

    def add(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            now.parts.append(text)
            if link:
                now.links += len(text.strip())

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in _RAW and not closing:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else size
            continue
        if tag == "br":
            now.parts.append(" ")
            continue
        if tag == "a":  # without href it is a place, not a link
            link = int(not closing and any(name.lower() == "href" for name, _ in _ATTRIBUTE.findall(attributes)))
            continue
        block = tag in _BLOCKS
        if block or tag in _OUT:
            close(heading=not closing and tag in _HEADINGS)
        if closing:
            tree.end(tag)
            continue
        if block:
            tree.start(tag)
        if tag in _VOID or attributes.endswith("/") and not block:
            continue
        named = bool(attributes) and _named_out(attributes, tag, tree.count["article"] > 0)
        if not (block or named or tag in _OUT):
            continue
        if tree.zone is not None and tag in ("article", "main") and tree.open[tree.zone] not in ("aside", "template", "noscript", "dialog") and not _named_out(attributes, tag, False):
            tree.cut(tree.zone)
        if tag == "article" and not tree.count["article"] and not named and tree.zone is None:
            articles += 1
            current = articles
        tree.push(tag)
        if tree.zone is None and (tag in _OUT or tag == "header" and not tree.count["article"] or named):
            tree.zone = len(tree.open) - 1
    close()
    return out


def _regions(sizes: list[int], surge: float) -> Iterator[tuple[int, int]]:
    """Spans of lines from a surge of the window sums to the next dive to zero."""
    n = len(sizes)
    sums = [sum(sizes[i : i + WINDOW]) for i in range(n)]
    i = 0
    while i < n:
        if sums[i] >= surge and sums[i] > 0:
            begin = next(j for j in range(i, n) if sizes[j])
            end = i
            while end < n and sums[end] > 0:
                end += 1
            yield begin, end
            i = end
        else:
            i += 1


def _weights(lines: list[Line]) -> tuple[list[int], list[bool]]:
    """Each line's length in the distribution, and which lines the page marks as its article's. Lines that are mostly links have none. If the page marks articles, or
    else a main element, lines outside have none and lines inside count MARKED times; in the largest article its
    links count as text."""
    plain = [0 if 2 * x.links > len(x.text) else len(x.text) for x in lines]
    inside = [x.article >= 0 for x in lines]
    if not any(n and own for n, own in zip(plain, inside, strict=True)):
        inside = [x.main for x in lines]
    if not any(n and own for n, own in zip(plain, inside, strict=True)):
        return plain, []
    size: dict[int, int] = {}
    for x, n, own in zip(lines, plain, inside, strict=True):
        if own:
            size[x.article] = size.get(x.article, 0) + n
    largest = max(size, key=lambda k: (size[k], -k))
    return [MARKED * (len(x.text) if x.article == largest else n) if own else 0 for x, n, own in zip(lines, plain, inside, strict=True)], inside


def main_text(page: str | None) -> str:
    """The text of the article, blocks joined by a space; empty if there is none. Malformed markup is read as lines_of() says.

    Windows are over lines with text, so markup alone never ends a region; WINDOW lines without length do. All
    regions that surge count. A region goes back from its surge to the dive before it, so short lines
    at its begin are kept, and lines without length within it stay. On pages without a marked article,
    labels far above the first heading and a copyright notice at the end, a sign or a year with it, don't belong to it; text
    that stands alone after WINDOW lines of links doesn't either, if it is too short to surge."""
    lines = [x for x in lines_of(page or "") if not x.out and x.text]
    sizes, marked = _weights(lines)
    most = max((sum(sizes[i : i + WINDOW]) for i in range(len(sizes))), default=0)
    surge = min(SURGE, most)
    out: list[Line] = []
    for n, (_, end) in enumerate(_regions(sizes, surge)):
        a = end
        while a and any(sizes[max(0, a - WINDOW) : a]):  # back to the dive before, or to the page's begin
            a -= 1
        first = next(i for i in range(a, end) if sum(sizes[i : i + WINDOW]) >= surge)
        while a < end and not sizes[a]:
            a += 1
        b = end
        while b > a and not sizes[b - 1]:
            b -= 1
        if not marked:
            if not n:
                for k in range(a + 1, min(first + WINDOW, end)):
                    if lines[k].heading and lines[k].place - lines[k - 1].place > WINDOW and all(sizes[j] < SURGE // 2 for j in range(a, k)):
                        a = k
                        break
            while b > a and _END_NOTE.match(lines[b - 1].text) and len(lines[b - 1].text) < 200:
                b -= 1
        out += [lines[i] for i in range(a, b) if not marked or marked[i]]
    return " ".join(x.text for x in out)


def extract(pages: DataFrame, markup: str = "html") -> DataFrame:
    """Add text, the main text of each whole page ("" if the page is null, empty or has none), and n_chars.
    Very long pages are read whole; of articles of equal size the first counts as the largest, and all that surge
    are kept; rows that repeat are pages of their own, and an empty table gives an empty result. Other columns
    pass through without the markup; columns named text and n_chars are replaced."""
    ship(pages.sparkSession)
    pages = pages.drop(*(["text"] if markup != "text" else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(markup)
            text = pa.array([main_text(x) for x in batch.column(k).to_pylist()], pa.string())
            rest = [i for i in range(batch.num_columns) if i != k]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), text], names=[*(batch.schema.names[i] for i in rest), "text"])

    return pages.mapInArrow(lean(run), schema_with(pages.drop(markup), text="string")).withColumn("n_chars", F.length("text").cast("long"))
