r"""HTML extraction by equivalence-class template deduction.

A page is read as elements, each named by the path of its tag and class
names (a rolling hash, so memory is linear in nesting), and as blocks: text
between block-level tags, white space joined, character references decoded.
Tokens are the paths and, outside menus and the like, (path, text).

1. Classes. Per host, tokens that occur equally often on the same pages have
   equal occurrence vectors. A vector is not gathered anywhere: the number of
   pages, the number of occurrences and two sums of a hash of (page, count)
   stand for it, and aggregate before they are shuffled, so that a host with
   a third of all pages is no hot spot. Tokens of one vector within one slot
   of another class form a class; it is valid if it is on ``MIN_PAGES`` pages
   and ``SUPPORT`` of the host's, and has two tags or texts at least (an
   element has two tags).
2. Template. Valid classes nest by the slot that holds them, in order of
   their mean place. A text is the template's if it is on ``CONSTANT`` of the
   pages that have its element; a text that recurs on its own, without a
   class, is not. A template has at most 1 / ``SUPPORT`` times as many tokens
   as a page of its host has on average.
3. Slots. For each element of the template the host's mean amount of text
   that is neither the template's, nor links, nor in menus and the like is
   known. Each page is aligned to the template (members of a class that break
   its order on this page do not count there). From the page's root the way
   leads into the element whose slots hold ``MOST`` of that amount, as far as
   one does; ``article`` and ``main`` weigh ``HINT_WEIGHT`` times as much,
   and the way ends there. The text is what lies in the slots of the element
   it ends at, and headings that stand beside the way.

Out of the slots go menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and comments, by element or role; by class name
within an article only if the name says advert or comment, or if the element
is of the template. The template's own texts go unless they are half of
what the slots hold: then pages are copies, and the text is theirs.

Edge cases: null or empty html gives an empty text; a page without a host,
or of a host with fewer than ``MIN_PAGES`` pages, has no template and goes by
its structure alone (the text of article or main, or else all text but menus
and the like); repeated rows count as pages of their own and give repeated
results; unclosed elements end with their container; very long pages are
read whole, one at a time; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MIN_PAGES = 4
SUPPORT = 0.1
CONSTANT = 0.5
MOST = 0.6
HINT_WEIGHT = 4
#: Bytes of all templates together up to which they are broadcast; beyond, pages and templates meet by a shuffle on the host.
BROADCAST_BYTES = 48 << 20
#: Pages of one host that such a shuffle hands to one task.
DEAL = 50_000

# Element names by their part in a page.
BLOCK = frozenset(
    "address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul head title".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea svg iframe noembed noframes".split())
#: Those of RAW that run to the page's end where no end tag follows, and those that end at once by "/>".
TO_THE_END, MAY_BE_EMPTY = frozenset("script style textarea".split()), frozenset(["svg"])
SIDE = frozenset("nav aside footer form menu dialog head title button select option datalist audio video canvas".split())
LEFT_OPEN = frozenset("nav form menu header button select".split())
MAIN = frozenset("article main".split())
#: Elements that may hold an article, and headings.
BOXES = frozenset("html body div section article main center table tbody tr td fieldset".split())
HEADINGS = frozenset("h1 h2 h3 hgroup".split())
UNNAMED = frozenset("html body p h1 h2 h3 h4 h5 h6".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar tablist".split())
#: Class names and ids, whole ones: those that count anywhere, and those that count outside an article, or within one if the template has them.
ALWAYS_SIDE = frozenset("ad ads advert adverts advertisement advertisements advertising adsense adbox adslot comments commentlist comment-list disqus_thread".split())
SIDE_NAMES = frozenset(
    "banner sponsor sponsored promo promotion cookie cookies cookie-notice cookie-banner cookie-consent consent gdpr notice notices alert popup modal overlay "
    "newsletter newsletter-signup subscribe subscription signup sidebar side-bar side aside widget widgets related related-posts recommended nav navbar "
    "navigation menu menus breadcrumb breadcrumbs masthead topbar header site-header page-header footer site-footer page-footer comment comment-form respond "
    "discussion share sharing social login search pager pagination toolbar".split()
)
MAIN_NAMES = frozenset("article articlebody article-body post post-body postbody entry entry-content post-content content main-content maincontent main story".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_DIGITS = re.compile(r"[0-9]+")

#: What a token is: a text; an element that is a side part, or only by its name within an article; one that is the article's, or may hold it.
TEXT, IS_SIDE, BY_NAME, IS_MAIN, IS_BOX = 1, 2, 4, 8, 16


class Element:
    __slots__ = ("tag", "parent", "token", "kind", "side", "main", "depth", "place", "amount")

    def __init__(self, tag: str, parent: Element | None, token: int, kind: int, side: bool, main: bool, place: int):
        self.tag, self.parent, self.token, self.kind, self.side, self.main, self.place = tag, parent, token, kind, side, main, place
        self.depth = parent.depth + 1 if parent else 0
        self.amount = 0


class Block:
    __slots__ = ("within", "text", "linked", "place")

    def __init__(self, within: Element, text: str, linked: int, place: int):
        self.within, self.text, self.linked, self.place = within, text, linked, place

    @property
    def token(self) -> int:
        return _token("t" + self.text, self.within.token)

    @property
    def own(self) -> int:
        """Code points that are not a link's."""
        return max(len(self.text) - self.linked, 0)


def _token(name: str, within: int) -> int:
    return xxhash.xxh3_64_intdigest(name, within & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(raw)} if raw else {}


def read(page: str | None) -> tuple[list[Element], list[Block]]:
    """Elements in order of their openings, the root first, and blocks in page order."""
    root = Element("", None, 0, IS_BOX, False, False, 0)
    elements, blocks = [root], []
    if not page:
        return elements, blocks
    stack = [root]
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    linked = in_link = 0
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal linked
        text = " ".join(html_lib.unescape("".join(parts)).split())
        parts.clear()
        if text:
            blocks.append(Block(stack[-1], text, linked, len(elements) + len(blocks)))
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        parts.append(piece)
        if in_link:
            linked += len(piece)

    def close(depth: int) -> None:
        for e in stack[depth:]:
            open_tags[e.tag] -= 1
        del stack[depth:]

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if tag in RAW and not closing:
            if tag in MAY_BE_EMPTY and m[0].endswith("/>"):
                continue
            end = None if tag in unclosed else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if end is None:
                unclosed.add(tag)  # nor is there an end further on
            at = end.end() if end else len(page) if tag in TO_THE_END else at
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag == "br":
            parts.append(" ")
        if tag not in BLOCK and tag not in SIDE:
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            if open_tags[tag]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if stack[-1].tag == "p" or tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1].tag == tag:
            close(len(stack) - 1)
        named = _attributes(m[3])
        names = set(f"{named.get('class', '')} {named.get('id', '')}".split())
        opens_main = tag in MAIN and not names & (SIDE_NAMES | ALWAYS_SIDE) or named.get("role") == "main" or named.get("itemprop") == "articlebody"
        if opens_main:
            first = next((i for i, x in enumerate(stack) if x.side), 0)
            if first and stack[first].tag in LEFT_OPEN:  # an article ends menus that were left open
                close(first)
        inside_main = stack[-1].main
        may_be_side = tag not in UNNAMED and not opens_main
        by_name = may_be_side and bool(names & SIDE_NAMES)
        is_side = tag in SIDE or named.get("role", "") in SIDE_ROLES or may_be_side and bool(names & ALWAYS_SIDE) or tag == "header" and not inside_main
        is_main = opens_main or tag in ("div", "section") and bool(names & MAIN_NAMES) and not by_name and not is_side and not inside_main
        mark = "." + ".".join(sorted(_DIGITS.sub("", n) for n in names)) if names else ""
        kind = (IS_SIDE if is_side else 0) | (BY_NAME if by_name else 0) | (IS_MAIN if opens_main else 0) | (IS_BOX if tag in BOXES else 0)
        above = stack[-1]
        element = Element(tag, above, _token(tag + mark, above.token), kind, above.side or is_side, inside_main or is_main and not above.side, len(elements) + len(blocks))
        elements.append(element)
        stack.append(element)
        open_tags[tag] += 1
    flush()
    return elements, blocks


def tokens(page: str | None) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """(token, parent, kind, depth, occurrences, first place, amount): the amount of a text is its own, that of an element what its subtree has outside side parts."""
    elements, blocks = read(page)
    found: dict[int, list[int]] = {}
    for b in blocks:
        if not b.within.side:
            b.within.amount += b.own
    for e in reversed(elements):
        if e.parent and not e.kind & IS_SIDE:
            e.parent.amount += e.amount
    things = [(e.token, e.parent.token, e.kind, e.depth, e.place, e.amount) for e in elements[1:]]
    things += [(b.token, b.within.token, TEXT, b.within.depth + 1, b.place, b.own) for b in blocks if not b.within.side]
    for token, parent, kind, depth, place, amount in things:
        row = found.setdefault(token, [parent, kind, depth, 0, place, 0])
        row[3] += 1
        row[5] += amount
    return ((t, *row) for t, row in found.items())


_NAMES = ["host", "page", "token", "parent", "kind", "depth", "n", "place", "amount"]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
_SEEN = "host bigint, page bigint, token bigint, parent bigint, kind int, depth int, n int, place int, amount bigint"


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for host, page_id, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            rows += [(host, page_id, *t) for t in tokens(page)]
        columns = zip(*rows, strict=True) if rows else [[]] * len(_NAMES)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)


#: A template: its tokens by mean place; mean amounts of an element's subtree, and of what it holds outside its boxes.
TEMPLATE = np.dtype([("token", "<i8"), ("part", "<i4"), ("kind", "<i4"), ("amount", "<f8"), ("direct", "<f8")])


def deduce(rows: list[tuple], constant: float = CONSTANT) -> np.ndarray:
    """The template of one host from its frequent tokens: (token, parent, kind, depth, on, n, vector, place, amount)."""
    rows = sorted(rows, key=lambda r: (r[3], r[7], r[0]))  # elements before what they hold
    by = {r[0]: r for r in rows}
    vector = {t: r[4:7] for t, r in by.items()}
    slot: dict[int, int] = {}
    members: dict[tuple, list[int]] = defaultdict(list)
    for t, r in by.items():
        above = r[1]
        slot[t] = slot[above] if above in by and vector[above] == vector[t] else above
        members[vector[t], slot[t]].append(t)
    part: dict[int, int] = {}
    for found in members.values():
        if sum(1 if by[t][2] & TEXT else 2 for t in found) >= 2:
            found = [t for t in found if not by[t][2] & TEXT or by[t][4] >= constant * by.get(by[t][1], by[t])[4]]
            part.update({t: len(part) for t in found[:1]})
            part.update({t: part[found[0]] for t in found[1:]})
    lost: Counter[int] = Counter()
    amount, direct = {}, {}
    boxed: Counter[int] = Counter()
    for r in reversed(rows):
        t, above, kind = r[:3]
        if kind & TEXT:
            lost[above] += r[8] if t in part else 0
            continue
        amount[t] = max(r[8] - lost[t], 0)
        direct[t] = max(amount[t] - boxed[t], 0)
        if kind & IS_SIDE:
            continue
        named = kind & BY_NAME and t in part
        lost[above] += r[8] if named else lost[t]
        if kind & IS_BOX and t in part and not named:
            boxed[above] += amount[t]
    ordered = sorted(part, key=lambda t: (by[t][7], by[t][3], t))
    return np.array([(t, part[t], by[t][2], amount.get(t, 0) / by[t][4], direct.get(t, 0) / by[t][4]) for t in ordered], TEMPLATE)


def _deduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [deduce([(x["token"], x["parent"], x["kind"], x["depth"], x["on"], x["n"], (x["v1"], x["v2"]), x["place"], x["amount"]) for x in row.as_py()]).tobytes()
                for row in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["of", "pages", "template"])


def with_host(pages: DataFrame) -> DataFrame:
    """Add __host: a hash of the url's host, null without one."""
    name = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return pages.withColumn("__host", F.when(name != "", F.xxhash64(name)))


def vectors(pages: DataFrame, min_pages: int = MIN_PAGES, support: float = SUPPORT) -> DataFrame:
    """Frequent tokens of each host with what stands for their occurrence vectors. Needs __host, page_id, url, html."""
    named = pages.filter(F.col("__host").isNotNull() & F.col("html").isNotNull())
    sizes = named.groupBy("__host").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages)
    seen = named.select("__host", F.xxhash64("page_id", "url").alias("page"), "html").mapInArrow(_emit, _SEEN)
    mark = F.xxhash64("page", "n")
    rows = seen.groupBy("host", "token").agg(
        F.first("parent").alias("parent"), F.first("kind").alias("kind"), F.first("depth").alias("depth"), F.count(F.lit(1)).alias("on"), F.sum("n").alias("n"),
        F.sum(F.shiftrightunsigned(mark, 32)).alias("v1"), F.sum(mark.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))).alias("v2"),
        F.avg("place").alias("place"), F.sum("amount").alias("amount"),
    ).filter(F.col("on") >= min_pages)
    return rows.join(sizes, F.col("host") == F.col("__host")).filter(F.col("on") >= F.col("pages") * support).drop("__host")


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, support: float = SUPPORT) -> DataFrame:
    """One row per host that has a template: of (its __host), pages, template (TEMPLATE records). A host's row is bounded by its pages' mean length."""
    token = F.struct("token", "parent", "kind", "depth", "on", "n", "v1", "v2", "place", "amount")
    return vectors(pages, min_pages, support).groupBy("host").agg(F.max("pages").alias("pages"), F.collect_list(token).alias("tokens")).mapInArrow(
        _deduced, "of bigint, pages bigint, template binary")


class Template:
    """A host's template, looked up by token."""

    def __init__(self, records: bytes | np.ndarray):
        known = np.frombuffer(records, TEMPLATE) if isinstance(records, bytes) else records
        self.known = {t: (rank, part, kind, amount, direct) for rank, (t, part, kind, amount, direct) in enumerate(known.tolist())}

    def aligned(self, elements: list[Element], texts: list[tuple[int, int]]) -> set[int]:
        """Tokens of the page that are of the template and keep the order of their class."""
        first: dict[int, int] = {}
        for token, place in [(e.token, e.place) for e in elements] + texts:
            if token in self.known:
                first[token] = min(place, first.get(token, place))
        parts: dict[int, list[int]] = defaultdict(list)
        for token in sorted(first, key=first.__getitem__):
            parts[self.known[token][1]].append(token)
        return {t for found in parts.values() for t in _longest_rise(found, [self.known[t][0] for t in found])}

    def way(self, elements: list[Element], aligned: set[int]) -> list[Element]:
        """First elements of the paths from the root to the one whose slots hold the article."""
        below: dict[int, dict[int, Element]] = defaultdict(dict)
        for e in elements[1:]:
            if e.token in aligned and e.kind & IS_BOX and not e.kind & (IS_SIDE | BY_NAME):
                below[e.parent.token].setdefault(e.token, e)
        way = [elements[0]]
        while not way[-1].kind & IS_MAIN:
            here = way[-1].token
            amounts = {t: self.known[t][3] * (HINT_WEIGHT if e.kind & IS_MAIN else 1) for t, e in below[here].items()}
            best = max(amounts, key=amounts.__getitem__, default=None)
            beside = self.known[here][4] if here in self.known else 0
            if best is None or not amounts[best] or amounts[best] < MOST * (sum(amounts.values()) + beside):
                break
            way.append(below[here][best])
        return way


def _longest_rise(items: list[int], ranks: list[int]) -> list[int]:
    """The longest part of ``items`` whose ranks rise."""
    ends: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, rank in enumerate(ranks):
        k = bisect_left(ends, rank)
        before.append(at[k - 1] if k else -1)
        if k == len(ends):
            ends.append(rank)
            at.append(i)
        else:
            ends[k], at[k] = rank, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(items[i])
        i = before[i]
    return out


def _by_structure(elements: list[Element], blocks: list[Block]) -> list[Block]:
    """The text of article or main (or a container named like one), or else all text but side parts and lists of links."""
    named: set[int] = set()  # within a side part by name, outside an article
    for e in elements[1:]:
        if id(e.parent) in named or e.kind & BY_NAME and not e.main:
            named.add(id(e))
    left = [b for b in blocks if not b.within.side and id(b.within) not in named]
    inside = [b for b in left if b.within.main]
    return inside or [b for b in left if not (b.linked * 2 > len(b.text) and _in_list(b.within))]


def _in_list(e: Element | None) -> bool:
    while e and e.tag not in ("li", "ul", "ol"):
        e = e.parent
    return e is not None


def main_text(page: str | None, template: Template | None = None) -> str:
    """The article's blocks, joined by line feeds."""
    elements, blocks = read(page)
    if template is None or not template.known:
        return "\n".join(b.text for b in _by_structure(elements, blocks))
    texts = {id(b): b.token for b in blocks if not b.within.side}
    aligned = template.aligned(elements, [(texts[id(b)], b.place) for b in blocks if id(b) in texts])
    way = template.way(elements, aligned)
    end, passed = way[-1].token, {e.token for e in way[:-1]}
    inside, side, beside = set(), set(), set()
    for e in elements:
        above = id(e.parent)
        if above in inside or e.token == end:
            inside.add(id(e))
        if above in side or e.kind & IS_SIDE or e.kind & BY_NAME and (e.token in aligned or not e.main):
            side.add(id(e))
        if e.tag in HEADINGS and e.parent.token in passed:
            beside.add(id(e))
    held = [b for b in blocks if id(b.within) in inside and id(b.within) not in side]
    if not way[-1].kind & IS_MAIN:
        # The template leaves it open: an article that only some pages have, and lists of links.
        held = [b for b in held if b.within.main] or [b for b in held if not (b.linked * 2 > len(b.text) and _in_list(b.within))]
    own = {id(b) for b in held if texts.get(id(b)) not in aligned}
    if sum(len(b.text) for b in held if id(b) in own) * 2 < sum(len(b.text) for b in held):
        own = {id(b) for b in held}
    return "\n".join(b.text for b in blocks if id(b) in own or id(b.within) in beside and id(b.within) not in side and texts.get(id(b)) not in aligned)


#: Templates that a task keeps at hand.
AT_HAND = 500


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at_hand: dict[bytes | None, Template | None] = {None: None}
    for batch in batches:
        out = []
        for page, records in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if records not in at_hand:
                if len(at_hand) > AT_HAND:
                    at_hand = {None: None}
                at_hand[records] = Template(records)
            out.append(main_text(page, at_hand[records]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])


def _with_templates(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages and their hosts' templates: a broadcast up to a checked size; beyond, a join on the host, large hosts dealt to many tasks."""
    size = found.agg(F.coalesce(F.sum(F.octet_length("template")), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        return pages.join(F.broadcast(found), F.col("__host") == F.col("of"), "left")
    large = found.filter(F.col("pages") > DEAL).select(F.col("of").alias("large"), F.ceil(F.col("pages") / DEAL).cast("bigint").alias("deals"))
    dealt = pages.join(F.broadcast(large), F.col("__host") == F.col("large"), "left").withColumn(  # at most a row per DEAL pages
        "deal", F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.col("deals")), F.lit(0)))
    copies = found.select("of", "template", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("pages") / DEAL).cast("bigint") - 1, F.lit(0)))).alias("copy"))
    return dealt.join(copies, (F.col("__host") == F.col("of")) & (F.col("deal") == F.col("copy")), "left")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, support: float = SUPPORT) -> DataFrame:
    """page_id, url, text, n_chars of every row. Needs page_id, url and html; other columns are left out."""
    hosted = with_host(pages.select("page_id", "url", "html"))
    found = Scratch(pages.sparkSession, "html").write(templates(hosted, min_pages, support), "templates")
    kinds = dict(pages.dtypes)
    return _with_templates(hosted, found).select("page_id", "url", "html", "template").mapInArrow(_extracted, f"page_id {kinds['page_id']}, url string, text string, n_chars bigint")
