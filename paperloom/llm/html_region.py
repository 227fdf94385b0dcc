"""Main text of web pages: the contiguous region of maximum score.

A page is a sequence of words and tags. Words score by the block they stand in, how much text
stands together and links; tags score below zero; the weights are log-odds counted on labelled
pages. One linear scan finds the contiguous run with the greatest sum, which is the main region on
every page; its boilerplate parts are then left out. Main containers are labels to count on, never
a feature of words; the scan only pays for crossing their borders, as for other tags.

Elements end as browsers end them: a paragraph before the next block, an item, term, cell or option
before the next one. A class, id or role that names boilerplate (``comments``, ``article-ads``) leaves
its element out unless it holds the page's heading; one that only mentions it (``related-work``,
``has-sidebar``) or holds the heading does so only where few words stand in plain text. Parsing takes
linear time on broken markup too: after a tag whose quotes never close, quotes mean nothing more.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

#: Pages that the weights are counted on, at most.
SAMPLE_PAGES = 1_000
#: Share of a page's words beside boilerplate that its one container must hold to be a label.
LABELLED = 0.5
#: Score of a container's begin or end: a run goes over a row of teaser cards only at a cost.
BORDER = -30.0

#: Plain words that keep an element whose class only mentions boilerplate.
WORTH = 20

_COMMENT, _OTHER, _WORDS = r"<!--.*?(?:-->|\Z)", r"<(?:[!?]|/(?![a-zA-Z]))[^>]*>", r"(?P<words>[^<]+|<)"
_TAG = r"<(?P<closes>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>%s)>"
_QUOTED = re.compile("|".join([_COMMENT, _TAG % r"(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+", _OTHER, _WORDS]), re.DOTALL)
_UNQUOTED = re.compile("|".join([_COMMENT, _TAG % "[^>]*", _OTHER, _WORDS]), re.DOTALL)
_NO_TAGS = re.compile("|".join([_COMMENT, _WORDS]), re.DOTALL)
_TAG_START = re.compile(r"</?[a-zA-Z]")
_ATTRIBUTE = re.compile(r"([^\s\"'=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*\"|'[^']*'")
_CUE_ATTRIBUTE = re.compile(r"class|id|role|hidden", re.I)
_CUE_WORD = re.compile(r"[a-z]+|[A-Z]+[a-z]*")

# Element names and cue words of boilerplate and of main content.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("nav footer aside form button select option noscript template svg menu dialog head canvas object audio video datalist".split())
MAIN = frozenset("article main".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset("table caption td th".split())
TABLE = frozenset("table caption thead tbody tfoot tr td th".split())
#: Inline elements whose end tag holds across blocks that were left open in them.
FORMATTING = frozenset("a b big code em font i s small strong tt u".split())
CUES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist disqus respond reply replies cookie cookies consent notice gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget toolbar pagination pager masthead skip hidden contentinfo complementary search copyright".split()
)
#: Words of a class name that say nothing after a cue, and words that turn it into a mention.
NEUTRAL = frozenset(
    "area articles bar block body bottom box button buttons col column container content count form group head header holder icon icons inner item items left link links list meta module news outer panel posts right row section slot stories text title top unit wrap wrapper".split()
)
MENTIONS = frozenset("allow enable enabled has hide no non show with without".split())

# What a start tag closes, and the elements that it doesn't look past.
_ROWS = ("tr", "td", "th")
_IMPLIED: dict[str, tuple[tuple[str, ...], frozenset[str]]] = {
    "li": (("li",), BLOCKS - {"address", "div", "p", "li"}),
    "tr": (_ROWS, frozenset(["table"])),
    "a": (("a",), CELLS),
    "option": (("option",), frozenset(["select", "datalist"])),
}
_IMPLIED |= dict.fromkeys(["dt", "dd"], (("dt", "dd"), BLOCKS - {"address", "div", "p", "dt", "dd"}))
_IMPLIED |= dict.fromkeys(["td", "th"], (("td", "th"), frozenset(["table", "tr"])))
_IMPLIED |= dict.fromkeys(["thead", "tbody", "tfoot"], (("thead", "tbody", "tfoot", *_ROWS), frozenset(["table"])))


def _names_boilerplate(name: str) -> bool | None:
    """True where a class name names boilerplate, False where it mentions it, else nothing."""
    words = [w.lower() for w in _CUE_WORD.findall(name)]
    if CUES.isdisjoint(words):
        return None
    head = next((w for w in reversed(words) if len(w) > 1 and (w in CUES or w not in NEUTRAL)), "")
    return head in CUES and MENTIONS.isdisjoint(words)


def _cue(tag: str, attributes: str) -> tuple[bool, bool | None]:
    """Whether an element is hidden, and whether its class, id or role names or mentions boilerplate."""
    found = None
    if tag in ("html", "body", "main", "h1") or not _CUE_ATTRIBUTE.search(attributes):
        return False, found
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, found
        if name in ("class", "id", "role"):
            for one in value.split():
                named = _names_boilerplate(one)
                found = found if named is None else bool(found or named)
    return False, found


class _Element(NamedTuple):
    tag: str
    skips: bool
    cue: bool | None
    is_main: bool
    began: int


class _Open:
    """Open elements of a page. All lookups take a time that doesn't depend on the depth."""

    def __init__(self) -> None:
        self.stack: list[_Element] = []
        self.where: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.skipped = self.main = 0
        self.spans: list[tuple[int, int]] = []
        self.cues: list[tuple[int, int, bool]] = []

    def kind(self) -> str:
        return self.stack[self.blocks[-1]].tag if self.blocks else "body"

    def last(self, tags: frozenset[str]) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=-1)

    def cut(self, size: int, now: int) -> None:
        """Close elements until ``size`` are open; ``now`` is the number of events so far."""
        while len(self.stack) > size:
            e = self.stack.pop()
            self.where[e.tag].pop()
            if e.tag in BLOCKS:
                self.blocks.pop()
            self.skipped -= e.skips
            self.main -= e.is_main
            if e.is_main:
                self.spans.append((e.began, now))
            if e.cue is not None:
                self.cues.append((e.began, now, e.cue))

    def push(self, e: _Element) -> None:
        self.where[e.tag].append(len(self.stack))
        if e.tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(e)
        self.skipped += e.skips
        self.main += e.is_main

    def before(self, tag: str, now: int) -> None:
        """Close what a start tag ends."""
        if tag in BLOCKS and (self.kind() == "p" or tag in HEADINGS and self.kind() in HEADINGS):
            self.cut(self.blocks[-1], now)
        closed, barrier = _IMPLIED.get(tag, ((), CELLS))
        if any(self.where.get(c) for c in closed):
            bar = self.last(barrier)
            for c in closed:
                if self.where[c] and self.where[c][-1] > bar:
                    self.cut(self.where[c][-1], now)

    def end(self, tag: str, now: int) -> None:
        """Close the nearest such element, unless it lies outside the table, cell or block at hand."""
        if not self.where.get(tag):
            return
        at = self.where[tag][-1]
        if tag in TABLE:
            bar = -1 if tag == "table" else self.last(frozenset(["table"]))
        elif tag in BLOCKS or tag in SKIPPED or tag in FORMATTING:
            bar = self.last(CELLS)
        else:
            bar = self.blocks[-1] if self.blocks else -1
        if at > bar:
            self.cut(at, now)


def _left_out(events: list[tuple], cues: list[tuple[int, int, bool]], headings: list[int]) -> list[bool]:
    """Which events lie in an element that its class, id or role makes boilerplate."""
    sizes = [0 if b < 0 or f[0] else -n if f[2] else n * (n >= 5) for f, n, b in events]
    worth = [0, *accumulate(sizes)]

    def covered(strict: bool) -> list[bool]:
        steps = [0] * (len(events) + 1)
        for begin, end, named in cues:
            at = bisect_left(headings, begin)
            if named and strict and not (at < len(headings) and headings[at] < end) or worth[end] - worth[begin] < WORTH:
                steps[begin] += 1
                steps[end] -= 1
        return [depth > 0 for depth in accumulate(steps)]

    out = covered(True)
    if all(o or b < 0 or f[0] for (f, _, b), o in zip(events, out, strict=False)):
        out = covered(False)
    return out


def parse(page: str) -> tuple[list[tuple], list[tuple[int, int]], list[str]]:
    """Events of a page, spans of its main containers, and the text of its blocks.

    An event is (tag, or nothing in boilerplate, 0, -1) or (feature of words, number of words,
    block). The feature of words is (in boilerplate, kind of block, in a link). The text of a block
    leaves out words in boilerplate.
    """
    events: list[tuple] = []
    blocks: list[list[tuple[str, int]]] = [[]]
    headings: list[int] = []
    tree = _Open()
    reader, at, size, last = _QUOTED, 0, len(page), page.rfind(">")
    while at < size:
        if at > last:
            reader = _NO_TAGS
        m = reader.match(page, at)
        if m.lastgroup is None:
            at = m.end()
            continue
        if m.lastgroup == "words":
            words = m["words"]
            if words == "<" and reader is _QUOTED and _TAG_START.match(page, at):
                reader = _UNQUOTED
                continue
            at = m.end()
            text = html.unescape(words) if "&" in words else words
            blocks[-1].append((text, len(events)))
            if n := len(text.split()):
                events.append(((tree.skipped > 0, tree.kind(), bool(tree.where.get("a"))), n, len(blocks) - 1))
            else:
                events.append(("", 0, -1))
            continue
        at = m.end()
        tag, attributes = m["tag"].lower(), m["attributes"]
        if not m["closes"]:
            tree.before(tag, len(events))
        if tag in BLOCKS and blocks[-1]:
            blocks.append([])
        elif tag == "br":
            blocks[-1].append((" ", -1))
        events.append(("" if tree.skipped else tag, 0, -1))
        if m["closes"]:
            tree.end(tag, len(events))
        elif tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
        elif tag not in VOID and not attributes.endswith("/"):
            hidden, cue = _cue(tag, attributes)
            skips = hidden or tag in SKIPPED or tag == "header" and not tree.main
            is_main = (tag in MAIN or "role=\"main\"" in attributes) and cue is not True and not skips and not tree.skipped
            if tag == "h1" and not tree.skipped:
                headings.append(len(events) - 1)
            tree.push(_Element(tag, skips, cue, is_main, len(events) - 1))
    tree.cut(0, len(events))
    if tree.cues:
        out = _left_out(events, tree.cues, headings)
        for i, (feature, n, block) in enumerate(events):
            if out[i]:
                events[i] = ("", 0, -1) if block < 0 else ((True, *feature[1:]), n, block)
        tree.spans = [s for s in tree.spans if not out[s[0]]]

    def piece(text: str, i: int) -> str:
        return " " if i >= 0 and events[i][2] >= 0 and events[i][0][0] else text

    return events, tree.spans, [" ".join("".join(piece(*x) for x in b).split()) for b in blocks]


def _features(feature: tuple, n: int) -> list[str]:
    """Names of the weights of ``n`` words that stand together, from the most to the least specific."""
    skips, kind, link = feature
    head = "skip" if skips else "text"
    size = "few" if n < 5 else "some" if n < 20 else "many"
    return [f"{head}:{kind}:{size}:{'link' if link else 'plain'}", f"{head}:{kind}", head]


def count_page(page: str) -> Counter:
    """(weight, inside) -> words or tags of a labelled page; its own main container is the label.

    A page with several containers beside each other, or whose container holds the lesser part of
    its text, as a teaser card does, is no label."""
    events, spans, _ = parse(page)
    counts: Counter = Counter()
    outer = [(a, b) for a, b in spans if not any(c <= a and b <= d and (a, b) != (c, d) for c, d in spans)]
    if len(outer) != 1:
        return counts
    start, end = outer[0]
    texts = [(start <= i < end, n) for i, (f, n, block) in enumerate(events) if block >= 0 and not f[0]]
    if sum(n for inside, n in texts if inside) <= LABELLED * sum(n for _, n in texts):
        return counts
    for i, (feature, n, block) in enumerate(events):
        inside = start <= i < end
        if block < 0:
            counts[f"tag:{feature}", inside] += 1
            continue
        for name in _features(feature, n):
            counts[name, inside and not feature[0]] += n
    return counts


#: What holds before any labelled page is seen.
PRIOR = {"text": 3.0, "skip": -0.1}


def weights(counts: dict[tuple[str, bool], float]) -> dict[str, float]:
    """Log-odds with add-one smoothing. Tags stay below zero, and so does boilerplate: it is left
    out in any case, so a run may go over it."""
    found = dict(PRIOR)
    for name in {k for k, _ in counts}:
        odds = math.log((counts.get((name, True), 0) + 1) / (counts.get((name, False), 0) + 1))
        if name.startswith("tag:"):
            found[name] = min(-0.05, max(-0.3, odds))
        elif not name.startswith("skip"):
            found[name] = max(-3.0, min(3.0, odds))
    return found | {"tag:": 0.0} | {f"tag:{t}": BORDER for t in MAIN}


def best_run(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the greatest positive sum, or (0, 0); the first of equals."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, bounds = total, (start, i + 1)
    return bounds


def main_text(page: str | None, weight: dict[str, float]) -> str:
    """The main text of one page. Null, empty and text-free pages give the empty text."""
    if not page:
        return ""
    events, _, blocks = parse(page)

    def score(feature, n, block):
        if block < 0:
            return weight.get(f"tag:{feature}", -0.1)
        return n * next((weight[k] for k in _features(feature, n) if k in weight), 0.0)

    start, end = best_run([score(*e) for e in events])
    # A block belongs to the region when a run of its words does; boilerplate inside is left out.
    inside = dict.fromkeys(b for f, _, b in events[start:end] if b >= 0 and not f[0])
    return "\n".join(t for b in inside if (t := blocks[b]))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: Counter = Counter()
        for page in batch["html"]:
            counts.update(count_page(page))
        yield pd.DataFrame([(k, i, n) for (k, i), n in counts.items()], columns=["name", "inside", "n"])


def learn(pages: DataFrame, page_id: str = "page_id", page_html: str = "html", sample: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from at most ``sample`` pages that mark their main content themselves.

    The labelled pages are those with the least hash of their id, so the choice doesn't depend on
    the order of rows. Without any such page the prior weights hold.
    """
    labelled = pages.filter(F.lower(F.col(page_html)).rlike(r"<(article|main)[\s>]"))
    ids = [r[0] for r in labelled.select(F.col(page_id)).dropna().distinct().orderBy(F.xxhash64(page_id), page_id).limit(sample).collect()]
    rows = labelled.filter(F.col(page_id).isin(ids)).select(F.col(page_html).alias("html")) if ids else None
    if rows is None:
        return weights({})
    counted = rows.mapInPandas(_counted, "name string, inside boolean, n long").groupBy("name", "inside").agg(F.sum("n").alias("n"))
    return weights({(r["name"], r["inside"]): r["n"] for r in counted.collect()})


def extract(pages: DataFrame, weight: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page; ``weight`` comes from ``learn`` where not given.

    A null or empty page gives the empty text and 0. Rows that repeat stay as they are, other
    columns are not looked at, and an empty table gives no rows.
    """
    weight = learn(pages) if weight is None else weight

    def extractor():
        def extracted(batch: dict) -> dict:
            texts = [main_text(p, weight) for p in batch["html"]]
            return {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": list(map(len, texts))}

        return extracted

    kind = dict(pages.dtypes)["page_id"]
    return mapped(pages.select("page_id", "url", "html"), extractor, f"page_id {kind}, url string, text string, n_chars long")
