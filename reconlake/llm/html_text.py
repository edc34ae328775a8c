"""Main text of web pages by a maximum-scoring subsequence.

A page becomes a sequence of words and tags. Words score positive, tags
negative, and one linear scan finds the contiguous run with the largest sum,
which is the content region. The scores are log-odds learned from labelled
pages: of a tag, how much rarer it is inside main text than outside; of a word,
how the names of the elements around it (tag, class, id and role, as whole
names and as their parts) speak for or against main text. Within the region
an element whose own names speak strongly against main text is left out with
all that it holds: an advert inside an article neither splits the article nor
stays in its text.

Names of the outermost elements (html, body, main, article) never count against
their content, nor does a header's inside an article. Other elements that hold
at least half of the page's words, and its heading or article, are wrappers,
whatever they are called: a form or a `search-page` around a whole page. Where
that leaves nothing, or fewer than FEW words of a page without main or article,
the page is judged once more with all elements as wrappers that hold at least
half of its words, heading or not, and against which only parts of names speak:
a `legal-notice-text` around the only text. Elements that are hidden by attribute
or style are never seen.

Blocks are joined in page order by one space; inline elements join without one;
white space runs are one space; character references are decoded. Scripts,
styles, markup comments and other unseen elements never count. Pages are judged one by
one, whole, in time and memory linear in their length, however deep they nest.

Nulls and odd rows: null or empty html gives the empty text, as does a page
without any word in favour. Unclosed and misnested elements end where the page
or an outer element does; a tag that is cut off by the end of the page is
dropped; an unseen element that is never closed hides nothing. Repeated rows
are each judged. Other columns pass through; columns named like the outputs are
replaced.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconlake.llm.labelled_pages import LABELLED_PAGES

#: Fixed value: elements that don't end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Fixed value: elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Fixed value: elements that a start tag of the same group closes.
CLOSES = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
#: Fixed value: elements whose content is never seen.
UNSEEN = frozenset("script style noscript template textarea svg iframe head title object canvas math xmp noembed noframes".split())
#: Elements whose names never count against their content, and those of which a wrapper holds one.
OUTER, HOLDS = frozenset("html body main article".split()), frozenset("h1 main article".split())
TOLD = frozenset("main article".split())  # fixed value: elements by which a page tells its main text

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    # No quoted value reaches over the next tag, so that an open quote costs no scan of the rest.
    r"""|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?>[^>"']++|"[^"<]*+"|'[^'<]*+')*+)>"""
    r"|</?[a-z][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

#: What hides an element: an attribute, looked for beside quoted values, or a style.
HIDDEN = re.compile(r"(?:\s|^)hidden(?:[\s=/]|$)", re.IGNORECASE)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
NO_DISPLAY = re.compile(r"(?<![\w-])style\s*=\s*(?:\"[^\"]*|'[^']*|[^\s\"'>]*)(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.IGNORECASE)

AGAINST = -1.5  # log-odds below which an element's names make its content boilerplate
FEW = 20  # words of a text that may have lost its main part
LARGEST = 4.0


class Weights(NamedTuple):
    tags: dict[str, float]  # negative
    names: dict[str, float]  # of the features of an element
    tag: float  # of unknown tags
    word: float  # of words without a known element around them


def names(rest: str) -> list[str]:
    """The names of class, id and role."""
    return [t for groups in NAMES.findall(rest) for t in next(filter(None, groups), "").split()] if "=" in rest else []


def hidden(rest: str) -> bool:
    """Do the attributes hide their element?"""
    low = rest.lower()
    return "hidden" in low and HIDDEN.search(QUOTED.sub("x", rest)) is not None or ("display" in low or "visibility" in low) and NO_DISPLAY.search(rest) is not None


def parts(token: str) -> list[str]:
    """The parts of a compound name as features, lower-cased."""
    found = PART.findall(token)
    return [f"~{p.lower()}" for p in found] if len(found) > 1 else []


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """('text', text, ''), ('start', name, attributes), ('end', name, '') and ('gap', '', '') in page order."""
    at = 0
    lower = page.lower()
    lower = lower if len(lower) == len(page) else page  # some characters change length; then only lower-case end tags are found
    open_ended: set[str] = set()  # unseen elements of which no further end follows
    m = TAG.search(page)
    while m:
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        name = (m["name"] or "").lower()
        if name in UNSEEN and not m["end"] and name not in open_ended:
            close = lower.find(f"</{name}", at)
            if close < 0:
                open_ended.add(name)
            else:
                stop = page.find(">", close)
                at = len(page) if stop < 0 else stop + 1
            yield "gap", "", ""
        elif name in UNSEEN:
            yield "gap", "", ""
        elif name:
            yield ("end", name, "") if m["end"] else ("start", name, m["rest"])
        m = TAG.search(page, at)
    if at < len(page):
        yield "text", page[at:], ""


class Open:
    """The open elements with a state of each, innermost last."""

    def __init__(self, state) -> None:
        self.names: list[str] = [""]
        self.states = [state]
        self.count: Counter[str] = Counter()

    def before(self, name: str) -> list:
        """Closes what a start tag closes; the states of it."""
        return self._pop_while(lambda last: last in CLOSES.get(name, ()))

    def start(self, name: str, state) -> None:
        if name not in VOID:
            self.names.append(name)
            self.states.append(state)
            self.count[name] += 1

    def end(self, name: str) -> list:
        """Closes the innermost element of that name and what is open in it; the states of all these."""
        if not self.count[name]:
            return []
        return self._pop_while(lambda last: last != name) + self._pop_while(lambda last: self.count[name] and last == name, 1)

    def _pop_while(self, fits, most: int | None = None) -> list:
        out = []
        while len(self.names) > 1 and len(out) != most and fits(self.names[-1]):
            self.count[self.names.pop()] -= 1
            out.append(self.states.pop())
        return out


def learn(pages: Iterable[str] = LABELLED_PAGES, mark: str = "data-main") -> Weights:
    """Weights from pages in which elements with the attribute `mark` hold main text."""
    tags, words = (Counter(), Counter()), (Counter(), Counter())  # outside, inside
    for page in pages:
        opened = Open((False, frozenset()))
        for kind, x, rest in events(page):
            if kind == "start":
                opened.before(x)
                inside, around = opened.states[-1]
                tag = set() if x in INLINE or x in OUTER else {f"<{x}>"}
                own = [f for t in names(rest) for f in (t.lower(), *parts(t))] if x not in OUTER else []
                opened.start(x, (inside or mark in rest, around | tag | set(own)))
            elif kind == "end":
                opened.end(x)
            inside, around = opened.states[-1]
            if kind in ("start", "end"):
                tags[inside][x] += 1
            elif kind == "text":
                n = len(x.split())
                words[inside][""] += n
                for f in around:
                    words[inside][f] += n
    n_tags = [sum(c.values()) + 1 for c in tags]

    def odds(a: Counter, b: Counter, f: str, n_a: int, n_b: int) -> float:
        return max(-LARGEST, min(LARGEST, math.log((a[f] + 0.5) / n_a) - math.log((b[f] + 0.5) / n_b)))

    known = (set(words[0]) | set(words[1])) - {""}
    return Weights(
        {t: -0.1 if t in INLINE else max(-2.0, min(-0.1, odds(tags[1], tags[0], t, n_tags[1], n_tags[0]))) for t in set(tags[0]) | set(tags[1])},
        {f: odds(words[1], words[0], f, words[1][""], words[0][""]) for f in known},
        -0.5,
        1.0,
    )


def own_weight(w: Weights, opened: Open, name: str, rest: str, by_parts: bool = True) -> float:
    """The least weight of an element's own names, at most 0; parts only count in names that are not known themselves, if `by_parts`."""
    if name in OUTER:
        return 0.0
    if hidden(rest):
        return -LARGEST
    least = 0.0
    if name not in INLINE and not (name == "header" and (opened.count["article"] or opened.count["main"])):
        least = min(least, w.names.get(f"<{name}>", 0.0))
    for token in names(rest):
        known = w.names.get(token.lower())
        least = min(least, known) if known is not None else min([least, *[w.names[f] for f in parts(token) if by_parts and f in w.names]])
    return least


def wrappers(steps: list[tuple[str, str, str]], w: Weights, headed: bool = True) -> set[int]:
    """Places of start tags whose names speak against main text and which yet hold half of the page's words: with its heading or article if `headed`, else if only parts of names speak against them; none that are hidden."""
    opened = Open(-1)
    begun: list[list[int]] = []  # place, words and heads before, then inside
    words = heads = 0

    def close(states: list[int]) -> None:
        for i in states:
            if i >= 0:
                begun[i][1:] = [words - begun[i][1], heads - begun[i][2]]

    for at, (kind, x, rest) in enumerate(steps):
        if kind == "text":
            words += len(x.split())
        elif kind == "start":
            close(opened.before(x))
            against = own_weight(w, opened, x, rest) < AGAINST and not hidden(rest)
            against = against and (headed or own_weight(w, opened, x, rest, by_parts=False) >= AGAINST)
            opened.start(x, len(begun) if against else -1)
            if against and x not in VOID:
                begun.append([at, words, heads])
            heads += x in HOLDS
        elif kind == "end":
            close(opened.end(x))
    close(opened.states)
    return {at for at, n, found in begun if (found or not headed) and 2 * n >= words}


def scored(steps: list[tuple[str, str, str]], w: Weights, outer: set[int]) -> tuple[list[str], list[float]]:
    """Pieces of text ("\0" ends a block; nothing for what is left out) and the score of each; outer: the places of wrappers."""
    opened = Open(0.0)  # least weight of the elements around
    pieces, scores = [], []
    for at, (kind, x, rest) in enumerate(steps):
        around = opened.states[-1]
        if kind == "text":
            left_out = around < AGAINST
            pieces.append("" if left_out else x)
            scores.append(0.0 if left_out else len(x.split()) * max(0.2, w.word + around))
            continue
        if kind == "start":
            opened.before(x)
            own = 0.0 if at in outer else own_weight(w, opened, x, rest)
            opened.start(x, min(opened.states[-1], own))
        elif kind == "end":
            opened.end(x)
        quiet = kind == "gap" or min(around, opened.states[-1]) < AGAINST
        pieces.append("" if x in INLINE else "\0")
        scores.append(0.0 if quiet else w.tags.get(x, w.tag))
    return pieces, scores


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end (exclusive) of the contiguous run with the largest positive sum, the first such; (0, 0) if there is none."""
    best = total = 0.0
    region, start = (0, 0), 0
    for i, x in enumerate(scores):
        total += x
        if total <= 0.0:
            total, start = 0.0, i + 1
        elif total > best:
            best, region = total, (start, i + 1)
    return region


def _region(steps: list[tuple[str, str, str]], w: Weights, outer: set[int]) -> str:
    pieces, scores = scored(steps, w, outer)
    first, end = best_run(scores)
    # A page's own NUL characters only end blocks too; html does not allow them.
    blocks = (" ".join(references.unescape(block).split()) for block in "".join(pieces[first:end]).split("\0"))
    return " ".join(filter(None, blocks))


def main_text(page: str | None, w: Weights) -> str:
    """The main text of one page."""
    steps = list(events(page or ""))
    outer = wrappers(steps, w)
    text = _region(steps, w, outer)
    told = any(kind == "start" and x in TOLD for kind, x, _ in steps)
    if not text or len(text.split()) < FEW and not told:
        wider = wrappers(steps, w, headed=False)
        text = _region(steps, w, wider) if wider != outer else text
    return text


def _extract(weights: Weights):
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: main_text(p, weights))

    return F.pandas_udf(extract, "string").asNondeterministic()  # so that no rewrite of the plan runs it twice


def extract(pages: DataFrame, html: str = "html", weights: Weights | None = None) -> DataFrame:
    """`pages` with text and n_chars (its code points)."""
    return pages.withColumn("text", _extract(weights or learn())(F.col(html))).withColumn("n_chars", F.length("text").cast("bigint"))
