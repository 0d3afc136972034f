"""Main text of web pages by a tree-structured graphical model.

Elements and runs of text are the nodes of a tree of hidden states: all of its
text is main text, none is, or both. A node's signs (its tag, words in its class
and id or in those of the part it stands in, whether it is hidden, how much of
its text is links, how long its text is, whether it stands in the page's article
or main) give a node potential, and each edge has a potential for the states of
parent and child. What they stand for is learned from the labelled pages alone.
Sum-product messages go up from the leaves and down from the root; their
product is each node's exact marginal. A run of text that is main text with a
marginal of one half or more is kept. All potentials are smoothed counts over
labelled pages (``labelled_pages``), taken once on the driver and broadcast.

Scripts, styles, templates, comments of the markup and the head are never text.
Messages run over arrays in document order, so deep nesting needs no recursion.

Cases: a null or empty html has an empty text; so has a page whose text is all
outside main text; broken markup (unclosed, stray or cut-off tags) is read as
browsers do in the common cases, in time linear in the page, however long; a tag
or quoted value that never ends takes the rest of the page; repeated rows each
get their result; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import map_batches
from fieldmark.llm.labelled_pages import MAIN_CLOSE, MAIN_OPEN, pages

#: A tag's end is the first > outside quoted values; quotes open behind = alone, and a tag or value that does not end takes the rest of the page, once.
TOKEN = re.compile(r"<!--(.*?)(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=\"']++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+|[\"'])*+)(?:>|\Z)", re.S)
#: One attribute, name and value; matched end to end, so nothing is looked for inside a value.
ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
#: Fixed values of HTML: elements without content, with raw text, and that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template head noscript svg iframe object canvas title".split())
IN_HEAD = frozenset("title meta link script style base basefont bgsound noframes noscript template head".split())
RAW = frozenset("script style title textarea noscript iframe".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul button textarea".split()
)
ENDS_PARAGRAPH = BLOCKS - frozenset("body button dd dt html li option select tbody td textarea tfoot th thead tr".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Elements that, where a page has them, tell in and out apart; what that means is learned.
FRAMED = frozenset(("article", "main"))
GROUPS = {tag: tag for tag in "nav header footer aside form article main section div p a li table pre blockquote body html".split()}
GROUPS |= {"#root": "root", "#text": "text"}
GROUPS |= dict.fromkeys("button input select option textarea label fieldset legend".split(), "control") | dict.fromkeys("h1 h2".split(), "title") | dict.fromkeys("h3 h4 h5 h6".split(), "heading") | dict.fromkeys("ul ol dl menu".split(), "list") | dict.fromkeys("tr td th tbody thead tfoot".split(), "cell")
#: States of a node: all of its text is main text, none is, or both.
MAIN, ELSE, BOTH = range(3)
STATES, NEUTRAL = 3, (1.0, 1.0, 1.0)
#: Node potentials that are kept for the next page; the others are computed again.
MOST_KNOWN = 1 << 16
#: The hint of a node without class, id and role, and of one that is not shown.
NOTHING, HIDDEN = ("none",), ("hidden",)


class Stack:
    """Open elements, and how many there are of each tag, so that a stray end tag costs no search."""

    def __init__(self, tags: list[str]) -> None:
        self.tags, self.nodes, self.open = tags, [0], Counter()

    @property
    def top(self) -> int:
        return self.nodes[-1]

    def push(self, node: int) -> None:
        self.nodes.append(node)
        self.open[self.tags[node]] += 1

    def pop(self) -> str:
        tag = self.tags[self.nodes.pop()]
        self.open[tag] -= 1
        return tag


class Tree:
    """A page: elements and runs of text in document order, each with its parent."""

    def __init__(self, page: str) -> None:
        self.parent, self.tag, self.hint, self.main = [-1], ["#root"], [NOTHING], [False]
        self.texts: list[tuple[int, str]] = []
        self._read(page)

    def _add(self, parent: int, tag: str, hint: tuple[str, ...], main: bool) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.hint.append(hint)
        self.main.append(main)
        return len(self.tag) - 1

    def _text(self, parent: int, text: str, main: bool) -> None:
        self.texts.append((self._add(parent, "#text", NOTHING, main) if text and not text.isspace() else parent, text))

    def _read(self, page: str) -> None:
        stack, unseen, at, main = Stack(self.tag), 0, 0, False
        while at < len(page):
            m = TOKEN.search(page, at)
            if m is None or m.start() > at:
                unseen -= self._close_head(stack, page[at : m.start() if m else None])
            if not unseen and (m is None or m.start() > at):
                self._text(stack.top, html.unescape(page[at : m.start() if m else None]), main)
            if m is None:
                break
            at = m.end()
            if m[2] is not None and not unseen:
                self._text(stack.top, m[2], main)
            if m[4] is None:
                main = (main or m[0] == MAIN_OPEN) and m[0] != MAIN_CLOSE
                continue
            tag = m[4].lower()
            if m[3]:
                if stack.open[tag]:
                    while True:
                        done = stack.pop()
                        unseen -= done in UNSEEN
                        if done == tag:
                            break
                elif tag in ("p", "br"):
                    self.texts.append((stack.top, " "))
                continue
            if tag not in IN_HEAD:
                unseen -= self._close_head(stack)
            unseen -= self._close_before(tag, stack)
            if tag in ("br", "hr"):
                self.texts.append((stack.top, " "))
                continue
            node = self._add(stack.top, tag, hint_of(m[5]) if m[5] else NOTHING, main)
            if tag in VOID or m[5].endswith("/") and tag in UNSEEN:
                continue
            if tag in RAW:
                end = re.compile(f"</{tag}[^>]*>?", re.I).search(page, at)
                if tag == "textarea" and not unseen:
                    self._text(node, html.unescape(page[at : end.start() if end else None]), main)
                at = end.end() if end else len(page)
                continue
            stack.push(node)
            unseen += tag in UNSEEN

    def _close_head(self, stack: Stack, text: str = "x") -> int:
        """Pop an open head before what cannot stand in one, a start tag or ``text``; how many were unseen."""
        closed = 0
        while self.tag[stack.top] == "head" and not text.isspace():
            stack.pop()
            closed += 1
        return closed

    def _close_before(self, tag: str, stack: Stack) -> int:
        """Pop what a start tag ends unasked; how many of those were unseen."""
        closed, names = 0, None
        if tag in ENDS_PARAGRAPH:
            names, stop = {"p"}, {"button", "td", "th", "table", "article", "section", "div", "#root"}
        elif tag in CLOSES:
            names, stop = CLOSES[tag]
        elif tag == "body":
            names, stop = {"head"}, {"body"}
        if names and any(stack.open[x] for x in names):
            found = None
            for depth in range(len(stack.nodes) - 1, 0, -1):
                if self.tag[stack.nodes[depth]] in names:
                    found = depth
                    if tag != "tr":
                        break
                elif self.tag[stack.nodes[depth]] in stop:
                    break
            while found is not None and len(stack.nodes) > found:
                closed += stack.pop() in UNSEEN
        return closed

    def signs(self) -> list[tuple]:
        """For each node: tag group, that with the parent's, words of its class, share of its text in links, length of its text, place in or out of the page's frames."""
        n = len(self.tag)
        length, linked = [0] * n, [0] * n
        for node, text in self.texts:
            length[node] += len(text.strip())
        for i in range(n - 1, 0, -1):
            if self.tag[i] == "a":
                linked[i] = length[i]
            length[self.parent[i]] += length[i]
            linked[self.parent[i]] += linked[i]
        group = [GROUPS.get(t, "other") for t in self.tag]
        both = [f"{group[p]}>{g}" if p >= 0 else g for p, g in zip(self.parent, group, strict=True)]
        inside: list[frozenset[str]] = [frozenset()] * n
        for i, tag in enumerate(self.tag):
            above = inside[self.parent[i]] if i else frozenset()
            inside[i] = above | {tag} if tag in FRAMED else above
        frames = FRAMED.intersection(self.tag)  # where a page has both, what is in one alone is told from what is in both
        names = {x: f"{'+'.join(sorted(x))} of {'+'.join(sorted(frames))}" for x in set(inside)}
        place, hint = [names[x] for x in inside], list(self.hint)
        for i in range(1, n):  # a part without words of its own stands under its parent's
            if hint[i] == NOTHING:
                hint[i] = hint[self.parent[i]]
        return [(g, b, h, share_of(k, s), size_of(s), x) for g, b, h, s, k, x in zip(group, both, hint, length, linked, place, strict=True)]

    def states(self) -> list[int]:
        """The labelled state of each node: all its text is main, none is, or both."""
        n = len(self.tag)
        has, lacks = [False] * n, [False] * n
        for i in range(n - 1, -1, -1):
            if self.tag[i] == "#text" or not (has[i] or lacks[i]):
                has[i], lacks[i] = self.main[i], not self.main[i]
            if i and (self.tag[i] == "#text" or has[i] or lacks[i]):
                has[self.parent[i]] |= has[i]
                lacks[self.parent[i]] |= lacks[i]
        return [BOTH if x and y else MAIN if x else ELSE for x, y in zip(has, lacks, strict=True)]


def hint_of(attributes: str) -> tuple[str, ...]:
    """The words of class, id and role, sorted; or that the element is not shown."""
    words: set[str] = set()
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and "true" in value or name == "style" and "display:none" in value.replace(" ", ""):
            return HIDDEN
        if name in ("class", "id", "role"):
            words.update(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()))
    return tuple(sorted(words - {"none", "hidden"})) or NOTHING


def share_of(linked: int, length: int) -> str:
    return "none" if not linked else "some" if linked * 3 < length else "most" if linked * 10 < length * 9 else "all"


def size_of(length: int) -> str:
    return "none" if not length else "short" if length < 40 else "middle" if length < 400 else "long"


class Model:
    """Potentials from smoothed counts: of each sign given a node's state, and of a child's state given its parent's."""

    def __init__(self, labelled: list[Tree], smoothing: float = 0.02) -> None:
        counts: list[dict[str, list[float]]] = [{} for _ in range(6)]
        total, edges = [0] * STATES, [[smoothing] * STATES for _ in range(STATES)]
        for tree in labelled:
            state = tree.states()
            for i, signs in enumerate(tree.signs()):
                total[state[i]] += 1
                for k, sign in enumerate(signs):
                    for one in sign if k == 2 else (sign,):
                        counts[k].setdefault(one, [0] * STATES)[state[i]] += 1
                if i:
                    edges[state[tree.parent[i]]][state[i]] += 1
        self.sign = [{s: [(c[x] + smoothing) / (total[x] + smoothing * (len(kind) + 1)) for x in range(STATES)] for s, c in kind.items()} for kind in counts]
        self.edge = [[e / sum(row) for e in row] for row in edges]
        self.known: dict[tuple, list[float]] = {}

    def unary(self, signs: tuple) -> list[float]:
        """A node's potential, scaled to a sum of 1; a sign never seen says nothing."""
        words = tuple(w for w in signs[2] if w in self.sign[2])
        signs = (*signs[:2], words, *signs[3:])
        if signs not in self.known:
            own = [kind.get(s, NEUTRAL) for k, (kind, s) in enumerate(zip(self.sign, signs, strict=True)) if k != 2]
            out = [math.prod(x) for x in zip(*own, *(self.sign[2][w] for w in words), strict=True)]
            if len(self.known) < MOST_KNOWN:
                self.known[signs] = [x / sum(out) for x in out]
            return [x / sum(out) for x in out]
        return self.known[signs]

    def marginals(self, tree: Tree) -> list[float]:
        """The probability of main text for every node: messages go up, then down."""
        e, parent = self.edge, tree.parent
        (e00, e01, e02), (e10, e11, e12), (e20, e21, e22) = e
        below, n = [self.unary(s) for s in tree.signs()], len(parent)
        up: list = [None] * n
        for i in range(n - 1, 0, -1):
            a, b, c = below[i]
            x, y, z = e00 * a + e01 * b + e02 * c, e10 * a + e11 * b + e12 * c, e20 * a + e21 * b + e22 * c
            up[i] = (x, y, z)
            p, q, r = below[parent[i]]
            x, y, z = p * x, q * y, r * z
            total = x + y + z
            below[parent[i]] = [x / total, y / total, z / total]
        for i in range(1, n):
            (p, q, r), (x, y, z), (a, b, c) = below[parent[i]], up[i], below[i]
            p, q, r = p / x, q / y, r / z  # the parent's belief without this child's message
            a, b, c = a * (p * e00 + q * e10 + r * e20), b * (p * e01 + q * e11 + r * e21), c * (p * e02 + q * e12 + r * e22)
            total = a + b + c
            below[i] = [a / total, b / total, c / total]
        return [x[MAIN] for x in below]


@cache
def trained() -> Model:
    return Model([Tree(p) for p in pages()])


def main_text(page: str | None, model: Model | None = None) -> str:
    """The main text of a page: blocks in page order, joined by one space."""
    if not page:
        return ""
    tree = Tree(page)
    keep, block = (model or trained()).marginals(tree), list(range(len(tree.tag)))
    for i, tag in enumerate(tree.tag):
        if i and tag not in BLOCKS:
            block[i] = block[tree.parent[i]]
    out, last = [], -1
    for node, text in tree.texts:
        if tree.tag[node] != "#text":
            out.append(" ")
        elif keep[node] >= 0.5:
            out += [text] if block[node] == last else [" ", text]
            last = block[node]
    return " ".join("".join(out).split())


def main_texts(pages_table: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages_table``."""

    model = pages_table.sparkSession.sparkContext.broadcast(trained())  # a few hundred counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py(), model.value) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages_table.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return map_batches(rows, run, "page_id long, url string, text string, n_chars long")
