"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every block of text is a node that is content or not. A node's own potential comes
from its tag, its names and its text; a parent and its child have a potential for each pair of labels.
Sum-product messages, once up and once down the tree, give each node's exact marginal. The weights are
trained on labelled pages by following the gradient of the labels' likelihood, which needs the same marginals.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_text

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose text is never shown as part of the page.
_UNSHOWN = frozenset("head script style template noscript title svg math iframe object textarea select option datalist".split())
#: Elements that may be in a head. Any other, and any text, ends a head whose end tag is left out.
_IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
#: Elements that, with all elements in them, end with their own tag if it ends in a slash.
_FOREIGN = ("svg", "math")
#: What an opened element closes before it, up to the elements after the bar.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
}
#: Elements that contain no markup.
_RAW_END = {t: re.compile(rf"</{t}(?![^\s/>])", re.I) for t in ("script", "style", "textarea", "title", "iframe")}
#: Comments, instructions and tags. Each form ends with the page at the latest, so no part is read twice.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|</(?![A-Za-z])[^>]*+>?"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?P<close>>|\Z)",
    re.DOTALL,
)
LABEL = "data-label"
_NAMING = ("class", "id", "role", "itemprop", "aria-label")
_ATTRIBUTE = re.compile(
    rf"(?<![^\s\"'/])({'|'.join(_NAMING)}|{LABEL})\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I
)
_TEXT = "#text"


class Node:
    __slots__ = ("chars", "controls", "label", "link_chars", "names", "parent", "tag", "text")

    def __init__(self, tag: str, parent: int, names: str = "", label: str | None = None, text: str = "") -> None:
        self.tag, self.parent, self.names, self.label, self.text = tag, parent, names, label, text
        self.chars = self.link_chars = self.controls = 0


class _Tree:
    """Builds the nodes of a page in page order; a parent comes before its children."""

    def __init__(self) -> None:
        self.nodes = [Node("#page", -1)]
        self.stack: list[tuple[str, int]] = [("#page", 0)]  # open elements and the node each belongs to
        self.open: Counter[str] = Counter()
        self.block: list[str] = []
        self.linked: list[str] = []

    def _end_block(self) -> None:
        text = " ".join("".join(self.block).split())
        if text:
            leaf = Node(_TEXT, self.stack[-1][1], text=text)
            leaf.chars, leaf.link_chars = len(text), len(" ".join("".join(self.linked).split()))
            self.nodes.append(leaf)
        self.block, self.linked = [], []

    def _pop(self) -> None:
        self.open[self.stack.pop()[0]] -= 1

    def _end_head(self, tag: str) -> None:
        if not self.open["head"] or tag in _IN_HEAD:
            return
        if tag == "body":
            self._close_upto({"head"}, {"template"})
        while self.stack[-1][0] == "head":
            self._pop()

    def start(self, tag: str, attributes: str) -> None:
        self._end_head(tag)
        if tag in _INLINE or tag in _VOID:
            if tag in ("br", "img", "hr"):
                self.block.append(" ")
            if tag == "hr":
                self._end_block()
            if tag not in _VOID:
                self.stack.append((tag, self.stack[-1][1]))
                self.open[tag] += 1
            return
        self._end_block()
        if self.open["p"]:
            self._close_upto({"p"}, {"table", "button", "object"})
        if tag in _CLOSES:
            self._close_upto(*_CLOSES[tag])
        found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
        names = " ".join(found[a] for a in _NAMING if a in found)
        self.nodes.append(Node(tag, self.stack[-1][1], names, found.get(LABEL)))
        self.stack.append((tag, len(self.nodes) - 1))
        self.open[tag] += 1

    def _close_upto(self, tags: set[str], bound: set[str]) -> None:
        """Close the outermost open element of the tags that is not beyond one of the bound."""
        cut = None
        for at in range(len(self.stack) - 1, 0, -1):
            name = self.stack[at][0]
            if name in bound:
                break
            if name in tags:
                cut = at
        while cut is not None and len(self.stack) > cut:
            self._pop()

    def end(self, tag: str) -> None:
        if tag not in _INLINE:
            self._end_block()
        if not self.open[tag]:
            return
        while self.stack[-1][0] != tag:
            if tag in _INLINE and self.stack[-1][0] not in _INLINE:
                return  # an inline element does not close blocks opened within it
            self._pop()
        self._pop()

    def closes_itself(self, tag: str, attributes: str) -> bool:
        """Whether an element just opened has no content; on elements of HTML a slash says nothing."""
        if not attributes.endswith("/") or tag in _VOID or not any(self.open[t] for t in _FOREIGN):
            return False
        # A slash at the end of a value without quotes belongs to the value.
        last = attributes.split()[-1]
        bare = last[max(last.rfind("'"), last.rfind('"')) + 1 :]
        return "=" not in bare and not (bare == last and attributes[: -len(last)].rstrip().endswith("="))

    def data(self, data: str) -> None:
        if self.stack[-1][0] == "head" and data.strip():
            self._end_head(_TEXT)
        if any(self.open[t] for t in _UNSHOWN):
            return
        data = unescape(data)
        self.block.append(data)
        if self.open["a"]:
            self.linked.append(data)

    def feed(self, html: str) -> None:
        """Read a whole page. A tag that the page ends in the middle of is dropped."""
        at = 0
        while found := _MARKUP.search(html, at):
            if found.start() > at:
                self.data(html[at : found.start()])
            at = found.end()
            tag = (found["tag"] or "").lower()
            if found["close"] != ">":
                continue
            if found["end"]:
                self.end(tag)
                continue
            self.start(tag, found["attrs"])
            if self.closes_itself(tag, found["attrs"]):
                self._pop()
            elif tag in _RAW_END:
                end = _RAW_END[tag].search(html, at)
                at = end.start() if end else len(html)
        if at < len(html):
            self.data(html[at:])
        self._end_block()


def parse(html: str) -> list[Node]:
    """The nodes of a page, with the characters of text and the buttons below each; any text is some page."""
    tree = _Tree()
    tree.feed(html)
    for node in reversed(tree.nodes[1:]):
        above = tree.nodes[node.parent]
        above.chars += node.chars
        above.link_chars += node.link_chars
        above.controls += node.controls + (node.tag == "button")
    return tree.nodes


# Words in class, id and role names, by what they name.
_NAMES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip",
    "header": "header masthead topbar branding logo hero",
    "footer": "footer copyright colophon legal bottom contentinfo",
    "side": "sidebar side aside related recommend recommended widget widgets rail complementary trending popular more",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe paywall dialog toast",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner dfp outbrain taboola",
    "form": "form search login signin signup register contact",
    "comment": "comment comments reply replies respond response responses feedback disqus discussion thread reader",
    "share": "share sharing social tags tag meta byline author print toolbar",
    "main": "article articlebody content post entry story main body text maincontent page document prose",
}
_NAME_OF = {word: group for group, words in _NAMES.items() for word in words.split()}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = re.compile(r"[.!?…:;»\"”)\]]$")
#: What a notice speaks of.
_NOTICE = re.compile(r"(?i)\b(?:cookies?|consent|gdpr|newsletter)\b")
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _kind(tag: str) -> str:
    return "h" if tag in _HEADINGS else tag


def _steps(value: float, *bounds: float) -> int:
    return sum(value >= b for b in bounds)


def features(node: Node, above: Node | None) -> list[str]:
    """What a node shows of itself."""
    share = node.link_chars / node.chars if node.chars else 0
    found = ["bias", f"links {_steps(share, 0.01, 0.3, 0.7)}"]
    if node.tag == _TEXT:
        found += [f"text {_steps(node.chars, 20, 80, 250)}", "ends" if _END.search(node.text) else "open"]
        if "©" in node.text:
            found.append("copyright")
        if node.chars < 400 and _NOTICE.search(node.text):
            found.append("notice")
        return found
    found += [f"tag {_kind(node.tag)}", f"size {_steps(node.chars, 1, 100, 600)}"]
    if node.controls:
        found.append(f"controls, size {_steps(node.chars, 100, 600)}")
    if above is not None:
        found.append(f"tag {_kind(node.tag)} in {_kind(above.tag)}")
    if node.names:
        groups = {_NAME_OF.get(w.lower()) for w in _WORD.findall(node.names)}
        found += [f"name {g}" for g in groups if g]
    return found


def _edge(node: Node) -> str:
    """The sort of a node's edge to its parent, each sort with weights of its own for the pairs of labels."""
    return "text" if node.tag == _TEXT else "leaf" if node.tag in ("p", "li", "td", "th") or node.tag in _HEADINGS else "block"


Weights = dict[object, float]


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def marginals(nodes: list[Node], weights: Weights, shown: list[list[str]] | None = None) -> tuple[list[float], list[tuple[float, float, float, float]]]:
    """Each node's probability of being content, and of each edge the probabilities of its label pairs."""
    size = len(nodes)
    own = [0.0] * size
    sort: list[tuple[float, float, float, float]] = [(0.0,) * 4] * size
    tables: dict[str, tuple[float, float, float, float]] = {}
    for i, node in enumerate(nodes):
        above = nodes[node.parent] if i else None
        own[i] = sum(weights.get(f, 0.0) for f in (shown[i] if shown else features(node, above)))
        if i:
            kind = _edge(node)
            if kind not in tables:
                tables[kind] = tuple(weights.get((kind, p, c), 0.0) for p in (0, 1) for c in (0, 1))
            sort[i] = tables[kind]
    # Up: what the nodes below say of a node being 0 and 1, and what it passes to its parent.
    below0, below1 = [0.0] * size, own[:]
    to0, to1 = [0.0] * size, [0.0] * size
    for i in range(size - 1, 0, -1):
        w00, w01, w10, w11 = sort[i]
        to0[i], to1[i] = _log_sum(below0[i] + w00, below1[i] + w01), _log_sum(below0[i] + w10, below1[i] + w11)
        below0[nodes[i].parent] += to0[i]
        below1[nodes[i].parent] += to1[i]
    # Down: what all but the nodes below a node say of it.
    all0, all1 = below0[:], below1[:]
    pairs: list[tuple[float, float, float, float]] = [(0.0,) * 4] * size
    for i in range(1, size):
        p, (w00, w01, w10, w11) = nodes[i].parent, sort[i]
        rest0, rest1 = all0[p] - to0[i], all1[p] - to1[i]
        logs = (rest0 + below0[i] + w00, rest0 + below1[i] + w01, rest1 + below0[i] + w10, rest1 + below1[i] + w11)
        most = max(logs)
        shares = [math.exp(x - most) for x in logs]
        total = sum(shares)
        pairs[i] = tuple(x / total for x in shares)
        all0[i] = below0[i] + _log_sum(rest0 + w00, rest1 + w10)
        all1[i] = below1[i] + _log_sum(rest0 + w01, rest1 + w11)
    return [1 / (1 + math.exp(min(700.0, all0[i] - all1[i]))) for i in range(size)], pairs


def labels(nodes: list[Node]) -> list[int]:
    """Labels of a labelled page: text is content as its nearest labelled element says, an element if text in it is."""
    said, found = [False] * len(nodes), [0] * len(nodes)
    for i, node in enumerate(nodes):
        said[i] = node.label == "content" if node.label else bool(i) and said[node.parent]
    for i in range(len(nodes) - 1, 0, -1):
        if nodes[i].tag == _TEXT:
            found[i] = int(said[i])
        if found[i]:
            found[nodes[i].parent] = 1
    return found


def train(pages: Iterable[str], rounds: int = 100, rate: float = 0.25, decay: float = 0.002) -> Weights:
    """Weights fitted to labelled pages by gradient ascent with a step for each weight of its own.

    A page's labels are in ``data-label`` attributes (``content`` or anything else), valid for what is below.
    Pages are held in memory: give a bounded sample.
    """
    known = []
    for nodes in map(parse, pages):
        shown = [features(n, nodes[n.parent] if i else None) for i, n in enumerate(nodes)]
        known.append((nodes, labels(nodes), shown))
    weights: Weights = {}
    squares: dict[object, float] = defaultdict(float)
    for _ in range(rounds):
        slope: dict[object, float] = defaultdict(float)
        for nodes, truth, shown in known:
            chances, pairs = marginals(nodes, weights, shown)
            for i, node in enumerate(nodes):
                for f in shown[i]:
                    slope[f] += truth[i] - chances[i]
                if i:
                    kind = _edge(node)
                    for at, chance in enumerate(pairs[i]):
                        p, c = divmod(at, 2)
                        slope[kind, p, c] += (truth[node.parent] == p and truth[i] == c) - chance
        for f, d in slope.items():
            d = d / len(known) - decay * weights.get(f, 0.0)
            squares[f] += d * d
            weights[f] = weights.get(f, 0.0) + rate * d / (math.sqrt(squares[f]) + 1e-9)
    return weights


def main_text(html: str, weights: Weights) -> str:
    """The blocks of text that are content, in page order, one to a line."""
    nodes = parse(html)
    if len(nodes) == 1:
        return ""
    chances, _ = marginals(nodes, weights)
    return "\n".join(n.text for n, c in zip(nodes, chances, strict=True) if n.tag == _TEXT and c >= 0.5)


def extract(pages: DataFrame, weights: Weights, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text, n_chars) of every row. A null or empty page has the empty text.

    Pages are read one by one, whole; a row is one page, so nothing is shuffled.
    """

    def run(rows: Iterator[tuple[object, str]]) -> Iterator[tuple]:
        for key, html in rows:
            text = main_text(html, weights)
            yield key, text, len(text)

    return per_text(pages, id_col, html_col, run, {"text": pa.string(), "n_chars": pa.int64()})
