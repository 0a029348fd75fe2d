"""DOM trees of pages and the tree-structured model over their elements.

Every element has a hidden label, content or not. A child's label depends on its parent's through a
potential that also knows the child's kind of tag; an element's features depend on its own label.
Sum-product messages go from the leaves to the root and back, which gives each element's exact
marginal in time linear in the page.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from html.parser import HTMLParser

#: Fixed sets of HTML: elements without content, elements that are never text, elements within a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset(
    "head title script style noscript template iframe object svg math canvas audio video select option textarea button".split()
)
#: What stands in a head; any other start tag, or text, ends one whose end tag is left out.
IN_HEAD = frozenset("head title base link meta style script noscript template basefont bgsound noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: A start tag of the key ends an open element of the value (up to the nearest of SCOPE).
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPE = frozenset("html body article section main aside nav header footer div table ul ol dl form".split())
#: Elements whose name says that they hold no article text, and those that hold the article.
ASIDE = frozenset("nav footer aside header form menu dialog".split())
LANDMARK = frozenset("article main".split())
#: Names in a class, id or role of what may stand within an article and is none of it.
OTHER = frozenset(
    "comment comments discussion respond replies ad ads advert advertisement sponsor sponsored promo banner share social"
    " related recommended newsletter subscribe signup cookie notice navigation breadcrumb breadcrumbs toolbar widget sidebar".split()
)
CLASS_BUCKETS = 512


@dataclass
class Node:
    tag: str
    parent: int
    names: list[str] = field(default_factory=list)
    marked: bool = False
    text: int = 0
    linked: int = 0
    children: int = 0


@dataclass
class Page:
    nodes: list[Node]
    blocks: list[tuple[int, str]]


class _Builder(HTMLParser):
    """Elements in page order and blocks of text with the element they stand in; tolerates open tags.

    Open elements are kept by tag, with their places in the stack, so that every tag and text is handled in
    a time that does not depend on how many are open.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes, self.blocks = [Node("#page", -1)], []
        #: Open elements, the nearest of each that is no inline element, and their places by tag and in SCOPE.
        self.stack, self.owners = [0], [0]
        self.open: dict[str, list[int]] = {}
        self.scopes = [0]
        self.pieces: list[str] = []
        self.unseen = 0

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        self.pieces.clear()
        if text:
            self.blocks.append((self.owners[-1], text))

    def _enter(self, node: Node) -> None:
        place = len(self.stack)
        self.nodes.append(node)
        self.stack.append(len(self.nodes) - 1)
        self.owners.append(self.owners[-1] if node.tag in INLINE else self.stack[-1])
        self.open.setdefault(node.tag, []).append(place)
        if node.tag in SCOPE:
            self.scopes.append(place)
        self.unseen += node.tag in UNSEEN

    def _leave(self, tag: str, scoped: bool) -> None:
        """Close the nearest open element of the tag with all inside it; ``scoped``: unless a SCOPE element is nearer."""
        places = self.open.get(tag)
        if not places or scoped and places[-1] < self.scopes[-1]:
            return
        place = places[-1]
        while len(self.stack) > place:
            name = self.nodes[self.stack.pop()].tag
            self.owners.pop()
            self.open[name].pop()
            if name in SCOPE:
                self.scopes.pop()
            self.unseen -= name in UNSEEN

    def _in_head(self) -> bool:
        return self.nodes[self.stack[-1]].tag == "head"

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "body" or self._in_head() and tag not in IN_HEAD:
            self._leave("head", False)
        if tag in VOID:
            if tag == "hr":
                self.flush()
                self._leave("p", True)
            elif tag != "wbr":
                self.pieces.append(" ")
            return
        if tag not in INLINE:
            self.flush()
            self._leave("p", True)
            for open_tag in ENDS.get(tag, ()):
                self._leave(open_tag, True)
        values = dict(attrs)
        words = re.findall(r"[a-z]+", f"{values.get('class') or ''} {values.get('id') or ''} {values.get('role') or ''}".lower())
        self.nodes[self.stack[-1]].children += 1
        self._enter(Node(tag, self.stack[-1], words, values.get("data-label") == "content"))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE and tag not in VOID:
            self.flush()
        self._leave(tag, tag in INLINE or tag == "p" or tag in ENDS)

    def handle_data(self, data: str) -> None:
        if data.strip() and self._in_head():
            self._leave("head", False)
        if self.unseen:
            return
        self.pieces.append(data)
        n = len(data.split())
        owner = self.nodes[self.owners[-1]]
        owner.text += n
        owner.linked += n if self.open.get("a") else 0


def parse(html: str) -> Page:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    builder.flush()
    return Page(builder.nodes, builder.blocks)


def features(node: Node) -> list[str]:
    """Features of one element; their number of kinds is bounded."""
    size = min(int(math.log2(node.text + 1)), 8)
    links = "no" if not node.linked else "all" if node.linked == node.text else "some"
    found = [f"tag:{node.tag if len(node.tag) < 12 else 'other'}", f"words:{size}", f"links:{links}", f"children:{min(node.children, 4)}"]
    return found + [f"name:{zlib.crc32(w.encode()) % CLASS_BUCKETS}" for w in sorted(set(node.names))]


def kind(node: Node) -> str:
    if node.tag in ASIDE:
        return "aside"
    return "landmark" if node.tag in LANDMARK else "inline" if node.tag in INLINE else "block"


def labels(page: Page) -> list[int] | None:
    """Labels that the page's own markup gives: inside marked or landmark elements, not inside asides nor
    inside what is named as no part of an article, such as its comments.

    None if it has neither marked nor landmark elements.
    """
    marked = any(n.marked for n in page.nodes)
    # 1 inside the article, -1 inside something that can hold no article any more
    found = [0]
    for node in page.nodes[1:]:
        above = found[node.parent]
        if not node.marked and (above < 0 or node.tag in ASIDE or not OTHER.isdisjoint(node.names)):
            found.append(-1 if above or not marked and not OTHER.isdisjoint(node.names) else 0)
        else:
            found.append(int(above == 1 or (node.marked if marked else node.tag in LANDMARK)))
    return [max(y, 0) for y in found] if 1 in found else None


def label_counts(page: Page) -> Counter:
    """What one labelled page adds to the model's counts; nothing without labels."""
    given, counts = labels(page), Counter()
    if given is None:
        return counts
    for i, node in enumerate(page.nodes):
        counts[f"label|{given[i]}"] += 1
        for f in features(node):
            counts[f"{f}|{given[i]}"] += 1
        if i:
            counts[f"edge:{kind(node)}:{given[node.parent]}|{given[i]}"] += 1
    return counts


class PageModel:
    """Potentials from counts of labelled pages, with ``smoothing`` added to each."""

    def __init__(self, counts: Counter, smoothing: float = 0.5):
        self.counts, self.smoothing = counts, smoothing
        self.totals = [counts[f"label|{y}"] for y in (0, 1)]
        self._unary: dict[str, tuple[float, float]] = {}
        self._edge: dict[str, tuple[tuple[float, float], tuple[float, float]]] = {}

    def unary(self, feature: str) -> tuple[float, float]:
        if feature not in self._unary:
            seen = [self.counts[f"{feature}|{y}"] for y in (0, 1)]
            p = [(n + self.smoothing) / (t + 2 * self.smoothing) for n, t in zip(seen, self.totals, strict=True)]
            self._unary[feature] = (p[0], p[1])
        return self._unary[feature]

    def edge(self, tag_kind: str) -> tuple[tuple[float, float], tuple[float, float]]:
        """Row: parent's label, column: child's."""
        if tag_kind not in self._edge:
            rows = []
            for parent in (0, 1):
                n = [self.counts[f"edge:{tag_kind}:{parent}|{y}"] + self.smoothing for y in (0, 1)]
                rows.append((n[0] / sum(n), n[1] / sum(n)))
            self._edge[tag_kind] = (rows[0], rows[1])
        return self._edge[tag_kind]

    def marginals(self, page: Page) -> list[float]:
        """Probability of content for each element, by messages up and then down the tree."""
        nodes = page.nodes
        local = []
        for node in nodes:
            a = b = 1.0
            for f in features(node):
                p = self.unary(f)
                a, b = a * p[0], b * p[1]
                a, b = a / (a + b), b / (a + b)
            local.append((a, b))
        local[0] = (1.0, 0.0)  # the page itself is no content
        up = list(local)  # an element's evidence with that of all below it
        message = [(1.0, 1.0)] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):  # children stand behind their parents
            e, (a, b) = self.edge(kind(nodes[i])), up[i]
            m0, m1 = e[0][0] * a + e[0][1] * b, e[1][0] * a + e[1][1] * b
            message[i] = (m0 / (m0 + m1), m1 / (m0 + m1))
            p = nodes[i].parent
            x, y = up[p][0] * message[i][0], up[p][1] * message[i][1]
            up[p] = (x / (x + y), y / (x + y))
        belief = list(up)
        for i in range(1, len(nodes)):
            e, parent = self.edge(kind(nodes[i])), belief[nodes[i].parent]
            # the parent's belief without what this child told it
            r0, r1 = parent[0] / message[i][0], parent[1] / message[i][1]
            x, y = up[i][0] * (r0 * e[0][0] + r1 * e[1][0]), up[i][1] * (r0 * e[0][1] + r1 * e[1][1])
            belief[i] = (x / (x + y), y / (x + y))
        return [b for _, b in belief]

    def extract(self, html: str) -> str:
        """The content blocks of a page in page order, one a line; empty if there are none."""
        page = parse(html)
        p = self.marginals(page)
        return "\n".join(text for owner, text in page.blocks if p[owner] >= 0.5)


#: Small labelled pages of common layouts: content elements carry data-label="content".
LABELLED_PAGES = (
    """<html><body><div id="header"><h1>Site</h1><ul class="menu"><li><a href="/">Home</a></li><li><a href="/b">Blog</a></li></ul></div>
    <div id="content" class="post" data-label="content"><h2>A walk by the river</h2><p>We set out early, before the mist had gone, and followed the bank for two hours.</p>
    <p>By noon the path had turned to mud, so we went back over the hill.</p></div>
    <div id="sidebar" class="widget"><h3>Recent</h3><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></div>
    <div class="comments"><div class="comment"><p>Lovely trip, thank you for writing about it.</p></div></div>
    <div id="footer">Copyright 2020. <a href="/p">Privacy</a></div></body></html>""",
    """<html><body><nav class="topbar"><a href="/">Start</a> <a href="/news">News</a></nav><div class="cookie notice">We use cookies. <a href="/c">More</a></div>
    <main data-label="content"><h1>Council agrees on the new bridge</h1><p>The council voted for the bridge on Monday evening after a long debate about its cost.</p>
    <blockquote>It will change this town.</blockquote><p>Work begins in spring and takes two years.</p><ul><li>Length: 200 metres</li><li>Cost: 12 million</li></ul></main>
    <aside class="related"><h3>Read next</h3><p><a href="/x">Traffic to be diverted</a></p></aside><div class="ad banner">Buy now and save.</div>
    <section class="comments"><h2>Comments</h2><article class="comment"><p>About time that this was decided.</p></article></section>
    <footer><p>Contact and imprint</p></footer></body></html>""",
    """<html><body><header><p>The Daily Page</p></header><article data-label="content"><h1>How to prune a pear tree</h1><p>Prune in late winter, when the tree is at rest and the buds are still closed.</p>
    <h2>Tools</h2><p>A sharp saw and clean shears are all that you need.</p><table><tr><td>Saw</td><td>20</td></tr></table></article>
    <div class="share social"><a href="/s">Share</a></div><form class="newsletter"><p>Sign up for our letter</p><input name="m"></form>
    <div class="sponsor advert"><p>Advertisement: pears by post.</p></div><footer>All rights reserved.</footer></body></html>""",
    """<html><body><header><p>Garden notes</p></header><article><h1>When to sow beans</h1><p>Wait until the soil is warm, then sow two seeds a hand apart and water them well.</p>
    <div class="advert"><p>Seeds at half price this week.</p></div><p>In dry weather the rows need water every second day.</p>
    <div class="comments"><h3>Comments</h3><div class="comment"><p>Mine came up within a week, thank you.</p></div><div class="comment"><p>The slugs ate all of them.</p></div></div></article>
    <section id="comments"><article class="comment"><p>I sow them in pots first.</p></article></section><footer>Imprint</footer></body></html>""",
)


def built_in_counts() -> Counter:
    return sum_counts(label_counts(parse(page)) for page in LABELLED_PAGES)


def sum_counts(counts: Iterable[Counter]) -> Counter:
    total: Counter = Counter()
    for c in counts:
        total.update(c)
    return total
