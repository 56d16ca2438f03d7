"""Main text of web pages by wrapper induction.

The pages of one host share a template. For each host a wrapper is induced from all its pages: their DOM trees are aligned one
after the other by simple tree matching (the largest order-preserving match of nodes with equal labels whose parents match)
and merged. A text that nearly all pages have in a node of the wrapper is template; other texts are content. A page with an
article or main element of its own has its text there, without what is template by the same count over different articles. In other pages, also of the same host, the nodes that are not mostly
links are content. Elements whose whole name says menu, footer, advert and the like are left out; parts of names only confirm
that an element is constant or mostly links. What holds the article, or most of the text, is never left out by its name.

A page goes to the induction as a tree of labels, hashes and counts, without texts. Trees of a host are merged in parts, and the
parts by the same alignment, counts added; a task holds one wrapper at a time. Pages with the same article (or, without one, the
same text) count once, so that a text is not taken for template because it was copied. Wrappers are joined by host, and
broadcast only if their measured size is small.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Generator, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wardline.llm.frames import ready, written

# Parts that the pages of one host are merged in, side by side, at most.
PARTS = 64
# Pages of a part of a large host, about.
PAGES = 256
# Share of (different) pages with one text that makes a node template, and the pages it takes to tell.
CONSTANT, LEAST_PAGES = 0.6, 3
# Texts that a slot keeps counts of: this many, and a multiple of its elements on a page. A text's count is then short by at most
# a sixteenth of the slot's pages, and the slot knows by how much (Misra and Gries).
KEPT, KEPT_TIMES = 64, 16
# Share of an article's text that may be template; with more it is taken for a copy.
MOST_REPEATED = 2 / 3
PRIME, BASE = (1 << 61) - 1, 0x1D3F84A5B7C96E21 % ((1 << 61) - 1)
# Siblings that are aligned at once; longer lists are aligned between labels that both have once, in windows that overlap.
ALIGNED = 64
BROADCAST_BYTES = 8 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "title", "textarea", "template", "iframe", "noembed", "noframes", "xmp"))
DROPPED = frozenset((
    "head", "script", "style", "noscript", "template", "title", "iframe", "noembed", "noframes", "svg", "canvas", "object",
    "form", "button", "select", "input", "textarea", "nav", "footer", "aside", "menu", "dialog"))
INLINE = frozenset((
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr").split())
CLOSED_BY_BLOCK = frozenset(("p",))
SAME_CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"),
               "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select", "optgroup")}
ARTICLE = frozenset(("article", "main"))
# Elements of these kinds may stand around the whole page, and hold the text then.
AROUND = frozenset(("form", "object", "dialog"))
# Names of a whole class, id or role that say by themselves what an element is. As a part of a longer name, and like the
# words below, they only confirm what the alignment says.
NAMES = frozenset((
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo sidebar side-bar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead cookie cookies consent newsletter subscribe comments comment-list commentlist "
    "disqus widget widgets toolbar pagination pager").split())
HINTS = re.compile(
    r"(?<![a-z])(ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar\w*|side-?bar|menu\w*|nav\w*|breadcrumbs?|footer|foot|masthead|"
    r"cookies?|consent|notice|popup|modal|newsletter|subscribe|share|sharing|social|related|recommend\w*|comments?|"
    r"comment-?list|respond|reply|replies|disqus|widget\w*|toolbar|pagination|pager|login|signup|search\w*)(?![a-z])")
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
DIGITS = re.compile(r"\d+")
LINK = "a"
_ends: dict[str, re.Pattern[str]] = {}


class Node:
    __slots__ = ("tag", "names", "parts")

    def __init__(self, tag: str, names: str = ""):
        self.tag, self.names = tag, names
        self.parts: list[Node | str] = []

    @property
    def label(self) -> str:
        """Numbers in names (of posts, of ads) say nothing about the layout."""
        return f"{self.tag} {DIGITS.sub('#', self.names)}" if self.names else self.tag


def parse(page: str) -> Node:
    """The page's tree; missing and stray end tags are put right as browsers do for the common cases."""
    root = Node("html")
    stack, at = Stack(root), 0
    while True:
        found = TAG.search(page, at)
        text = page[at:found.start()] if found else page[at:]
        if text:
            stack[-1].parts.append(text)
        if not found:
            return root
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            for depth in range(len(stack) - 1, 0, -1) if stack.open[tag] else ():
                if stack[depth].tag == tag:
                    stack.cut(depth)
                    break
                # An inline element's end tag doesn't end the blocks around it.
                if tag in INLINE and stack[depth].tag not in INLINE:
                    break
            continue
        if tag == "html":
            continue
        if tag not in INLINE:
            _close(stack, CLOSED_BY_BLOCK, ("article", "body", "div", "section", "td", "li", "button"))
        if tag in SAME_CLOSES:
            _close(stack, (tag,) if tag not in ("dt", "dd", "td", "th") else ("dt", "dd", "td", "th"), SAME_CLOSES[tag])
        names = ""
        if found[3] and "=" in found[3]:
            names = " ".join(sorted({
                f"{k.lower()}:{w}" for k, v in ATTRIBUTE.findall(found[3]) for w in v.strip("\"'").lower().split()}))
        node = Node(tag, names)
        stack[-1].parts.append(node)
        if tag in VOID or found[3].endswith("/"):
            continue
        if tag in RAW:
            end = _ends.setdefault(tag, re.compile(rf"</{tag}[^>]*>", re.I)).search(page, at)
            at = end.end() if end else len(page)
            continue
        stack.push(node)


class Stack(list[Node]):
    """Open elements, and how many there are of each kind, so that nothing is looked for in vain in deep pages."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.open: Counter[str] = Counter()

    def push(self, node: Node) -> None:
        self.append(node)
        self.open[node.tag] += 1

    def cut(self, depth: int) -> None:
        for node in self[depth:]:
            self.open[node.tag] -= 1
        del self[depth:]


def _close(stack: Stack, tags: tuple[str, ...] | frozenset[str], within: tuple[str, ...]) -> None:
    for depth in range(len(stack) - 1, 0, -1) if any(stack.open[t] for t in tags) else ():
        if stack[depth].tag in tags:
            stack.cut(depth)
            return
        if stack[depth].tag in within:
            return


def named(node: Node) -> bool:
    """If one of the element's names alone says that it is no part of the article. The page's and the article's own say nothing."""
    return (node.tag not in ARTICLE and node.tag not in ("html", "body")
            and any(name.split(":", 1)[1] in NAMES for name in node.names.split()))


def hinted(node: Node) -> bool:
    """If the element's names would fit a part of the page that isn't the article, should it be constant or mostly links."""
    return node.tag not in ARTICLE and node.tag not in ("html", "body") and bool(HINTS.search(node.names))


class Facts:
    """What is known of a page's elements, by their ids: characters of text, those in links, and a hash of the text, all without
    white space and without elements that are dropped by kind; which hold an article or main element with a text; and the
    hash of the page's articles or, without one, of its text."""

    def __init__(self, page: Node):
        order, todo = [], [page]
        while todo:
            node = todo.pop()
            order.append(node)
            todo.extend(_inner(node))
        self.chars: dict[int, int] = {}
        self.links: dict[int, int] = {}
        self.hash: dict[int, int] = {}
        self.blocks: set[int] = set()
        self.holding: set[int] = set()
        power: dict[int, int] = {}
        articles = 0
        for node in reversed(order):
            me, chars, links, value, times = id(node), 0, 0, 0, 1
            gone = node.tag in DROPPED and node.tag not in AROUND
            for part in () if gone else node.parts:
                if isinstance(part, str):
                    text = "".join(part.split())
                    if text:
                        chars += len(text)
                        word = int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big")
                        value, times = (value * BASE + word) % PRIME, times * BASE % PRIME
                else:
                    its = id(part)
                    chars += self.chars[its]
                    links += self.links[its]
                    value, times = (value * power[its] + self.hash[its]) % PRIME, times * power[its] % PRIME
                    if its in self.holding:
                        self.holding.add(me)
                    if part.tag not in INLINE or its in self.blocks:
                        self.blocks.add(me)
            self.chars[me], self.hash[me], power[me] = chars, value, times
            self.links[me] = chars if node.tag == LINK else links
            if node.tag in ARTICLE and chars:
                self.holding.add(me)
                articles = (articles * BASE + value + 1) % PRIME
        self.article = id(page) in self.holding
        self.key = articles if self.article else self.hash[id(page)]


def _inner(node: Node) -> list[Node]:
    return [] if node.tag in DROPPED and node.tag not in AROUND else [p for p in node.parts if isinstance(p, Node)]


def children(node: Node) -> list[Node]:
    return [p for p in node.parts if isinstance(p, Node) and p.tag not in RAW and p.tag not in VOID]


def groups(node_list: list[Node]) -> list[tuple[str, list[Node]]]:
    """Nodes to be aligned: runs of one label are one group."""
    out: list[tuple[str, list[Node]]] = []
    for node in node_list:
        if out and out[-1][0] == node.label and (node.tag in INLINE or node.tag in ("p", "li", "tr", "td", "dt", "dd")):
            out[-1][1].append(node)
        else:
            out.append((node.label, [node]))
    return out


class Slot:
    """A node of a wrapper: a label, the pages that have it, its texts and on how many pages each was, and child slots in order.

    A page is a wrapper of its own, whose slots know their nodes.
    """

    __slots__ = ("label", "tag", "pages", "members", "chars", "links", "texts", "lost", "kids", "nodes", "constant", "linked")

    def __init__(self, label: str, nodes: list[Node] | None = None):
        self.label, self.tag = label, label.split(" ", 1)[0]
        self.pages, self.members, self.chars, self.links, self.lost = 0, 0, 0, 0, 0
        self.texts: dict[int, int] = {}
        self.kids: list[Slot] = []
        self.nodes = nodes or []
        self.constant: frozenset[int] = frozenset()
        self.linked = False

    def add(self, other: Slot) -> None:
        self.pages += other.pages
        self.members += other.members
        self.chars += other.chars
        self.links += other.links
        self.lost += other.lost
        for text, pages in other.texts.items():
            self.texts[text] = self.texts.get(text, 0) + pages
        keep = max(KEPT, KEPT_TIMES * self.members // max(1, self.pages))
        if len(self.texts) > 2 * keep:
            less = sorted(self.texts.values(), reverse=True)[keep]
            self.texts = {t: n - less for t, n in self.texts.items() if n > less}
            self.lost += less

    def decide(self, inside: bool = False) -> None:
        """``inside`` an article it takes one page more, as articles quote each other."""
        if self.pages >= LEAST_PAGES:
            least = LEAST_PAGES if inside else LEAST_PAGES - 1
            self.constant = frozenset(t for t, n in self.texts.items() if n >= least and n + self.lost >= CONSTANT * self.pages)
        self.linked = 2 * self.links > self.chars > 0


def page_slots(page: Node, facts: Facts) -> Slot:
    """The page as a wrapper; inline elements share the fate of what they stand in."""
    root = Slot("html", [page])
    todo = [root]
    while todo:
        slot = todo.pop()
        slot.pages, slot.members = 1, len(slot.nodes)
        slot.chars = sum(facts.chars[id(n)] for n in slot.nodes)
        slot.links = sum(facts.links[id(n)] for n in slot.nodes)
        slot.texts = {facts.hash[id(n)]: 1 for n in slot.nodes if facts.chars[id(n)]}
        inner = [k for n in slot.nodes for k in children(n)
                 if (k.tag not in DROPPED or k.tag in AROUND) and (k.tag not in INLINE or id(k) in facts.blocks)]
        slot.kids = [Slot(label, members) for label, members in groups(inner)]
        todo.extend(slot.kids)
    return root


Sizes = dict[tuple[int, int], int]
Pairs = list[tuple[int, int]]


def _run(job: Generator[tuple[Slot, Slot], None, Pairs | None], sizes: Sizes) -> Pairs | None:
    """A job that asks for sizes of matches, and they for others: a stack of its own, as trees may be of any depth."""
    stack, result = [job], None
    while stack:
        try:
            stack.append(_sizing(*next(stack[-1]), sizes))
        except StopIteration as end:
            stack.pop()
            result = end.value
    return result


def _sizing(a: Slot, b: Slot, sizes: Sizes) -> Generator[tuple[Slot, Slot], None, None]:
    """Nodes of the largest match of the two trees, their roots included."""
    pairs = yield from _aligned(a.kids, b.kids, sizes)
    sizes[id(a), id(b)] = 1 + sum(sizes[id(a.kids[i]), id(b.kids[j])] for i, j in pairs)


def _aligned(left: list[Slot], right: list[Slot], sizes: Sizes) -> Generator[tuple[Slot, Slot], None, Pairs]:
    """The match of two lists of siblings of any length, each place at most once and in order."""
    if len(left) <= ALIGNED and len(right) <= ALIGNED:
        return (yield from _window(left, right, sizes))
    pairs: Pairs = []
    for i, i_end, j, j_end in _between(left, right):
        while i < i_end and j < j_end:
            part = yield from _window(left[i:min(i + ALIGNED, i_end)], right[j:min(j + ALIGNED, j_end)], sizes)
            if i + ALIGNED >= i_end and j + ALIGNED >= j_end:
                pairs.extend((i + a, j + b) for a, b in part)
                break
            # Pairs near the window's end may change with what follows.
            sure = [(i + a, j + b) for a, b in part if max(a, b) < ALIGNED // 2]
            pairs.extend(sure)
            if sure:
                i, j = sure[-1][0] + 1, sure[-1][1] + 1
            elif part:
                i, j = i + part[0][0], j + part[0][1]
            else:
                i, j = i + ALIGNED // 2, j + ALIGNED // 2
    return pairs


def _between(left: list[Slot], right: list[Slot]) -> Iterator[tuple[int, int, int, int]]:
    """Parts of both lists that belong together: labels that both have once, as many as are in one order, and what is between."""
    times = Counter(s.label for s in left), Counter(s.label for s in right)
    there = {s.label: j for j, s in enumerate(right) if times[1][s.label] == 1}
    alone = [(i, there[s.label]) for i, s in enumerate(left) if times[0][s.label] == 1 and s.label in there]
    ends: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(alone):
        at = bisect_left(ends, j)
        before.append(last[at - 1] if at else -1)
        ends[at:at + 1], last[at:at + 1] = [j], [n]
    chain, n = [], last[-1] if last else -1
    while n >= 0:
        chain.append(alone[n])
        n = before[n]
    i = j = 0
    for a, b in reversed(chain):
        yield i, a, j, b
        yield a, a + 1, b, b + 1
        i, j = a + 1, b + 1
    yield i, len(left), j, len(right)


def _window(left: list[Slot], right: list[Slot], sizes: Sizes) -> Generator[tuple[Slot, Slot], None, Pairs]:
    """Simple tree matching of two lists of siblings: pairs of places, in order on both sides, with the most nodes matched; of
    equal matches the one with more equal texts."""
    n, m = len(left), len(right)
    best = [[0] * (m + 1)]
    worth: Sizes = {}
    for i, a in enumerate(left):
        above, row = best[-1], [0] * (m + 1)
        best.append(row)
        for j, b in enumerate(right):
            most = above[j + 1] if above[j + 1] > row[j] else row[j]
            if a.label == b.label:
                if (id(a), id(b)) not in sizes:
                    yield a, b
                few, many = (a.texts, b.texts) if len(a.texts) < len(b.texts) else (b.texts, a.texts)
                worth[i, j] = 2 * sizes[id(a), id(b)] + any(t in many for t in few)
                most = max(most, above[j] + worth[i, j])
            row[j + 1] = most
    pairs, i, j = [], n, m
    while i and j:
        if (i - 1, j - 1) in worth and best[i][j] == best[i - 1][j - 1] + worth[i - 1, j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def match(slots: list[Slot], found: list[tuple[str, list[Node]]]) -> Pairs:
    """Places of slots and of groups of nodes that match."""
    page = Node("html")
    page.parts = [n for _, members in found for n in members]
    facts = Facts(page)
    return _matched(slots, page_slots(page, facts).kids)


def _matched(left: list[Slot], right: list[Slot], sizes: Sizes | None = None) -> Pairs:
    sizes = {} if sizes is None else sizes
    return _run(_aligned(left, right, sizes), sizes) or []


def merge(into: Slot, other: Slot) -> None:
    """Add a page or another wrapper; slots without a match become new ones at their place."""
    sizes: Sizes = {}
    todo = [(into, other)]
    while todo:
        a, b = todo.pop()
        a.add(b)
        if not a.kids or not b.kids:
            a.kids = a.kids or b.kids
            continue
        partner = {j: i for i, j in _matched(a.kids, b.kids, sizes)}
        kids, done = [], 0
        for j, kid in enumerate(b.kids):
            if j in partner:
                kids.extend(a.kids[done:partner[j] + 1])
                done = partner[j] + 1
                todo.append((a.kids[partner[j]], kid))
            else:
                kids.append(kid)
        a.kids = kids + a.kids[done:]


def in_order(root: Slot) -> Iterator[Slot]:
    todo = [root]
    while todo:
        slot = todo.pop()
        yield slot
        todo.extend(reversed(slot.kids))


def induce(pages: list[str]) -> Slot:
    root, seen = Slot("html"), set()
    for page in pages:
        tree = parse(page)
        facts = Facts(tree)
        if facts.key not in seen:
            seen.add(facts.key)
            merge(root, page_slots(tree, facts))
    decide(root)
    return root


def decide(root: Slot) -> None:
    todo = [(root, False)]
    while todo:
        slot, inside = todo.pop()
        inside = inside or slot.tag in ARTICLE
        slot.decide(inside)
        todo.extend((k, inside) for k in slot.kids)


def flat(root: Slot) -> bytes:
    """A part of a wrapper as bytes, to be merged with others."""
    rows = [[s.label, s.pages, s.members, s.chars, s.links, s.lost, len(s.kids), *(x for t in s.texts.items() for x in t)]
            for s in in_order(root)]
    return zlib.compress(json.dumps(rows, separators=(",", ":")).encode(), 1)


def from_flat(data: bytes) -> Slot:
    def slot(row: list) -> Slot:
        made = Slot(row[0])
        made.pages, made.members, made.chars, made.links, made.lost = row[1:6]
        made.texts = dict(zip(row[7::2], row[8::2], strict=True))
        return made

    return _tree((slot(row), row[6]) for row in json.loads(zlib.decompress(data)))


def _tree(slots: Iterator[tuple[Slot, int]]) -> Slot:
    """Slots in page order, each with the count of its children, as a tree."""
    root, open_slots = None, []
    for slot, kids in slots:
        root = root or slot
        if open_slots:
            open_slots[-1][0].kids.append(slot)
            open_slots[-1][1] -= 1
        open_slots.append([slot, kids])
        while open_slots and not open_slots[-1][1]:
            open_slots.pop()
    return root


def packed(root: Slot) -> str:
    """What pages are told apart by. Slots of few pages are left out: elements without a slot are judged by their own links."""
    decide(root)
    for slot in in_order(root):
        slot.kids = [k for k in slot.kids if k.pages >= LEAST_PAGES]
    return json.dumps([[s.label, int(s.linked), len(s.kids), *sorted(s.constant)] for s in in_order(root)], separators=(",", ":"))


def unpacked(data: str) -> Slot:
    def slot(row: list) -> Slot:
        made = Slot(row[0])
        made.linked, made.constant = bool(row[1]), frozenset(row[3:])
        return made

    return _tree((slot(row), row[2]) for row in json.loads(data))


def partners(page: Slot, wrapper: Slot) -> dict[int, Slot]:
    """The wrapper's slot of each of the page's elements that has one."""
    found: dict[int, Slot] = {}
    sizes: Sizes = {}
    todo = [(wrapper, page)]
    while todo:
        slot, here = todo.pop()
        found.update((id(n), slot) for n in here.nodes)
        if slot.kids and here.kids:
            todo.extend((slot.kids[i], here.kids[j]) for i, j in _matched(slot.kids, here.kids, sizes))
    return found


def extract(page: str | None, wrapper: Slot | None) -> str:
    """The blocks of the page that the wrapper calls content, joined by an empty line. Without a wrapper names and kinds decide."""
    if not page:
        return ""
    tree = parse(page)
    facts = Facts(tree)
    slots = partners(page_slots(tree, facts), wrapper) if wrapper else {}
    blocks: list[str] = []
    held: list[str] = []

    def close() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            blocks.append(text)

    def linked(node: Node) -> bool:
        return 2 * facts.links[id(node)] > facts.chars[id(node)]

    def constant(node: Node) -> bool:
        return id(node) in slots and facts.hash[id(node)] in slots[id(node)].constant

    def template(node: Node) -> bool:
        if node.tag in INLINE or node.tag in ("html", "body") or wrapper is None:
            return False
        return constant(node) or (slots[id(node)].linked if id(node) in slots else linked(node))

    def repeated() -> set[int]:
        """Elements inside the article with a text that other articles have there too; none if they are most of it, as then the
        article is a copy with changes."""
        found, whole, part = set(), 0, 0
        todo = [(tree, False)]
        while todo:
            node, inside = todo.pop()
            if node.tag in ARTICLE and not inside:
                inside, whole = True, whole + facts.chars[id(node)]
            elif inside and node.tag not in INLINE and constant(node):
                found.add(id(node))
                part += facts.chars[id(node)]
                continue
            todo.extend((n, inside) for n in _inner(node))
        return found if part <= MOST_REPEATED * whole else set()

    def dropped(node: Node, own: bool, whole: int) -> bool:
        """By kind, name, or a hint that is confirmed; never what holds the article or most of the ``whole`` text."""
        if node.tag in DROPPED and node.tag not in AROUND:
            return True
        if id(node) in facts.holding:
            return False
        if node.tag == "header" and not own:
            return True
        if 2 * facts.chars[id(node)] <= whole and (node.tag in AROUND or named(node)):
            return True
        return hinted(node) and (linked(node) or constant(node))

    again = repeated() if wrapper and facts.article else set()
    # Texts and elements still to come, and for each: if it is out, if it is in the article, the characters around it.
    todo: list[tuple[Node | str | None, bool, bool, int]] = [(tree, False, False, facts.chars[id(tree)])]
    while todo:
        part, out, own, whole = todo.pop()
        if part is None:
            close()
        elif isinstance(part, str):
            if not out:
                held.append(part)
        elif part.tag == "br":
            held.append(" ")
        elif dropped(part, own, whole):
            if part.tag not in INLINE:
                close()
        else:
            if part.tag in ARTICLE and not own:
                own, out, whole = True, False, facts.chars[id(part)]
            elif own:
                out = out or id(part) in again
            else:
                out = out or facts.article or template(part)
            if part.tag not in INLINE:
                close()
                todo.append((None, out, own, whole))
            todo.extend((p, out, own, whole) for p in reversed(part.parts))
    close()
    return "\n\n".join(blocks)


def host_of(url: str) -> Column:
    """The host of an address, in lower case and without a port; NULL if there is none."""
    found = F.lower(F.regexp_extract(F.col(url), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, trees = [], []
        for page in batch.column("html").to_pylist():
            tree = parse(page)
            facts = Facts(tree)
            keys.append(facts.key)
            trees.append(flat(page_slots(tree, facts)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), pa.array(keys, pa.int64()), pa.array(trees, pa.binary())], ["host", "key", "part"])


def merged(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """One wrapper for rows that follow each other with one host and salt; of those with one key the first."""
    group, last, root = None, None, Slot("html")

    def made() -> pa.RecordBatch:
        if whole:
            return pa.RecordBatch.from_arrays([pa.array([group[0]]), pa.array([packed(root)])], ["__host", "__wrapper"])
        return pa.RecordBatch.from_arrays(
            [pa.array([group[0]]), pa.array([group[1]], pa.int64()), pa.array([flat(root)], pa.binary())], ["host", "key", "part"])

    for batch in batches:
        for row in batch.to_pylist():
            here = row["host"], row["salt"]
            if here != group:
                if group:
                    yield made()
                group, last, root = here, None, Slot("html")
            if row["key"] != last:
                last = row["key"]
                merge(root, from_flat(row["part"]))
    if group:
        yield made()


def wrappers_of(some: DataFrame) -> DataFrame:
    """__host, __wrapper of pages with ``host`` and ``html``.

    The trees of a host are merged in parts, and the parts in rounds of ``PARTS`` at a time. A host has ``PARTS`` parts at first, or as many
    as make each ``PAGES`` pages.
    """
    large = written(
        some.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / F.lit(PARTS * PAGES)).alias("times")).filter("times > 1"), "large-hosts")
    most = large.agg(F.max("times")).first()[0] or 1
    found = some.mapInArrow(sketches, "host string, key long, part binary")
    if most > 1:
        found = found.join(large, "host", "left").withColumn("parts", F.coalesce("times", F.lit(1)) * PARTS)
        salted = found.withColumn("salt", F.pmod("key", "parts")).select("host", "key", "part", "salt")
    else:
        salted = found.withColumn("salt", F.pmod("key", F.lit(PARTS)).cast("long"))

    def round_of(rows: DataFrame) -> DataFrame:
        return rows.repartition("host", "salt").sortWithinPartitions("host", "salt", "key", "part").mapInArrow(
            lambda b: merged(b, False), "host string, key long, part binary")

    parts, left = round_of(salted), most * PARTS
    while left > PARTS:
        parts = round_of(parts.withColumn("salt", F.expr(f"key div {PARTS}")))
        left = -(-left // PARTS)
    return (
        parts.withColumn("salt", F.lit(0).cast("long")).repartition("host").sortWithinPartitions("host", "key")
        .mapInArrow(lambda b: merged(b, True), "__host string, __wrapper string")
    )


def main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url",
              html_column: str = "html", name: str = "text") -> DataFrame:
    """All columns and ``text`` (replaces a given one): the page's main text.

    Blocks in page order, joined by two line ends; character references decoded, white space inside a block one space. A NULL or empty
    page, or one without content, has an empty text. Pages without a host have no wrapper: their own names and kinds of
    elements decide. Repeated rows are pages like others; an empty table gives an empty one.
    """
    spark = pages.sparkSession
    ready(spark)
    own = [c for c in pages.columns if c not in (name, "__host", "__wrapper")]
    placed = pages.select(*own, host_of(url_column).alias("__host"))
    some = placed.filter(F.col("__host").isNotNull() & F.col(html_column).isNotNull())
    wrappers = written(wrappers_of(some.select(F.col("__host").alias("host"), F.col(html_column).cast("string").alias("html"))), "wrappers")
    total = wrappers.agg(F.sum(F.octet_length("__wrapper") + 64)).first()[0] or 0
    joined = placed.join(F.broadcast(wrappers) if total <= BROADCAST_BYTES else wrappers, "__host", "left")
    at = own.index(html_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Slot | None] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column(at).to_pylist(), batch.column(len(own)).to_pylist(), strict=True):
                if wrapper not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[wrapper] = unpacked(wrapper) if wrapper else None
                texts.append(extract(page, known[wrapper]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*own, name])

    return joined.select(*own, "__wrapper").mapInArrow(run, StructType([*pages.select(*own).schema.fields, StructField(name, StringType())]))
