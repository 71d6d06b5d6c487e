"""HTML extraction with inferred wrappers: union-free regular expressions over same-host pages.

A page is a tree of block elements.  A wrapper is such a tree with multiplicities:
a node can be optional or repeated, sequences of siblings that recur become a
repeated group, and text is a constant while all pages agree on it, else a slot.
Two wrappers are aligned node by node; what one of them lacks becomes optional.
Alignment is what folds a page into a wrapper and also what merges wrappers, so
every page of a host takes part: tasks infer partial wrappers, which are merged
in two shuffles (salted, then by host), each page's text being reduced to the
hash of its slots by then.

The wrapper tells where the article is on a host's pages and which blocks are
its template: an element whose whole text is the same on several different pages
holds no article, whatever its name or class, and constants at their aligned
place are dropped inside an article too.  A place whose text is links on all pages
taken together is a menu where the host names no article, and so is a place of
short, linked articles beside longer ones (teasers).  Other text that varies is never
dropped for being optional or in a repeated group, as paragraphs are both.  Names and
classes choose between the elements that are left, and alone on hosts with few pages.
Each page is then read whole against its host's wrapper.

A sequence of siblings that stays too irregular for groups and options is summarised
as (a? b? ...)+, which keeps names but not places; no text is lost by it.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, release, row_groups, sized, slices, stored

# Element names of HTML by their role here.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label map mark meter nobr output picture progress q ruby rb rp rt s samp small source span strike strong sub sup time track tt u var wbr math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msup msub msubsup mover munder munderover mfenced semantics".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe noframes noembed xmp textarea title svg object".split())
DROPPED = RAW | set("head nav footer aside form button select menu dialog canvas audio video map fieldset".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An opening tag that ends an open one of these, up to the given container.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of class, id and role attributes that tell an element's part.
NOISE_WORDS = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login paywall sidebar aside widget widgets related recommended recommendations share sharing social comment comments disqus respond reply replies menu menubar nav navbar navigation breadcrumb breadcrumbs pager pagination toolbar footer masthead skip hidden".split())
MAIN_WORDS = set("article content post entry story main maincontent".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: A slot's state: nothing, a constant (hash and length), or text that varies.
VARIES = -1
#: Children of a wrapper node that are kept in order; beyond, they become one repeated group of optional nodes.
WIDEST = 64
#: Siblings of a repeated group.
LONGEST_GROUP = 8
#: Different pages that have to agree before text counts as their template.
DIFFERENT = 5
#: Levels of nesting that a path shows in full.
DEEPEST = 120
#: Share of a place's text in links from which it is a menu, and from which short articles are teasers.
MENU, TEASER = 0.8, 0.3
#: So many times shorter than the host's longest articles are teasers.
SHORTER = 4


def part_of(tag: str, attributes: str) -> str:
    """An element's key: its name, with the words among its class, id and role that matter."""
    if not attributes or not ("class" in attributes or "id" in attributes or "role" in attributes):
        return tag
    words: set[str] = set()
    for name, *values in ATTRIBUTE.findall(attributes):
        name = name.lower()
        value = "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            words.add("hidden")
        else:
            words.update(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()))
    kept = sorted(words & (NOISE_WORDS | MAIN_WORDS))
    return ".".join([tag, *kept])


@lru_cache(maxsize=10_000)
def noisy(key: str) -> bool:
    """Whether an element is no part of an article wherever it stands."""
    tag, *words = key.split(".")
    return tag in DROPPED or (tag not in ("article", "main", "body", "html") and any(w in NOISE_WORDS for w in words)) or (tag == "article" and bool({"comment", "comments", "reply"} & set(words)))


class Node:
    __slots__ = ("key", "children", "text", "optional", "repeated", "pages", "seen", "whole", "chars", "links")

    def __init__(self, key: str):
        self.key, self.children, self.text = key, [], None
        self.optional, self.repeated, self.pages = False, False, 1
        self.seen: tuple[int, ...] = ()  # up to DIFFERENT of the different pages that hold the constant text
        #: Of an element that can hold an article: hash of all its text and up to DIFFERENT pages, while all pages agree; then VARIES.
        self.whole: tuple[int, tuple[int, ...]] | int | None = None
        self.chars = self.links = 0  # code points of its own text on all pages, and of those the ones in links

    def to(self) -> list:
        return [self.key, self.text, int(self.optional) + 2 * int(self.repeated), self.pages, [c.to() for c in self.children], self.seen, self.whole, self.chars, self.links]

    @staticmethod
    def of(x: list) -> Node:
        n = Node(x[0])
        n.text, n.optional, n.repeated, n.pages = tuple(x[1]) if isinstance(x[1], list) else x[1], bool(x[2] & 1), bool(x[2] & 2), x[3]
        n.children = [Node.of(c) for c in x[4]]
        n.seen = tuple(x[5])
        n.whole = (x[6][0], tuple(x[6][1])) if isinstance(x[6], (list, tuple)) else x[6]
        n.chars, n.links = x[7:9]
        return n


def walk(source: str) -> Iterator[tuple[str, str | tuple[str, ...]]]:
    """('open', path), ('close', path), ('break', path), ('text', raw) and ('link', 'open' or 'close'): block structure with the path of open elements; implied ends are closed.

    Elements nested deeper than DEEPEST show in the path only if they have a part to play."""
    stack: list[str] = []
    keys: list[str] = []
    shown: list[bool] = []

    def push(tag: str, key: str) -> bool:
        stack.append(tag)
        shown.append(len(keys) < DEEPEST or noisy(key) or holds_article(key, "any"))
        if shown[-1]:
            keys.append(key)
        return shown[-1]

    def pop() -> str:
        if shown.pop():
            keys.pop()
        return stack.pop()

    def closing_event() -> tuple[str, tuple[str, ...]]:
        return "close" if shown[-1] else "break", tuple(keys)

    at, n = 0, len(source)
    lowered = None
    while at < n:
        m = TOKEN.search(source, at)
        if m is None:
            yield "text", source[at:]
            break
        if m.start() > at:
            yield "text", source[at : m.start()]
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag == "br" or tag == "hr" and not closing:
            yield ("text", " ") if tag == "br" else ("break", tuple(keys))
            continue
        if not closing and tag in RAW:
            if m[3].endswith("/"):
                continue
            lowered = source.lower() if lowered is None else lowered
            # lower() can change lengths of a few letters; then the tag is looked for with a pattern
            if len(lowered) == n:
                end = lowered.find(f"</{tag}", at)
            else:
                found = re.compile(f"</{tag}", re.I).search(source, at)
                end = found.start() if found else -1
            if end < 0:
                break
            close = source.find(">", end)
            at = n if close < 0 else close + 1
            continue
        if tag in VOID:
            continue
        if tag in INLINE:
            if tag == "a":
                yield "link", "close" if closing else "open"
            if closing:
                if tag in stack:
                    below = len(stack) - 1 - stack[::-1].index(tag)
                    if all(t in INLINE for t in stack[below:]):
                        while len(stack) > below:
                            pop()
                continue
            key = part_of(tag, m[3])
            if noisy(key) and not m[3].endswith("/"):
                push(tag, key)
            continue
        if closing:
            if tag in stack:
                while True:
                    yield closing_event()
                    if pop() == tag:
                        break
            continue
        if tag in CLOSES_P and "p" in stack:
            below = len(stack) - 1 - stack[::-1].index("p")
            if not any(t in ("table", "td", "th", "button") for t in stack[below:]):
                while len(stack) > below:
                    yield closing_event()
                    pop()
        if tag in SIBLINGS:
            ends, within = SIBLINGS[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] in within:
                    break
                if stack[i] in ends:
                    while len(stack) > i:
                        yield closing_event()
                        pop()
                    break
        yield "open" if push(tag, part_of(tag, m[3])) else "break", tuple(keys)


def squeezed(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def blocks(source: str) -> Iterator[tuple[tuple[str, ...], str]]:
    """The text blocks of a page in order, each with the path of its element."""
    held: list[str] = []
    path: tuple[str, ...] = ()
    for kind, what in walk(source):
        if kind == "link":
            continue
        if kind == "text":
            held.append(what)
            continue
        if held and (text := squeezed(held)):
            yield (what[:-1] if kind == "open" else what), text
        held = []
        path = what[:-1] if kind == "close" else what
    if held and (text := squeezed(held)):
        yield path, text


def outline(source: str) -> tuple[Node, list[Node | None], int]:
    """(a page's elements as they stand, the element of each of its :func:`blocks`, what tells different pages apart: the text outside noise)."""
    from xxhash import xxh3_64, xxh3_64_intdigest

    root = Node("")
    open_nodes = [root]
    owners: list[Node | None] = []
    held: list[str] = []
    whole = xxh3_64()
    holders: list[tuple[Node, object]] = []
    path: tuple[str, ...] = ()
    linked, link = 0, -1  # code points of links since the last block, and the depth at which a link is open

    def open_holders() -> list[tuple[Node, object]]:
        while holders and not any(holders[-1][0] is x for x in open_nodes):
            ended(*holders.pop())
        return holders

    def ended(node: Node, own) -> None:
        node.whole = (own.intdigest() >> 1, ())

    def flush(path: tuple[str, ...]) -> None:
        nonlocal linked, link
        if held and (text := squeezed(held)):
            del open_nodes[len(path) + 1 :]  # inline elements that have ended
            # text in an inline element has no node: such elements are noise
            node = open_nodes[-1] if len(open_nodes) == len(path) + 1 else None
            owners.append(node)
            if not any(noisy(k) for k in path):
                whole.update(text + "\n")
                for _, own in open_holders():
                    own.update(text + "\n")
            if node is not None:
                slot = (xxh3_64_intdigest(text) >> 1, len(text))
                node.text = slot if node.text is None else (xxh3_64_intdigest(f"{node.text}{slot}") >> 1, node.text[1] + slot[1])
                node.chars += len(text)
                node.links += min(len(text), linked)
        held.clear()
        linked = 0
        if len(path) < link:  # a link that was never closed ends with its element
            link = -1

    for kind, what in walk(source):
        if kind == "link":
            link = len(path) if what == "open" else -1
            continue
        if kind == "text":
            held.append(what)
            linked += len(what.strip()) if link >= 0 else 0
            continue
        flush(what[:-1] if kind == "open" else what)
        path = what[:-1] if kind == "close" else what
        if kind == "open":
            del open_nodes[len(what) :]  # inline elements that a block closes
            for key in what[len(open_nodes) - 1 :]:
                node = Node(key)
                open_holders()
                open_nodes[-1].children.append(node)
                open_nodes.append(node)
                if holds_article(key, "any"):
                    holders.append((node, xxh3_64()))
        elif kind == "close":
            del open_nodes[max(1, len(what)) :]
    flush(path)
    for holder in holders:
        ended(*holder)
    return root, owners, whole.intdigest() >> 1


def tree(source: str) -> Node:
    """A page as a wrapper of one page."""
    root, owners, page = outline(source)
    for node in owners:
        if node is not None:
            node.seen = (page,)
    return folded(root, page)


def folded(node: Node, page: int) -> Node:
    """Fold recurring siblings of a fresh tree into repeated nodes and groups, bottom up; mark what holds an article with the page."""
    if node.whole is not None:
        node.whole = (node.whole[0], (page,))
    node.children = fold([folded(c, page) for c in node.children])
    return node


def alike(a: Node, b: Node) -> bool:
    """Whether two siblings can be one repeated element: boxes only if half of what they hold is the same."""
    if a.key != b.key or a.key not in ("div", "section"):
        return a.key == b.key
    x, y = ({g.key for c in n.children for g in (c.children if c.key.startswith("(") else [c])} for n in (a, b))
    return 2 * len(x & y) >= len(x | y)


def fold(children: list[Node]) -> list[Node]:
    for length in range(1, LONGEST_GROUP + 1):
        out: list[Node] = []
        i = 0
        while i < len(children):
            some = children[i : i + length]
            names = [c.key for c in some]
            j = i + length
            runs = [some]
            while len(some) == length == len(children[j : j + length]) and all(map(alike, some, children[j : j + length])):
                runs.append(children[j : j + length])
                j += length
            if len(runs) == 1 or (length > 1 and len(set(names)) == 1):
                out.append(children[i])
                i += 1
                continue
            if length == 1:
                one = runs[0][0]
                for other in runs[1:]:
                    merge(one, other[0], within=True)
            else:
                one = Node(f"({'|'.join(names)})")
                one.children = runs[0]
                for other in runs[1:]:
                    for a, b in zip(one.children, other, strict=True):
                        merge(a, b, within=True)
            one.repeated = True
            out.append(one)
            i = j
        children = out
    return children


def grouped(children: list[Node], groups: list[Node]) -> list[Node]:
    """Write single occurrences of known groups as groups."""
    for g in groups:
        names = [c.key for c in g.children]
        out, i = [], 0
        while i < len(children):
            if len(names) and [c.key for c in children[i : i + len(names)]] == names:
                one = Node(g.key)
                one.children = children[i : i + len(names)]
                out.append(one)
                i += len(names)
            else:
                out.append(children[i])
                i += 1
        children = out
    return children


def merge(a: Node, b: Node, within: bool = False) -> None:
    """Align ``b`` into ``a`` (equal keys).  within: both stand on the same page."""
    a.optional |= b.optional
    a.repeated |= b.repeated
    a.chars += b.chars
    a.links += b.links
    if not within:
        a.pages += b.pages
    if a.text != b.text:
        a.text = VARIES if a.text is not None and b.text is not None or VARIES in (a.text, b.text) else (a.text if a.text is not None else b.text)
    a.seen = () if a.text == VARIES else tuple(sorted({*a.seen, *b.seen})[:DIFFERENT])
    if a.whole is None or b.whole is None:
        a.whole = b.whole if a.whole is None else a.whole
    elif VARIES in (a.whole, b.whole) or a.whole[0] != b.whole[0]:
        a.whole = VARIES
    else:
        a.whole = (a.whole[0], tuple(sorted({*a.whole[1], *b.whole[1]})[:DIFFERENT]))
    x, y = a.children, b.children
    if [c.key for c in x] != [c.key for c in y]:
        x = grouped(x, [c for c in y if c.key.startswith("(")])
        y = grouped(y, [c for c in x if c.key.startswith("(")])
    a.children = aligned(x, y, within)


def aligned(x: list[Node], y: list[Node], within: bool) -> list[Node]:
    n, m = len(x), len(y)
    start = 0
    out = []
    while start < min(n, m) and x[start].key == y[start].key:
        merge(x[start], y[start], within)
        out.append(x[start])
        start += 1
    end = 0
    while end < min(n, m) - start and x[n - 1 - end].key == y[m - 1 - end].key:
        end += 1
    tail = []
    for i in range(end):
        merge(x[n - end + i], y[m - end + i], within)
        tail.append(x[n - end + i])
    p, q = x[start : n - end], y[start : m - end]
    # longest common subsequence of what is left
    best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i in range(len(p) - 1, -1, -1):
        for j in range(len(q) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if p[i].key == q[j].key else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < len(p) or j < len(q):
        if i < len(p) and j < len(q) and p[i].key == q[j].key:
            merge(p[i], q[j], within)
            out.append(p[i])
            i, j = i + 1, j + 1
        elif j == len(q) or i < len(p) and best[i + 1][j] >= best[i][j + 1]:
            p[i].optional = True
            out.append(p[i])
            i += 1
        else:
            q[j].optional = True
            out.append(q[j])
            j += 1
    return bounded(fold(out + tail))


def bounded(children: list[Node]) -> list[Node]:
    """At most WIDEST children: more become (a? b? ...)+, still without a union."""
    if len(children) <= WIDEST:
        return children
    by_key: dict[str, Node] = {}
    flat = [g for c in children for g in (c.children if c.key.startswith("(") else [c])]
    for c in flat:
        if c.key in by_key:
            merge(by_key[c.key], c, within=True)
        else:
            by_key[c.key] = c
    one = Node("(*)")
    one.children = [by_key[k] for k in sorted(by_key)]
    for c in one.children:
        c.optional = True
    one.repeated = True
    return [one]


def pattern(node: Node) -> str:
    """The wrapper as a regular expression, for reading: <tag>, #text, (...)?, (...)+."""
    inner = "#" if node.text == VARIES else "" if node.text is None else "text"
    inner += "".join(pattern(c) for c in node.children)
    body = inner if not node.key or node.key.startswith("(") else f"<{node.key}>{inner}</>"
    mark = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[node.optional, node.repeated]
    return f"({body}){mark}" if mark else body


def fixed_whole(node: Node) -> bool:
    """Whether an element that could hold an article has the same text on DIFFERENT pages, and so holds none."""
    return isinstance(node.whole, tuple) and len(node.whole[1]) >= DIFFERENT


def roles(node: Node) -> dict:
    """What extraction needs of a wrapper: the kind of element that holds the article, and the template, as what :func:`skeleton` leaves of the wrapper.

    The kind is the first of article, main and words whose text varies between the host's
    pages (or whose pages are too few to tell); ``body`` if there are such elements, but all are template.
    Menus are part of the template."""
    found: set[str] = set()
    fixed = False

    def visit(x: Node, noise: bool) -> None:
        nonlocal fixed
        tag, *words = x.key.split(".") if x.key and not x.key.startswith("(") else [""]
        noise = noise or bool(tag) and noisy(x.key)
        if not noise and tag and fixed_whole(x):
            fixed = True
        elif not noise and tag:
            if tag in ("article", "main"):
                found.add(tag)
            elif MAIN_WORDS & set(words):
                found.add("words")
        for c in x.children:
            visit(c, noise)

    visit(node, False)
    main = next((k for k in ("article", "main", "words") if k in found), "body" if fixed else "")
    if node.pages < DIFFERENT:
        menus: dict[int, float] = {}
    elif main in ("", "body"):
        menus = dict.fromkeys(linked_places(node), MENU)
    else:
        menus = dict.fromkeys(teasers(node, main), TEASER)
    return {"main": main, "template": skeleton(node, menus)}


def amounts(node: Node) -> tuple[int, int]:
    """(code points, code points in links) of an element's whole text outside noise; a title's link is none."""
    if node.key and not node.key.startswith("(") and noisy(node.key):
        return 0, 0
    inner = [amounts(c) for c in node.children]
    title = node.key.split(".")[0] == "h1"
    return node.chars + sum(c for c, _ in inner), 0 if title else node.links + sum(n for _, n in inner)


def links_of(node: Node) -> float:
    chars, links = amounts(node)
    return links / chars if chars else 0.0


def linked_places(node: Node) -> set[int]:
    """ids of the outermost elements whose text is links."""
    out: set[int] = set()
    todo = list(node.children)
    while todo:
        x = todo.pop()
        chars, links = amounts(x)
        if chars and links >= MENU * chars and x.key.split(".")[0] not in ("body", "html"):
            out.add(id(x))
        else:
            todo.extend(x.children)
    return out


def teasers(node: Node, main: str) -> set[int]:
    """ids of the article elements that are short and linked beside the host's longer ones."""
    found: list[tuple[Node, int, int]] = []
    todo = list(node.children)
    while todo:
        x = todo.pop()
        if x.key.startswith("(") or not noisy(x.key) and not holds_article(x.key, main):
            todo.extend(x.children)
        elif not noisy(x.key):
            found.append((x, *amounts(x)))
    most = max((chars for _, chars, _ in found), default=0)
    return {id(x) for x, chars, links in found if chars * SHORTER < most and links >= TEASER * chars > 0}


def skeleton(node: Node, menus: dict[int, float]) -> list | None:
    """[key, constant or none, whether it recurs, children, constant of all its text or none, share of links from which it is a menu or 0] of the nodes around template text, None if there is none.

    Template is the same text at the same place of DIFFERENT pages, in an element of its own, and what
    ``menus`` has.  Siblings without any stay, as they tell the place of the others."""
    bare = not node.key or node.key.startswith("(")
    if not bare and noisy(node.key):
        return None
    fixed = not bare and isinstance(node.text, tuple) and len(node.seen) >= DIFFERENT and node.key.split(".")[0] not in ("h1", "p", "article", "main")
    if id(node) in menus:
        least = menus[id(node)]
        return [node.key, None, node.repeated, [[c.key, None, False, [], None, least] for c in node.children] if node.key.startswith("(") else [], None, least]
    if not bare and fixed_whole(node):
        return [node.key, None, node.repeated, [], node.whole[0], 0]
    inner = [skeleton(c, menus) for c in node.children]
    if not fixed and not any(inner):
        return None
    children = [k or [c.key, None, c.repeated, [[g.key, None, False, [], None, 0] for g in c.children] if c.key.startswith("(") else [], None, 0] for k, c in zip(inner, node.children, strict=True)] if any(inner) else []
    return [node.key, node.text[0] if fixed else None, node.repeated, children, None, 0]


def placed(children: list[Node], bones: list[list]) -> Iterator[tuple[Node, list]]:
    """Elements of a page with the skeleton's node at their place: the longest alignment of siblings, equal constants deciding between equally long ones."""

    def member(c: Node, bone: list) -> tuple[int, list | None]:
        some = [b for b in (bone[3] if bone[0].startswith("(") else [bone]) if b[0] == c.key]
        same = next((b for b in some if b[1] is not None and c.text is not None and b[1] == c.text[0] or b[4] is not None and c.whole is not None and b[4] == c.whole[0]), None)
        return (1_000_001, same) if same else (1_000_000, some[0]) if some else (0, None)

    n, m = len(children), len(bones)
    match = [[member(c, b) for b in bones] for c in children]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            worth = match[i][j][0]
            best[i][j] = max(best[i + 1][j], best[i][j + 1], worth + best[i + 1][j if bones[j][2] else j + 1] if worth else 0)
    i = j = 0
    while i < n and j < m:
        worth, bone = match[i][j]
        then = j if bones[j][2] else j + 1
        if worth and best[i][j] == worth + best[i + 1][then]:
            yield children[i], bone
            i, j = i + 1, then
        elif best[i][j] == best[i][j + 1]:
            j += 1
        else:
            i += 1


def template_nodes(root: Node, bones: list) -> set[int]:
    """ids of a page's elements whose text is the template's at their place."""
    out: set[int] = set()
    todo = [(root, bones)]
    while todo:
        node, bone = todo.pop()
        if bone[1] is not None and node.text is not None and node.text[0] == bone[1]:
            out.add(id(node))
        if bone[5] and links_of(node) >= bone[5] or bone[4] is not None and node.whole is not None and node.whole[0] == bone[4]:
            inner = [node]
            while inner:
                out.add(id(inner[-1]))
                inner.extend(inner.pop().children)
        if bone[3]:
            todo.extend(placed(node.children, bone[3]))
    return out


def holds_article(key: str, main: str) -> bool:
    tag, *words = key.split(".")
    if main == "any":
        return tag in ("article", "main") or bool(MAIN_WORDS & set(words))
    if main == "words":
        return bool(MAIN_WORDS & set(words))
    return tag == main


def article(source: str | None, known: dict) -> str:
    """The main text of a page: its blocks joined by line breaks."""
    if not source:
        return ""
    every = [(path, text, i) for i, (path, text) in enumerate(blocks(source)) if not any(noisy(k) for k in path)]
    main = known.get("main", "")
    if known.get("template"):
        root, owners, _ = outline(source)
        drop = template_nodes(root, known["template"])
        # a page that is nothing but template is read whole
        if kept := [b for b in every if id(owners[b[2]]) not in drop]:
            every = kept
        else:
            main = ""
    # the host's place of the article; a page without it is read by what it has itself
    for kind in dict.fromkeys([main, "article", "main", "words"]):
        if kind and (some := [b for b in every if kind != "body" and any(holds_article(k, kind) for k in b[0])]):
            # what heads an article belongs to it, what heads the page around it doesn't
            some = [b for b in some if not any(k.split(".")[0] == "header" and not any(p.split(".")[0] == "article" for p in b[0][:n]) for n, k in enumerate(b[0]))] or some
            break
    else:
        # a page header is no article; without an article's element the rest of the body is
        some = [b for b in every if not any(k.split(".")[0] == "header" for k in b[0])]
    return "\n".join(t for _, t, _ in some)


def inferrer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (host, salt, html) sorted by host, salt and page to one partial wrapper for each host and salt."""
    key, one = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"host": [key[0]], "salt": pa.array([key[1]], pa.int64()), "wrapper": [json.dumps(one.to())]})

    for batch in slices(batches, "html"):
        for host, salt, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (host, salt) != key:
                if one is not None:
                    yield out()
                key, one = (host, salt), None
            if one is None:
                one = tree(source)
            else:
                merge(one, tree(source))
    if one is not None:
        yield out()
    release()


def merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: partial wrappers sorted by host and salt to one for each host."""
    for table in row_groups(batches, ["host"]):
        one = None
        for text in table.column("wrapper"):
            other = Node.of(json.loads(text.as_py()))
            if one is None:
                one = other
            else:
                merge(one, other)
        yield pa.RecordBatch.from_pydict({"host": [table.column("host")[0].as_py()], "wrapper": [json.dumps(one.to())]})


def describer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = [Node.of(json.loads(x)) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_pydict({"host": batch.column(0), "pattern": [pattern(n) for n in nodes], "roles": [json.dumps(roles(n)) for n in nodes], "pages": pa.array([n.pages for n in nodes], pa.int64())})


def host_of(url):
    """The host of an address in lower case; what has none is the empty host."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html", salts: int = 64) -> DataFrame:
    """(host, pattern, roles, pages): the wrapper of every host, from all its pages.

    Alignment depends on the order of what is aligned, so the order is one of content: a
    page's digest gives its salt and its place, whatever the tables' rows, files and tasks."""
    html = F.col(f"`{html_col}`").cast("string")
    rows = pages.where(F.length(html) > 0).select(host_of(F.col(f"`{url_col}`")).alias("host"), F.pmod(F.xxhash64(html), F.lit(salts)).alias("salt"), html.alias("html"), F.md5(html.cast("binary")).alias("mark"))
    parts = rows.repartition("host", "salt").sortWithinPartitions("host", "salt", "mark").select("host", "salt", "html").mapInArrow(inferrer, "host string, salt long, wrapper string")
    whole = parts.repartition("host").sortWithinPartitions("host", "salt").mapInArrow(merger, "host string, wrapper string")
    return stored(whole.mapInArrow(describer, "host string, pattern string, roles string, pages long"), "wrappers")


def extractor(keep: list[str], html: str, role_col: str):
    """mapInArrow: the columns to keep, with the text of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, dict] = {None: {}}
        for batch in slices(batches, html):
            column = lambda c, batch=batch: batch.column(batch.schema.get_field_index(c))
            texts = []
            for source, role in zip(column(html).to_pylist(), column(role_col).to_pylist(), strict=True):
                if role not in known:
                    if len(known) > 10_000:
                        known = {None: {}}
                    known[role] = json.loads(role)
                texts.append(article(source, known[role]))
            yield pa.RecordBatch.from_pydict({c: column(c) for c in keep} | {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})
        release()

    return run


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` (columns ``keep``, by default all but the html) with ``text`` and ``n_chars``.

    Null or empty html: empty text.  A null address belongs to the empty host.  Pages
    cut off anywhere are read as far as they go, and long ones whole.  Repeated rows each
    get a row and count as one page of the wrapper's evidence; an empty table gives an
    empty table.  Columns text and n_chars give way.
    """
    keep = [c for c in (keep or [c for c in pages.columns if c != html_col]) if c not in ("text", "n_chars")]
    html, key, host, role = (fresh(keep, c) for c in ("__html", "__key", "__host", "__roles"))
    wrappers = infer(pages, url_col, html_col).select(F.col("host").alias(host), F.col("roles").alias(role))
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").cast("string").alias(html), host_of(F.col(f"`{url_col}`")).alias(key))
    rows = rows.join(sized(wrappers), F.col(key) == F.col(host), "left").drop(key, host)
    schema = rows.select(*[F.col(f"`{c}`") for c in keep]).schema.add("text", "string").add("n_chars", "long")
    return rows.mapInArrow(extractor(keep, html, role), schema)
