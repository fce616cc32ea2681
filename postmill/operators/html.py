"""A small reader of board pages: a tree from `html.parser`, and the few selectors that boards need.

A parsed page is indexed once: its elements are numbered in their order, and listed by name, class and id. A selector looks
only at the elements that its last step names, within the numbers of the element it starts from.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable
from functools import cache
from html import unescape
from html.parser import HTMLParser
from operator import attrgetter

# Fixed value: whitespace of ECMAScript.
WHITE = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# Elements without content, and elements that end an open one of the same kind.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
HOLDS = {"li": {"ul", "ol"}, "tr": {"table", "tbody", "thead"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "p": {"div", "td", "li", "article", "body"}, "option": {"select"}, "dt": {"dl"}, "dd": {"dl"}}


class Node:
    """An element: its name, attributes, classes, children (elements and texts), and the element around it.

    `order` is its number on the page, `end` the number behind all elements below it, `index` the page's lists.
    """

    __slots__ = ("attrs", "children", "classes", "end", "index", "name", "order", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []
        self.classes, self.order, self.end, self.index = frozenset(attrs["class"].split()) if "class" in attrs else frozenset(), -1, -1, None

    def text(self, without: str = "") -> str:
        """All text below, save that of elements which match `without`."""
        out, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            elif not (without and matches(c, without)):
                stack.extend(reversed(c.children))
        return "".join(out)

    def own_text(self) -> str:
        return "".join(c.strip(WHITE) for c in self.children if isinstance(c, str))


class _Tree:
    """A page's tree while it is built: `nodes` are its elements in order, behind the root."""

    def __init__(self):
        self.root = self.at = Node("", {}, None)
        self.nodes: list[Node] = []

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ENDS:
            node, ends, holds = self.at, ENDS[tag], HOLDS[tag]
            while node.parent and node.name not in holds:
                if node.name in ends:
                    self.at = node.parent
                    if tag != "tr" or node.name == "tr":
                        break
                node = node.parent
        # A row stands in a table's body, as browsers make it.
        if tag == "tr" and self.at.name == "table":
            self._add(Node("tbody", {}, self.at))
            self.at = self.nodes[-1]
        self._add(Node(tag, attrs, self.at))
        if tag not in VOID:
            self.at = self.nodes[-1]

    def _add(self, node: Node) -> None:
        self.at.children.append(node)
        self.nodes.append(node)

    def end(self, tag: str) -> None:
        node = self.at
        while node.parent and node.name != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def text(self, data: str) -> None:
        # One text however many pieces it comes in.
        held = self.at.children
        if held and isinstance(held[-1], str):
            held[-1] += data
        else:
            held.append(data)

    def indexed(self) -> Node:
        """The root; elements are numbered and listed."""
        index: dict[str, list[Node]] = defaultdict(list, {"": self.nodes})
        self.root.order, self.root.index = 0, index
        for order, node in enumerate(self.nodes, 1):
            node.order, node.index = order, index
            index[node.name].append(node)
            if node.attrs:
                for c in node.classes:
                    index[f".{c}"].append(node)
                if "id" in node.attrs:
                    index[f"#{node.attrs['id']}"].append(node)
        # From the last one on: an element's last child comes before all its others.
        for node in reversed(self.nodes):
            if node.end < 0:
                node.end = node.order + 1
            if node.parent.end < 0:
                node.parent.end = node.end
        self.root.end = len(self.nodes) + 1
        return self.root


class _Builder(HTMLParser):
    def __init__(self, tree: _Tree):
        super().__init__(convert_charrefs=True)
        self.tree = tree
        self.handle_endtag, self.handle_data = tree.end, tree.text

    def handle_starttag(self, tag, attrs):
        self.tree.start(tag, {k: v or "" for k, v in attrs})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.tree.at = self.tree.at.parent


# Elements whose content `html.parser` doesn't read as markup.
RAW = frozenset("iframe noembed noframes noscript plaintext script style textarea title xmp".split())
#: Markup that every reader of HTML reads in one way: texts, end tags, and start tags with lower-case names and quoted values.
_PIECE = r'''([^<]++)|</([a-z][a-z0-9]*+)>|<([a-z][a-z0-9]*+)((?: [a-z][a-z-]*+="[^"<>&]*+(?:&(?:amp|lt|gt|quot);[^"<>&]*+)*+")*+)>'''
_PIECES, _PLAIN = re.compile(_PIECE), re.compile(f"(?:{re.sub(r'[(](?![?])', '(?:', _PIECE)})*+")
_ATTR = re.compile(r' ([a-z-]+)="([^"]*)"')


def _plain(html: str) -> _Tree | None:
    """The tree of a page that holds nothing but plain markup, as `html.parser` would give it, in a fraction of its time; null for any other."""
    if not _PLAIN.fullmatch(html):
        return None
    tree = _Tree()
    add = tree.nodes.append
    for text, end, tag, attrs in _PIECES.findall(html):
        at = tree.at
        if text:
            tree.text(unescape(text) if "&" in text else text)
        elif end:
            if at.name == end:
                tree.at = at.parent
            else:
                tree.end(end)
        elif tag in RAW:
            return None
        else:
            given = {k: unescape(v) if "&" in v else v for k, v in _ATTR.findall(attrs)} if attrs else {}
            if tag in ENDS:
                tree.start(tag, given)
                continue
            node = Node(tag, given, at)
            at.children.append(node)
            add(node)
            if tag not in VOID:
                tree.at = node
    return tree


#: Characters that are parsed between two looks at the time.
STEP = 1 << 16


# Elements whose text isn't shown, and those that stand on lines of their own.
HIDDEN = frozenset("head script style noscript template title".split())
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody tfoot thead tr ul".split())


def shown_text(root: Node) -> str:
    """A page's text about as a reader sees it: blocks on lines of their own, a row's cells beside each other, blanks as one."""
    out: list[str] = []
    stack: list[Node | str] = [root]
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            out.append(c if c in ("\n", "\t") else re.sub("[ \t\n\r\f]+", " ", c))
        elif c.name not in HIDDEN:
            around = "\n" if c.name in BLOCKS else "\t" if c.name in ("td", "th") else ""
            stack += [around] * bool(around) + list(reversed(c.children)) + [around] * (around == "\n")
    lines = (line.strip(WHITE) for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)


def parse(html: str, tick: Callable[[], None] = lambda: None) -> Node:
    """The page's tree; of a page that breaks off in broken markup, what stands before. `tick` is called again and again."""
    if len(html) <= STEP:
        tick()
        if (tree := _plain(html)) is not None:
            return tree.indexed()
    tree = _Tree()
    builder = _Builder(tree)
    try:
        for at in range(0, len(html), STEP):
            tick()
            builder.feed(html[at : at + STEP])
        builder.close()
    except AssertionError:
        pass
    return tree.indexed()


_SIMPLE = re.compile(r"(?P<name>[a-z][a-z0-9]*)|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[(?P<attr>[\w-]+)(?P<op>[*^]?=)\"?(?P<val>[^\]\"]*)\"?\]|:not\((?P<no>[^)]*)\)", re.IGNORECASE)


@cache
def _chains(selector: str) -> tuple:
    """Alternatives of a selector; each is its steps from the last, with how they hang together."""
    out = []
    for part in selector.split(","):
        steps, how = [], " "
        for word in part.replace(">", " > ").split():
            if word == ">":
                how = ">"
            else:
                steps.append((how, tuple((m.lastgroup if m["attr"] is None else "attr", m) for m in _SIMPLE.finditer(word))))
                how = " "
        out.append(tuple(reversed(steps)))
    return tuple(out)


def _is(node: Node, tests: tuple) -> bool:
    for kind, m in tests:
        if kind == "name":
            ok = node.name == m["name"].lower()
        elif kind == "cls":
            ok = m["cls"] in node.classes
        elif kind == "id":
            ok = node.attrs.get("id") == m["id"]
        elif kind == "no":
            ok = not matches(node, m["no"])
        else:
            have = node.attrs.get(m["attr"])
            ok = have is not None and {"=": have == m["val"], "*=": m["val"] in have, "^=": have.startswith(m["val"])}[m["op"]]
        if not ok:
            return False
    return True


def _fits(node: Node | None, chain: tuple) -> bool:
    if not node or not node.name or not _is(node, chain[0][1]):
        return False
    if len(chain) == 1:
        return True
    up = node.parent
    if chain[0][0] == ">":
        return _fits(up, chain[1:])
    while up:
        if _fits(up, chain[1:]):
            return True
        up = up.parent
    return False


def matches(node: Node, selector: str) -> bool:
    return any(_fits(node, chain) for chain in _chains(selector))


@cache
def _lists(selector: str) -> tuple[tuple[str, tuple, bool], ...]:
    """For each alternative, the list that holds all elements that can match it, the alternative, and whether all in the list do."""
    out = []
    for chain in _chains(selector):
        named = {kind: m for kind, m in chain[0][1] if kind in ("id", "cls", "name")}
        kind = next((k for k in ("id", "cls", "name") if k in named), "")
        key = {"id": "#", "cls": ".", "name": "", "": ""}[kind] + (named[kind][kind] if kind else "")
        out.append((key if key[:1] in ("#", ".") else key.lower(), chain, len(chain) == 1 and len(chain[0][1]) == 1 and bool(kind)))
    return tuple(out)


_ORDER = attrgetter("order")


def select(node: Node, selector: str) -> list[Node]:
    """Elements below `node` that match, in the order of the page."""
    found: list[list[Node]] = []
    for key, chain, sure in _lists(selector):
        listed = node.index.get(key, ())
        low = bisect_left(listed, node.order + 1, key=_ORDER)
        below = listed[low : bisect_left(listed, node.end, low, key=_ORDER)]
        found.append([*below] if sure else [e for e in below if _fits(e, chain)])
    return found[0] if len(found) == 1 else sorted({e.order: e for some in found for e in some}.values(), key=_ORDER)


def first(node: Node | None, selector: str) -> Node | None:
    return next(iter(select(node, selector)), None) if node else None
