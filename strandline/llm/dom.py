"""A small tolerant HTML tree: tags, classes and texts, enough to align pages and to collect their blocks."""

from __future__ import annotations

import html
import re

#: A comment, a declaration, or a tag; quoted attribute values may hold ">".
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
NAME = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp svg".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag closes open elements with these names, up to the nearest of the second set.
CLOSES = {"li": ("li", {"ul", "ol"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
SCOPE = frozenset("article aside body div dd details figure footer form header html li main nav section table td th blockquote".split())


class Node:
    __slots__ = ("tag", "name", "children", "key")

    def __init__(self, tag: str, name: str = ""):
        self.tag, self.name, self.children = tag, name, []
        self.key = f"{tag}.{name}" if name else tag


class _Open:
    """The elements that are open, and how many of each name, so that a stray end tag costs nothing however deep the tree."""

    def __init__(self, root: Node):
        self.nodes, self.number = [root], {}

    def push(self, node: Node) -> None:
        self.nodes.append(node)
        self.number[node.tag] = self.number.get(node.tag, 0) + 1

    def close(self, names: list[str], limits: frozenset[str] | set[str] = frozenset()) -> bool:
        """Ends the innermost element of one of the names, and all in it, unless one of ``limits`` stands between."""
        if not any(self.number.get(n) for n in names):
            return False
        for i in range(len(self.nodes) - 1, 0, -1):
            tag = self.nodes[i].tag
            if tag in names:
                for node in self.nodes[i:]:
                    self.number[node.tag] -= 1
                del self.nodes[i:]
                return True
            if tag in limits:
                return False
        return False


def parse(source: str | None) -> Node:
    """The tree under a root named ``#``; texts are str children. Unclosed and stray tags are repaired; an unclosed raw element runs to the end. Depth has no limit."""
    root = Node("#")
    up, at, text = _Open(root), 0, source or ""
    while True:
        m = MARKUP.search(text, at)
        if m is None:
            if at < len(text):
                up.nodes[-1].children.append(text[at:])
            return root
        if m.start() > at:
            up.nodes[-1].children.append(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            up.close([tag])
            continue
        if tag in BLOCK:
            up.close(["p"], SCOPE)
        if tag in CLOSES:
            names, limits = CLOSES[tag]
            while up.close(names.split(), limits) and tag == "tr":
                pass
        node = Node(tag, " ".join(v.strip("\"'").lower() for _, v in NAME.findall(m[3])) if m[3] else "")
        up.nodes[-1].children.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}\\s*>", re.I).search(text, at)
            node.children.append(text[at : end.start() if end else len(text)])
            at = end.end() if end else len(text)
        elif tag not in VOID and not m[3].endswith("/"):
            up.push(node)


SPACES = re.compile(r"\s+")


def decoded(text: str) -> str:
    return html.unescape(text) if "&" in text else text


def squeezed(text: str) -> str:
    return SPACES.sub(" ", text).strip()
