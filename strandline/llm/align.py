"""Simple tree matching of two pages' block trees, in memory that grows with their length and not with its square.

Matching goes from the roots down: a node's children are matched with those of its partner, in order, and only partners' children are compared. Lists
of children are matched in three rounds: first those whose whole subtrees are equal, then, between these, those of equal name and shape, then those of
equal name. Each round takes a longest common subsequence, from bit vectors.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Bits of the table of one comparison; beyond it the longer list is split in halves.
TABLE_BITS = 1 << 27
#: The name of a line of text, which is a leaf.
LINE = 0


def digest(text: str) -> int:
    """A signed 64-bit hash."""
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >= 1 << 63 else h


class Tree:
    """Nodes in document order: depth, name and content (a hash; of a line its text, of a block its name and its children's content)."""

    def __init__(self):
        self.depth: list[int] = []
        self.name: list[int] = []
        self.content: list[int] = []

    def add(self, depth: int, name: int, content: int = 0) -> int:
        self.depth.append(depth)
        self.name.append(name)
        self.content.append(content)
        return len(self.depth) - 1

    def link(self) -> None:
        """Finds children, paths and content from depths and names. Node 0 is the root."""
        n = len(self.depth)
        self.children: list[list[int]] = [[] for _ in range(n)]
        self.path = [0] * n
        open_: list[int] = []
        for i in range(n):
            del open_[self.depth[i] :]
            if open_:
                self.children[open_[-1]].append(i)
                self.path[i] = hash((self.path[open_[-1]], self.name[i]))
            open_.append(i)
        self.shape = [0] * n
        for i in range(n - 1, -1, -1):
            if self.name[i] != LINE or not i:
                below = self.children[i]
                self.content[i] = hash((self.name[i], *(self.content[c] for c in below)))
                self.shape[i] = hash((self.name[i], frozenset(self.name[c] for c in below)))

    def pack(self) -> bytes:
        return np.array([self.depth, self.name, self.content], "<i8").tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Tree:
        tree = cls()
        tree.depth, tree.name, tree.content = np.frombuffer(data, "<i8").reshape(3, -1).tolist()
        tree.link()
        return tree

    def lines(self) -> list[int]:
        return [i for i, name in enumerate(self.name) if name == LINE and i]


class Trees(dict):
    """Trees by their packed bytes, remembered up to a number of bytes."""

    def __init__(self, most: int = 1 << 20):
        super().__init__()
        self.most, self.held = most, 0

    def __missing__(self, data: bytes) -> Tree:
        if self.held + len(data) > self.most:
            self.clear()
            self.held = 0
        self.held += len(data)
        tree = self[data] = Tree.unpack(data)
        return tree


def _rows(a: list, b: list) -> list[int]:
    """For each prefix of ``a`` the bit vector whose zeros among the first j bits count the common subsequence with ``b[:j]``."""
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, [full]
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows


def _lengths(a: list, b: list) -> np.ndarray:
    """The length of the common subsequence of ``a`` with each prefix of ``b``."""
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence, ascending."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            found.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            found.append((i1, j1))
        shared = set(a[i0:i1]) & set(b[j0:j1])
        x, y = [i for i in range(i0, i1) if a[i] in shared], [j for j in range(j0, j1) if b[j] in shared]
        if not x or not y:
            continue
        p, q = [a[i] for i in x], [b[j] for j in y]
        if len(p) * len(q) > TABLE_BITS and len(p) > 1:
            half = len(p) // 2
            cut = int((_lengths(p[:half], q) + _lengths(p[half:][::-1], q[::-1])[::-1]).argmax())
            todo += [(i0, x[half], j0, y[cut] if cut < len(y) else j1), (x[half], i1, y[cut] if cut < len(y) else j1, j1)]
            continue
        rows, i, j = _rows(p, q), len(p), len(q)
        while i and j:
            if p[i - 1] == q[j - 1]:
                i, j = i - 1, j - 1
                found.append((x[i], y[j]))
            elif rows[i] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
    return sorted(found)


def _gaps(pairs: list[tuple[int, int]], n: int, m: int):
    """The places between pairs: (from, to, from, to)."""
    i = j = 0
    for a, b in [*pairs, (n, m)]:
        if a > i and b > j:
            yield i, a, j, b
        i, j = a + 1, b + 1


def matched(base: Tree, page: Tree) -> list[int]:
    """For each node of ``page`` its partner in ``base``, or -1."""
    partner = [-1] * len(page.depth)
    todo = [(0, 0)] if base.depth and page.depth else []
    while todo:
        a, b = todo.pop()
        partner[b] = a
        x, y = base.children[a], page.children[b]
        pairs: list[tuple[int, int]] = []
        for kind in ("content", "shape", "name"):
            left, right = getattr(base, kind), getattr(page, kind)
            new = []
            for i0, i1, j0, j1 in _gaps(pairs, len(x), len(y)):
                new += [(i0 + i, j0 + j) for i, j in common([(base.name[c], left[c]) for c in x[i0:i1]], [(page.name[c], right[c]) for c in y[j0:j1]])]
            if new:
                pairs = sorted(pairs + new)
        todo += [(x[i], y[j]) for i, j in pairs]
    return partner


def line_keys(base: Tree | None, page: Tree) -> list[int]:
    """For each line of ``page`` a hash of its text and of its place: the node of ``base`` that it matches, or where there is none, its path."""
    partner = matched(base, page) if base is not None else [-1] * len(page.depth)
    return [hash((1, partner[i], page.content[i]) if partner[i] >= 0 else (0, page.path[i], page.content[i])) for i in page.lines()]
