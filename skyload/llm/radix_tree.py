"""An adaptive radix tree over byte strings, with node layouts that grow and compressed paths."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class Sorted:
    """Up to four, then up to sixteen children: their bytes in order beside the children."""

    __slots__ = ("signs", "children", "most")

    def __init__(self) -> None:
        self.signs, self.children, self.most = bytearray(), [], 4

    def find(self, sign: int) -> Node | None:
        at = self.signs.find(sign)
        return None if at < 0 else self.children[at]

    def put(self, sign: int, child: Node) -> Sorted | Indexed:
        at = bisect_left(self.signs, sign)
        if at < len(self.signs) and self.signs[at] == sign:
            self.children[at] = child
            return self
        if len(self.signs) == self.most:
            if self.most == 16:
                return Indexed(self).put(sign, child)
            self.most = 16
        self.signs.insert(at, sign)
        self.children.insert(at, child)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.signs, self.children)


class Indexed:
    """Up to 48 children: 256 byte-wide places, each naming a child."""

    __slots__ = ("places", "children")

    def __init__(self, smaller: Sorted) -> None:
        self.places, self.children = bytearray(256), [None]  # place 0: no child
        for sign, child in smaller.items():
            self.places[sign] = len(self.children)
            self.children.append(child)

    def find(self, sign: int) -> Node | None:
        return self.children[self.places[sign]]

    def put(self, sign: int, child: Node) -> Indexed | Full:
        if self.places[sign]:
            self.children[self.places[sign]] = child
        elif len(self.children) > 48:
            return Full(self).put(sign, child)
        else:
            self.places[sign] = len(self.children)
            self.children.append(child)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((sign, self.children[place]) for sign, place in enumerate(self.places) if place)


class Full:
    """One place for each of the 256 bytes."""

    __slots__ = ("children",)

    def __init__(self, smaller: Indexed) -> None:
        self.children: list[Node | None] = [None] * 256
        for sign, child in smaller.items():
            self.children[sign] = child

    def find(self, sign: int) -> Node | None:
        return self.children[sign]

    def put(self, sign: int, child: Node) -> Full:
        self.children[sign] = child
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((sign, child) for sign, child in enumerate(self.children) if child is not None)


class Node:
    """The end of a compressed path: byte depths ``top`` (excluded) to ``bottom`` of ``key``, and the values of keys that end here."""

    __slots__ = ("key", "top", "bottom", "values", "branches", "kept")

    def __init__(self, key: bytes, top: int, bottom: int) -> None:
        self.key, self.top, self.bottom = key, top, bottom
        self.values: list = []
        self.branches: Sorted | Indexed | Full = Sorted()
        self.kept: object = None  # for those who walk the tree


def common(a: bytes, b: bytes, start: int, end: int) -> int:
    """The first place from ``start`` on where two byte strings differ, ``end`` if there is none before it."""
    if a[start:end] == b[start:end]:
        return end
    while end - start > 1:
        middle = (start + end) // 2
        if a[start:middle] == b[start:middle]:
            start = middle
        else:
            end = middle
    return start


class Tree:
    def __init__(self) -> None:
        self.root = Node(b"", 0, 0)

    def insert(self, key: bytes, value: object) -> None:
        node = self.root
        while True:
            if len(key) == node.bottom:
                node.values.append(value)
                return
            child = node.branches.find(key[node.bottom])
            if child is None:
                leaf = Node(key, node.bottom, len(key))
                leaf.values.append(value)
                node.branches = node.branches.put(key[node.bottom], leaf)
                return
            end = min(child.bottom, len(key))
            same = common(key, child.key, child.top, end)
            if same < child.bottom:
                upper = Node(child.key, child.top, same)
                child.top = same
                upper.branches = upper.branches.put(child.key[same], child)
                node.branches = node.branches.put(key[node.bottom], upper)
                child = upper
            node = child

    def reach(self, key: bytes, depth: int) -> Node:
        """The node on whose path byte ``depth`` of a stored key lies."""
        node = self.root
        while node.bottom < depth:
            node = node.branches.find(key[node.bottom])
        return node

    def downward(self) -> list[tuple[Node, Node | None]]:
        """All nodes with their parents, parents before children; reversed, children come before parents."""
        order: list[tuple[Node, Node | None]] = [(self.root, None)]
        for node, _ in order:
            order.extend((child, node) for _, child in node.branches.items())
        return order
