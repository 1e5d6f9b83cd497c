"""An adaptive radix tree over byte strings: resizable node layouts and path compression."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

#: Children that a node of each layout holds: sorted bytes (4, 16), an index of 256 slots (48), direct slots (256).
LAYOUTS = (4, 16, 48, 256)


class Node:
    """A compressed path, the value of the key that ends behind it, and children by their next byte."""

    __slots__ = ("path", "value", "layout", "keys", "children", "size")

    def __init__(self, path: bytes, value: Any = None) -> None:
        self.path = path
        self.value = value
        self.layout = 4
        self.keys: Any = bytearray()
        self.children: list = []
        self.size = 0

    def find(self, byte: int) -> Node | None:
        if self.layout <= 16:
            at = self.keys.find(byte)
            return self.children[at] if at >= 0 else None
        if self.layout == 48:
            at = self.keys[byte]
            return self.children[at] if at != 255 else None
        return self.children[byte]

    def put(self, byte: int, child: Node) -> None:
        """Add a child, or put another in its place; a full node takes the next layout first."""
        if self.find(byte) is not None:
            if self.layout <= 16:
                self.children[self.keys.index(byte)] = child
            else:
                self.children[self.keys[byte] if self.layout == 48 else byte] = child
            return
        if self.size == self.layout:
            self._grow()
        if self.layout <= 16:
            at = 0
            while at < self.size and self.keys[at] < byte:
                at += 1
            self.keys.insert(at, byte)
            self.children.insert(at, child)
        elif self.layout == 48:
            self.keys[byte] = self.size
            self.children.append(child)
        else:
            self.children[byte] = child
        self.size += 1

    def _grow(self) -> None:
        found = list(self.items())
        self.layout = LAYOUTS[LAYOUTS.index(self.layout) + 1]
        if self.layout == 48:
            self.keys, self.children = bytearray(b"\xff" * 256), []
            for at, (byte, child) in enumerate(found):
                self.keys[byte] = at
                self.children.append(child)
        elif self.layout == 256:
            self.keys, self.children = None, [None] * 256
            for byte, child in found:
                self.children[byte] = child

    def items(self) -> Iterator[tuple[int, Node]]:
        """Children in the order of their bytes."""
        if self.layout <= 16:
            yield from zip(self.keys, self.children)
        elif self.layout == 48:
            yield from ((byte, self.children[at]) for byte, at in enumerate(self.keys) if at != 255)
        else:
            yield from ((byte, child) for byte, child in enumerate(self.children) if child is not None)


def _common(path: bytes, key: bytes, at: int) -> int:
    """How many bytes of ``path`` the key holds from ``at`` on."""
    if key.startswith(path, at):
        return len(path)
    low, high = 0, min(len(path), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if key.startswith(path[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


class RadixTree:
    """Byte strings and their values; a key may be the beginning of another."""

    def __init__(self) -> None:
        self.root: Node | None = None

    def insert(self, key: bytes, value: Any) -> None:
        """Put a value (not None) at a key that is new."""
        if self.root is None:
            self.root = Node(key, value)
            return
        parent, byte, node, at = None, 0, self.root, 0
        while True:
            common = _common(node.path, key, at)
            if common < len(node.path):
                # The key leaves the compressed path, which is split there.
                upper = Node(node.path[:common])
                upper.put(node.path[common], node)
                node.path = node.path[common + 1 :]
                if parent is None:
                    self.root = upper
                else:
                    parent.put(byte, upper)
                node = upper
            at += common
            if at == len(key):
                node.value = value
                return
            child = node.find(key[at])
            if child is None:
                node.put(key[at], Node(key[at + 1 :], value))
                return
            parent, byte, node, at = node, key[at], child, at + 1

    def walk(self) -> Iterator[tuple[bool, int, bytes, Node]]:
        """Nodes in the order of their keys, each twice: (entered, bytes above it, its own bytes, node).

        The own bytes are the byte that leads to the node and its compressed path.
        """
        if self.root is None:
            return
        stack = [(0, self.root.path, self.root, None)]
        yield True, 0, self.root.path, self.root
        stack[0] = (0, self.root.path, self.root, self.root.items())
        while stack:
            above, own, node, children = stack[-1]
            following = next(children, None)
            if following is None:
                yield False, above, own, node
                stack.pop()
                continue
            byte, child = following
            below = above + len(own)
            mine = bytes([byte]) + child.path
            yield True, below, mine, child
            stack.append((below, mine, child, child.items()))
