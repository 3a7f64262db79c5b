"""Trees: Newick text, and a small node type for computations on the driver or inside grouped functions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field


@dataclass(eq=False)
class Node:
    name: str | None = None
    length: float | None = None
    children: list[Node] = field(default_factory=list)
    support: float | None = None

    def postorder(self) -> Iterator[Node]:
        order, todo = [], [self]
        while todo:
            node = todo.pop()
            order.append(node)
            todo += node.children
        return reversed(order)

    def tips(self) -> list[Node]:
        return [n for n in self.postorder() if not n.children]

    def names(self) -> list[str]:
        return [n.name for n in self.tips()]

    def copy(self) -> Node:
        return Node(self.name, self.length, [c.copy() for c in self.children], self.support)


TOKEN = re.compile(r"\s*('(?:[^']|'')*'|[(),:;]|[^\s(),:;\[\]']+|\[[^\]]*\])")


def parse(text: str) -> Node:
    """A tree; an inner node's label is its support if it is a number, else its name."""
    tokens = [t for t in TOKEN.findall(text) if t[0] != "["]
    if not tokens or tokens[-1] != ";":
        raise ValueError("a tree ends with a semicolon")
    out = node = Node()
    open_, complete = [], False  # the inner nodes around `node`; whether its children and label stand
    at = 0
    while tokens[at] != ";":
        token = tokens[at]
        if token == "(":
            if complete:
                raise ValueError(f"expected no ( at token {at}")
            open_.append(node)
            node = Node()
            open_[-1].children.append(node)
        elif token == ",":
            if not open_:
                raise ValueError(f"expected no , at token {at}")
            node, complete = Node(), False
            open_[-1].children.append(node)
        elif token == ")":
            if not open_:
                raise ValueError(f"expected no ) at token {at}")
            node, complete = open_.pop(), True
        elif token == ":":
            at += 1
            node.length, complete = float(tokens[at]), True
        else:
            label = token[1:-1].replace("''", "'") if token[0] == "'" else token
            try:
                node.support = float(label) if node.children else None
            except ValueError:
                pass
            if node.support is None:
                node.name = label
            complete = True
        at += 1
    if open_ or at < len(tokens) - 1:
        raise ValueError(f"expected ) at token {at}" if open_ else f"expected the end at token {at}")
    return out


def write(node: Node) -> str:
    def part(n: Node) -> str:
        label = n.name if n.name is not None else "" if n.support is None else f"{n.support:g}"
        if re.search(r"[\s(),:;\[\]']", label):
            label = "'" + label.replace("'", "''") + "'"
        inner = f"({','.join(map(part, n.children))})" if n.children else ""
        return inner + label + ("" if n.length is None else f":{n.length!r}")

    return part(node) + ";"


def rows(tree_id: str, tree: Node) -> list[tuple]:
    """(tree_id, node_id, parent_id, name, length, support) of each node; the root comes last."""
    ids = {id(n): k for k, n in enumerate(tree.postorder())}
    parent = {id(c): ids[id(n)] for n in tree.postorder() for c in n.children}
    return [(tree_id, ids[id(n)], parent.get(id(n)), n.name, n.length, n.support) for n in tree.postorder()]


def pruned(tree: Node, keep: set[str]) -> Node | None:
    """The tree on the named tips. Nodes with one child give way to it, and lengths add up."""
    if not tree.children:
        return Node(tree.name, tree.length) if tree.name in keep else None
    children = [c for c in (pruned(c, keep) for c in tree.children) if c]
    if not children:
        return None
    if len(children) == 1:
        only = children[0]
        if only.length is not None or tree.length is not None:
            only.length = (only.length or 0.0) + (tree.length or 0.0)
        return only
    return Node(tree.name, tree.length, children, tree.support)


def rooted_at(tree: Node, outgroup: str) -> Node:
    """The tree with the outgroup's parent as root: its edges up to the old root are turned round."""
    up = {id(c): n for n in tree.postorder() for c in n.children}
    tip = next(n for n in tree.tips() if n.name == outgroup)
    path, node = [], up.get(id(tip), tip)
    while node is not None:
        path.append(node)
        node = up.get(id(node))
    root = Node(path[0].name, None, list(path[0].children))
    last, below = path[0], root
    for node in path[1:]:
        turned = Node(node.name, last.length, [c for c in node.children if c is not last], last.support)
        below.children = [*below.children, turned]
        last, below = node, turned
    if len(below.children) == 1 and below is not root:  # the old root had two children
        only = below.children[0]
        only.length = (only.length or 0.0) + (below.length or 0.0)
        for n in root.postorder():
            n.children = [only if c is below else c for c in n.children]
    return root


def ordered(tree: Node) -> Node:
    """Children by number of tips, then by the names of their tips, in their own order, joined."""
    tree.children = sorted(map(ordered, tree.children), key=lambda c: (len(c.tips()), "".join(c.names())))
    return tree
