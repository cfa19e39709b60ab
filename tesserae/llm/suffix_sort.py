"""Deep-shallow suffix sorting of byte strings, with longest common prefixes.

Multikey quicksort orders the suffixes on eight-byte words down to a shallow depth.  Groups that
still agree there would make it compare the same long prefixes again and again; each is instead
put into a blind (Patricia) trie, where an insertion walks the trie on single bytes, compares one
whole suffix, and branches where they part.  Reading the leaves in order gives the sorted group and
its common prefixes.
"""

from __future__ import annotations

import random

SHALLOW = 32
WORD = 8


def lcp(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of two strings that agree on their first ``at`` bytes."""
    n = min(len(a), len(b))
    x, y = a[at:n], b[at:n]
    if x == y:
        return n
    d = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (d.bit_length() + 7) // 8


class _Node:
    __slots__ = ("depth", "kids")

    def __init__(self, depth: int):
        self.depth = depth
        self.kids: dict[int, _Node | list[int]] = {}


def _byte(s: bytes, i: int) -> int:
    return s[i] if i < len(s) else -1


def blind_trie(strings: list[bytes], group: list[int], depth: int) -> tuple[list[int], list[int]]:
    """Sorts the members of ``group``, which agree on their first ``depth`` bytes; also the lcp of each with the one before (the first: ``depth``)."""
    root: _Node | list[int] = [group[0]]
    for i in group[1:]:
        s = strings[i]
        node = root
        while isinstance(node, _Node):  # blind: only the branching bytes are looked at
            node = node.kids.get(_byte(s, node.depth)) or next(iter(node.kids.values()))
        other = strings[node[0]]
        n = lcp(s, other, depth)
        if n == len(s) == len(other):
            node.append(i)
            continue
        above, key, node = None, 0, root
        while isinstance(node, _Node) and node.depth < n:
            key = _byte(s, node.depth)
            above, node = node, node.kids[key]
        if isinstance(node, _Node) and node.depth == n:
            node.kids[_byte(s, n)] = [i]
            continue
        new = _Node(n)
        new.kids[_byte(other, n)] = node
        new.kids[_byte(s, n)] = [i]
        if above is None:
            root = new
        else:
            above.kids[key] = new
    order: list[int] = []
    common: list[int] = []
    stack: list[tuple[_Node | list[int], int]] = [(root, depth)]
    while stack:
        node, with_before = stack.pop()
        if isinstance(node, _Node):
            kids = sorted(node.kids.items(), reverse=True)
            stack += [(k, node.depth) for _, k in kids[:-1]]
            stack.append((kids[-1][1], with_before))
        else:
            order += node
            common += [with_before] + [len(strings[node[0]])] * (len(node) - 1)
    return order, common


def sort(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """The order of ``strings``, which agree on their first ``depth`` bytes, and the lcp of each with the one before it (the first: 0).

    The groups still to be partitioned wait on a stack of our own and pivots are drawn at random, so
    no order of the input makes it deep or slow.
    """
    order: list[int] = []
    common: list[int] = []
    draw = random.Random(len(strings))
    stack = [(list(range(len(strings))), depth)] if strings else []
    while stack:
        group, d = stack.pop()
        if len(group) > 1 and d < depth + shallow:
            stack += _partition(strings, group, d, depth + shallow, draw)
            continue
        sorted_, shared = blind_trie(strings, group, min(d, min(len(strings[i]) for i in group)))
        shared[0] = lcp(strings[order[-1]], strings[sorted_[0]], depth) if order else 0
        order += sorted_
        common += shared
    return order, common


def _partition(strings: list[bytes], group: list[int], d: int, end: int, draw: random.Random) -> list[tuple[list[int], int]]:
    """One step of multikey quicksort on the word at ``d``: the larger, equal and smaller members, each with the depth to go on at."""
    # a shorter string sorts before its extensions, and one that ends inside a word equals its whole group
    words = [strings[i][d : d + WORD] for i in group]
    pivot = sorted(draw.choices(words, k=3))[1]
    more = [i for i, w in zip(group, words) if w > pivot]
    same = [i for i, w in zip(group, words) if w == pivot]
    less = [i for i, w in zip(group, words) if w < pivot]
    return [(g, t) for g, t in ((more, d), (same, d + WORD if len(pivot) == WORD else end), (less, d)) if g]
