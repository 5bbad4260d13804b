"""Runs (maximal periodic stretches) of a sequence by the method of Gusfield and Stoye.

A suffix tree gives the Lempel-Ziv blocks.  Every square whose leftmost occurrence is
there ends in the block after the one that holds its middle, at most: from the two
borders of each block, extensions both ways give squares that cover all leftmost
occurrences.  Each of them is looked up in the suffix tree, and from there suffix links
walk to its rotations as long as the tree holds them: the vocabulary of squares.  The
leaves below a square are its occurrences, and neighbouring ones of one half length
merge into runs.  Only squares of primitive halves are followed, so that their
occurrences are O(n log n).
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np


class SuffixTree:
    """Ukkonen's tree of a list of integers, with an end mark that equals none of them.

    Node 0 is the root.  The edge into node v reads text[start[v]:end[v]], depth[v] is the
    length down to v, link[v] the suffix link of an inner node, low[v] the leftmost
    suffix below v; leaves[first[v]:last[v]] are all suffixes below it.
    """

    def __init__(self, text: list[int]):
        self.text = text = [*text, -1]
        n = len(text)
        self.start, self.end, self.link, self.kids = [0], [0], [0], [{}]
        start, end, link, kids = self.start, self.end, self.link, self.kids
        node, edge, length, left = 0, 0, 0, 0  # the active point, and suffixes yet to be put in
        for i, c in enumerate(text):
            left += 1
            above = 0
            while left:
                if not length:
                    edge = i
                below = kids[node].get(text[edge])
                if below is None:
                    kids[node][text[edge]] = len(start)
                    start.append(i), end.append(n), link.append(0), kids.append({})
                    if above:
                        link[above] = node
                    above = node
                else:
                    size = (end[below] if end[below] <= i else i + 1) - start[below]
                    if length >= size:
                        node, edge, length = below, edge + size, length - size
                        continue
                    if text[start[below] + length] == c:
                        if above:
                            link[above] = node
                        length += 1
                        break
                    middle = len(start)
                    start.append(start[below]), end.append(start[below] + length), link.append(0)
                    start[below] += length
                    kids.append({text[start[below]]: below, c: middle + 1})
                    kids[node][text[edge]] = middle
                    start.append(i), end.append(n), link.append(0), kids.append({})
                    if above:
                        link[above] = middle
                    above = middle
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - left + 1
        self._measure(n)

    def _measure(self, n: int) -> None:
        count = len(self.start)
        self.parent, self.depth = [0] * count, [0] * count
        self.low, self.first, self.last = [n] * count, [0] * count, [0] * count
        self.leaves, self.leaf_of = [], [0] * n
        start, end, kids, parent, depth, low = self.start, self.end, self.kids, self.parent, self.depth, self.low
        order, todo = [], [0]
        while todo:
            v = todo.pop()
            order.append(v)
            self.first[v] = len(self.leaves)
            if kids[v]:
                for u in kids[v].values():
                    parent[u], depth[u] = v, depth[v] + end[u] - start[u]
                    todo.append(u)
            elif v:
                low[v] = n - depth[v]
                self.leaf_of[low[v]] = v
                self.leaves.append(low[v])
        for v in reversed(order):
            self.last[v] = self.last[v] or self.first[v] + 1
            p = parent[v]
            self.last[p] = max(self.last[p], self.last[v])
            low[p] = min(low[p], low[v])

    def blocks(self) -> list[int]:
        """Borders of the Lempel-Ziv blocks: each is the longest stretch that also begins further left, or one element."""
        at, n, borders = 0, len(self.text) - 1, [0]
        while at < n:
            v = self.parent[self.leaf_of[at]]
            while self.low[v] == at and v:
                v = self.parent[v]
            at += max(1, min(self.depth[v], n - at))
            borders.append(at)
        return borders

    def locate(self, at: int, length: int) -> int:
        """The node at or right below the end of text[at:at + length]."""
        v = self.leaf_of[at]
        while self.depth[self.parent[v]] >= length:
            v = self.parent[v]
        return v

    def rotated(self, v: int, length: int) -> int | None:
        """The node of the square at (v, length) without its first element and with it at the end; None if the tree lacks it."""
        text, depth, start = self.text, self.depth, self.start
        i = self.low[v]
        up = self.parent[v]
        node = self.link[up] if up else 0
        # Everything but the first element is in the tree: whole edges are skipped.
        while depth[node] < length - 1:
            node = self.kids[node][text[i + 1 + depth[node]]]
        if depth[node] == length - 1:
            return self.kids[node].get(text[i])
        over = depth[node] - (length - 1)
        return node if text[self.end[node] - over] == text[i] else None


def matches(pattern: list[int], text: list[int]) -> list[int]:
    """For every place of text, how far it agrees with pattern from its beginning (Z algorithm)."""
    s = [*pattern, -2, *text]
    n, z = len(s), [0] * len(s)
    lo = hi = 0
    for i in range(1, n):
        k = min(hi - i, z[i - lo]) if i < hi else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return z[len(pattern) + 1 :]


def leftmost_squares(text: list[int], borders: list[int]) -> set[tuple[int, int]]:
    """(start, half) of squares with primitive halves: every square's leftmost occurrence lies in a row of rotations that begins at one of them."""
    found = set()

    def take(pairs) -> None:
        # A half that is a power lies in the longer stretch of its root's period, which the same border met before.
        roots = []
        for k, lo, hi, at in pairs:
            if not any(k % d == 0 and a <= at and at + 2 * k <= b for d, a, b in roots):
                roots.append((k, lo, hi))
                found.add((at, k))

    for b in range(len(borders) - 1):
        h, h1 = borders[b], borders[b + 1]
        h2 = borders[b + 2] if b + 2 < len(borders) else h1
        size, both = h1 - h, h2 - h
        if h1 < len(text):
            ahead = matches(text[h1 : h1 + size], text[h : h1 + size])
            behind = text[max(0, h1 - 2 * size) : h1][::-1]
            back = matches(behind, behind[1:])
            pairs = []
            for k in range(1, size + 1):
                f, r = ahead[size - k], back[k - 1] if k <= len(back) else 0
                if f and f + r >= k:
                    pairs.append((k, h1 - k - r, h1 + f, max(h1 - k - r, h1 - 2 * k + 1)))
            take(pairs)
        if h:
            here = text[h : h + 2 * both]
            ahead = matches(here, here[1:])
            back = matches(text[max(0, h - both) : h][::-1], text[max(0, h - both) : h + both][::-1])
            pairs, most = [], min(both, len(text) - h - 1)
            for k in range(1, most + 1):
                # back is read from the end of its text: place of text[h + k - 1].
                f, r = ahead[k - 1], back[min(h + both, len(text)) - h - k]
                if f and r and f + r >= k:
                    at = max(h - r, h - k + 1)
                    if at + k <= h1:
                        pairs.append((k, h - r, h + k + f, at))
            take(pairs)
    return found


def runs(ids: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs: longest stretches with a smallest period of at most half their length."""
    if len(ids) < 2:
        return []
    tree = SuffixTree(ids)
    marked: set[tuple[int, int]] = set()
    for at, half in leftmost_squares(ids, tree.blocks()):
        v = tree.locate(at, 2 * half)
        while v is not None and (v, half) not in marked:
            marked.add((v, half))
            v = tree.rotated(v, 2 * half)
    places = defaultdict(list)
    for v, half in marked:
        places[half].append(v)
    out = []
    for half, nodes in places.items():
        starts = np.sort(np.concatenate([np.asarray(tree.leaves[tree.first[v] : tree.last[v]]) for v in nodes]))
        breaks = np.flatnonzero(np.diff(starts) > 1)
        for a, z in zip(starts[np.r_[0, breaks + 1]], starts[np.r_[breaks, len(starts) - 1]]):
            out.append((int(a), int(z - a) + 2 * half, half))
    return sorted(out)
